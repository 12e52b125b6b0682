"""Scratch tables: only on shared storage, and gone once nothing reads them."""

import gc
import os
import time
from types import SimpleNamespace

import pytest

from gnomon import runtime


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.local_root("spark://host:7077", "app-1")
    with pytest.raises(RuntimeError):
        runtime.local_root("local-cluster[2,1,1024]", "app-1")
    with pytest.raises(RuntimeError):
        runtime.local_root("yarn", "app-1")


def test_the_named_folder_is_used():
    named = SimpleNamespace(sparkContext=None, conf={"spark.checkpoint.dir": "hdfs:///shared/"})
    assert runtime.scratch_root(named) == "hdfs:///shared"


def test_tables_go_with_their_last_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "scratch_root", lambda spark: f"file://{tmp_path}")
    a, b = runtime.write_scratch(spark.range(3), "a"), runtime.write_scratch(spark.range(4), "b").where("id > 0")
    assert a.count() == 3
    del a
    for _ in range(20):
        gc.collect()
        spark._jvm.System.gc()
        runtime.sweep()
        if len(os.listdir(tmp_path)) == 1:
            break
        time.sleep(0.2)
    assert b.count() == 3  # still there, though only a frame derived from it is
    assert [n.split("-")[1] for n in os.listdir(tmp_path)] == ["b"]
