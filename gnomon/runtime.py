"""What operators need from the session: scratch space that every executor can reach."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()
#: Scratch tables by path: their session, and a weak reference of the JVM to the file listing that all plans over one share.
_tables: dict[str, tuple[SparkSession, object]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: what the cluster names in ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only in local mode, where executors share the driver's disk, a folder of our own is made if there is neither, once per
    application. On a cluster that is an error: executors would write where nobody else reads.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        of = context._jsc.sc().getCheckpointDir()
        named = of.get() if of.isDefined() else None
    return named.rstrip("/") if named else local_root(context.master, context.applicationId)


def local_root(master: str, application: str) -> str:
    if master.split("[")[0] != "local":
        raise RuntimeError(f"no shared folder for intermediate tables: set spark.checkpoint.dir to one that all executors of {master} reach")
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="gnomon-")
    return _own[application]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone by now; the folder's owner cleans up then
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed when Python exits, if nobody has removed it before."""
    path = f"{scratch_root(spark)}/gnomon-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df``, read straight from ``path``, which is removed once no plan over it is left."""
    try:
        leaf = df._jdf.queryExecution().analyzed().collectLeaves().apply(0)
        _tables[path] = df.sparkSession, df.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(leaf.relation().location())
    except Exception:  # read by another kind of source: the table stays until Python exits
        pass
    return df


def sweep() -> None:
    """Remove the scratch tables that no plan reads any more, so that a long-lived driver doesn't fill the disk."""
    for path, (spark, listing) in list(_tables.items()):
        try:
            gone = listing.get() is None
        except Exception:  # the JVM of that session has ended
            gone = True
        if gone:
            del _tables[path]
            remove(spark, path)


def write_scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage ends there, and lost executors don't
    matter. The table is there as long as any frame over it; tables written earlier whose frames are gone are removed."""
    sweep()
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return kept(spark.read.schema(df.schema).parquet(path), path)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver has it from. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    path = scratch_path(spark, "package") + ".zip"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(packed.getvalue()))
    out.close()
    atexit.register(remove, spark, path)
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def over_cores(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """Spread the rows of a small input (by the planner's estimate, at most ``small`` bytes a core) that comes in fewer
    files than there are cores, for work that is heavy per row. Any larger input stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * small and len(df.inputFiles()) < cores else df
