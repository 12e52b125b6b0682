"""Mixes: token counts, fitted rates against the closed solution, caps, soft memberships, odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gnomon.llm import mixing
from gnomon.llm.mixing import PLACES, Classifier, features, mix_sources, short_sources
from gnomon.llm.tokens import STRETCH, TOKENIZER, count_tokens, encoding

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id long, source string, text string, tokens int, copies int, rate int"
TARGETS = "source string, target_weight double, max_repeats int"
WORDS = {"a": "kiln glaze clay pot wheel", "b": "query index table join scan", "c": "sail mast rope tide keel"}


def docs(spark, sizes, extra=()):
    rng = random.Random(2)
    rows = [(i * 10 + len(s), s, " ".join(rng.choices(WORDS[s].split(), k=30)), 1, 2, 3) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def test_counts():
    enc = encoding(TOKENIZER)
    texts = ["hello world", "", None, "naïve – ещё 木", "<|endoftext|>", "x " * STRETCH, "\ud800"]
    got = count_tokens(texts)
    assert got[:5] == [len(enc.encode_ordinary(t or "")) for t in texts[:5]]
    assert got[5] >= STRETCH and got[6] >= 1
    assert count_tokens(["a" * 300_000, " " * 300_000]) and enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def test_targets_are_met(spark):
    df = docs(spark, {"a": 300, "b": 200, "c": 20})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], TARGETS)
    mix = mix_sources(df, t)
    plan = {r["source"]: r for r in mix.plan.collect()}
    total = plan["c"]["tokens"] * 3 / 0.2  # c is the narrowest
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert plan[s]["expected_tokens"] == pytest.approx(w * total, rel=1e-4)
        assert plan[s]["share"] == pytest.approx(w, abs=0.01)
    assert plan["c"]["least_rate"] == pytest.approx(3)
    used = mix.documents.selectExpr("max(copies) m", "min(copies) l", "count(*) n").first()
    assert used.m == 3 and used.l >= 0 and used.n == 520
    assert short_sources(mix_sources(df, t, total="corpus")).collect() == [("c",)]


def test_unlabelled_documents_are_judged_by_their_text(spark):
    df = docs(spark, {"a": 200, "b": 200}, [(90_000 + i, None, WORDS["a"] + " clay pot", 0, 0, 0) for i in range(50)] + [(95_000, "stranger", WORDS["b"], 0, 0, 0), (95_001, "a", None, 0, 0, 0), (95_001, "a", "", 0, 0, 0)])
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2), (None, 0.1, 2)], TARGETS)
    mix = mix_sources(df, t)
    got = {r["doc_id"]: r for r in mix.documents.where("doc_id >= 90000").collect()}
    assert got[90_000]["posterior"][0] > 0.8 * PLACES and got[95_000]["posterior"][1] > 0.6 * PLACES
    assert got[95_001]["tokens"] == 0 and mix.documents.count() == df.count()
    plan = {r["source"]: r for r in mix.plan.collect()}
    assert plan["a"]["expected_tokens"] == pytest.approx(plan["b"]["expected_tokens"], rel=1e-3)
    assert plan["a"]["domain_tokens"] > plan["a"]["tokens"] * 1.05  # the unlabelled count for their domain


def test_classifier_on_held_out_rows():
    rng = random.Random(1)
    make = lambda s: " ".join(rng.choices(WORDS[s].split() + ["the", "of", "and"], k=12))
    data = [(s, make(s)) for s in "abc" for _ in range(200)]
    rng.shuffle(data)
    model = Classifier(["a", "b", "c"], [(s, features(t)) for s, t in data[:400]])
    best = model.posteriors([t for _, t in data[400:]]).argmax(1)
    assert sum("abc"[k] == s for k, (s, _) in zip(best, data[400:])) >= 190


def test_wrong_labels_are_seen_through(spark):
    """A fifth of a's texts are recorded as b: the fit must be nearer to the true sizes than the recorded ones are."""
    df = docs(spark, {"a": 600, "b": 200, "c": 200})
    wrong = df.withColumn("source", F.when((F.col("source") == "a") & (F.col("doc_id") % 50 == 1), "b").otherwise(F.col("source")))
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 2)], TARGETS)
    true = {r["source"]: r["tokens"] for r in mix_sources(df, t).plan.collect()}
    mix = mix_sources(wrong, t, total=float(sum(true.values())) / 2)
    for r in mix.plan.collect():
        assert abs(r["domain_tokens"] - true[r["source"]]) < 0.03 * true[r["source"]] + 0.1 * abs(r["tokens"] - true[r["source"]])
        assert r["expected_tokens"] == pytest.approx(r["target_tokens"], rel=1e-3)
    assert {r["source"]: r["tokens"] for r in mix.plan.collect()}["b"] > 1.5 * true["b"]


def test_confusion_of_held_out_rows():
    rng = random.Random(3)
    make = lambda s: " ".join(rng.choices(WORDS[s].split() + ["the", "of", "and"], k=12))
    flip = lambda s: rng.choice("abc".replace(s, "")) if rng.random() < 0.2 else s
    data = [(flip(s), features(make(s))) for _ in range(800) for s in "abc"]
    noisy = Classifier(["a", "b", "c"], data[:1200], data[1200:])
    assert noisy.confusion.diagonal() == pytest.approx([0.8] * 3, abs=0.06)
    alike = [(rng.choice("abc"), features(make("a"))) for _ in range(2400)]  # texts that tell nothing speak against no source
    assert (Classifier(["a", "b", "c"], alike[:1200], alike[1200:]).confusion.diagonal() > 0.97).all()


def test_few_and_many_cells_give_the_same_mix(spark, rows, monkeypatch):
    df = docs(spark, {"a": 60, "b": 40}, [(90_000, None, WORDS["a"], 0, 0, 0)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    few = rows(mix_sources(df, t).plan)
    monkeypatch.setattr(mixing, "CELLS", 1)
    many = rows(mix_sources(df, t).plan)
    assert [r[:2] for r in many] == [r[:2] for r in few] and all(a[5:10] == pytest.approx(b[5:10], rel=1e-6) for a, b in zip(many, few))


def test_empty(spark):
    df, t = docs(spark, {"a": 3}), spark.createDataFrame([("a", 1.0, 1), ("gone", 0.5, 2)], TARGETS)
    assert mix_sources(df.where("false"), t).documents.collect() == []
    assert mix_sources(df, t.where("false")).plan.collect() == []
    assert [r.source for r in short_sources(mix_sources(df, t, total="corpus")).collect()] == ["gone"]
    assert mix_sources(df, t).documents.agg({"copies": "sum"}).first()[0] == 0  # nothing can meet a share of a source without text
