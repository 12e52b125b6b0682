"""One mix of several sources that meets target shares in tokens, small sources repeated up to a cap."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import over_cores, ship, write_scratch
from .tokens import TOKENIZER, count_tokens

#: Labelled documents that the classifier is fitted on, about, in equal parts for each source; never over twice as many.
SAMPLE = 6000
FEATURES = 2048
#: Posteriors are kept to 1 / PLACES, rounded without bias; documents with equal ones form a cell with one rate.
PLACES = 200
#: Up to so many cells, a few numbers each, are fitted on the driver; more in one aggregation a step, with the same result.
CELLS = 50_000
MOST_STEPS, TOLERANCE = 200, 1e-6
#: Sharpness of the classifier and shares of wrong sources: the candidates, of which the held-out rows choose.
SHARPNESS = (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
#: Texts tell domains for sure if their posteriors' mean entropy is under this share of the greatest possible.
SURE = 0.1
WRONG = (0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4)

_WORD = re.compile(r"\w+")


def features(text: str | None) -> list[int]:
    """The hashed words of a whole text, each once."""
    return list({zlib.crc32(w.encode("utf-8", "replace")) % FEATURES for w in set(_WORD.findall((text or "").lower()))})


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _confused(p: np.ndarray, y: np.ndarray, start: np.ndarray, rounds: int = 150) -> np.ndarray:
    """The confusion that makes sources ``y`` likeliest where texts give domains the probabilities ``p``, by EM."""
    seen = np.eye(p.shape[1])[y]
    c = start
    for _ in range(rounds):
        q = p * c[:, y].T
        n = (q / q.sum(1, keepdims=True)).T @ seen + 1e-3
        c = n / n.sum(1, keepdims=True)
    return c


def _likely(p: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    return float(np.log(np.maximum((p * c[:, y].T).sum(1), 1e-300)).sum())


class Classifier:
    """Softmax regression of the true domain on the hashed words of a text, and how recorded sources depend on the
    true domain: ``confusion`` [domain, source], from rows that the regression wasn't fitted on.

    Some recorded sources may be wrong, so neither is fitted without the other. The regression is fitted to the domains that
    text and source together make likely. Then, on the held-out rows, the confusion and the regression's sharpness are
    the ones that make the recorded sources likeliest: sources nearly always right, or wrong at one rate, or with rows of
    their own for some domains (EM); the rate and every row must gain more than their parameters cost (BIC). Only where
    nearly every text tells its domain for sure are texts believed before sources at equal likelihood. So wrong sources show
    as texts that surely belong elsewhere, and texts that can't be told apart say nothing against any source.
    """

    def __init__(self, domains: list[str], rows: list[tuple[str, list[int]]], held_out: list[tuple[str, list[int]]] = (), turns: int = 3, rounds: int = 80, rate: float = 1.0, decay: float = 1e-3) -> None:
        self.domains = domains
        s = len(domains)
        self.w, self.b = np.zeros((FEATURES, s), np.float32), np.zeros(s, np.float32)
        self.confusion = np.eye(s)
        if not rows or s < 2:
            return
        self.confusion = self._trusting(s, 0.05)
        x, y = self._table(rows)
        hx, hy = self._table(held_out) if held_out else (x, y)
        mw, mb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(turns):
            self.confusion = np.maximum(self.confusion, self._trusting(s, 0.01))
            for _ in range(rounds):
                p = _soft(x @ self.w + self.b)
                q = p * self.confusion[:, y].T
                g = ((p - q / q.sum(1, keepdims=True)) / len(y)).astype(np.float32)
                mw = 0.9 * mw + x.T @ g + decay * self.w
                mb = 0.9 * mb + g.sum(0)
                self.w -= rate * mw
                self.b -= rate * mb
            z = hx @ self.w + self.b
            cost = 0.5 * np.log(max(2, len(hy)))
            fits = []
            for k in SHARPNESS:
                h = _soft(k * z)
                fits += [(_likely(h, hy, c := self._trusting(s, wrong)) - cost * (wrong > WRONG[0]), k, c) for wrong in WRONG]
                c, free, own = self._trusting(s, WRONG[0]), 0, _confused(h, hy, self._trusting(s, 0.05))
                for d in range(s):
                    trial = np.where(np.arange(s)[:, None] == d, own, c)
                    if _likely(h, hy, trial) - _likely(h, hy, c) > cost * (s - 1):
                        c, free = trial, free + s - 1
                fits.append((_likely(h, hy, c) - cost * free, k, c))
                if -(h * np.log(h + 1e-12)).sum(1).mean() < SURE * np.log(s) and np.diag(own).min() > 0.5:
                    fits.append((_likely(h, hy, own) + cost, k, own))
            _, sharp, self.confusion = max(fits, key=lambda r: r[0])
            if np.allclose(self.confusion, self._trusting(s, WRONG[0])):  # nothing speaks against any source
                break
        self.w, self.b = self.w * np.float32(sharp), self.b * np.float32(sharp)

    @staticmethod
    def _trusting(s: int, wrong: float) -> np.ndarray:
        return np.eye(s) * (1 - wrong - wrong / (s - 1)) + wrong / (s - 1)

    def _table(self, rows: list[tuple[str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        number = {d: k for k, d in enumerate(self.domains)}
        x = np.zeros((len(rows), FEATURES), np.float32)
        for i, (_, f) in enumerate(rows):
            x[i, f] = 1 / np.sqrt(max(1, len(f)))
        return x, np.array([number[d] for d, _ in rows])

    def posteriors(self, texts) -> np.ndarray:
        """Of each domain, by the text alone."""
        z = np.tile(self.b, (len(texts), 1))
        for i, t in enumerate(texts):
            f = features(t)
            if f:
                z[i] += self.w[f].sum(0) / np.sqrt(len(f))
        return _soft(z.astype(float))


def _hashed(doc_id: str, text: str, what: str) -> Column:
    """A number in [0, 1) by id and text, another one for each ``what``."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(what)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit_classifier(docs: DataFrame, domains: list[str], doc_id: str, source: str, text: str, sample: int = SAMPLE) -> Classifier:
    """Fit on a bounded sample of labelled rows: those whose hash falls under sample / (sources * rows of the source); half
    of them, by hash, are held out for the confusion."""
    labelled = docs.where(F.col(source).isin(domains))
    sizes = {r[0]: r[1] for r in labelled.groupBy(source).count().collect()}  # one row for each source of the targets
    each = max(1, sample // max(1, len(domains)))
    below = None
    for d in domains:
        case = F.when(F.col(source) == d, F.lit(min(1.0, each / max(1, sizes.get(d, 0)))))
        below = case if below is None else F.coalesce(below, case)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": b["s"], "h": b["h"], "f": [features(t) for t in b["t"]]})

    rows: list[tuple[str, list[int], int]] = []
    if below is not None:
        half = F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit("half")), F.lit(2)).cast("int")
        picked = labelled.where(_hashed(doc_id, text, "sample") < below).select(F.col(source).alias("s"), half.alias("h"), F.col(text).alias("t")).mapInPandas(featured, "s string, h int, f array<int>").limit(2 * sample)
        rows = sorted((r["s"], sorted(r["f"]), r["h"]) for r in picked.collect())  # at most 2 * sample rows of at most FEATURES numbers
    return Classifier(domains, [r[:2] for r in rows if not r[2]], [r[:2] for r in rows if r[2]])


def _matrix(posterior: pa.Array, s: int) -> np.ndarray:
    return posterior.flatten().to_numpy(zero_copy_only=False).reshape(-1, s) / PLACES if s else np.zeros((len(posterior), 0))


def _rates(p: np.ndarray, cap: np.ndarray, start: float, slopes: list[np.ndarray]) -> np.ndarray:
    """The rates after the projected steps, from the steps' slopes alone."""
    r = np.minimum(start, cap)
    for g in slopes:
        r = np.clip(r - p @ g, 0, cap)
    return r


@dataclass
class Mix:
    """``documents``: doc_id, source, tokens, posterior, rate, copies. ``plan``: one row for each target source."""

    documents: DataFrame
    plan: DataFrame
    steps: int


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER, label_trust: float | None = None, total: int | str = "largest", sample: int = SAMPLE) -> Mix:
    """Document rates whose expected tokens by domain meet the targets, by soft-membership mixing.

    ``targets``: source, target_weight, max_repeats. The mix is to hold ``total`` tokens, ``target_weight`` of them from
    each source, no document more than ``max_repeats`` times. ``total`` is a number, 'corpus' (as many tokens as all
    documents together; small sources may then fall short) or 'largest' (as many as let every source meet its
    share within its repeats by the documents that likeliest belong to it, so the shares are met; 0 if a source with a weight has nothing).

    1. One pass counts the tokens of every whole text and gives every document the posterior of each domain: a
       classifier of the text, fitted on labelled rows, times the likelihood of the recorded source in each domain, by the
       confusion of domains and sources that held-out rows show (``label_trust``, if given, in its place: that
       much for a source's own domain, the rest spread over the others). A document without a source, or with one that
       has no target, is judged by its text alone. Posteriors are rounded at random by the hash of id and text, so that their mean stays. The table goes to the shared folder.
    2. Documents with equal posterior and cap form a cell; all documents count in the cells.
    3. Projected-gradient least squares over the cells' rates r in [0, cap]: minimise
       sum_s (x_s - target_s)^2 / mass_s with x_s = sum_d r_d tokens_d posterior_ds. In the metric of the tokens the step
       is r_d <- clip(r_d - sum_s posterior_ds (x_s - target_s) / mass_s), which never overshoots. A step is one
       aggregation to as many numbers as there are sources; rates are recomputed from the steps' gradients, so no state
       is kept on executors. Up to ``CELLS`` cells are summed on the driver instead.
    4. A rate becomes copies: its whole part, and one more wherever the running sum of the fractions' tokens, kept by source
       along each part of the table, is owed half a document: a source's copies keep within half a document a part of
       its expected tokens.

    Caps: of a document with a target source, that source's ``max_repeats``; of others, that of the likeliest
    domain. Negative or null repeats are 0. Documents without tokens have copies like others and weigh
    nothing. Null texts have no tokens; repeated ids are documents of their own.
    Empty documents or targets give an empty mix.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_weight").cast("double"), F.max("max_repeats").cast("double")).orderBy("source").collect()
    domains = [r[0] for r in wanted]
    weight = np.array([r[1] or 0.0 for r in wanted])
    cap = np.array([max(0.0, r[2] or 0.0) for r in wanted])
    s = len(domains)
    model = fit_classifier(docs, domains, doc_id, source, text, sample)
    shared = spark.sparkContext.broadcast((model, cap, tokenizer, label_trust))
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.IntegerType())), T.StructField("cap", T.DoubleType())])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cap, path, trust = shared.value
        number = {d: i for i, d in enumerate(model.domains)}
        n = len(number)
        likely = model.confusion if trust is None or n < 2 else Classifier._trusting(n, 1 - trust)
        for b in batches:
            texts = b["t"].tolist()
            p = model.posteriors(texts) if n else np.zeros((len(texts), 0))
            own = np.array([number.get(x, -1) for x in b["s"]], int)
            known = np.flatnonzero(own >= 0)
            if n > 1 and trust != 0:
                q = p[known] * likely[:, own[known]].T
                p[known] = q / q.sum(1, keepdims=True)
            upto = np.concatenate([np.zeros((len(p), 1)), np.cumsum(p, 1)], 1)
            upto[:, -1] = 1
            whole = np.diff(np.floor(upto * PLACES + b["u"].to_numpy()[:, None]), axis=1).astype(int)
            if n:
                likeliest = p.argmax(1)
                caps = np.where(own >= 0, cap[np.maximum(own, 0)], cap[likeliest])
            else:
                caps = np.zeros(len(texts))
            yield pd.DataFrame({"doc_id": b["i"], "source": b["s"], "tokens": count_tokens(texts, path), "posterior": list(whole), "cap": caps})

    weighed = write_scratch(over_cores(docs.select(F.col(doc_id).alias("i"), F.col(source).cast("string").alias("s"), F.col(text).alias("t"), _hashed(doc_id, text, "round").alias("u"))).mapInPandas(weigh, schema), "mix")
    cells = write_scratch(weighed.groupBy("posterior", "cap").agg(F.sum("tokens").alias("tokens")), "cells")
    few = cells.limit(CELLS + 1).toArrow() if s else None
    few = few.combine_chunks().to_batches() if few is not None and len(few) <= CELLS else None

    start = float(min(1.0, cap.max(initial=0.0)))
    slopes: list[np.ndarray] = []

    def domain_sums(use: list[np.ndarray] | str | None) -> np.ndarray:
        """Tokens of each domain at the rates after the steps ``use``; at rate 1 for None, at the caps and of its likeliest
        documents alone for 'cap'."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(s)
            for b in batches:
                p, t = _matrix(b.column("posterior"), s), b.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                most = b.column("cap").to_numpy(zero_copy_only=False)
                r = 1.0 if use is None else most if use == "cap" else _rates(p, most, start, use)
                got += (t * r) @ (np.where(np.arange(s) == p.argmax(1)[:, None], p, 0) if isinstance(use, str) else p)
            yield pa.RecordBatch.from_pydict({"x": pa.array([got.tolist()], pa.list_(pa.float64()))})

        if not s:
            return np.zeros(0)
        if few is not None:
            return np.array(next(part(iter(few))).column("x")[0].as_py())
        sums = cells.mapInArrow(part, "x array<double>").agg(*[F.sum(F.get("x", F.lit(k))) for k in range(s)]).first()
        return np.array([v or 0.0 for v in sums])

    mass = domain_sums(None)
    all_tokens = weighed.agg(F.sum("tokens")).first()[0] or 0 if few is None else sum(b.column("tokens").to_numpy().sum() for b in few)
    if total == "largest":
        most = domain_sums("cap")
        asked = weight > 0
        total = float((most[asked] / weight[asked]).min()) if asked.any() else 0.0
    else:
        total = float(all_tokens if total == "corpus" else total)
    target = weight * total
    start = start if total > 0 else 0.0
    x = domain_sums([])
    while s and total and len(slopes) < MOST_STEPS:
        slopes.append(np.where(mass > 0, (x - target) / np.where(mass > 0, mass, 1), 0))
        new = domain_sums(slopes)
        moved = np.abs(new - x).max() / total
        x = new
        if moved < TOLERANCE:
            break

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owed: dict[object, float] = {}  # tokens, by source; of documents without tokens, documents
        for b in batches:
            p = _matrix(b.column("posterior"), s)
            r = _rates(p, b.column("cap").to_numpy(zero_copy_only=False), start, slopes)
            copies = np.floor(r)
            likeliest = p.argmax(1).tolist() if s else [0] * len(r)
            for i, (d, t, f) in enumerate(zip(b.column("source").to_pylist(), b.column("tokens").to_pylist(), (r - copies).tolist())):
                of = (likeliest[i] if d is None else d, t == 0)
                t = t or 1
                o = owed.get(of, 0.0) + f * t
                if f and o >= t / 2:
                    copies[i] += 1
                    o -= t
                owed[of] = o
            yield b.append_column("rate", pa.array(r, pa.float64())).append_column("copies", pa.array(copies.astype(np.int32)))

    mixed = weighed.mapInArrow(copied, T.StructType([*schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("copies", T.IntegerType())]))
    fitted = spark.createDataFrame(
        [(d, float(weight[k]), float(cap[k]), float(target[k]), float(mass[k]), float(x[k])) for k, d in enumerate(domains)],
        "source string, target_weight double, max_repeats double, target_tokens double, domain_tokens double, expected_tokens double",
    )
    sizes = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.max("rate").alias("most_rate"), F.min("rate").alias("least_rate"))
    plan = fitted.join(sizes, "source", "left").select(
        *fitted.columns, F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        "least_rate", "most_rate", F.lit(int(all_tokens)).alias("corpus_tokens"),
    )
    shared_of = F.sum("mix_tokens").over(Window.partitionBy())  # one row for each target source
    plan = plan.withColumn("share", F.when(shared_of > 0, F.col("mix_tokens") / shared_of))
    return Mix(mixed, plan, len(slopes))


def short_sources(mix: Mix) -> DataFrame:
    """Target sources that can't fill their share: the fit leaves them over 1 % short of it with the rates of their
    documents at the cap, or they have no documents. Of a mix with ``total='corpus'``."""
    capped = (F.col("least_rate") >= F.col("max_repeats") * 0.99) | F.col("least_rate").isNull()
    return mix.plan.where(capped & (F.col("expected_tokens") < F.col("target_tokens") * 0.99)).select("source")
