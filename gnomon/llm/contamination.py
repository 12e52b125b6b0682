"""Evaluation passages inside a training corpus: find them, say which leaked, cut them out."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import over_cores, ship, write_scratch
from .words import has_doubtful_tags, portions, spans, words

#: Successive words that make a case when all agree.
EXACT = 12
#: Successive words that make a case when at most one in ONE_IN of them differs.
LOOSE, ONE_IN = 30, 8
#: Words of a seed. Of L >= 30 words with at most L/8 wrong, some 6 in succession are right: the right ones fall
#: into at most wrong + 1 stretches, and ceil((L - w) / (w + 1)) >= 6 for every L >= 30, w <= L/8.
SEED = 6
#: Item text, in characters, that one broadcast index may hold; more items are searched in several blocks.
BLOCK_CHARS = 16 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """The normalised words of a block of items as numbers, and a sorted table of the hashes of their seeds."""

    def __init__(self, rows: Sequence[tuple], fields: Sequence[str]) -> None:
        self.fields = list(fields)
        self.vocabulary: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.owner: list[tuple[object, int]] = []
        for row in rows:
            for f in range(len(fields)):
                t = row[1 + f] or ""
                for tags in (False, True) if has_doubtful_tags(t) else (False,):
                    w = words(t, tags)
                    if len(w) < EXACT:
                        continue
                    self.texts.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
                    self.owner.append((row[0], f))
        hashes, which, at = [], [], []
        for k, t in enumerate(self.texts):
            h = seeds(t)
            hashes.append(h)
            which.append(np.full(len(h), k))
            at.append(np.arange(len(h)))
        empty = [np.zeros(0, np.int64)]
        h = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        self.hashes, self.which, self.at = h[order], np.concatenate(which or empty)[order], np.concatenate(at or empty)[order]


def seeds(ids: np.ndarray) -> np.ndarray:
    """The hash of every SEED successive word numbers."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SEED):
        h = (h ^ ids[i : i + n].astype(np.uint64)) * _MULT
        h ^= h >> np.uint64(29)
    return h


def loose_window(equal: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch of at least LOOSE places of which at most one in ONE_IN isn't ``equal``, or None.

    With a place worth 1 if equal and 1 - ONE_IN if not, such a stretch is one with a sum of 0 or more.
    """
    n = len(equal)
    if n < LOOSE:
        return None
    s = np.concatenate([[0], np.cumsum(np.where(equal, 1, 1 - ONE_IN))])
    # for each end, the earliest start with a prefix sum not above the end's
    low = np.minimum.accumulate(s)
    start = np.searchsorted(-low, -s, side="left")
    length = np.arange(n + 1) - start
    best = int(length.argmax())
    return (int(start[best]), best) if length[best] >= LOOSE else None


def loose_windows(equal: np.ndarray) -> list[tuple[int, int]]:
    """The longest such stretch, then the longest ones of what is left on either side of it, until none is left."""
    out, rest = [], [(0, len(equal))]
    while rest:
        a, b = rest.pop()
        if (w := loose_window(equal[a:b])) is not None:
            out.append((a + w[0], a + w[1]))
            rest += [(a, a + w[0]), (a + w[1], b)]
    return sorted(out)


def exact_runs(equal: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= EXACT]


def leaks_in(ids: np.ndarray, hit: np.ndarray, index: Index) -> list[tuple]:
    """The leaks of a document: (item, field, kind, words, differing, first word, end word). ``hit``: places in ``ids`` whose seed is in the index."""
    seen: dict[tuple[int, int], None] = {}
    h = seeds(ids)
    lo, hi = np.searchsorted(index.hashes, h[hit], "left"), np.searchsorted(index.hashes, h[hit], "right")
    for p, a, b in zip(hit.tolist(), lo.tolist(), hi.tolist()):
        for k in range(a, b):
            seen[int(index.which[k]), p - int(index.at[k])] = None
    best: dict[tuple[object, int, int], tuple] = {}
    for which, shift in seen:
        t = index.texts[which]
        a, b = max(0, shift), min(len(ids), shift + len(t))
        equal = ids[a:b] == t[a - shift : b - shift]
        found = [("exact", x, y) for x, y in exact_runs(equal)]
        for w in loose_windows(equal):
            right = np.flatnonzero(equal[w[0] : w[1]])  # report it from its first to its last right word
            found.append(("loose", w[0] + int(right[0]), w[0] + int(right[-1]) + 1))
        item, field = index.owner[which]
        for kind, x, y in found:
            best[item, field, a + x, a + y] = (item, index.fields[field], kind, y - x, int((~equal[x:y]).sum()), a + x, a + y)
    return _maximal(best.values(), 5, 6)


def _maximal(found: Iterable[tuple], start: int, end: int) -> list[tuple]:
    """The stretches without those inside another of the same item and field, which say nothing new; of equal ones the
    first. A stretch lies inside one that begins no later exactly if it ends no later than the farthest of them."""
    out: list[tuple] = []
    farthest: dict[tuple, int] = {}
    for r in sorted(found, key=lambda r: (r[start], -r[end])):
        key = r[0], r[1]
        if r[end] > farthest.get(key, -1):
            farthest[key] = r[end]
            out.append(r)
    return out


def _scan(texts: list[str | None], index: Index) -> Iterator[tuple[int, str, list[tuple]]]:
    """The leaks of each text that has any: (its number, the text, leaks with their first and end character)."""
    for r in portions(texts):
        part = texts[r.start : r.stop]
        leaks: dict[int, list[tuple]] = {}
        twice = [d for d, t in enumerate(part) if t and has_doubtful_tags(t)]
        for tags, which in ((False, range(len(part))), (True, twice)):
            for k, found in _scan_portion([part[d] for d in which], index, tags):
                where = spans(part[which[k]], tags)
                leaks.setdefault(which[k], []).extend((*x, where[x[5]][0], where[x[6] - 1][1]) for x in found)
        for d in sorted(leaks):
            yield r.start + d, part[d], _maximal(leaks[d], 7, 8) if d in twice else leaks[d]


def _scan_portion(texts: list[str | None], index: Index, tags: bool = False) -> Iterator[tuple[int, list[tuple]]]:
    """One lookup for all words of all texts."""
    get = index.vocabulary.get
    parts, ends = [], [0]
    for t in texts:
        ids = [get(w, 0) for w in words(t, tags)] if t else []
        parts.append(np.array([*ids, *[0] * SEED], np.int64))  # 0 is no word of any item and keeps texts apart
        ends.append(ends[-1] + len(parts[-1]))
    if not len(index.hashes) or not parts:
        return
    h = seeds(np.concatenate(parts))
    place = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
    hit = np.flatnonzero(index.hashes[place] == h)
    doc = np.searchsorted(ends, hit, "right") - 1
    for d in np.unique(doc):
        found = leaks_in(parts[d][:-SEED], hit[doc == d] - ends[d], index)
        if found:
            yield int(d), found


def _cut(text: str, stretches: Iterable[tuple[int, int]]) -> str:
    """The text without the stretches, which may overlap."""
    kept, at = [], 0
    for s, e in sorted(stretches):
        if e > at:
            kept.append(text[at : max(s, at)])
            at = e
    return "".join(kept) + text[at:]


def cut_leaks(texts: list[str | None], index: Index) -> dict[int, str]:
    """By number, every text that leaks, without its leaks. What a cut brings together may be a leak again,
    so cut texts are searched until none has any; each round makes them shorter."""
    out: dict[int, str] = {}
    which = list(range(len(texts)))
    while which:
        found = {which[k]: _cut(t, [r[7:] for r in leaks]) for k, t, leaks in _scan([out.get(d, texts[d]) for d in which], index)}
        out |= found
        which = list(found)
    return out


def _blocks(items: DataFrame, item_id: str, fields: Sequence[str], block_chars: int) -> tuple[int, Iterator[Index]]:
    """The number of blocks, and their indexes, each built when asked for."""
    size = items.select(F.sum(sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).cast("bigint"))).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_chars)) if size > block_chars else 1

    def build() -> Iterator[Index]:
        for b in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(n)) == b)
            yield Index([tuple(r) for r in part.select(item_id, *fields).where(F.col(item_id).isNotNull()).toLocalIterator()], fields)

    return n, build()


def _in_blocks(docs: DataFrame, blocks: tuple[int, Iterator[Index]], search: Callable[[Broadcast], Callable], schema: T.StructType) -> DataFrame:
    """What ``search`` gives on ``docs`` for every block of items. With several blocks each one's result is written to the
    shared folder and its index released before the next is built, so one index is all that is ever held."""
    n, indexes = blocks
    context = docs.sparkSession.sparkContext
    all_ = None
    for index in indexes:
        shared = context.broadcast(index)
        one = docs.mapInArrow(search(shared), schema)
        if n > 1:
            one = write_scratch(one, "leaks")
            shared.destroy()
        all_ = one if all_ is None else all_.unionByName(one)
    return all_


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: Sequence[str] = ("passage", "question"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every stretch of an item's ``fields`` that a document holds.

    A case is a stretch of at least 12 successive words of one field, or of at least 30 of which at most one in eight
    differs. Words are compared without case, punctuation, spacing, markup and comment marks. A text with what may be no
    tag ('i<n; ... ->'), or with prose in an attribute, is read both ways, without and with the words in tags;
    first_word and end_word count the words of the reading that holds the stretch.

    A hash set of all items' word 6-grams is broadcast. Each document's word windows are looked up in it, and
    every hit is verified by comparing the two texts word by word along the hit. No shuffle; documents stay
    where they are read, and whole. The index holds items, never documents; where the items are more than
    ``block_chars`` of text, they are split by id hash and the documents scanned once for each block, one block after the
    other, so that no more than one block's index is broadcast at a time.

    Result: doc_id, item_id, field, kind ('exact' or 'loose'), n_words, n_differing, first_word, end_word, start_char, end_char
    (end exclusive), longest stretches only. Null or empty texts hold nothing; a field of fewer than 12 words,
    null or empty can't leak; rows with a null id are reported under null (documents) or left out (items).
    Repeated documents are each reported; repeated item ids are one item.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("field", T.StringType()), T.StructField("kind", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("n_words", "n_differing", "first_word", "end_word", "start_char", "end_char")]
    )
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def search(shared: Broadcast) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, rows = [], []
                for d, _, found in _scan(b.column("_text").to_pylist(), shared.value):
                    at += [d] * len(found)
                    rows += found
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([b.column("_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

        return scan

    return _in_blocks(over_cores(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))), _blocks(items, item_id, fields, block_chars), search, schema)


def remove_leaks(docs: DataFrame, items: DataFrame, how: str = "spans", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: Sequence[str] = ("passage", "question"), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without leaked stretches (``how='spans'``) or without documents that have any (``how='documents'``).

    All columns of ``docs`` are kept, ``text`` changed; clean documents pass as they are. Spans are cut from the first
    to the last character of their words, all spans of a text at once; what a cut brings together is searched again, so
    ``find_leaks`` has nothing to find in the result, whatever ``block_chars``.

    With one block of items, the rule, cutting happens in the scan itself: no join back, no shuffle. With several, the
    leaking texts of every block (each known by its SHA-256) are gathered in the shared folder, their spans put together
    and cut, and the cut texts, leaking ones only, searched in all blocks again until none leaks; one join by the
    text's hash puts them in place.
    """
    if how not in ("spans", "documents"):
        raise ValueError(f"how must be 'spans' or 'documents', not {how!r}")
    ship(docs.sparkSession)
    n, indexes = _blocks(items, item_id, fields, block_chars)
    if n > 1:
        return _removed_by_hash(docs, items, how, text, item_id, fields, block_chars)
    place = docs.columns.index(text)

    def cut(shared: Broadcast) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(place).to_pylist()
                if how == "spans":
                    for d, new in cut_leaks(texts, shared.value).items():
                        texts[d] = new
                    yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if k == place else c for k, c in enumerate(b.columns)], b.schema.names)
                else:
                    keep = np.ones(len(texts), bool)
                    keep[[d for d, _, _ in _scan(texts, shared.value)]] = False
                    yield b.filter(pa.array(keep))

        return scan

    return _in_blocks(over_cores(docs), (n, indexes), cut, docs.schema)


def _removed_by_hash(docs: DataFrame, items: DataFrame, how: str, text: str, item_id: str, fields: Sequence[str], block_chars: int) -> DataFrame:
    """``remove_leaks`` for items of several blocks."""

    def search(shared: Broadcast) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, [r[7] for r in found], [r[8] for r in found]) for d, _, found in _scan(b.column("_text").to_pylist(), shared.value)]
                at, starts, ends = zip(*got) if got else ((), (), ())
                at = pa.array(at, pa.int64())
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("_hash").take(at), b.column("_text").take(at), pa.array(starts, ints), pa.array(ends, ints)], ["_hash", "_text", "_starts", "_ends"])

        return scan

    @F.pandas_udf("string")
    def without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, zip(s, e)) for t, s, e in zip(texts, starts, ends)], dtype=object)

    hash_ = F.sha2(F.col(text), 256)
    left = docs.where(F.col(text).isNotNull()).select(hash_.alias("_hash"), F.col(text).alias("_text"))
    fixed = None
    while True:
        found = _in_blocks(over_cores(left), _blocks(items, item_id, fields, block_chars), search, "_hash string, _text string, _starts array<int>, _ends array<int>")
        # a text has its spans once from each block, however many copies of it there are
        once = found.dropDuplicates(["_hash", "_starts", "_ends"]).groupBy("_hash").agg(
            F.first("_text").alias("_text"), F.flatten(F.collect_list("_starts")).alias("_starts"), F.flatten(F.collect_list("_ends")).alias("_ends")
        )
        cut = write_scratch(once.select("_hash", without("_text", "_starts", "_ends").alias("_text")), "cut")
        if cut.isEmpty():
            break
        fixed = cut if fixed is None else write_scratch(fixed.join(cut.withColumnRenamed("_text", "_new"), "_hash", "left").select("_hash", F.coalesce("_new", "_text").alias("_text")), "cut")
        if how == "documents":
            break
        left = cut
    if fixed is None:
        return docs
    h, new = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("h", "t"))  # none of the documents' own columns
    keyed, fixed = docs.withColumn(h, hash_), fixed.toDF(h, new)
    if how == "documents":
        return keyed.join(fixed, h, "left_anti").select(*docs.columns)
    return keyed.join(fixed, h, "left").select(*[F.coalesce(new, c).alias(c) if c == text else F.col(c) for c in docs.columns])
