"""Implausible readings: impossible values, spikes and stuck stretches, by each source's own behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship, write_scratch
from .common import HOUR_MS, floor_div

COORDINATES = ["db", "namespace", "metric"]

#: Readings on either side that make a reading's baseline.
REACH = 8
#: A run this long is stuck, if the source's other runs are at most OTHER_RUNS long ...
STUCK, OTHER_RUNS = 12, 5
#: A source that spends more than this share of its readings in runs of over OTHER_RUNS, without those at the level it
#: holds most, holds set levels by nature.
SET_LEVEL_SHARE = 0.5
#: A spike is at most this many readings in succession.
SPIKE_RUN = 3
#: The fences: this many interquartile ranges from the baseline, and of rates of change above their upper quartile.
EXPAND = 7.3
#: Before and after a spike readings go on as before: within this share of the fence.
CALM = 0.7
#: An hour's context stands for itself from so many residuals on; else the source's whole scatter does.
CONTEXT = 48
#: Accuracy parameter of the quantile sketches (KLL: about 1.3 % rank error at 200, 0.7 % at 400).
SKETCH_K = 400
#: Usable readings that a chunk knows of either neighbour: a baseline's reach around the readings that a spike looks at, and more.
HALO = 40
#: Hours whose sketches are merged with their neighbours in one window.
BLOCK = 256
#: Hours without a context are sketched by blocks, numbered from minus this on.
POOL = 1 << 40
#: The chunk of a source that isn't cut.
WHOLE = -(1 << 63)


def _quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def _iqr(sketch: Column) -> Column:
    return _quantile(sketch, 0.75) - _quantile(sketch, 0.25)


def _scatter(sketch: Column) -> Column:
    """The interquartile range; the 5..95 % range on the same footing, if that is wider by far."""
    return F.greatest(_iqr(sketch), (_quantile(sketch, 0.95) - _quantile(sketch, 0.05)) / 3.3)


# -- readings of whole chunks, as arrays


class Series:
    """Readings of one or more chunks in order of chunk, time and value: runs of equal readings, and which ones are usable,
    that is, neither impossible nor in a stuck run. Copies are folded."""

    def __init__(self, first: np.ndarray, t: np.ndarray, v: np.ndarray, halo: np.ndarray, gap: np.ndarray, bad: np.ndarray) -> None:
        n = len(t)
        same = np.zeros(n, bool)  # as the one before
        same[1:] = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
        same &= ~first
        copy = same.copy()
        copy[1:] &= t[1:] == t[:-1]
        self.at = np.flatnonzero(~copy)
        own = np.logical_or.reduceat(~halo, self.at) if n else ~halo
        self.first, self.t, self.v, self.own, gap, bad, same = first[self.at], t[self.at], v[self.at], own, gap[self.at], bad[self.at], same[self.at]
        same[1:] &= ~gap[1:] & ~gap[:-1]
        self.run = np.cumsum(~same) - 1
        self.length = np.bincount(self.run)[self.run] if n else self.run
        self.bad = bad | gap
        self.ok = np.flatnonzero(~self.bad & (self.length < STUCK))
        self.chunk = np.cumsum(self.first) - 1
        of = self.chunk[self.ok]
        self.starts = np.flatnonzero(np.diff(of, prepend=-1))  # of each chunk's usable readings, among them
        self.sizes = np.diff(np.append(self.starts, len(of)))

    def baselines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every usable reading, the median of the 17 around it, at the ends of a series the outermost 17, so that a change of
        level near an end has its window too; and the least step between these. NaN where fewer than 5 are usable."""
        u, w = self.v[self.ok], 2 * REACH + 1
        median, step = np.full(len(u), np.nan), np.zeros(len(u))
        start, size = np.repeat(self.starts, self.sizes), np.repeat(self.sizes, self.sizes)
        of = start + np.clip(np.arange(len(u)) - start - REACH, 0, np.maximum(size - w, 0))
        padded = np.append(u, np.full(w, np.inf))
        full = np.unique(of[size >= w])
        few = np.unique(of[(size < w) & (size >= 5)])
        for begin, count in ((full, np.full(len(full), w)), (few, size[few])):
            for a in range(0, len(begin), 1 << 15):
                b, c = begin[a : a + (1 << 15)], count[a : a + (1 << 15)]
                near = padded[b[:, None] + np.arange(w)]
                near[np.arange(w) >= c[:, None]] = np.inf
                near.sort(axis=1)
                row = np.arange(len(b))
                median[b] = (near[row, c // 2] + near[row, (c - 1) // 2]) / 2
                with np.errstate(invalid="ignore"):
                    d = np.diff(near, axis=1)
                d[~(d > 0)] = np.inf
                least = d.min(axis=1)
                step[b] = np.where(np.isinf(least), 0.0, least)
        return median[of], step[of]

    def rates(self) -> np.ndarray:
        """The change of every usable reading from the usable one before, by second; NaN without one or at the same time."""
        out = np.full(len(self.ok), np.nan)
        if len(out) > 1:
            dt, dv = np.diff(self.t[self.ok]), np.abs(np.diff(self.v[self.ok]))
            with np.errstate(invalid="ignore", divide="ignore"):
                out[1:] = np.where((dt > 0) & (np.diff(self.chunk[self.ok]) == 0), dv * 1000.0 / dt, np.nan)
        return out


def _even(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number in [-0.5, 0.5) by time and value (a 64-bit mixing hash)."""
    with np.errstate(over="ignore"):
        x = (t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (v + 0.0).view(np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(40)).astype(float) / (1 << 24) - 0.5


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that hold whole chunks: rows are numbered from 1 in each (``_i``)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("_i").to_numpy() == 1)
        if not len(starts):
            held.append(b)
            continue
        held.append(b.slice(0, int(starts[-1])))
        if (whole := pa.Table.from_batches(held)).num_rows:
            yield whole
        held = [b.slice(int(starts[-1]))]
    if held and (whole := pa.Table.from_batches(held)).num_rows:
        yield whole


def _column(table: pa.Table, name: str) -> np.ndarray:
    """As numpy; nulls of doubles are NaN, there are none in others."""
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _series(table: pa.Table) -> Series:
    return Series(_column(table, "_i") == 1, _column(table, "_t"), _column(table, "_v"), _column(table, "_halo"), _column(table, "_gap"), _column(table, "_bad"))


def _pooled(chunk: np.ndarray, hour: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of hours with so many residuals, whether neither they nor their neighbours can have a context of their own: these
    need no sketch by the hour. What a chunk's first and last hour have beyond it isn't known, so they may."""
    last = np.append(chunk[1:] != chunk[:-1], True)
    first = np.append(True, last[:-1])
    beside = np.append(~last[:-1] & (hour[1:] == hour[:-1] + 1), False)  # the next one is the next hour
    around = count.copy()
    around[beside] += count[1:][beside[:-1]]
    around[1:][beside[:-1]] += count[:-1][beside[:-1]]
    own = first | last | (around >= CONTEXT)
    near = own.copy()
    near[:-1] |= own[1:] & beside[:-1]
    near[1:] |= own[:-1] & beside[:-1]
    return ~near


def _profile(keys: list[str]) -> Callable:
    """Of each own reading its hour (or block of hours), residual and rate; with each hour's first one, what its runs tell of the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches):
            s = _series(table)
            base, step = s.baselines()
            spread, rate = np.full(len(s.t), np.nan), np.full(len(s.t), np.nan)
            spread[s.ok] = s.v[s.ok] - base + step * _even(s.t[s.ok], s.v[s.ok])
            rate[s.ok] = s.rates()
            mine = np.bincount(s.run, s.own)[s.run].astype(np.int64)
            own = np.flatnonzero(s.own)
            head = np.zeros(len(s.t), bool)  # the first own reading of its run
            head[own[np.flatnonzero(np.diff(s.run[own], prepend=-1))]] = True
            hour = s.t[own] // HOUR_MS
            begin = np.flatnonzero((np.diff(hour, prepend=0) != 0) | (np.diff(s.chunk[own], prepend=-1) != 0)) if len(own) else own
            if not len(own):
                continue
            held = ~s.bad[own] & (s.length[own] > OTHER_RUNS)
            level = np.where(held & head[own], mine[own], 0)
            # the longest run of each hour, of equal ones the greatest value
            order = np.lexsort((s.v[own], level, np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(own))))))
            top = order[np.append(begin[1:], len(own)) - 1]
            short = np.where(s.length[own] < STUCK, s.length[own], 0)
            of_hour = np.zeros((4, len(own)), np.int64)
            of_hour[0, begin] = np.add.reduceat((~s.bad[own]).astype(np.int64), begin)
            of_hour[1, begin] = np.add.reduceat(held.astype(np.int64), begin)
            of_hour[2, begin] = level[top]
            of_hour[3, begin] = np.maximum.reduceat(short, begin)
            count = np.add.reduceat((~np.isnan(spread[own])).astype(np.int64), begin)
            pooled = np.repeat(_pooled(s.chunk[own][begin], hour[begin], count) & (level[top] == 0), np.diff(np.append(begin, len(own))))
            hour = np.where(pooled, hour // BLOCK - POOL, hour)
            at = np.full(len(own), np.nan)
            at[begin] = np.where(level[top] > 0, s.v[own][top], np.nan)
            where = pa.array(s.at[own])
            nullable = [pa.array(x, pa.float64(), from_pandas=True) for x in (spread[own], rate[own], at)]
            yield from pa.Table.from_arrays([*[table.column(k).take(where) for k in keys], pa.array(hour), *nullable, *[pa.array(x) for x in of_hour]], names=[*keys, "_hour", "_spread", "_rate", "_lv", "_all", "_held", "_ln", "_short"]).to_batches(65536)

    return run


def _verdicts(keys: list[str]) -> Callable:
    """The flags of each own reading, given the fences of its hour and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches):
            s = _series(table)
            base, _ = s.baselines()
            fence, levels, other, most = (_column(table, c)[s.at] for c in ("_fence", "_levels", "_other", "_most"))
            far = np.abs(s.v[s.ok] - base)
            with np.errstate(invalid="ignore"):
                out, calm = far > fence[s.ok], far <= fence[s.ok] * CALM
                fast = s.rates() > most[s.ok]
            # outside in short succession, and well inside on both sides
            of = s.chunk[s.ok]
            begin = np.flatnonzero((np.diff(out, prepend=False) != 0) | (np.diff(of, prepend=-1) != 0)) if len(of) else of
            end = np.append(begin[1:], len(of))[: len(begin)]
            before, after = np.maximum(begin - 1, 0), np.minimum(end, max(len(of) - 1, 0))
            fits = out[begin] & (end - begin <= SPIKE_RUN) & (begin > 0) & (end < len(of)) if len(of) else np.zeros(0, bool)
            if len(of):
                fits &= (of[before] == of[begin]) & calm[before] & (of[after] == of[begin]) & calm[after]
            spike, too_fast, baseline = np.zeros(len(s.t), bool), np.zeros(len(s.t), bool), np.full(len(s.t), np.nan)
            spike[s.ok] = np.repeat(fits, end - begin)
            spike &= ~levels
            too_fast[s.ok], baseline[s.ok] = fast, base
            stuck = (s.length >= STUCK) & ~levels & ~other
            own = np.flatnonzero(s.own)
            where = pa.array(s.at[own])
            doubles = [pa.array(s.v[own], pa.float64()), *[pa.array(x[own], pa.float64(), from_pandas=True) for x in (baseline, fence)]]
            flags = [pa.array(x[own]) for x in (s.bad, spike, stuck, too_fast)]
            yield from pa.Table.from_arrays([*[table.column(k).take(where) for k in keys], pa.array(s.t[own]), *doubles, *flags], names=[*keys, "timestamp", "value", "baseline", "fence", "impossible", "spike", "stuck", "too_fast"]).to_batches(65536)

    return run


# -- what a chunk of a long source must know of its neighbours


def thin(t: np.ndarray, v: np.ndarray, bad: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """What matters of readings, given outward from a border, to the chunk beyond it: the places to keep, which of these now
    only stand for a gap, and whether HALO usable ones were found (else all that matters is there).

    Up to STUCK readings of the run at the border, so that its length is known as far as it counts, and as many of the run at the
    far end, which may go on; the usable ones between; one reading for each stretch that isn't usable.
    """
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), gap, False
    same = np.zeros(n, bool)
    same[1:] = ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))) & ~gap[1:] & ~gap[:-1]
    run = np.cumsum(~same) - 1
    length = np.bincount(run)[run]
    place = np.arange(n)
    edge = ((run == 0) & (place < STUCK)) | ((run == run[-1]) & (place >= n - STUCK))
    usable = ~(bad | gap) & (length < STUCK)
    counted = usable & (run != 0) & (run != run[-1])
    full = int(counted.sum()) >= HALO
    last = int(np.flatnonzero(counted)[HALO - 1]) if full else n - 1
    whole = edge | usable
    stands = ~whole & np.append(True, whole[:-1])  # the first of each stretch
    keep = np.flatnonzero((whole | stands) & (place <= last))
    return keep, gap[keep] | stands[keep], full


_END = ["_t", "_v", "_bad", "_gap"]


def _ends(keys: list[str]) -> Callable:
    """Both thinned ends of every chunk: ``_side`` -1 the beginning, for the chunk before, 1 the end; numbered outward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_chunks(batches):
            start = np.flatnonzero(_column(table, "_i") == 1)
            t, v, bad = _column(table, "_t"), _column(table, "_v"), _column(table, "_bad")
            gap = np.zeros(len(t), bool)
            rows = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(t)]):
                for side in (-1, 1):
                    outward = np.arange(a, b)[::-side]
                    keep, gaps, full = thin(t[outward], v[outward], bad[outward], gap[outward])
                    rows.append((outward[keep], np.full(len(keep), side), np.arange(len(keep)), gaps, np.full(len(keep), full)))
            where, side, pos, gaps, full = (np.concatenate(x) for x in zip(*rows))
            yield from pa.Table.from_arrays(
                [*[table.column(k).take(pa.array(where)) for k in keys], pa.array(side.astype(np.int32)), pa.array(pos.astype(np.int32)), *[pa.array(x) for x in (t[where], v[where], bad[where], gaps, full)]],
                names=[*keys, "_side", "_pos", *_END, "_full"],
            ).to_batches(65536)

    return run


def _carried(source: list[str], side: int) -> Callable:
    """For every chunk but the first what it must know of all before it (``side`` 1; -1: of all behind it), from their
    ends in that order: an end that holds enough is all, one that doesn't is put before what it had itself been told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[np.ndarray] = []
        for table in _by_chunk(batches):
            chunk = table.column("_chunk")[0].as_py()
            keys = [table.column(k)[0] for k in source]
            if table.column("_i")[0].as_py() == 1:
                told = []
            elif told:
                n = len(told[0])
                yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()] * n, k.type) for k in keys], pa.array([chunk] * n, pa.int64()), *[pa.array(x) for x in told]], names=[*source, "_chunk", *_END])
            own = [_column(table, c) for c in _END]
            if told and not table.column("_full")[0].as_py():
                own = [np.concatenate([a, b]) for a, b in zip(own, told)]
                keep, gaps, _ = thin(*own)
                own = [*[x[keep] for x in own[:3]], gaps]
            told = own

    return run


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for every chunk of sorted ends; each begins with ``_pos`` 0."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cuts = [*np.flatnonzero(b.column("_pos").to_numpy() == 0).tolist(), b.num_rows]
        if cuts[0] > 0 or not held:
            held.append(b.slice(0, cuts[0]))
        for x, y in zip(cuts, cuts[1:]):
            if sum(h.num_rows for h in held):
                yield pa.Table.from_batches(held)
            held = [b.slice(x, y - x)]
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def _in_order(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """Number the rows of each group (``_i``): so all rows of one are in one task, in order, whatever the planner changes."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)


def _in_chunks(r: DataFrame, src: list[str], rows_per_chunk: int) -> tuple[DataFrame, list[str]]:
    """Every reading in its chunk (``_chunk``: the start of the time that it covers; WHOLE where a source isn't cut), and
    copies of what a chunk must know of its neighbours (``_halo``, ``_gap``); and the columns that name a chunk, without
    ``_chunk`` where no source is cut.

    Readings are counted by source and hour, folded before they move. A source of more than ``rows_per_chunk`` is cut at
    hours, an hour of more than that at milliseconds. Where no source is, nothing else happens. Readings of cut sources are
    folded first, so copies of one reading, however many, never meet.
    """
    hour = floor_div(F.col("_t"), HOUR_MS)
    run, size = Window.partitionBy(*src).orderBy("_hour"), F.lit(rows_per_chunk)
    hours = r.groupBy(*src, hour.alias("_hour")).agg(F.count("*").alias("_n"))
    hours = hours.withColumn("_total", F.sum("_n").over(Window.partitionBy(*src))).where(F.col("_total") > rows_per_chunk)
    hours = hours.withColumn("_piece", F.call_function("div", F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), size))
    hours = hours.withColumn("_busy", F.col("_n") > rows_per_chunk)
    start = F.when(F.col("_busy"), F.col("_hour")).otherwise(F.min("_hour").over(Window.partitionBy(*src, "_piece", "_busy"))) * HOUR_MS
    places = write_scratch(hours.select(*src, "_hour", start.alias("_start"), "_busy"), "chunks")
    flat = r.withColumns({"_halo": F.lit(False), "_gap": F.lit(False)})
    if places.isEmpty():
        return flat, src
    r = r.withColumn("_hour", hour)
    if not places.where("_busy").isEmpty():
        busy = r.join(places.where("_busy"), [*src, "_hour"]).select(*src, "_hour", "_t", "_v").distinct()
        within = Window.partitionBy(*src, "_hour").orderBy("_t")
        counted = busy.groupBy(*src, "_hour", "_t").agg(F.count("*").alias("_n")).withColumn("_p", F.call_function("div", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"), size))
        cuts = counted.groupBy(*src, "_hour", "_p").agg(F.min("_t").alias("_t")).groupBy(*src, "_hour").agg(F.collect_list("_t").alias("_cuts"))
        places = write_scratch(places.join(cuts, [*src, "_hour"], "left"), "chunks")
    else:
        places = places.withColumn("_cuts", F.lit(None).cast("array<bigint>"))
    placed = r.join(places, [*src, "_hour"], "left")
    chunk = F.greatest(F.col("_start"), F.array_max(F.filter("_cuts", lambda c: c <= F.col("_t"))))
    readings = [*src, "_t", "_v", "_bad"]
    calm = placed.where("_start is null").select(*readings, F.lit(WHOLE).alias("_chunk"))
    cut = write_scratch(placed.where("_start is not null").select(*readings, chunk.alias("_chunk")).distinct(), "cut")  # used three times
    ends = _in_order(cut.repartition(*src, "_chunk"), [*src, "_chunk"], "_t", "_v")
    ends = ends.mapInArrow(_ends([*src, "_chunk"]), f"{_types(cut, [*src, '_chunk'])}, _side int, _pos int, {_types(cut, _END[:3])}, _gap boolean, _full boolean")
    ends = write_scratch(ends, "ends")
    told = None
    for side in (1, -1):
        ordered = _in_order(ends.where(F.col("_side") == side), src, F.col("_chunk").asc() if side == 1 else F.col("_chunk").desc(), "_pos")
        one = ordered.mapInArrow(_carried(src, side), f"{_types(ends, [*src, '_chunk', *_END])}")
        told = one if told is None else told.unionByName(one)
    own = calm.unionByName(cut).withColumns({"_halo": F.lit(False), "_gap": F.lit(False)})
    return own.unionByName(write_scratch(told, "halos").withColumn("_halo", F.lit(True))), [*src, "_chunk"]


def judge_readings(readings: DataFrame, limits: DataFrame, source: str = "name", expand: float = EXPAND, rows_per_chunk: int = 500_000) -> DataFrame:
    """Judge every reading by its own source: one row per distinct reading with ``impossible``, ``spike``, ``stuck``, ``too_fast``.

    ``readings``: db, namespace, metric, timestamp, value and ``source``. ``limits``: db, namespace, metric, value_low, value_high.

    - impossible: outside ``value_low`` .. ``value_high`` (a null or absent limit limits nothing; NaN is impossible).
    - stuck: in a run of at least 12 successive equal readings of a source whose other runs are at most 5
      long and that doesn't hold set levels by nature, that is, doesn't spend most of its possible readings in
      runs of over 5. The level it holds most is left out of that (a sensor that died holds one level for long, and
      varied before), but a source that has nothing else holds set levels. A run of 6 to 11 alone, as a coarse source has it by chance, rules out stuck stretches, not spikes.
    - spike: alone or up to three in succession outside the fences, with a reading well inside the fences right
      before and right after. The baseline is the median of the 17 readings around (without impossible and
      stuck ones), so lasting changes of level, waves and drift move the baseline. The fences are ``expand``
      interquartile ranges of the residuals (each spread over the source's step between values), from quantile sketches per source and hour, merged over the
      adjacent hours (where these hold enough) and over the whole source.
    - too_fast: the change from the usable reading before, by second, is more than ``expand`` interquartile ranges
      above the upper quartile of all such rates of the source, by sketches too. (A first reading after a lasting change of level is one.)

    Result: the coordinates, ``source``, timestamp, value, baseline, fence and the four flags. Null values,
    timestamps or sources are no readings; copies and equal rows are one reading; differing readings at one
    timestamp follow each other by value. A source with fewer than 5 usable readings has no
    spikes. Extra columns are ignored; empty tables give no rows.

    Readings move once, by source, and are worked on in Arrow batches of whole sources. Sources of more than ``rows_per_chunk``
    readings are cut by time; each chunk is told of its neighbours the run at the border and the next 40 usable readings,
    however far off these are, so the flags don't depend on the cuts.
    """
    ship(readings.sparkSession)
    keys = [f"_c{i}" for i in range(len(COORDINATES))]  # never null, so that plain equality keeps rows where they lie
    src = [*keys, "_s"]
    r = readings.where(F.col("value").isNotNull() & F.col("timestamp").isNotNull() & F.col(source).isNotNull()).select(
        *_never_null(), F.col(source).alias("_s"), F.col("timestamp").cast("bigint").alias("_t"), F.col("value").cast("double").alias("_v")
    )
    lim = limits.select(*_never_null(), "value_low", "value_high").groupBy(*keys).agg(F.max("value_low").alias("_low"), F.min("value_high").alias("_high"))
    r = r.join(F.broadcast(lim) if _small(lim) else lim, keys, "left")
    bad = F.isnan("_v") | F.coalesce(F.col("_v") < F.col("_low"), F.lit(False)) | F.coalesce(F.col("_v") > F.col("_high"), F.lit(False))
    r = r.select(*src, "_t", "_v", bad.alias("_bad"))
    cut, part = _in_chunks(r, src, rows_per_chunk)
    cut = cut.repartition(*part)
    kinds = _types(cut, part)

    # scatter: sketches per source and hour, a small table that is used three times below; one row per source and chunk goes back to the readings
    seen = _in_order(cut, part, "_t", "_v").mapInArrow(_profile(part), f"{kinds}, _hour bigint, _spread double, _rate double, _lv double, _all bigint, _held bigint, _ln bigint, _short bigint")
    hours = write_scratch(seen.groupBy(*part, "_hour").agg(
        F.kll_sketch_agg_double("_spread", SKETCH_K).alias("_k"), F.kll_sketch_agg_double("_rate", SKETCH_K).alias("_r"), F.count("_spread").alias("_n"), F.count("_rate").alias("_rn"),
        F.sum("_all").alias("_all"), F.sum("_held").alias("_held"), F.max(F.when(F.col("_ln") > 0, F.struct("_ln", "_lv"))).alias("_level"), F.max("_short").alias("_short"),
    ), "hours")

    def named(prefix: str, of: list[str]) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in of]

    tops = hours.where("_level is not null").select(*named("t", src), "_level").groupBy(*[f"t{c}" for c in src], "_level._lv").agg(F.sum("_level._ln").alias("_n"))
    tops = tops.groupBy(*[f"t{c}" for c in src]).agg(F.max("_n").alias("_top"))
    whole = hours.groupBy(*named("w", src)).agg(
        F.kll_merge_agg_double("_k").alias("_k"), F.kll_merge_agg_double("_r").alias("_r"), F.sum("_n").alias("_n"), F.sum("_rn").alias("_rn"),
        F.sum("_all").alias("_all"), F.sum("_held").alias("_held"), F.max("_short").alias("_short"),
    )
    top, all_ = F.coalesce("_top", F.lit(0)), F.col("_all")
    of_source = whole.join(tops, [F.col(f"w{c}") == F.col(f"t{c}") for c in src], "left").select(
        *[f"w{c}" for c in src],
        ((F.col("_held") - top > SET_LEVEL_SHARE * (all_ - top)) | (top >= all_)).alias("_levels"), (F.col("_short") > OTHER_RUNS).alias("_other"),
        F.when(F.col("_n") >= 5, _scatter(F.col("_k"))).alias("_scatter"),
        F.when(F.col("_rn") >= 5, _quantile(F.col("_r"), 0.75) + expand * _scatter(F.col("_r"))).alias("_most"),
    )
    block = floor_div(F.col("_hour"), BLOCK)
    inside = F.col("_hour") - block * BLOCK
    to = F.array_compact(F.array(block, F.when(inside == 0, block - 1), F.when(inside == BLOCK - 1, block + 1)))  # and to its neighbours' windows
    near = Window.partitionBy(*[f"n{c}" for c in src], "_to").orderBy("_hour").rangeBetween(-1, 1)
    local = hours.where(F.col("_hour") > -(POOL // 2)).select(*named("n", part), "_hour", "_k", "_n", block.alias("_block"), F.explode(to).alias("_to")).withColumns({"_near": F.kll_merge_agg_double("_k").over(near), "_count": F.sum("_n").over(near)})
    nparts = [f"n{c}" for c in part]
    entry = F.when(F.col("_count") >= CONTEXT, F.struct("_hour", _iqr(F.col("_near")).alias("_iqr")))  # null, and not collected, elsewhere
    local = local.where(F.col("_to") == F.col("_block")).groupBy(*nparts, floor_div(F.col("_hour"), 64).alias("_b")).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    local = local.groupBy(*nparts).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_m"))).alias("_locals"))
    # every part has its first hour there, which is never pooled
    scale = local.join(of_source, [F.col(f"n{c}") == F.col(f"w{c}") for c in src])

    fenced = cut.join(scale.hint("shuffle_hash"), [F.col(c) == F.col(f"n{c}") for c in part])
    hour = floor_div(F.col("_t"), HOUR_MS)
    here = F.try_element_at(F.try_element_at("_locals", floor_div(hour, 64)), hour)
    scatter = F.when(here.isNotNull(), F.greatest(here, F.col("_scatter") / 2)).otherwise(F.col("_scatter"))
    fenced = fenced.select(*part, "_t", "_v", "_halo", "_gap", "_bad", (scatter * expand).alias("_fence"), "_most", "_levels", "_other")
    out = _in_order(fenced, part, "_t", "_v").mapInArrow(_verdicts(part), f"{kinds}, timestamp bigint, value double, baseline double, fence double, impossible boolean, spike boolean, stuck boolean, too_fast boolean")
    return out.select(
        *[F.when(F.col(k) != "-", F.substr(k, F.lit(2))).alias(c) for c, k in zip(COORDINATES, keys)], F.col("_s").alias(source),
        "timestamp", "value", "baseline", "fence", "impossible", "spike", "stuck", "too_fast",
    )


def _never_null() -> list[Column]:
    """The coordinates as keys: '-' for null, else the text after a '+'."""
    return [F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-")).alias(f"_c{i}") for i, c in enumerate(COORDINATES)]


def _small(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether the planner's own size estimate proves that ``df`` is small enough to broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
