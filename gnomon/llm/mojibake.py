"""Text read in a wrong character encoding: found by a hidden Markov model over characters, and restored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import over_cores, ship, write_scratch
from .encodings import DECODE, DOUBLE, ENCODE, PAIRS, SINGLE, TWICE, WIDE, double_bytes, utf8_units, wide_bytes
from .words import portions

#: Log probabilities of leaving and of resuming the clean state; and what a pair that isn't of the commonest costs more.
ENTER, LEAVE, UNCOMMON = -6.0, -2.0, -0.7
#: Log probability of a character, after the one before, that the corpus doesn't know; and of one that a state can't emit.
UNKNOWN, IMPOSSIBLE = np.log(1e-6), -30.0
#: A character pair counts as known from this share of the documents on, so that garbled rarities stay unknown.
RARE = 1e-3
#: A text none of whose characters is less likely than this is clean without asking the other states.
DOUBTFUL = -7.0
#: A span takes in the characters at most this many places off ...
REACH = 40
#: ... on the same line, that its state explains with at least this log probability more than the clean one.
SIMILAR = -1.5
#: Log probability of an ASCII letter right after a Cyrillic or East Asian character.
MIXED = -7.0
#: Text that was garbled again and again is restored in as many rounds.
ROUNDS = 3

#: Characters of texts that are labelled together.
TOGETHER = 60_000
#: What a capital costs against its small letter.
CAPITAL = -1.5

_LOST = 0xFFFD
_A_GRAVE = "à".encode()
_SMALL = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x10000)], np.int32)
#: Closed fences (from line start to line start, or within a line), and closed pairs that don't open within a word.
_QUOTED = re.compile(r"^[ \t>]*```.*?^[ \t>]*```|```[^`\n]+```|(?<![0-9A-Za-z\u00c0-\u024f`])`[^`\n]+`", re.DOTALL | re.MULTILINE)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def context(cp: np.ndarray) -> np.ndarray:
    """What a character is to its successor: itself, but for digits and all other ASCII besides letters, which are one each."""
    out = cp.copy()
    a = cp < 128
    upper = (cp >= 65) & (cp <= 90)
    lower = (cp >= 97) & (cp <= 122)
    digit = (cp >= 48) & (cp <= 57)
    out[a] = 32
    out[lower | upper] = cp[lower | upper]
    out[digit] = 48
    return out


def _keys(before: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return before.astype(np.int64) << 21 | cp.astype(np.int64)


def script(cp: np.ndarray) -> np.ndarray:
    """A coarse class of a context: 0 space and punctuation, 1 digit, 2 Latin, 3 Cyrillic, 4 East Asian, 5 other,
    7 ASCII capital."""
    out = np.full(len(cp), 5, np.int64)
    out[cp < 128] = 2
    out[(cp >= 65) & (cp <= 90)] = 7
    out[cp == 32] = 0
    out[cp == 48] = 1
    out[(cp >= 0xC0) & (cp <= 0x24F)] = 2
    out[(cp >= 0x400) & (cp <= 0x52F)] = 3
    out[cp >= 0x3000] = 4
    return out


def surroundings(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of characters between ASCII ones that a single-byte encoding may have, and numbers for each of them with the two
    characters before and after it, as far as its word goes: what a misreading of single bytes leaves as it is."""
    ctx = np.concatenate([[32, 32], context(cp), [32, 32]]).astype(np.int64)
    at = np.flatnonzero((cp >= 128) & (cp < 0x2E80))
    b1, a1 = ctx[at + 1], ctx[at + 3]
    b2, a2 = np.where(b1 > 64, ctx[at], 32), np.where(a1 > 64, ctx[at + 4], 32)
    fine = (b1 < 128) & (a1 < 128) & (b2 < 128) & (a2 < 128)
    at, b1, a1, b2, a2 = (x[fine] for x in (at, b1, a1, b2, a2))
    return at, 1 << 44 | b2 << 37 | b1 << 30 | a1 << 23 | a2 << 16 | cp[at].astype(np.int64)


def misreadings(keys: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What known surroundings look like misread, by every single-byte pair, where that is unknown: sorted numbers, pairs,
    and how much likelier the pair is there than an unknown character, as a log probability."""
    out = []
    c, rest = (keys & 0xFFFF).astype(np.int64), keys & ~np.int64(0xFFFF)
    for i, (e, d) in enumerate(PAIRS):
        if e in SINGLE and d in SINGLE:
            b = ENCODE[e][c]
            new = rest | DECODE[d][np.maximum(b, 0)]
            ok = np.flatnonzero((b >= 0) & (new != keys) & ~np.isin(new, keys))
            out.append((new[ok], np.full(len(ok), i), np.log(share[ok]) - UNKNOWN))
    new, pair, bonus = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(new, kind="stable")
    return new[order], pair[order], bonus[order]


#: Keys from here on are (class of the context, character), and with character 0 the class itself; with class ANY, the character.
_CLASSES, _ANY = 1 << 20, 6


@dataclass
class Characters:
    """How likely a non-ASCII character is after another, from the documents of the corpus that show no plain garbling."""

    n: int
    keys: np.ndarray  # sorted (context, character)
    count: np.ndarray  # documents with it
    misread: tuple[np.ndarray, np.ndarray, np.ndarray] = ()  # of the known surroundings

    def told(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose surroundings are those of a misreading, its pair, and what speaks for it."""
        if not len(self.misread) or not len(self.misread[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, keys = surroundings(cp)
        lo, hi = np.searchsorted(self.misread[0], keys, "left"), np.searchsorted(self.misread[0], keys, "right")
        n = hi - lo
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return np.repeat(at, n), self.misread[1][which], self.misread[2][which]

    def _docs(self, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        k = _keys(before, cp)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.count[at], 0.0)

    def knows(self, cp: np.ndarray) -> np.ndarray:
        """Whether each character is more than a rarity."""
        return self._docs(np.full(len(cp), _CLASSES + _ANY), cp) > 0 if len(self.keys) and len(cp) else np.zeros(len(cp), bool)

    def log(self, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        """The log probability of each character after its context. A capital after a capital or a space is at least
        about as likely as the small letters would be: text in capitals is rare, but no sign of anything."""
        if not self.n or not len(self.keys) or not len(cp):
            return np.full(len(cp), UNKNOWN)
        out = self._log(before, cp)
        small = _SMALL[np.minimum(cp, 0xFFFF)]
        caps = np.flatnonzero((cp < 0x10000) & (small != cp) & (before < 0x10000))
        if len(caps):
            b = _SMALL[before[caps]]
            fits = (b != before[caps]) | (before[caps] == 32)
            caps, b = caps[fits], b[fits]
            out[caps] = np.maximum(out[caps], self._log(b, small[caps]) + CAPITAL)
        return out

    def _log(self, before: np.ndarray, cp: np.ndarray) -> np.ndarray:
        few = RARE * self.n
        of = np.where(before < 128, self.n, np.maximum(self._docs(np.full(len(cp), _CLASSES + _ANY), before), few))
        kind = script(before)
        of_kind = np.where((kind <= 2) | (kind == 7), self.n, np.maximum(self._docs(_CLASSES + kind, np.zeros(len(cp), np.int32)), few))
        pair, alike = self._docs(before, cp) / of, self._docs(_CLASSES + kind, cp) / of_kind
        return np.log(0.8 * np.minimum(1, pair) + 0.1 * np.minimum(1, alike) + 1e-6)


def _common(u: np.ndarray, wide: bool) -> np.ndarray:
    letters = ((u >= 0xA0) & (u <= 0x17F)) | ((u >= 0x400) & (u <= 0x45F)) | ((u >= 0x2010) & (u <= 0x2026)) | (u == 0x20AC) | (u == 0x2122)
    return letters | (wide & (((u >= 0x3000) & (u <= 0x30FF)) | ((u >= 0x4E00) & (u <= 0x9FFF))))


def plainly_garbled(cp: np.ndarray) -> np.ndarray:
    """Places of a text that read as UTF-8 of common characters, of accented letters four in a row, or of lost ones:
    a document with any isn't counted among the clean ones. A coarse guard of the statistics, not the detector."""
    whole = cp == _LOST
    keep = cp >= 128
    keep[1:] |= keep[:-1]  # and what ends each run of non-ASCII characters
    at = np.flatnonzero(keep)
    cp = cp[at]
    out = np.zeros(len(cp), bool)
    box = (cp >= 0x2500) & (cp < 0x25A0)
    drawn = box & np.concatenate([box[1:], [False]])  # tables in code
    for d in SINGLE:
        u, size = utf8_units(ENCODE[d][np.where(cp < 0x10000, cp, 0)])
        out |= (size > 0) & _common(u, d != "cp866") & ~drawn
    accented = (cp >= 0x80) & (cp <= 0x24F)
    if len(cp) >= 4:
        row = accented[:-3] & accented[1:-2] & accented[2:-1] & accented[3:]
        out[:-3] |= row
    whole[at[out]] = True
    return whole


def _batch(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, a line break between, and the number of each place's text."""
    parts = [points((t or "") + "\n") for t in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def character_statistics(docs: DataFrame, text: str = "text") -> Characters:
    """Count, over all documents, in how many each pair (character before, non-ASCII character), each such character, and each
    with its surroundings occurs. Counted by partition, summed by Spark; only those in more than ``RARE`` of the documents are
    kept, at most (mean distinct ones of a document) / RARE, whatever the number of documents."""

    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in (b["t"].tolist()[r.start : r.stop] for b in batches for r in portions(b["t"].tolist())):
            cp, doc = _batch(texts)
            rare = cp >= 128
            bad = np.zeros(len(texts), bool)
            at = np.flatnonzero(rare)
            if len(at):
                bad[doc[plainly_garbled(cp)]] = True
            at = at[~bad[doc[at]]]
            before = np.concatenate([[32], context(cp)[:-1]])[at] if len(cp) else cp
            pairs = np.unique(doc[at].astype(np.int64) << 42 | _keys(before, cp[at]))
            d, b, own = pairs >> 42 << 42, pairs >> 21 & (1 << 21) - 1, pairs & (1 << 21) - 1
            kind = _CLASSES + script(b)
            coarse = np.unique(np.concatenate([d | _keys(kind, own), d | _keys(kind, np.zeros_like(own)), d | _keys(np.full(len(own), _CLASSES + _ANY), own)]))
            once = np.concatenate([pairs, coarse]) & (1 << 42) - 1
            k, n = np.unique(once, return_counts=True)
            place, around = surroundings(cp)
            clean = ~bad[doc[place]]
            ka, na = np.unique(np.unique(doc[place[clean]].astype(np.int64) << 46 | around[clean]) & (1 << 46) - 1, return_counts=True)
            k, n = np.concatenate([k, ka]), np.concatenate([n, na])
            yield pd.DataFrame({"k": np.concatenate([[-1], k]), "n": np.concatenate([[int((~bad).sum())], n]).astype(np.int64)})

    counted = over_cores(docs.select(F.col(text).alias("t"))).mapInPandas(count, "k bigint, n bigint")
    sums = write_scratch(counted.groupBy("k").agg(F.sum("n").alias("n")), "characters")
    total = docs.sparkSession.createDataFrame([(-1,)], "k bigint").join(sums, "k").first()
    n = int(total["n"]) if total else 0
    kept = sums.where((F.col("k") >= 0) & (F.col("n") > RARE * n)).toPandas()
    k, c = kept["k"].to_numpy(np.int64), kept["n"].to_numpy(float)
    order = np.argsort(k)
    k, c = k[order], c[order]
    pairs = k < 1 << 44
    return Characters(n, k[pairs], c[pairs] - RARE * n, misreadings(k[~pairs], c[~pairs] / max(1, n)))


def _double_units(cp: np.ndarray, b: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``utf8_units``, for an encoding with two-byte characters: read from the left, a run at a time."""
    n = len(cp)
    u, size, covered = np.zeros(n, np.int32), np.zeros(n, np.int8), np.zeros(n + 1, bool)
    second = np.append(np.where(b[1:] >= 0, b[1:], np.where(cp[1:] < 128, cp[1:], 0)), 0)
    says = np.where(b >= 0x81, double_bytes(codec)[np.maximum(b, 0), second], 0)
    chosen, free = [], 0
    for s in np.flatnonzero(says).tolist():
        if s >= free:
            chosen.append(s)
            free = s + 2
    at = np.array(chosen, np.int64)
    u[at], size[at], covered[at + 1] = says[at], 2, True
    if codec == "cp932":  # half-width letters have one byte
        one = (b >= 0xA1) & (b <= 0xDF) & (size == 0) & ~covered[:n]
        u[one], size[one] = 0xFF61 + b[one].astype(np.int32) - 0xA1, 1
    return u, size


def _wide_units(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Units of UTF-8 read as a multi-byte encoding, from the left: (start, end, what it says). A unit is the fewest
    characters from its start on whose bytes are whole UTF-8 characters, at least one of them not ASCII. Its last character may have
    swallowed an ASCII letter. A longer unit's inner characters begin within a UTF-8 character, so none can be a unit's start."""
    out, end = [], 0
    for m in re.finditer(r"[^\x00-\x7f]+", text):
        i, end = m.span()
        while i < end:
            raw, left, j = bytearray(), 0, i
            while j < end:
                more = wide_bytes(text[j], codec)
                j += 1
                for b in more:
                    if left and 0x80 <= b <= 0xBF:
                        left -= 1
                    elif left:
                        more = b""
                        break
                    elif 0xC2 <= b <= 0xF4:
                        left = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                    elif b >= 0x80:
                        more = b""
                        break
                raw += more
                if not more or not left:
                    break
            if more and not left:
                try:
                    out.append((i, j, raw.decode("utf-8")))
                    i = j
                    continue
                except UnicodeDecodeError:
                    pass
            i += 1
    return out


def _wide_gains(units: list[tuple[int, int, str]], cp: np.ndarray, ctx: np.ndarray, clean: np.ndarray, model: Characters) -> tuple[np.ndarray, np.ndarray]:
    """As ``_unit_gains``, for units that say one or more characters each: the first place has the log probability of all."""
    score, says, door = np.where(cp < 128, 0.0, IMPOSSIBLE), ctx.copy(), np.ones(len(cp), bool)
    if units:
        start, end = np.array([x[0] for x in units]), np.array([x[1] for x in units])
        size = np.array([len(x[2]) for x in units])
        u = points("".join(x[2] for x in units))
        inner = np.concatenate([[0], np.cumsum(end - start)])
        places = np.arange(inner[-1]) + np.repeat(start - inner[:-1], end - start)
        score[places], door[places], door[start] = 0.0, False, True
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        last = first + size - 1
        c = context(u)
        says[end - 1] = c[last]
        before = np.concatenate([[32], c[:-1]])
        before[first] = np.concatenate([[32], says])[start]
        logs = np.where(u >= 128, model.log(before, u), 0.0)
        logs[last] += np.where(u[last] >= 128, _foreign(u[last], end, ctx), 0.0)
        # a Latin letter right before an East Asian one that is none of a unit's: a rare letter read right
        stray = np.isin(end, start, invert=True) & (script(np.concatenate([ctx, [32]])[end]) == 4)
        logs[last] += np.where((script(u[last]) == 2) & stray, MIXED, 0.0)
        score[start] = np.add.reduceat(logs, first)
    return score - clean, door


def _with_spaces(cp: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A plain space after the first byte of 'à' is its second one, a no-break space that something has made plain."""
    return np.where((np.concatenate([[-1], b[:-1]]) == _A_GRAVE[0]) & (cp == 32), _A_GRAVE[1], b)


def _unit_gains(units: tuple[np.ndarray, np.ndarray], cp: np.ndarray, ctx: np.ndarray, clean: np.ndarray, model: Characters) -> tuple[np.ndarray, np.ndarray]:
    """By place, how much likelier a state with these units is than the clean one, and whether the state may be
    entered there. A unit is entered at its first place, which has the log probability of what it says; its other
    places follow for certain. Non-ASCII places outside of units are impossible."""
    u, size = units
    starts = np.flatnonzero(size)
    if not len(starts):
        return np.full(len(cp), IMPOSSIBLE), np.ones(len(cp), bool)
    score = np.where(cp < 128, 0.0, IMPOSSIBLE)
    says, door = ctx.copy(), np.ones(len(cp), bool)
    for k in range(int(size.max(initial=0))):
        at = starts[size[starts] > k] + k
        score[at] = 0.0
        says[at] = u[at - k]
        door[at] = k == 0
    before = np.concatenate([[32], says[:-1]]) if len(cp) else says
    score[starts] = model.log(before[starts], u[starts]) + _foreign(u[starts], starts + size[starts], ctx)
    return score - clean, door


def _foreign(u: np.ndarray, after: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """What a character that a state stands for loses by the one after it."""
    follows = np.concatenate([ctx, [32]])[np.minimum(after, len(ctx))]
    latin = (follows >= 65) & (follows <= 122)
    return np.where((script(u) >= 3) & (script(u) <= 4) & latin, MIXED, 0.0)


def _twice_units(cp: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray]:
    """Units of text that was UTF-8 read as ``d`` two times: units of the units."""
    table = ENCODE[d]
    u, size = utf8_units(table[np.where(cp < 0x10000, cp, 0)])
    inner = np.zeros(len(cp) + 8, bool)
    starts = np.flatnonzero(size)
    for k in range(1, int(size.max(initial=1))):
        inner[starts[size[starts] > k] + k] = True
    at = np.flatnonzero(~inner[: len(cp)])
    once = np.where(size > 0, u, cp)[at]
    length = np.where(size > 0, size, 1)[at]
    u2, size2 = utf8_units(table[np.where(once < 0x10000, once, 0)])
    end = np.concatenate([[0], np.cumsum(length)])
    out_u, out_size = np.zeros(len(cp), np.int32), np.zeros(len(cp), np.int8)
    for s in np.flatnonzero(size2).tolist():
        out_u[at[s]], out_size[at[s]] = u2[s], end[s + int(size2[s])] - end[s]
    return out_u, out_size


def _labels(texts: list[str], model: Characters) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every text the likeliest state of every place: -1 clean, len(PAIRS) lost, else the number of a pair. And True
    where quoted. States are scored for many texts at once, then each text's path is searched."""
    for r in portions(texts, TOGETHER):
        yield from _labels_together(texts[r.start : r.stop], model)


def _labels_together(texts: list[str], model: Characters) -> list[tuple[np.ndarray, np.ndarray]]:
    cp, doc = _batch(texts)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    quoted = np.zeros(len(cp), bool)
    for d, t in enumerate(texts):
        for m in _QUOTED.finditer(t) if "`" in t else ():
            quoted[first[d] + m.start() : first[d] + m.end()] = True
    out = [(np.full(len(t), -1, np.int16), quoted[first[d] : first[d + 1] - 1]) for d, t in enumerate(texts)]
    ctx, rare = context(cp), cp >= 128
    at = np.flatnonzero(rare)
    before = np.concatenate([[32], ctx[:-1]])
    clean = np.zeros(len(cp))
    clean[at] = model.log(before[at], cp[at])
    odd = np.zeros(len(cp), bool)
    odd[at] = (clean[at] < DOUBTFUL) | (cp[at] == _LOST)
    told, told_pair, told_gain = model.told(cp)
    odd[told] = True
    odd &= ~quoted
    asked = np.zeros(len(texts), bool)  # a state must explain something that the clean one can't
    asked[doc[odd]] = True
    # from here on only non-ASCII characters and the ones next to them
    rare[1:] |= cp[:-1] >= 128
    rare[:-1] |= cp[1:] >= 128
    rare &= asked[doc]
    if not rare.any():
        return out
    rare[first[1:] - 1] = True  # and the line breaks between texts
    place = np.flatnonzero(rare)
    line = np.cumsum(cp == 10)[place]
    doc_all = doc
    cp, ctx, doc, quoted, clean, odd = cp[place], ctx[place], doc[place], quoted[place], clean[place], odd[place]
    seen = asked[doc_all[told]]
    told, told_pair, told_gain = np.searchsorted(place, told[seen]), told_pair[seen], told_gain[seen]
    at = np.flatnonzero(cp >= 128)
    of, free, low = doc[at], ~quoted[at], np.where(cp < 0x10000, cp, 0)
    offered: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    part = np.searchsorted(of, np.arange(len(texts) + 1))

    def docs_with(places: np.ndarray) -> np.ndarray:
        got = np.zeros(len(texts), bool)
        got[doc[places]] = True
        return got

    def offer(state: int, gain: np.ndarray, door: np.ndarray | None, to: np.ndarray) -> None:
        gain = np.where(free, gain[at], 0.0)
        door = np.ones(len(at), bool) if door is None else door[at]
        worth = np.bincount(of, np.maximum(gain, 0), len(texts)) > -(ENTER + LEAVE)
        for d in np.flatnonzero(worth & to).tolist():
            a, b = part[d], part[d + 1]
            offered[d].append((state, gain[a:b], door[a:b]))

    raw = {d: ENCODE[d][low] for d in SINGLE}
    for i, (e, d) in enumerate(PAIRS):
        if d in WIDE:
            to = docs_with(odd & (cp > 0x2E80))
            if to.any():
                units = [(first[k] + a, first[k] + b, says) for k in np.flatnonzero(to).tolist() for a, b, says in _wide_units(texts[k], WIDE[d])]
                where = np.searchsorted(place, [x[0] for x in units])
                offer(i, *_wide_gains([(int(w), int(w + b - a), says) for w, (a, b, says) in zip(where, units)], cp, ctx, clean, model), to)
            continue
        b = raw[d]
        to = docs_with(odd & (b >= (0x81 if e in DOUBLE else 0)))
        if not to.any():
            continue
        if e == "utf-8":
            offer(i, *_unit_gains(utf8_units(_with_spaces(cp, b)), cp, ctx, clean, model), to)
        elif e == TWICE:
            offer(i, *_unit_gains(_twice_units(cp, d), cp, ctx, clean, model), to)
        elif e in DOUBLE:
            offer(i, *_unit_gains(_double_units(cp, np.where(to[doc], b, -1), DOUBLE[e]), cp, ctx, clean, model), to)
        else:
            says = np.where(b >= 0, DECODE[e][np.maximum(b, 0)], ctx)
            can = np.flatnonzero(odd & (b >= 0))
            to = docs_with(can[model.knows(says[can])])
            if to.any():
                prev = np.concatenate([[32], says[:-1]])
                gain = np.full(len(cp), IMPOSSIBLE)
                can = at[(b[at] >= 0) & to[of]]
                gain[can] = model.log(prev[can], says[can]) + _foreign(says[can], can + 1, ctx) - clean[can]
                gain[told[told_pair == i]] += told_gain[told_pair == i]
                offer(i, gain, None, to)
    offer(len(PAIRS), np.where(cp == _LOST, -UNKNOWN, IMPOSSIBLE), None, asked)
    for d, states in enumerate(offered):
        if states:
            mine = at[part[d] : part[d + 1]]
            out[d][0][place[mine] - first[d]] = _path([x[0] for x in states], np.stack([x[1] for x in states], 1), np.stack([x[2] for x in states], 1), place[mine], line[mine])
    return out


def _path(states: list[int], g: np.ndarray, doors: np.ndarray, at: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The likeliest state of each place ``at`` of a text, by the gains ``g`` [place, state] and where states may be entered."""
    common = np.array([s == len(PAIRS) or PAIRS[s][0] in ("utf-8", TWICE, "latin") for s in states])
    enter = np.where(doors, np.where(common, ENTER, ENTER + UNCOMMON), -np.inf)
    m, k = g.shape
    entered, before_hub = np.zeros((m, k), bool), np.full(m, -1, np.int16)
    clean_score, v = 0.0, np.full(k, -np.inf)
    for t in range(m):
        best = int(v.argmax())
        if v[best] + LEAVE >= clean_score:  # of equal paths the one that leaves last, so with its units whole
            clean_score, before_hub[t] = v[best] + LEAVE, best
        fresh = clean_score + enter[t]
        entered[t] = fresh >= v
        v = np.maximum(v, fresh) + g[t]
    best = int(v.argmax())
    s = best if v[best] + LEAVE > clean_score else -1
    path = np.full(m, -1, np.int16)
    for t in range(m - 1, -1, -1):
        if s >= 0:
            path[t] = states[s]
        if s < 0 or entered[t, s]:
            s = int(before_hub[t])
    _spread(path, at, g, states, line)
    return path


def _spread(path: np.ndarray, at: np.ndarray, g: np.ndarray, states: list[int], line: np.ndarray) -> None:
    """Let a span take in the clean characters next to it, within REACH places, that its state explains about as well
    as the clean state: a span's first and last letters may by themselves look like either. Beyond ASCII characters, a run of others is taken
    only if the state explains all of it that well."""
    column = {s: k for k, s in enumerate(states)}
    run = np.cumsum(np.diff(at, prepend=-1) != 1) - 1
    of_run = np.add.reduceat(g, np.flatnonzero(np.diff(run, prepend=-1)), axis=0)
    for order in (range(1, len(path)), range(len(path) - 2, -1, -1)):
        step = order.step
        for t in order:
            s = path[t - step]
            if path[t] < 0 and s >= 0 and abs(int(at[t]) - int(at[t - step])) <= REACH and line[t] == line[t - step] and g[t, column[s]] > SIMILAR:
                if run[t] == run[t - step] or of_run[run[t], column[s]] > SIMILAR:
                    path[t] = s


Span = tuple[int, int, str, str]


def restore_all(texts: list[str], model: Characters) -> list[tuple[str, list[Span], bool]]:
    """Every text with its labelled spans turned back; the spans of the given text: (start, end, true encoding, read
    as); and whether nothing garbled or lost is left. Lost characters stay, as ('', 'replaced'). Rounds after the first
    undo repeated garbling; their spans are reported at the places of the first."""
    now, spans, whole = list(texts), [[] for _ in texts], [True] * len(texts)
    left = list(range(len(texts)))
    for round_ in range(ROUNDS + 1):
        changed = []
        for d, (label, quoted) in zip(left, _labels([now[d] for d in left], model)):
            marked = np.flatnonzero(label >= 0)
            whole[d] = not len(marked)
            if not len(marked) or round_ == ROUNDS:
                continue
            if round_ == 0:
                edge = np.flatnonzero((np.diff(label[marked]) != 0) | (np.diff(marked) > 40)) + 1
                for part in np.split(marked, edge):
                    e, read = PAIRS[label[part[0]]] if label[part[0]] < len(PAIRS) else ("", "replaced")
                    spans[d].append((int(part[0]), int(part[-1]) + 1, e, read))
            new = _turn_back(now[d], label, quoted)
            if new != now[d]:
                now[d] = new
                changed.append(d)
        left = changed
        if not left:
            break
    return [(t, s, w and chr(_LOST) not in t) for t, s, w in zip(now, spans, whole)]


def restore(text: str, model: Characters) -> tuple[str, list[Span]]:
    """``restore_all`` of one text: the text and its spans."""
    return restore_all([text], model)[0][:2]


def _turn_back(text: str, label: np.ndarray, quoted: np.ndarray) -> str:
    out, i, n = [], 0, len(text)
    while i < n:
        s = int(label[i])
        if s < 0 or s >= len(PAIRS) or quoted[i]:
            out.append(text[i])
            i += 1
            continue
        j = i
        e, d = PAIRS[s]
        while j < n and (label[j] == s and not quoted[j] or (j > i and label[j - 1] == s and (e in DOUBLE and 0x40 <= ord(text[j]) < 0x7F or e == "utf-8" and d in SINGLE and text[j] == " " and _byte(text[j - 1], d) == _A_GRAVE[0]))):
            j += 1
        out.append(_inverse(text[i:j], e, d))
        i = j
    return "".join(out)


def _byte(c: str, d: str) -> int:
    return int(ENCODE[d][ord(c)]) if ord(c) < 0x10000 else -1


def _inverse(run: str, e: str, d: str) -> str:
    """A run read as ``d`` in its true encoding ``e``; as it is, where its bytes say nothing there."""
    try:
        if d in WIDE:  # unit by unit: what is none stays
            at, out = 0, []
            for start, end, says in _wide_units(run, WIDE[d]):
                out += [run[at:start], says]
                at = end
            return "".join(out) + run[at:]
        if e == TWICE:
            return _inverse(_inverse(run, "utf-8", d), "utf-8", d)
        raw = bytes(int(ENCODE[d][c]) if (c := ord(x)) >= 128 else c for x in run)
        if e in SINGLE:
            return "".join(chr(DECODE[e][b]) for b in raw)
        if e == "utf-8":
            raw = raw.replace(_A_GRAVE[:1] + b" ", _A_GRAVE)
        return raw.decode(DOUBLE.get(e, e))
    except (UnicodeDecodeError, UnicodeEncodeError, ValueError, IndexError):
        return run


def doubtful(texts: list[str | None], model: Characters) -> np.ndarray:
    """The numbers of the texts that hold a lost or an unlikely character, or one in the surroundings of a misread one: only
    these are asked further."""
    cp, doc = _batch(texts)
    at = np.flatnonzero(cp >= 128)
    if not len(at):
        return at
    before = np.concatenate([[32], context(cp)[:-1]])[at]
    odd = (model.log(before, cp[at]) < DOUBTFUL) | (cp[at] == _LOST)
    return np.unique(doc[np.concatenate([at[odd], model.told(cp)[0]])])


def find_garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Characters | None = None) -> DataFrame:
    """Documents with any stretch of text that was read in a wrong encoding, and the text restored.

    A hidden Markov model labels every non-ASCII character of the whole text: one clean state, one state for each
    pair (true encoding, read as), one for characters lost to U+FFFD. A state emits a character with the
    probability that the corpus gives the character it stands for after the one before; ASCII looks alike in
    all states and tells nothing. Leaving the clean state and coming back costs, so stray rare letters stay clean.
    Each labelled span gets its state's inverse transform, again for text garbled twice.

    ``model``: character statistics, by default those of ``docs`` (one more pass over them; broadcast, bounded by the
    rarity threshold). Characters in backticks are quoted on purpose and judged neither way.

    Result: doc_id, ``spans`` (start, end, true_encoding, read_as), ``restored`` (the text), ``whole`` (false if any character
    was lost or a span had no inverse). Null and empty texts are clean; repeated ids are documents of their
    own. No shuffle besides the statistics.
    """
    model = character_statistics(docs, text) if model is None else model
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("true_encoding", T.StringType()), T.StructField("read_as", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("spans", T.ArrayType(span)), T.StructField("restored", T.StringType()), T.StructField("whole", T.BooleanType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column("t").to_pylist()
            asked = [r.start + d for r in portions(texts) for d in doubtful(texts[r.start : r.stop], m).tolist()]
            rows = [(d, *x) for d, x in zip(asked, restore_all([texts[d] for d in asked], m)) if x[1]]
            at, restored, spans, whole = zip(*rows) if rows else ((), (), (), ())
            spans = [[dict(zip(span.names, x)) for x in of] for of in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column("i").take(pa.array(at, pa.int64())), pa.array(spans, to_arrow_type(schema["spans"].dataType)), pa.array(restored, pa.string()), pa.array(whole, pa.bool_())], schema.names
            )

    return over_cores(docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))).mapInArrow(scan, schema)
