"""Words of a text, the same whatever its case, punctuation, spacing, markup and comment marks."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

#: Tags and link targets are skipped; an entity is part of the word around it until it is unescaped;
#: joiners, soft hyphens and combining marks are parts of words too.
_PIECES = re.compile(
    r"</?[A-Za-z][^<>]*>|\]\([^()\s]*\)|((?:[^\W_]|&(?:[A-Za-z]{2,8}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,6});|[­​-‍⁠﻿̀-ͯ])+)"
)
#: All words, those in tags and link targets too.
_ALL_PIECES = re.compile(_PIECES.pattern[_PIECES.pattern.index("((?:") :])
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: What surely is markup: a name and attributes with values that can't hold a passage.
_PLAIN_TAG = re.compile(r"""</?[A-Za-z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:"(?:[^"<>\s]*\s+){0,8}[^"<>\s]*"|'(?:[^'<>\s]*\s+){0,8}[^'<>\s]*'|[^\s"'<>=]+))*\s*/?>""")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def _clean(piece: str) -> tuple[str, ...]:
    """The words of a piece; the usual ones are worked out once."""
    return _usual(piece) if len(piece) <= 40 else _cleaned(piece)


def _cleaned(piece: str) -> tuple[str, ...]:
    if "&" in piece:
        piece = html.unescape(piece)
    if piece.isascii():
        found = piece.lower()
        return (found,) if found.isalnum() else tuple(_WORD.findall(found))
    return tuple(_WORD.findall(unicodedata.normalize("NFKC", piece.translate(_INVISIBLE)).casefold()))


_usual = lru_cache(1 << 17)(_cleaned)


def has_doubtful_tags(text: str) -> bool:
    """Whether something that ``words`` skips as a tag may be none ('i<n; ... ->'), or holds prose in an attribute:
    such a text has a second reading, with the words in tags."""
    return "<" in text and any(not _PLAIN_TAG.fullmatch(m.group()) for m in _TAG.finditer(text))


def words(text: str, tags: bool = False) -> list[str]:
    """The normalised words of the whole text, in order; with ``tags``, those in tags and link targets too."""
    pieces = _ALL_PIECES if tags else _PIECES
    if text.isascii() and "&" not in text:
        return [w for w in pieces.findall(text.lower()) if w]
    return [w for piece in pieces.findall(text) if piece for w in _clean(piece)]


def spans(text: str, tags: bool = False) -> list[tuple[int, int]]:
    """Where each of ``words(text, tags)`` lies in the text, as (start, end)."""
    out = []
    for m in (_ALL_PIECES if tags else _PIECES).finditer(text):
        if m.group(1):
            out += [m.span(1)] * len(_clean(m.group(1)))
    return out


def portions(texts: list[str | None], most: int = 4_000_000) -> list[range]:
    """The numbers of the texts in runs of at most ``most`` characters, or of one longer text: what is worked on at once."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            out.append(range(start, i))
            start, size = i, 0
        size += n
    return [*out, range(start, len(texts))] if len(texts) > start else out
