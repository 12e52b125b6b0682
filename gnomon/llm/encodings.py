"""Encoding pairs: text of one encoding that was read as another."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Single-byte encodings of the pairs (fixed values). "latin" is cp1252 with ISO 8859-1 where cp1252 has nothing.
SINGLE = {
    "latin": "cp1252", "cp1250": "cp1250", "iso8859-2": "iso8859-2", "cp1251": "cp1251", "koi8-r": "koi8-r", "cp866": "cp866",
    "cp437": "cp437", "cp850": "cp850", "cp852": "cp852", "mac-roman": "mac-roman",
}
#: Multi-byte encodings that text may truly have been in, besides UTF-8.
DOUBLE = {"cp932": "cp932", "euc-jp": "euc-jp"}
#: Multi-byte encodings that UTF-8 may have been read as.
WIDE = {"as-cp932": "cp932", "as-gbk": "gb18030", "as-euc-jp": "euc-jp"}


def _decode_table(codec: str) -> np.ndarray:
    """Code point of each byte; a byte that the encoding leaves open is the control of its number, as readers have it."""
    out = np.arange(256, dtype=np.int32)
    for b in range(128, 256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except (UnicodeDecodeError, TypeError):
            pass
    return out


DECODE = {name: _decode_table(codec) for name, codec in SINGLE.items()}


def _encode_table(name: str) -> np.ndarray:
    """Byte of each code point under U+10000 read by ``name``, -1 for none; ASCII is left out: it tells nothing."""
    out = np.full(0x10000, -1, np.int16)
    out[0x80:0xA0] = np.arange(0x80, 0xA0)
    out[DECODE[name][128:]] = np.arange(128, 256)
    return out


ENCODE = {name: _encode_table(name) for name in SINGLE}

#: Characters that cp932 has twice, by the bytes that can occur in UTF-8.
_CP932_TWICE = {c: b for a in (0xED, 0xEE) for t in range(0x40, 0xFD) if len(c := (b := bytes([a, t])).decode("cp932", "ignore")) == 1}


@lru_cache(1 << 16)
def wide_bytes(c: str, codec: str) -> bytes:
    """The bytes of a character in a multi-byte encoding; none if it has none there."""
    if codec == "cp932" and c in _CP932_TWICE:
        return _CP932_TWICE[c]
    try:
        return c.encode(codec)
    except UnicodeEncodeError:
        return b""


@lru_cache(4)
def double_bytes(codec: str) -> np.ndarray:
    """Code point by first and second byte of an encoding's two-byte characters, 0 for none."""
    out = np.zeros((256, 256), np.int32)
    for a in range(0x81, 0x100):
        for b in range(0x40, 0x100):
            try:
                c = bytes([a, b]).decode(codec)
            except UnicodeDecodeError:
                continue
            out[a, b] = ord(c) if len(c) == 1 else 0
    return out


#: The true encoding of text that went through the same misreading of UTF-8 two times.
TWICE = "utf-8 twice"

#: (true encoding, read as). The order breaks ties: the commoner pairs come first.
PAIRS = (
    [("utf-8", d) for d in SINGLE]
    + [(TWICE, d) for d in SINGLE]
    + [(e, d) for e in SINGLE for d in SINGLE if e != d]
    + [(e, d) for e in DOUBLE for d in SINGLE]
    + [("utf-8", d) for d in WIDE]
)


def utf8_units(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bytes ``b`` (-1: none), where valid multi-byte sequences start and what they say: (code points, 0 for
    none; lengths, 0 for none)."""
    n = len(b)
    p = np.concatenate([b.astype(np.int32), [-1, -1, -1]])
    cont = (p >= 0x80) & (p <= 0xBF)
    u, size = np.zeros(n, np.int32), np.zeros(n, np.int8)
    c1, c2, c3 = p[1 : n + 1], p[2 : n + 2], p[3 : n + 3]
    b = p[:n]
    two = (b >= 0xC2) & (b <= 0xDF) & cont[1 : n + 1]
    three = (b >= 0xE0) & (b <= 0xEF) & cont[1 : n + 1] & cont[2 : n + 2]
    four = (b >= 0xF0) & (b <= 0xF4) & cont[1 : n + 1] & cont[2 : n + 2] & cont[3 : n + 3]
    u[two] = ((b & 0x1F) << 6 | (c1 & 0x3F))[two]
    u3 = (b & 0x0F) << 12 | (c1 & 0x3F) << 6 | (c2 & 0x3F)
    three &= (u3 >= 0x800) & ((u3 < 0xD800) | (u3 > 0xDFFF))
    u[three] = u3[three]
    u4 = (b & 0x07) << 18 | (c1 & 0x3F) << 12 | (c2 & 0x3F) << 6 | (c3 & 0x3F)
    four &= (u4 >= 0x10000) & (u4 <= 0x10FFFF)
    u[four] = u4[four]
    size[two], size[three], size[four] = 2, 3, 4
    return u, size
