"""Token counts by a public tokenizer, whose file's place is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The public word-splitting pattern that goes with that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longest stretch given to the tokenizer at once. Longer texts are cut, at white space if there is any near.
STRETCH = 100_000


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> Iterable[str]:
    at = 0
    while len(text) - at > STRETCH:
        end = at + STRETCH
        cut = text.rfind(" ", end - 2000, end)
        end = cut if cut > at else end
        yield text[at:end]
        at = end
    yield text[at:]


def count_tokens(texts: Iterable[str | None], path: str = TOKENIZER) -> list[int]:
    """Tokens of each whole text; null and empty texts have none. Unpaired surrogates count as their replacement."""
    enc = encoding(path)
    out = []
    for t in texts:
        n = 0
        for s in stretches(t or ""):
            try:
                n += len(enc.encode_ordinary(s))
            except (UnicodeEncodeError, ValueError, RuntimeError):
                n += len(enc.encode_ordinary(s.encode("utf-8", "replace").decode("utf-8", "replace")))
        out.append(n)
    return out
