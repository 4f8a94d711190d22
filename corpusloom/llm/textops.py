"""Vectorised text primitives shared by the corpus operators.

Everything works on a chunk of documents joined into one code-point array, so
the per-document Python cost is a few list operations and the per-character
cost a few numpy passes.  Chunks are bounded by characters (one longer document
is a chunk of its own), which bounds the memory of a Python worker whatever the
Arrow batch size is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

CHUNK_CHARS = 1 << 18
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Is-word flags and single-character lower case, by code point."""
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    category = unicodedata.category
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum() or category(ch)[0] == "M":
            word[c] = True
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return word, lower


@lru_cache(None)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    size = 1
    with np.errstate(over="ignore"):
        while size < n:
            up[size : 2 * size] = up[:size] * (up[size - 1] * _B)
            down[size : 2 * size] = down[:size] * (down[size - 1] * _BINV)
            size *= 2
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, mod 2^64, for n positions."""
    up, down = _powers(max(20, int(n).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Words(NamedTuple):
    """Words of a chunk in order: 64-bit hashes, character spans, document numbers; `first[d]` is document d's first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    base: np.ndarray


def words(texts: list[str]) -> Words:
    """Case-folded runs of letters, digits and marks. Spans count from the chunk's joined text; `base[d]` is where document d begins there."""
    is_word, lower = _tables()
    joined = "\n".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.concatenate(([0], np.cumsum(lens + 1)))
    cp = codepoints(joined)
    flag = np.zeros(len(cp) + 2, np.int8)
    flag[1:-1] = is_word[cp]
    edge = np.diff(flag)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((lower[cp].astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, base)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(h, start, end, doc, first, base)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive items (windows may cross documents; callers mask)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        m = len(h) - n + 1
        return mix((total[n:] - total[:m]) * down[:m])


def hash_bytes(text: str) -> int:
    """Stable signed 64-bit hash of a whole string."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)
