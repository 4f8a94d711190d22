"""Pre-tokenisation of whole chunks: the split pattern of byte-level BPE as array operations.

The pattern (contractions, then an optional space with letters, with numbers or
with other signs, then blanks without their last one if something follows) needs
one look at the neighbouring characters, so its boundaries follow from runs of
character classes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .textops import codepoints

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _BLANK, _WALL = range(5)


@lru_cache(None)
def compiled():
    import regex

    return regex.compile(PATTERN)


@lru_cache(None)
def _classes() -> np.ndarray:
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.int8)
    for kind, what in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\s")):
        out[codepoints("".join(regex.findall(what + "+", everything)))] = kind
    return out


def starts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts (a line feed between), where each pre-token starts and ends there. Separators belong to none."""
    joined = "\n".join(texts)
    if not joined:
        return joined, np.empty(0, np.int64), np.empty(0, np.int64)
    cp = codepoints(joined)
    n = len(cp)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # one past each separator
    wall = ends[:-1] - 1
    kind = np.empty(n + 2, np.int8)
    kind[0] = kind[-1] = _WALL
    kind[1:-1] = _classes()[cp]
    kind[wall + 1] = _WALL
    here, before, after = kind[1:-1], kind[:-2], kind[2:]
    blank = here == _BLANK
    first = here != before
    space = np.zeros(n + 1, bool)
    space[1:] = (cp == 32) & blank
    flag = first & ~space[:-1]  # a run starts unless the space before it belongs to it; runs of blanks start too
    flag |= blank & first
    flag |= blank & (after != _BLANK) & (after != _WALL)
    flag[wall] = False
    # contractions: an apostrophe that starts a token, then one of s t m d re ve ll
    quote = np.flatnonzero((cp == 39) & flag)
    if len(quote):
        pad = np.concatenate((cp, np.zeros(2, np.uint32)))
        a, b = pad[quote + 1], pad[quote + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for at, size in ((quote[one], 1), (quote[two], 2)):
            flag[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            flag[rest[here[rest] == _LETTER]] = True
    begin = np.flatnonzero(flag)
    wall_at = np.concatenate((wall, [n]))
    end = np.concatenate((begin[1:], [n]))
    if len(wall):
        # the last token of a text ends at the separator
        end = np.minimum(end, wall_at[np.searchsorted(wall_at, begin)])
    return joined, begin, end


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens in order, and how many of them each text has."""
    joined, begin, end = starts(texts)
    pieces = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    base = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))))
    return pieces, np.diff(np.searchsorted(begin, base))
