"""Synthetic spelling errors, and the errors that two versions of a sentence differ by."""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from hashlib import md5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CANDIDATE = re.compile(r"['A-Za-zА-ЯЄІЇҐа-яєіїґ]{4,}")
_UKRAINIAN = frozenset("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя'")
_PAIRS = "иі еє оа ую ть шщ пр нм".split()
SIMILAR = {a: b for p in _PAIRS for a, b in (p, p[::-1])} | {"а": "о"}
LOOKALIKE = dict(zip("aceiopxyACEIOPXY", "асеіорхуАСЕІОРХУ"))
_SAME = ("CORRECT",) * 2
_TOKEN = re.compile(r"[\w'’-]+")


class Draw:
    """Numbers from the md5 of a key: the same wherever and whenever a row is worked on."""

    def __init__(self, key: str) -> None:
        self.key, self.n = key, 0

    def below(self, n: int) -> int:
        self.n += 1
        return int(md5(f"{self.key}|{self.n}".encode()).hexdigest()[:12], 16) % n

    def order(self, items: list) -> list:
        items = list(items)
        for i in range(len(items) - 1, 0, -1):
            j = self.below(i + 1)
            items[i], items[j] = items[j], items[i]
        return items


def candidates(sentence: str, letters: int = 3, alphabet: frozenset[str] = _UKRAINIAN) -> list[tuple[int, str]]:
    """Words of four characters with enough letters of the alphabet, and where they start."""
    return [(m.start(), m[0]) for m in _CANDIDATE.finditer(sentence) if sum(ch in alphabet for ch in m[0].lower()) >= letters]


def swap(w: str, d: Draw) -> str:
    i = d.below(len(w) - 1) if len(w) > 1 else 0
    return w[:i] + w[i : i + 2][::-1] + w[i + 2 :]


def drop(w: str, d: Draw) -> str:
    if len(w) < 5:
        return w
    i = d.below(len(w))
    return w[:i] + w[i + 1 :]


def double(w: str, d: Draw) -> str:
    i = d.below(len(w))
    return w[: i + 1] + w[i:]


def _exchange(w: str, d: Draw, table: Callable[[str], str | None]) -> str:
    places = [i for i, ch in enumerate(w) if table(ch)]
    if not places:
        return w
    i = places[d.below(len(places))]
    return w[:i] + table(w[i]) + w[i + 1 :]


def _similar(ch: str) -> str | None:
    other = LOOKALIKE.get(ch, SIMILAR.get(ch.lower()))
    return other.upper() if other and ch.isupper() else other


def substitute(w: str, d: Draw) -> str:
    return _exchange(w, d, _similar)


def homoglyph(w: str, d: Draw) -> str:
    return _exchange(w, d, LOOKALIKE.get)


STRATEGIES = (swap, drop, double, substitute, homoglyph)


def typo(word: str, d: Draw) -> str | None:
    """By the first strategy, in random order, that changes the word."""
    return next((t for f in d.order(STRATEGIES) if (t := f(word, d)) != word and t), None)


def inject(sentence: str, key: str, alphabet: frozenset[str] = _UKRAINIAN) -> tuple[str, str, str] | None:
    """Sentence with one word spelt wrong, the wrong and the right word; the wrong word stands in it once."""
    d = Draw(key)
    for at, word in d.order(candidates(sentence, alphabet=alphabet)):
        wrong = typo(word, d)
        if wrong and (out := sentence[:at] + wrong + sentence[at + len(word) :]).count(wrong) == 1:
            return out, wrong, word
    return None


def injected(sentence: Column, key: Column, correct: Column, seed: int = 42, alphabet: frozenset[str] = _UKRAINIAN) -> Column:
    """struct<input,wrong,right>: an error unless `correct` or where none can be made; then CORRECT."""

    @F.pandas_udf("input string, wrong string, right string")
    def run(s: pd.Series, k: pd.Series, ok: pd.Series) -> pd.DataFrame:
        rows = [((None if c else inject(t, f"{seed}|{i}", alphabet)) or (t, "CORRECT", "CORRECT")) if t is not None else (None, "CORRECT", "CORRECT") for t, i, c in zip(s, k, ok)]
        return pd.DataFrame(rows, columns=["input", "wrong", "right"], dtype=object)

    return run(sentence, key.cast("string"), correct)


def _changes(a, b) -> list[tuple[int, int, int, int]]:
    return [x[1:] for x in SequenceMatcher(None, a, b).get_opcodes() if x[0] != "equal"]


def difference(source: str | None, target: str | None) -> tuple[str, str, int]:
    """The first words that differ (else characters), an empty side filled with the other, and the number of such regions."""
    source, target = source or "", target or ""
    if not _changes([source.strip()], [target.strip()]):
        return *_SAME, 0
    a, b = _TOKEN.findall(source), _TOKEN.findall(target)
    by_word, regions, pair = _changes(a, b), 0, None
    for x, y, glue, found in ((a, b, " ", by_word), (source, target, "", None)):
        found = _changes(x, y) if found is None else found
        regions = regions or len(found)
        for i, j, k, m in found:
            left, right = glue.join(x[i:j]).strip(), glue.join(y[k:m]).strip()
            if left or right:
                pair = left or right, right or left
                break
        if pair:
            break
    return *(pair or _SAME), regions


def differing(source: Column, target: Column) -> Column:
    """struct<wrong,right,regions> of two versions of a sentence."""

    @F.pandas_udf("wrong string, right string, regions int")
    def run(s: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([difference(a, b) for a, b in zip(s, t)], columns=["wrong", "right", "regions"])

    return run(source, target)
