"""Stages of pair cleaning. A stage is a column: struct<reason, score>, reason null for pairs that pass.

All rules but the model seams are native expressions, so a chain of stages is one
projection in one code-generated stage, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLDS: dict[str, dict[str, float]] = {
    pair: {"src": (10, 1000), "tgt": (5, 1200), "chars": chars, "words": words}
    for pair, chars, words in (("en-uk", (0.50, 2.20), (0.25, 4.00)), ("cs-uk", (0.60, 1.80), (0.30, 3.50)))
}
COPY = {"cs-uk": (0.60, 1.80, 0.15), "en-uk": (0.50, 2.20, 0.20)}
WEIGHTS = dict(zip(("semantic", "uk_quality", "structural", "qe"), (0.35, 0.35, 0.15, 0.15)))
RUSSIAN = "бы был была были вот всё ведь даже другой его если ещё же здесь или какой когда который между нет они очень перед после потому сам себя сейчас так такой там тогда тоже только уже через что чтобы это".split()
URL = r"www\.\S+|https?://\S+"
NUMBER = r"(?U)\b\d(?:[\s\d'.,]*\d|\b)"


def thresholds(pair: str, overrides: dict | None = None) -> dict:
    """The pair's bounds (those of en-uk for pairs without any), with overrides."""
    return THRESHOLDS.get(pair, THRESHOLDS["en-uk"]) | (overrides or {})


def _outcome(rules: list[tuple[Column, str]], score: Column) -> Column:
    """The first broken rule's name; the score of pairs that break none, else 0."""
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    any_broken = rules[0][0]
    for broken, _ in rules[1:]:
        any_broken = any_broken | broken
    return F.struct(reason.alias("reason"), F.when(any_broken, F.lit(0.0)).otherwise(score).alias("score"))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def empty(src: Column, tgt: Column) -> Column:
    """After Unicode cleaning: a side without any text."""
    return _outcome([((F.coalesce(src, F.lit("")) == "") | (F.coalesce(tgt, F.lit("")) == ""), "empty")], F.lit(1.0))


def structural(src: Column, tgt: Column, pair: str = "en-uk", overrides: dict | None = None) -> Column:
    """Lengths and ratios within bounds; the score is the mean of terminal signs, brackets and quotes."""
    t = thresholds(pair, overrides)
    ns, nt, ws, wt = F.length(src), F.length(tgt), T.word_count(src), T.word_count(tgt)
    outside = lambda x, span: (x < span[0]) | (x > span[1])
    rules = [
        (ns < t["src"][0], "src_too_short"),
        (ns > t["src"][1], "src_too_long"),
        (nt < t["tgt"][0], "tgt_too_short"),
        (nt > t["tgt"][1], "tgt_too_long"),
        (F.coalesce(outside(F.try_divide(ns, nt), t["chars"]), F.lit(True)), "char_ratio"),
        (F.coalesce(outside(F.try_divide(ws, wt), t["words"]), F.lit(False)), "word_ratio"),
    ]
    ends = lambda c: c.rlike(r"(?U)[.!?]\s*$")
    blank = lambda c: ~c.rlike(r"\S")
    # a side without text has no last sign, which counts as one that ends a sentence
    terminal = F.when(~(ends(src) | blank(src)) | ends(tgt) | blank(tgt), 1.0).otherwise(0.5)
    balance = lambda c: F.abs(_count(c, r"\(") - _count(c, r"\)"))
    brackets = F.when((balance(src) == 0) & (balance(tgt) == 0), 1.0).when(balance(src) == balance(tgt), 0.8).otherwise(0.4)
    apart = F.abs(_count(src, "[\"'«»]") - _count(tgt, "[\"'«»]"))
    quotes = F.when(apart == 0, 1.0).when(apart <= 1, 0.7).otherwise(0.3)
    return _outcome(rules, (terminal + brackets + quotes) / 3)


def entity(src: Column, tgt: Column) -> Column:
    """Numbers, addresses, brackets and per cents agree."""
    a, b = (F.regexp_extract_all(c, F.lit(NUMBER), 0) for c in (src, tgt))
    apart = F.abs(F.size(a) - F.size(b))
    large = F.filter(a, lambda n: F.length(F.translate(n, ",.", "")) >= 4)
    urls, percent = (F.abs(_count(src, p) - _count(tgt, p)) for p in (URL, r"(?U)\d+\s*%"))
    balance = lambda c: _count(c, r"[(\[{]") - _count(c, r"[)\]}]")
    rules = [
        (apart > F.greatest(F.lit(1), F.floor(F.size(a) / 4)), "number_count"),
        (~F.forall(large, lambda n: F.contains(tgt, n)), "large_number"),
        (urls > 0, "url"),
        (percent > 1, "percent"),
    ]
    parts = (1 - F.least(F.lit(1.0), apart * 0.3)) + 1 + F.when(F.abs(balance(src) - balance(tgt)) <= 1, 1.0).otherwise(0.5) + (1 - percent * 0.2)
    return _outcome(rules, parts / 4)


def copied(src: Column, tgt: Column, pair: str = "en-uk", latin: float | None = None) -> Column:
    """Targets that are a copy of their source, or in the wrong script. `latin`: largest share of ASCII letters, 1 to allow any."""
    low, high, most = COPY.get(pair, COPY["en-uk"])
    most = most if latin is None else latin
    ratio = F.greatest(F.length(tgt), F.lit(1)) / F.greatest(F.length(src), F.lit(1))
    share = F.try_divide(_count(tgt, "[A-Za-z]"), _count(tgt, r"\p{L}"))
    a, b = (F.array_distinct(T.words(F.lower(c))) for c in (src, tgt))
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    rules = [
        ((ratio <= low) | (ratio >= high), "char_ratio_oob"),
        (F.coalesce(share > most, F.lit(False)) & ~src.rlike(URL), "high_latin_in_target"),
        ((F.size(a) > 3) & (F.size(b) > 3) & F.coalesce(overlap > 0.70, F.lit(False)), "high_token_overlap"),
    ]
    return _outcome(rules, F.lit(1.0))


_OWN, _FOREIGN = "іїєґІЇЄҐ", "ыэъЫЭЪ"
#: А to я, and the letters that only Ukrainian has; ё isn't among them.
_CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + _OWN
#: In both cases, as lower() is slow in Cyrillic texts.
_LISTED = rf"(?<!\S)(?:{'|'.join(''.join(f'[{x}{x.upper()}]' for x in w) for w in RUSSIAN)})(?!\S)"


def _letters(c: Column, letters: str) -> Column:
    """How often any of the letters occurs."""
    return F.length(c) - F.length(F.translate(c, letters, ""))


def uk_quality(c: Column) -> Column:
    """Share of letters that only Ukrainian has, less Russian letters and function words; 0.5 without Cyrillic."""
    cyrillic, own, foreign = (_letters(c, x) for x in (_CYRILLIC, _OWN, _FOREIGN))
    listed = _count(c, f"(?U){_LISTED}")
    penalty = F.coalesce(F.least(F.lit(1.0), F.try_divide(listed, T.word_count(c)) * 10), F.lit(0.0))
    score = own / cyrillic * 0.5 + (1 - F.least(F.lit(1.0), foreign / cyrillic * 5)) * 0.3 + (1 - penalty) * 0.2
    return F.when(F.coalesce(cyrillic, F.lit(0)) == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def quality(tgt: Column, least: float = 0.0) -> Column:
    """uk_quality() as a stage; with `least` 0 nothing is rejected."""
    score = uk_quality(tgt)
    return F.struct(F.when(score < least, F.lit("uk_quality")).alias("reason"), score.alias("score"))


def language(src: Column, tgt: Column, pair: str, identify: Callable[[list[str]], list[tuple[str, float]]] | None, least: float = 0.95) -> Column:
    """Both sides in the expected language; `identify` maps texts to labels and confidences. Without one, nothing is rejected."""
    if identify is None:
        return F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("score"))

    @F.pandas_udf("label string, conf double")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(identify(s.fillna("").tolist()), columns=["label", "conf"])

    expected = pair.split("-")
    bad = [~F.coalesce((run(c)["label"] == want) & (run(c)["conf"] >= least), F.lit(False)) for c, want in ((src, expected[0]), (tgt, "uk" if len(expected) < 2 else expected[1]))]
    return _outcome([(bad[0], "source_language"), (bad[1], "target_language")], F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of floats, in double precision; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic(a: Column | None, b: Column | None, least: float = 0.85) -> Column:
    """Cosine of the two sides' embeddings; without embeddings nothing is rejected."""
    if a is None or b is None:
        return F.struct(F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("score"))
    score = cosine(a, b)
    return F.struct(F.when(F.coalesce(score < least, F.lit(True)), F.lit("semantic")).alias("reason"), score.alias("score"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def composite(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the scores that are there; null without any of them."""
    w = weights or WEIGHTS
    if not set(scores) & set(w):
        return F.lit(None).cast("double")
    terms = [(F.coalesce(c * w[k], F.lit(0.0)), F.when(c.isNull(), 0.0).otherwise(w[k])) for k, c in scores.items() if k in w]
    total, weight = terms[0]
    for a, b in terms[1:]:
        total, weight = total + a, weight + b
    return F.try_divide(total, weight)


def estimated(scores: dict[str, Column], least: float = 0.50, weights: dict[str, float] | None = None) -> Column:
    """composite() as a stage; pairs without any score have 0 and are rejected."""
    score = F.coalesce(composite(scores, weights), F.lit(0.0))
    return F.struct(F.when(F.coalesce(score < least, F.lit(True)), F.lit("composite")).alias("reason"), score.alias("score"))
