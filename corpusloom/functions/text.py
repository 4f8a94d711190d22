"""Text projections. Native expressions throughout; Python only for Unicode normalisation, which Spark SQL lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad"
CONTROL = r"[\p{Cc}&&[^\t\n\r\x80-\x9f]]"
UKRAINIAN = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя'"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition. Texts of Latin letters without marks (all characters below U+0300) are composed already; the others go to Python, which sees at a glance whether there is something to do (the batch is sent all the same, without the other rows' texts)."""
    open_ = (F.octet_length(c) > F.length(c)) & c.rlike(r"[\x{300}-\x{10FFFF}]")
    return F.when(open_, _nfc(F.when(open_, c))).otherwise(c)


def unicode_clean(c: Column, compose: bool = True) -> Column:
    """Composed, without zero-width and control characters, plain apostrophes, single blanks; line feeds and no-break spaces stay."""
    base = F.coalesce(c, F.lit(""))
    base = nfc(base) if compose else base
    plain = F.translate(base, "\u02bc\u2019" + ZERO_WIDTH, "''")
    return strip(F.regexp_replace(F.regexp_replace(plain, CONTROL, ""), r"[ \t\r\f\x0b]+", " "))


def question_key(c: Column, compose: bool = True) -> Column:
    """Letters, digits and underscores in lower case with single spaces: what questions are matched by."""
    return collapse(F.regexp_replace(F.lower(nfc(c) if compose else c), r"[^\p{L}\p{N}\p{M}_]", " "))


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", ""))


def prediction_text(c: Column) -> Column:
    """A model's answer on one line, without thoughts and outer quotes."""
    bare = F.regexp_replace(strip_thinking(c), r'^"+|"+$', "")
    return collapse(F.regexp_replace(bare, r"^'+|'+$", ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S+"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), 0)


def char_ngrams(c: Column, n: int = 5) -> Column:
    """Distinct n-grams of lower-case characters. Overlapping look-ahead: linear in the text, unlike substring()."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def strip_line_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s*\d+\s*\t", "")


def document_key(c: Column) -> Column:
    """The first two fields of an id line."""
    return F.array_join(F.slice(F.split(c, "\t"), 1, 2), "\t")


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[\p{L}]*\s*", ""), r"\s*```$", ""))


def unpack(c: Column, source: str, target: str) -> list[Column]:
    """The two sides of a struct of translations."""
    return [c.getField(source).alias("source"), c.getField(target).alias("target")]


def options_list(options: Column) -> Column:
    """Entries of a map of options by their numeric keys."""
    entry = lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["key"].alias("key"), e["value"].alias("value"))
    return F.array_sort(F.transform(F.map_entries(options), entry))


def format_options(options: Column) -> Column:
    """Lines "key. text" by numeric key."""
    return F.array_join(F.transform(options_list(options), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def format_lettered(options: Column, labels: str = "АБВГД") -> Column:
    """Lines "letter: text" by numeric key."""
    line = lambda e, i: F.concat(F.substring(F.lit(labels), i + 1, F.lit(1)), F.lit(": "), e["value"])
    return F.array_join(F.transform(options_list(options), line), "\n")


def lettered_answers(options: Column, labels: str = "АБВГД") -> Column:
    """array<struct<marker,text>> of a map of numbered options; those beyond the labels are left out."""
    pair = lambda e, i: F.struct(F.substring(F.lit(labels), i + 1, F.lit(1)).alias("marker"), e["value"].alias("text"))
    return F.slice(F.transform(options_list(options), pair), 1, len(labels))


def choices_map(choices: Column) -> Column:
    """A map by "0", "1", … of a list of choices."""
    return F.map_from_arrays(F.transform(choices, lambda _, i: i.cast("string")), choices)


def question_prompt(question: Column, answers: Column, prefix: Column | str = "", passage: Column | None = None) -> Column:
    """Passage, question and "marker: text" lines, with blank lines between."""
    head = F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, question)
    if passage is not None:
        head = F.when(F.coalesce(passage, F.lit("")) != "", F.concat(passage, F.lit("\n\n"), head)).otherwise(head)
    return F.concat(head, F.lit("\n\n"), F.array_join(F.transform(answers, lambda a: F.concat(a["marker"], F.lit(": "), a["text"])), "\n"))


def with_passage(header: str, passage: Column, stem: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(header), passage, stem)


def error_target(wrong: Column, right: Column) -> Column:
    """CORRECT, or "wrong -> right"."""
    return F.when((wrong == "CORRECT") | (right == "CORRECT"), F.lit("CORRECT")).otherwise(F.concat(wrong, F.lit(" -> "), right))


def token_budget(c: Column) -> Column:
    """Tokens to generate for a chunk: three quarters of its characters and 64, between 384 and 1024."""
    return F.least(F.lit(1024), F.greatest(F.lit(384), (F.length(c) * 0.75 + 64).cast("int")))


def difficulty(identifier: Column) -> Column:
    """By the id's prefix low- or medium-; "default" for any other."""
    return F.when(identifier.startswith("low-"), F.lit("low")).when(identifier.startswith("medium-"), F.lit("medium")).otherwise(F.lit("default"))


def peel_quotes(c: Column) -> Column:
    return strip(F.regexp_replace(strip(c), "^[\"'«»„“”`]+|[\"'«»„“”`]+$", ""))


def content_key(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def in_share(c: Column, tenths: int = 7) -> Column:
    """Whether the md5 of a text, as a number, ends in a digit below `tenths`: 16 to any power is 6 mod 10, so digit sums give it."""
    digest = F.md5(c)
    value = lambda x: F.conv(x, 16, 10).cast("int")
    head = F.aggregate(F.split(F.substring(digest, 1, 31), ""), F.lit(0), lambda acc, x: acc + F.when(x == "", 0).otherwise(value(x)))
    return (head * 6 + value(F.substring(digest, 32, 1))) % 10 < tenths


def subject(text: Column, patterns: dict[str, str], default: str) -> Column:
    """The label whose pattern matches most often; of equals the first; `default` without any match."""
    counts = [F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?iu){p}")) for p in patterns.values()]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.when(most == 0, F.lit(default))
    for label, n in zip(patterns, counts):
        out = out.when(n == most, F.lit(label))
    return out


def count_of(c: Column, inside: str) -> Column:
    """How many characters are of a class, given as what stands between the brackets. Runs are taken out at once, where regexp_count() makes a text of every match."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{inside}]+", ""))


#: Both cases, as ranges: lower() is slow in texts beyond ASCII, and no other character becomes one of these letters by it.
_UKRAINIAN = "а-щА-ЩьюяєіїґЬЮЯЄІЇҐ'"


def ukrainian_letters(c: Column) -> Column:
    return count_of(c, _UKRAINIAN)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
