"""Row predicates of the corpus builders. All are columns for where(), so Catalyst pushes what it can into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def filled(*columns: Column) -> Column:
    """None of them is null or blank."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(c, F.lit("")).rlike(r"(?U)\S")
    return out


def word_window(src: Column, tgt: Column, least: int = 3, most: int = 100, ratio: float = 3.0) -> Column:
    a, b = T.word_count(src), T.word_count(tgt)
    return a.between(least, most) & b.between(least, most) & (a / F.greatest(b, F.lit(1))).between(1 / ratio, ratio)


def long_enough(src: Column, tgt: Column, chars: int = 30, parts: int = 5) -> Column:
    """Characters, and parts between single spaces, on both sides."""
    side = lambda c: (F.length(c) >= chars) & (F.size(F.split(c, " ", -1)) >= parts)
    return filled(src, tgt) & side(src) & side(tgt)


def mined(laser: Column, src_lid: Column | None, tgt_lid: Column | None, least: float = 1.17, src: tuple = (0.95, 9.0), tgt: tuple = (0.98, 9.0)) -> Column:
    """Mined pairs by their scores, given as text or numbers; what is no number fails, a column that isn't there passes."""
    out = laser.try_cast("double") >= least
    for c, (low, high) in ((src_lid, src), (tgt_lid, tgt)):
        if c is not None:
            out = out & c.try_cast("double").between(low, high)
    return F.coalesce(out, F.lit(False))


STRICT = {"src": (0.97, 1.01), "tgt": (0.99, 1.01)}


def laser_or_unscored(laser: Column, least: float = 1.2) -> Column:
    return laser.isNull() | (laser >= least)


def clean_prose(c: Column) -> Column:
    """Mostly Cyrillic, few digits, some word."""
    n, cyrillic, digits = (T.count_of(c, p) for p in (r"\p{L}\p{N}_", "\\x{0400}-\\x{04FF}", r"\p{Nd}"))
    return (n > 0) & F.coalesce(F.try_divide(cyrillic, n) >= 0.6, F.lit(False)) & (digits / F.greatest(F.length(c), F.lit(1)) <= 0.15)


def dialogue(c: Column) -> Column:
    """Starts with a dash, or stands in quotes as a whole."""
    s = T.strip(c)
    quoted = r"^«.*»[.!?…]*$|^„.*“[.!?…]*$|^“.*”[.!?…]*$|^\".*\"[.!?…]*$"
    return s.rlike("^[—–-]") | s.rlike(f"(?s){quoted}")


def chunk_kept(body: Column, sentences: Column, low: int = 300, high: int = 700, most_dialogue: float = 0.3) -> Column:
    """Words within 0.8 of the least and 1.2 of the most, clean, and not too much direct speech."""
    share = F.coalesce(F.try_divide(F.size(F.filter(sentences, dialogue)), F.size(sentences)), F.lit(0.0))
    return T.word_count(body).between(0.8 * low, 1.2 * high) & clean_prose(body) & (share <= most_dialogue)


def char_window(src: Column, tgt: Column, low: int, high: int) -> Column:
    return F.length(src).between(low, high) & F.length(tgt).between(low, high)


def length_bucket(words: Column) -> Column:
    return F.when(words.between(50, 250), F.lit("short")).when((words > 250) & (words < 800), F.lit("medium"))


def single_error(n: Column) -> Column:
    return n <= 1


def usable_choice(c: Column) -> Column:
    """Long enough to hide an error in: 12 characters, 4 Ukrainian letters."""
    return (F.length(T.strip(c)) >= 12) & (T.ukrainian_letters(c) >= 4)


def reasoned(score: Column, reasoning: Column) -> Column:
    return (score == 1) & filled(reasoning)


def one_correct(answers: Column, correct: Column) -> Column:
    """There are answers, one marker is correct, and an answer bears it."""
    return (F.size(answers) > 0) & (F.size(correct) == 1) & F.exists(answers, lambda a: a["marker"] == F.try_element_at(correct, F.lit(1)))


def numbered_question(number: Column, answers: Column, *texts: Column) -> Column:
    """A known number from 1 to the count of answers, none of which is blank."""
    return number.try_cast("int").between(1, F.size(answers)) & F.forall(answers, lambda a: filled(a)) & filled(*texts)


def keyed_question(key: Column, choices: Column) -> Column:
    """A key that is the text of one of 2 to 5 choices; blank choices don't count, blanks at ends don't matter."""
    kept = filled_choices(choices)
    return filled(key) & F.size(kept).between(2, 5) & F.array_contains(kept, T.strip(key))


def filled_choices(choices: Column) -> Column:
    """The choices that aren't null or blank, without blanks at their ends."""
    return F.filter(F.transform(choices, T.strip), lambda c: c != "")


def subjects(subject: Column, included: list[str] | None) -> Column:
    """One of the included; without a list, any."""
    return F.lit(True) if included is None else subject.isin(included)


def excluding(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Rows whose name isn't listed."""
    return df.join(names.select(F.col(names.columns[0]).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def of_pair(lang_pair: Column | None, system: Column | None, pair: str = "en_uk", marker: str | None = None) -> Column:
    """By the pair's name (a row without one is en_uk), or by a marker in the system prompt."""
    return F.contains(system, F.lit(marker)) if marker else F.coalesce(lang_pair, F.lit("en_uk")) == pair


def maths_row(question: Column, answer: Column, level: Column | None = None, wanted: str | None = None) -> Column:
    out = filled(question, answer)
    return out if wanted is None or level is None else out & (level == wanted)


def translated_row(question: Column, options: Column) -> Column:
    return filled(question) & F.coalesce(F.size(options) > 0, F.lit(False))


def sound_latex(c: Column, broken: tuple[str, ...] = ("\\фрак", "\\тексту", "\\квадратний", "\\межа")) -> Column:
    """No command that a translator turned into another script."""
    out = F.lit(True)
    for marker in broken:
        out = out & ~F.contains(c, F.lit(marker))
    return out & ~c.rlike(r"\\[\x{0400}-\x{04FF}]")
