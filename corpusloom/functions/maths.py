"""Mathematics records: final answers, boxes, calculator marks, decimals."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip, strip_thinking

_DECIMAL = re.compile(r"(?<![\d.,])\d*[.,]\d+")
_DRAWING = re.compile(r"(\[asy\].*?\[/asy\])", re.DOTALL)


def _closing(s: str, opening: int) -> int:
    """Where the brace that opens at `opening` closes, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(s, opening):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def box_content(s: str | None) -> str | None:
    """What the last \\boxed holds, braces balanced."""
    at = (s or "").rfind("\\boxed")
    opening = s.find("{", at) if at >= 0 else -1
    closing = _closing(s, opening) if opening >= 0 else -1
    return s[opening + 1 : closing] if closing >= 0 else None


def without_boxes(s: str) -> str:
    """Every \\boxed{X} as X; text after a box that never closes stays."""
    while (at := s.find("\\boxed")) >= 0:
        opening = s.find("{", at)
        closing = _closing(s, opening) if opening >= 0 else -1
        if closing < 0:
            break
        s = s[:at] + s[opening + 1 : closing] + s[closing + 1 :]
    return s


def _fraction(m: re.Match) -> str:
    f = Fraction("0" + m[0].replace(",", ".")).limit_denominator(10_000)
    return str(f.numerator) if f.denominator == 1 else "\\frac{%d}{%d}" % (f.numerator, f.denominator)


def to_fractions(s: str) -> str:
    """Decimals (point or comma) as fractions, except in drawings; blanks single."""
    s = re.sub(r"(?<=[-+=/* ])(?=[.,]\d)", "0", s)
    s = "".join(p if k % 2 else _DECIMAL.sub(_fraction, p) for k, p in enumerate(_DRAWING.split(s)))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"(?<!\d)[.,]00(?!\d)", "", s))


def without_marks(s: str) -> str:
    """Without calculator annotations, nested ones too."""
    n = 1
    while n:
        s, n = re.subn(r"<<[^><]*>>", "", s)
    return re.sub(r"<<|>>", "", s)


def _mapped(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


boxed = _mapped(box_content)
unboxed = _mapped(without_boxes)
fractions = _mapped(to_fractions)
unmarked = _mapped(without_marks)
_solution = _mapped(lambda s: re.sub(r"(?: |\t)+", " ", without_boxes(to_fractions(without_marks(s)))).strip())


def finished(body: Column, final: Column) -> Column:
    """A cleaned solution that ends in its boxed answer. One Python call for all steps."""
    return F.concat(_solution(body), F.lit("\nAnswer: \\boxed{"), strip(final), F.lit("}"))


def simple_box(c: Column) -> Column:
    """What the last box without inner braces holds, else the whole text."""
    found = F.regexp_extract_all(c, F.lit(r"\\boxed[{]([^}]*)[}]"), 1)
    return strip(F.coalesce(F.try_element_at(found, F.lit(-1)), c))


def after_hashes(c: Column) -> Column:
    return strip(F.substring_index(c, "####", -1))


def final_answer(prediction: Column) -> Column:
    """After the last "Answer:", else after the last ####, else everything."""
    text = strip_thinking(prediction)
    parts = F.split(text, r"(?i)Answer\s*:", -1)
    return strip(F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.substring_index(text, "####", -1)))


def assistant(answer: Column, final: Column) -> Column:
    """The answer if it says "Answer:", else its steps and the final answer, else as it is."""
    body = strip(F.coalesce(answer, F.lit("")))
    last = strip(F.coalesce(final.cast("string"), F.lit("")))
    steps = F.when(F.contains(body, F.lit("####")), strip(F.regexp_replace(body, r"(?s)####(?!.*####).*$", ""))).otherwise(body)
    return F.when(body.rlike(r"(?i)Answer\s*:"), body).when(last != "", F.concat(steps, F.lit("\n\nAnswer: "), last)).otherwise(body)


def ends_in_number(c: Column) -> Column:
    """Whether a worked answer ends in #### and a number."""
    return F.coalesce(c, F.lit("")).rlike(r"####\s*-?[\d.,]+\s*$")
