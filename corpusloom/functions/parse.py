"""Parsers of model output and of loosely structured records."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, options_list, prediction_text, question_key, strip, strip_thinking

_CHOICES = (r"(?i)(?:Відповідь|Answer)\s*[-:]?\s*(\d+)", r"^\s*(\d+)", r"(?U)\b([0-9]+)\b")


def choice(prediction: Column, options: Column) -> Column:
    """The key of the option that a prediction names: by number in three forms, else the first option whose text it holds, else null."""
    text = strip_thinking(prediction)
    keys = F.map_keys(options)
    numbered = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in _CHOICES]
    body = F.lower(prediction_text(text))
    held = F.filter(options_list(options), lambda e: F.contains(body, F.lower(prediction_text(e["value"]))))
    return F.coalesce(*(F.when(F.array_contains(keys, n), n) for n in numbered), F.try_element_at(held, F.lit(1))["key"])


_NONE = ("без помилки", "no error", "помилки немає", "немає помилки")
_WORD = re.compile(r"[\w'’-]+")
_WRONG = ("incorrect word", "wrong word", "неправильне слово", "помилкове слово")
_RIGHT = ("correction", "correct word", "правильне слово", "виправлення")
_LABELS = re.compile(".*?".join(rf"(?:{'|'.join(names)})\s*[-:]\s*([^,;\n]+)" for names in (_WRONG, _RIGHT)), re.I | re.S)
_ARROW = re.compile(r"([^`'\":;,\s]+)\s*(?:[-=]>|[→—-])\s*([^`'\":;,\s]+)")
_QUOTED = re.compile(r"[«„“`'\"]([^»“`'\"]+)[»“`'\"]")


def _tidy(s: str) -> str:
    return " ".join(re.sub(r"^\s*\"*'*|'*\"*\s*$", "", s).split())


def read_error_pair(text: str, strict: bool) -> tuple[str | None, str | None]:
    low = text.casefold()
    clean = low.strip(" .!") == "correct" if strict else "correct" in low
    if clean or any(m in low for m in _NONE):
        return "CORRECT", "CORRECT"
    for pattern in (_LABELS, _ARROW):
        if m := pattern.search(text):
            return _tidy(m[1]), _tidy(m[2])
    for found in (_QUOTED.findall(text), _WORD.findall(text)):
        if len(found) > 1:
            return _tidy(found[0]), _tidy(found[1])
    return None, None


def error_pair(prediction: Column, strict: bool = False) -> Column:
    """struct<wrong,right>. Without `strict`, a text that holds "correct" anywhere, as in "incorrect word", says that nothing is wrong."""

    @F.pandas_udf("wrong string, right string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_error_pair(t, strict) for t in s], columns=["wrong", "right"], dtype=object)

    return run(prediction_text(prediction))


def checked_pair(wrong: Column, right: Column) -> Column:
    """Nulls as NO_OUTPUT; if either side is CORRECT both are."""
    ok = F.coalesce((wrong == "CORRECT") | (right == "CORRECT"), F.lit(False))
    side = lambda c: F.when(ok, F.lit("CORRECT")).otherwise(F.coalesce(c, F.lit("NO_OUTPUT")))
    return F.struct(side(wrong).alias("wrong"), side(right).alias("right"))


def answer_letters(options: Column, correct: Column) -> Column:
    """Labels of the options whose text or label is among the correct answers; without any, the correct answers of up to two characters."""
    keys = F.transform(correct, question_key_native)
    hit = F.filter(options, lambda o: F.array_contains(keys, question_key_native(o["text"])) | F.array_contains(keys, question_key_native(o["marker"])))
    named = F.array_distinct(F.transform(hit, lambda o: F.upper(strip(o["marker"]))))
    short = F.array_distinct(F.filter(F.transform(correct, lambda a: F.upper(strip(a))), lambda a: F.length(a) <= 2))
    return F.array_sort(F.when(F.size(named) > 0, named).otherwise(short))


def question_key_native(c: Column) -> Column:
    """question_key() without composition, for use inside array functions."""
    return question_key(c, compose=False)


def predicted_letter(answer: Column, options: Column) -> Column:
    """A lone capital letter of the answer, else the label of the first option whose text it holds."""
    letter = F.nullif(F.regexp_extract(F.upper(strip(answer)), r"(?U)\b([АБВГҐДЕЖЗИІКЛМНО])\b", 1), F.lit(""))
    body = question_key_native(answer)
    held = F.filter(options, lambda o: (question_key_native(o["text"]) != "") & F.contains(body, question_key_native(o["text"])))
    return F.when(F.coalesce(answer, F.lit("")) != "", F.coalesce(letter, F.upper(strip(F.try_element_at(held, F.lit(1))["marker"]))))


_OPTION = re.compile(r"(?m)^([А-Д])\s*:\s*(.+)$")
_ANSWER = re.compile(r"Відповідь\s*:\s*([А-Д])", re.I)
_LAST = re.compile(r"\nВідповідь\s*:\s*[А-Д]\s*\Z", re.I)
LETTERED = "question string, possible_answers map<string,string>, correct_answer_num string"


def read_lettered(user: str | None, reply: str | None) -> tuple | None:
    options, said = _OPTION.findall(user or ""), (reply or "").strip()
    if not options:
        return None
    at = user.rfind(f"\n{options[0][0]}:")
    at = at if at >= 0 else user.find(f"{options[0][0]}:")
    question = (user[:at] if at >= 0 else user).strip()
    question = _LAST.sub("", question).strip()
    if len(said) <= 2:
        question = question.partition("\nТЕМА:")[0].rstrip()
    found = [said] if len(said) <= 2 else _ANSWER.findall(said)[:1]
    letter = next((x for x in [*found, *_ANSWER.findall(question)[:1]] if x), None)
    if letter not in {x for x, _ in options} or len(letter) != 1:
        return None
    return question, {str(i): t.strip() for i, (_, t) in enumerate(options)}, str("АБВГД".index(letter))


def lettered_question(user: Column, reply: Column) -> Column:
    """Numbered fields of a question with lettered options; null if they don't agree."""
    return F.udf(read_lettered, LETTERED, useArrow=True)(user, reply)


def read_list(text: str | None) -> list[str]:
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        value = [text] if text else []
    return [str(x) for x in value] if isinstance(value, (list, tuple, set)) else [str(value)]


def literal_list(text: Column) -> Column:
    """A list written as a Python or JSON literal; a text that is none is a list of itself, null and empty give an empty list."""
    return F.udf(read_list, "array<string>", useArrow=True)(text)


MESSAGES = "array<struct<role:string,content:string>>"


def read_messages(text: str | None) -> list[tuple] | None:
    try:
        return [(str(m["role"]), str(m["content"])) for m in ast.literal_eval(text)]
    except (ValueError, SyntaxError, TypeError, KeyError, MemoryError, RecursionError):
        return None


def messages(text: Column) -> Column:
    """Messages written as a literal list of dicts; null where they aren't."""
    return F.udf(read_messages, MESSAGES, useArrow=True)(text)


def one_line(c: Column) -> Column:
    return collapse(F.coalesce(c, F.lit("")))
