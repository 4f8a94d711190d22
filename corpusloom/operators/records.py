"""Chat records, question records and their variants, dataset assemblies."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as T
from .filters import one_correct
from .sample import draw, mixed

#: System prompts by task; pass your own to match a model that was trained on others.
PROMPTS = {
    "mt": "You translate from English into Ukrainian.",
    "mt_cs": "You translate from Czech into Ukrainian.",
    "gc": "Find the one grammar error of the sentence, if any. Reply CORRECT, or the wrong word and the right one.",
    "sc": "Find the one spelling error of the sentence, if any. Reply CORRECT, or the wrong word and the right one.",
    "qa": "Choose the right option of the question.",
    "qa_en": "Translate the question into Ukrainian and choose the right option.",
    "mr": "Solve the problem step by step and end with 'Answer:' and the result.",
    "mr_en": "Translate the problem into Ukrainian and solve it.",
}


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.lit(content) if isinstance(content, str) else content).alias("content"))


def chat(system: Column | str, user: Column, assistant: Column | None = None) -> Column:
    """array<struct<role,content>>; without an answer, a prompt."""
    return F.array(message("system", system), message("user", user), *([] if assistant is None else [message("assistant", assistant)]))


def translation(src: Column, tgt: Column | None, language: Column | None = None, prompts: dict[str, str] = PROMPTS) -> Column:
    """By source language: cs or cz, else English."""
    system = F.lit(prompts["mt"]) if language is None else F.when(F.lower(language).isin("cs", "cz"), F.lit(prompts["mt_cs"])).otherwise(F.lit(prompts["mt"]))
    return chat(system, src, tgt)


def correction(task: str, sentence: Column, wrong: Column | None = None, right: Column | None = None, prompts: dict[str, str] = PROMPTS) -> Column:
    """Grammar ("gc") or spelling ("sc")."""
    return chat(prompts[task], sentence, None if wrong is None else T.error_target(wrong, right))


def _asked(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n\n"), T.format_options(options), F.lit("\n\nAnswer:"))


def question(text: Column, options: Column, number: Column | None = None, prompts: dict[str, str] = PROMPTS) -> Column:
    return chat(prompts["qa"], _asked(text, options), None if number is None else number.cast("string"))


def bilingual_question(en: Column, options_en: Column, uk: Column, options_uk: Column, number: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    reply = F.concat(F.lit("Question (Ukrainian): "), uk, F.lit("\n\n"), T.format_options(options_uk), F.lit("\n\nAnswer: "), number.cast("string"))
    return chat(prompts["qa_en"], _asked(en, options_en), reply)


def problem(uk: Column, answer: Column | None = None, final: Column | None = None, prompts: dict[str, str] = PROMPTS) -> Column:
    reply = None if answer is None else M.assistant(answer, F.lit(None) if final is None else final)
    return chat(prompts["mr"], F.concat(uk, F.lit("\n\nAnswer:")), reply)


def bilingual_problem(en: Column, uk: Column, answer: Column, prompts: dict[str, str] = PROMPTS) -> Column:
    reply = F.concat(F.lit("Question (Ukrainian): "), uk, F.lit("\n\nSolution:\n"), answer)
    return chat(prompts["mr_en"], F.concat(en, F.lit("\n\nAnswer:")), reply)


def reasoned(text: Column, reasoning: Column, options: Column, letter: Column, system: str, implicit: Column) -> Column:
    """With the reasoning in the question (implicit), or in the answer, which then ends in the letter."""
    tail = F.regexp_replace(reasoning, r"(?U)\s+$", "")
    ends = F.regexp_extract(tail, r"(?iu)Відповідь\s*:\s*(\S)\s*$", 1)
    said = F.when(F.upper(ends) == F.upper(letter), tail).otherwise(F.concat(tail, F.lit("\nВідповідь: "), letter))
    user = F.when(implicit, F.concat_ws("\n\n", text, reasoning, options)).otherwise(F.concat_ws("\n\n", text, options))
    return chat(system, user, F.when(implicit, letter).otherwise(said))


def rendered(messages: Column, generate: bool = False) -> Column:
    """As text with role marks; with `generate`, open for an answer."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if generate else body


def as_json(messages: Column) -> Column:
    return F.to_json(messages)


def numbered(prefix: str, ordinal: Column, digits: int = 5) -> Column:
    """prefix and ordinal, filled up with zeros but never cut."""
    text = ordinal.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def _orders(n: int) -> list[list[int]]:
    return [list(p) for p in permutations(range(n))]


def permuted(answers: Column, order: Column) -> Column:
    """Answers in another order, markers staying where they were."""
    return F.transform(order, lambda k, i: F.struct(F.get(answers, i)["marker"].alias("marker"), F.get(answers, k)["text"].alias("text")))


def new_marker(answers: Column, order: Column, marker: Column) -> Column:
    """Where the answer of `marker` stands in the new order."""
    old = F.array_position(F.transform(answers, lambda a: a["marker"]), marker) - 1
    return F.get(answers, (F.array_position(order, old.cast("int")) - 1).cast("int"))["marker"]


PREFIXES = ("", "Оберіть відповідь:\n", "Який варіант правильний?\n", "Укажіть варіант:\n", "Виберіть один варіант:\n", "Що є правильним?\n", "Знайдіть відповідь:\n")


def variants(questions: DataFrame, key: str, factor: int, seed: int = 42, prefixes: tuple[str, ...] = PREFIXES, most: int = 5) -> DataFrame:
    """Each usable question `factor` times: variant 0 as it is, the others with answers in different random orders; a question of too few orders has fewer variants,
    and one of more than `most` answers has the first variant alone.

    Columns answers array<struct<marker,text>> and correct_answers array<string> are
    rewritten, and `variant` and `prefix` added. Orders come from a constant table of at
    most 120 rows, ranked by a hash of question and order.
    """
    usable = questions.where(one_correct(F.col("answers"), F.col("correct_answers")) & (F.size("answers") <= most))
    n = F.size("answers")
    table = F.when(F.lit(False), F.array(F.array(F.lit(0))))
    for size in range(1, most + 1):
        table = F.when(n == size, F.from_json(F.lit(str(_orders(size)[1:])), "array<array<int>>")).otherwise(table)
    ranked = F.transform(F.array_sort(F.transform(table, lambda o: F.struct(draw(seed, F.col(key), F.array_join(o.cast("array<string>"), ",")).alias("d"), o.alias("o")))), lambda x: x["o"])
    identity = F.transform("answers", lambda _, i: i)
    orders = F.concat(F.array(identity), F.slice(ranked, 1, max(0, factor - 1)) if factor > 1 else F.from_json(F.lit("[]"), "array<array<int>>"))
    exploded = usable.select("*", F.posexplode(orders).alias("variant", "__order"))
    marker = new_marker(F.col("answers"), F.col("__order"), F.element_at("correct_answers", 1))
    # the first variant of another order has no prefix, the next ones take the others in turn
    place = F.when(F.col("variant") <= 1, F.lit(0)).otherwise((F.col("variant") - 2) % (len(prefixes) - 1) + 1)
    fixed = exploded.withColumn("correct_answers", F.array(marker)).withColumn("answers", permuted(F.col("answers"), F.col("__order")))
    return fixed.withColumn("prefix", F.get(F.array(*map(F.lit, prefixes)), place)).drop("__order")


def picked(variants_: DataFrame, key: str, in_reasoning: Column) -> DataFrame:
    """Two variants a question: the second and third of questions with a reasoning, else the first and third; of questions with fewer the first two."""
    few = F.col("__n") < 3
    wanted = F.when(few, F.col("variant") < 2).when(in_reasoning, F.col("variant").isin(1, 2)).otherwise(F.col("variant").isin(0, 2))
    return variants_.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(wanted).drop("__n")


def another_order(answers: Column, key: Column, seed: int = 42) -> Column:
    """A random order of the answers that isn't the one they have; the same for fewer than two.

    All n! - 1 others can come out: places are ordered by a hash each, and an order
    that turns out as the old one has its first place moved to another, by a hash too.
    """
    n = F.size(answers)
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mixed = F.transform(F.array_sort(F.transform(place, lambda i: F.struct(draw(seed, key, i).alias("d"), i.alias("i")))), lambda x: x["i"])
    shift = (F.pmod(F.xxhash64(F.lit(seed), key), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    turned = F.transform(place, lambda i: F.when(i == 0, shift).when(i == shift, F.lit(0)).otherwise(i))
    return F.when((n < 2) | (mixed != place), mixed).otherwise(turned)


def assembled(parts: dict[str, DataFrame], caps: dict[str, int] | None = None, key: str = "id", seed: int = 42) -> DataFrame:
    """Records of several tasks, capped and in one random order."""
    return mixed(parts, caps or {}, key, seed)
