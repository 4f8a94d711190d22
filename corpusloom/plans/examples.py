"""Examples to be answered: prompts of development sets with their references, prompts of test sets with their rows, and augmented questions as items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records
from ..operators.sample import concatenated


def _example(identifier: Column, messages: Column, reference: Column | None = None, wrong: Column | None = None, right: Column | None = None, options: Column | None = None) -> list[Column]:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    chosen = F.lit(None).cast("map<string,string>") if options is None else options
    return [identifier.cast("string").alias("id"), messages.alias("messages"), text(reference).alias("reference"), text(wrong).alias("incorrect_word"), text(right).alias("correct_word"), chosen.alias("possible_answers")]


def development(task: str, rows: DataFrame, prompts: dict[str, str] = records.PROMPTS, order: str | None = None) -> DataFrame:
    """id, messages and what a prediction is held against, of a task's development rows: MT (sent_id, en, uk), MT_CS (sent_id, cs, uk), QA (dataset_id, question, possible_answers, correct_answer_num, and its place `order`, counted from 0), SC and GC (id, input_sentence, incorrect_word, correct_word), MR (id, question, answer)."""
    c = F.col
    if task == "MT":
        return rows.select(*_example(c("sent_id"), records.chat(prompts["mt"], c("en")), c("uk")))
    if task == "MT_CS":
        return rows.select(*_example(c("sent_id"), records.chat(prompts["mt_cs"], c("cs")), c("uk")))
    if task == "QA":
        place = c(order or "ord").cast("string")
        return rows.select(*_example(F.concat("dataset_id", F.lit("::"), place), records.question(c("question"), c("possible_answers"), prompts=prompts), c("correct_answer_num"), options=c("possible_answers")))
    if task in ("SC", "GC"):
        return rows.select(*_example(c("id"), records.correction(task.lower(), c("input_sentence"), prompts=prompts), wrong=c("incorrect_word"), right=c("correct_word")))
    if task == "MR":
        return rows.select(*_example(c("id"), records.problem(c("question"), prompts=prompts), c("answer")))
    raise ValueError(f"there is no task {task}")


def all_development(tables: dict[str, DataFrame], prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """development() of several tasks in one table, with `task`."""
    return concatenated([development(t, df, prompts).withColumn("task", F.lit(t)) for t, df in tables.items()])


def test(task: str, rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """The rows of a test set as `row`, with `messages`; problems also with `difficulty`. Tasks as in development()."""
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row")
    asked = {
        "MT": lambda: records.chat(prompts["mt"], F.col("en")),
        "MT_CS": lambda: records.chat(prompts["mt_cs"], F.col("cs")),
        "QA": lambda: records.question(F.col("question"), F.col("possible_answers"), prompts=prompts),
        "SC": lambda: records.correction("sc", F.col("input_sentence"), prompts=prompts),
        "GC": lambda: records.correction("gc", F.col("input_sentence"), prompts=prompts),
        "MR": lambda: records.problem(F.col("question"), prompts=prompts),
    }[task]()
    return rows.select(row, asked.alias("messages"), *([T.difficulty(F.col("id")).alias("difficulty")] if task == "MR" else []))


#: System prompts of questions with and without a passage.
EXAM, READING = "Choose the right option of the exam question.", "Read the text and choose the right option."


def augmented_chat(prefix: Column, question: Column, answers: Column, correct: Column, passage: Column) -> Column:
    """An augmented question as messages; the system prompt tells whether there is a passage."""
    system = F.when(F.coalesce(passage, F.lit("")) != "", F.lit(READING)).otherwise(F.lit(EXAM))
    return records.chat(system, T.question_prompt(question, answers, prefix, passage), F.element_at(correct, 1))


def augmented_item(prefix: Column, question: Column, answers: Column, correct: Column, subject: Column, passage: Column) -> Column:
    """An augmented question as an item: question (with its prefix), answers, correct_answers, subject, and the passage, null if there is none."""
    kept = F.nullif(passage, F.lit(""))
    return F.struct(F.concat(F.coalesce(prefix, F.lit("")), question).alias("question"), answers.alias("answers"), correct.alias("correct_answers"), subject.alias("subject"), kept.alias("passage"))
