"""Training sets: tasks read, made into records, and mixed. Every function takes tables of raw rows and gives (id, messages, part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from ..operators import filters, records, sample

SEED = 42


def _record(rows: DataFrame, identifier: Column, messages: Column) -> DataFrame:
    return rows.select(identifier.cast("string").alias("id"), messages.alias("messages"))


def _known(rows: DataFrame, *names: str) -> Column:
    """The first of the columns that the table has and that isn't empty."""
    return T.first_of(*(F.col(c) for c in names if c in rows.columns))


def _number(rows: DataFrame, name: str = "id") -> Column:
    if name not in rows.columns:
        raise ValueError(f"the rows need a column {name}: draws depend on it and not on the order of rows")
    return F.col(name)


def translations(rows: DataFrame, pair: str = "en_uk", prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """Parallel rows (src or en, tgt or uk; lang_pair, en_uk where it is missing) of one pair. MT alone is this."""
    kept = rows.where(filters.of_pair(F.col("lang_pair") if "lang_pair" in rows.columns else F.lit(None).cast("string"), None, pair))
    language = F.lit("cs" if pair.startswith("cs") else "en")
    return _record(kept, _number(rows), records.translation(_known(rows, "src", "en"), _known(rows, "tgt", "uk"), language, prompts))


def first_messages(rows: DataFrame, marker: str | None = None, n: int | None = None, order: str = "id") -> DataFrame:
    """Rows that are messages already (an array, or a text that holds one); those whose system prompt has a marker, the first n in order."""
    messages = F.col("messages") if dict(rows.dtypes)["messages"].startswith("array") else parse.messages(F.col("messages"))
    read = rows.withColumn("messages", messages).where("messages is not null")
    system = F.try_element_at(F.filter("messages", lambda m: m["role"] == "system"), F.lit(1))["content"]
    kept = read if marker is None else read.where(F.coalesce(filters.of_pair(None, system, marker=marker), F.lit(False)))
    return _record(kept if n is None else sample.first_n(kept, order, n), _number(rows), F.col("messages"))


def corrections(rows: DataFrame, task: str, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """Grammar ("gc") or spelling ("sc") rows: input_sentence, incorrect_word, correct_word."""
    return _record(rows, _number(rows), records.correction(task, F.col("input_sentence"), F.col("incorrect_word"), F.col("correct_word"), prompts))


def questions(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """Questions with numbered options (question, possible_answers, correct_answer_num)."""
    return _record(rows, _number(rows), records.question(F.col("question"), F.col("possible_answers"), F.col("correct_answer_num"), prompts))


def listed_questions(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """Questions whose choices are a list (question, choices, answer): those with a known answer and no blank choice."""
    kept = rows.where(filters.numbered_question(F.col("answer") + 1, F.col("choices"), F.col("question")))
    return _record(kept, _number(rows), records.question(F.col("question"), T.choices_map(F.col("choices")), F.col("answer"), prompts))


def bilingual_questions(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """English questions to be translated and answered."""
    columns = map(F.col, ("question_en", "possible_answers_en", "question_uk", "possible_answers_uk", "correct_answer_num"))
    return _record(rows, _number(rows), records.bilingual_question(*columns, prompts))


def translated_questions(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """The Ukrainian side of translated questions alone; rows without it go."""
    kept = rows.where(filters.translated_row(F.col("question_uk"), F.col("possible_answers_uk")))
    return _record(kept, _number(rows), records.question(F.col("question_uk"), F.col("possible_answers_uk"), F.col("correct_answer_num"), prompts))


def lettered_questions(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS, numbered: bool = True) -> DataFrame:
    """Chats with lettered options (messages): read into questions with numbered options; with `numbered` false, asked and answered by letters. Chats that don't agree with themselves go."""
    messages = F.col("messages") if dict(rows.dtypes)["messages"].startswith("array") else parse.messages(F.col("messages"))
    said = lambda role: F.try_element_at(F.filter("__m", lambda m: m["role"] == role), F.lit(1))["content"]
    read = rows.withColumn("__m", messages).withColumn("__q", parse.lettered_question(said("user"), said("assistant"))).where("__q is not null")
    q = F.col("__q")
    if numbered:
        return _record(read, _number(rows), records.question(q["question"], q["possible_answers"], q["correct_answer_num"], prompts))
    letters = F.transform(T.lettered_answers(q["possible_answers"]), lambda a: a["marker"])
    user = F.concat(q["question"], F.lit("\n\n"), T.format_lettered(q["possible_answers"]))
    return _record(read, _number(rows), records.chat(prompts["qa"], user, F.get(letters, q["correct_answer_num"].cast("int"))))


def problems(rows: DataFrame, level: str | None = None, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """Ukrainian problems with answers (question_uk, answer_uk, final_answer), of one difficulty if it is named."""
    kept = rows.where(filters.maths_row(F.col("question_uk"), F.col("answer_uk"), F.col("difficulty") if "difficulty" in rows.columns else None, level))
    final = F.col("final_answer") if "final_answer" in rows.columns else None
    return _record(kept, _number(rows), records.problem(F.col("question_uk"), F.col("answer_uk"), final, prompts))


def bilingual_problems(rows: DataFrame, prompts: dict[str, str] = records.PROMPTS) -> DataFrame:
    """English problems to be translated and solved."""
    english = _known(rows, "question_en", "question")
    return _record(rows, _number(rows), records.bilingual_problem(english, F.col("question_uk"), F.col("answer_uk"), prompts))


def interleaved(parts: dict[str, DataFrame], shares: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """Parts in equal shares, or those given, until each was used in full."""
    even = shares or {k: 1 / len(parts) for k in parts}
    return sample.interleaved({k: df.select("id", "messages") for k, df in parts.items()}, even, "id", seed)


def nested(inner: dict[str, DataFrame], outer: dict[str, DataFrame], name: str = "qa", seed: int = SEED) -> DataFrame:
    """The inner parts in equal shares as one part, which shares equally with the outer ones. A row's id names its inner part and copy, so copies are rows of their own."""
    both = interleaved(inner, seed=seed)
    one = both.select(F.concat_ws("|", "part", "id", "copy").alias("id"), "messages")
    return interleaved({name: one} | outer, seed=seed)


def first_stage(mt: DataFrame, gc: DataFrame, sc: DataFrame) -> DataFrame:
    """Translation, grammar and spelling, a third each."""
    return interleaved({"mt": translations(mt), "gc": corrections(gc, "gc"), "sc": corrections(sc, "sc")})


def first_stage_without_grammar(mt: DataFrame, sc: DataFrame) -> DataFrame:
    """Translation and spelling, half each."""
    return interleaved({"mt": translations(mt), "sc": corrections(sc, "sc")})


def second_stage(qa_en: DataFrame, qa_uk: DataFrame, mr: DataFrame) -> DataFrame:
    """Questions (half bilingual, half Ukrainian) and bilingual problems, half each."""
    return nested({"qa_en": bilingual_questions(qa_en), "qa_uk": listed_questions(qa_uk)}, {"mr": bilingual_problems(mr)})


def second_stage_ukrainian(qa_en: DataFrame, qa_uk: DataFrame, mr: DataFrame) -> DataFrame:
    """The same with Ukrainian prompts and answers alone."""
    return nested({"qa_en_uk": translated_questions(qa_en), "qa_uk": listed_questions(qa_uk)}, {"mr": problems(mr)})


def second_stage_mix(qa_en: DataFrame, qa_uk: DataFrame, qa_zno: DataFrame, mr: DataFrame, qa_lettered: DataFrame | None = None, mt: DataFrame | None = None, mt_cs: DataFrame | None = None, gc: DataFrame | None = None, n_mt: int | None = 5000, n_gc: int | None = 5000, n_mt_cs: int | None = None, marker: str = "Czech", mr_ready: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """The canonical second stage: all Ukrainian questions and problems, a sample of translation and grammar against forgetting, in one random order.

    n_mt samples (null takes all, 0 or less none); n_gc likewise, but below 0 takes
    all and 0 none; n_mt_cs takes the first rows of Czech messages. `mr_ready` has
    problems as messages and takes the place of `mr`.
    """
    parts = {"qa_en_uk": translated_questions(qa_en), "qa_uk": listed_questions(qa_uk), "qa_zno": questions(qa_zno)}
    if qa_lettered is not None:
        parts["qa_lettered"] = lettered_questions(qa_lettered)
    parts["mr"] = problems(mr) if mr_ready is None else first_messages(mr_ready)
    if mt is not None:
        parts["mt"] = sample.sampled(translations(mt), "id", n_mt, seed)
    if mt_cs is not None and n_mt_cs is not None and n_mt_cs > 0:
        parts["mt_cs"] = first_messages(mt_cs, marker, n_mt_cs)
    if gc is not None and n_gc != 0:
        parts["gc"] = sample.sampled(corrections(gc, "gc"), "id", None if n_gc is None or n_gc < 0 else n_gc, seed)
    return sample.mixed({k: df.select("id", "messages") for k, df in parts.items()}, {}, "id", seed)


def joint(mt: DataFrame, gc: DataFrame, sc: DataFrame, qa_en: DataFrame, qa_uk: DataFrame, qa_zno: DataFrame, mr: DataFrame, mt_cs: DataFrame | None = None, n_mt_cs: int | None = 10_000, marker: str = "Czech", how: str = "interleave", seed: int = SEED) -> DataFrame:
    """All tasks at once, in equal shares ("interleave") or all rows in random order ("shuffle")."""
    parts = {"mt": translations(mt)}
    if mt_cs is not None and n_mt_cs is not None and n_mt_cs > 0:
        parts["mt_cs"] = first_messages(mt_cs, marker, n_mt_cs)
    parts |= {"gc": corrections(gc, "gc"), "sc": corrections(sc, "sc"), "qa_en_uk": translated_questions(qa_en), "qa_uk": listed_questions(qa_uk), "qa_zno": questions(qa_zno), "mr": problems(mr)}
    if how == "interleave":
        return interleaved(parts, seed=seed)
    if how == "shuffle":
        return sample.mixed({k: df.select("id", "messages") for k, df in parts.items()}, {}, "id", seed)
    raise ValueError(f"mix by interleave or shuffle, not {how}")


#: Corpora left out of training and of validation, by pair.
EXCLUDED = {
    "train": {"en-uk": ("paracrawl_para01", "open_subtitles", "open_subtitles_para", "dochplt copy"), "cs-uk": ("open_subtitles", "open_subtitles_para", "paracrawl_para", "paracrawl")},
    "validation": {"en-uk": ("paracrawl_para01", "open_subtitles_para", "tilde"), "cs-uk": ("open_subtitles_para", "paracrawl_para", "elrc_acts", "nllb")},
}


def translation_set(pairs: DataFrame, pair: str, split: str = "train", caps: dict[str, int] | None = None, official: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """corpus, id, messages of a pair's corpora (corpus, id, source, target): without those left out of the split, capped in training, and with the official development pairs in validation."""
    kept = pairs.where(~F.col("corpus").isin(*EXCLUDED[split].get(pair, ("",))))
    if split == "train" and caps:
        kept = sample.capped(kept, "corpus", "id", caps, seed=seed)
    if official is not None and split == "validation":
        kept = kept.unionByName(official.select(F.lit("official").alias("corpus"), "id", "source", "target"))
    kept = kept.where(filters.filled(F.col("source"), F.col("target")))
    return kept.select("corpus", F.col("id").cast("string").alias("id"), records.translation(F.col("source"), F.col("target"), F.lit(pair.split("-")[0])).alias("messages"))
