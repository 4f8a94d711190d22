"""Stage statistics, calibration and corpus descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sample import capped, chosen


def reasons(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows by reason; "pass" stands for none."""
    return df.groupBy(F.coalesce(reason, F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


def stage_stats(df: DataFrame, stages: list[str], failed: str = "failed_stage", reason: str = "reason") -> DataFrame:
    """For each stage: rows in, out and rejected, and the share kept in per cent. One pass: rows carry the first stage they fail.

    The counts of failures (a row for each stage) are small whatever the data's size,
    so the running differences are taken over them and not over rows.
    """
    order = F.create_map(*(x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))))
    names = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "i int, stage string")
    lost = df.groupBy(F.col(failed).alias("stage")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    table = names.join(F.broadcast(lost.where("stage is not null").select(order[F.col("stage")].alias("i"), "n")), "i", "left").crossJoin(F.broadcast(total))
    before = F.coalesce(F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_in = F.col("total") - before
    rejected = F.coalesce("n", F.lit(0))
    kept = F.when(n_in > 0, F.round((n_in - rejected) / n_in * 100, 2)).otherwise(F.lit(0.0))
    return table.select("stage", n_in.alias("n_in"), (n_in - rejected).alias("n_out"), rejected.alias("n_rejected"), kept.alias("retention"))


def _measures() -> dict[str, Column]:
    """Lengths and ratios of pairs; parts are what single spaces separate."""
    src, tgt = F.col("source"), F.col("target")
    parts = lambda c: F.size(F.split(c, " ", -1))
    return {"src_chars": F.length(src), "tgt_chars": F.length(tgt), "char_ratio": F.length(src) / F.greatest(F.length(tgt), F.lit(1)), "word_ratio": parts(src) / F.greatest(parts(tgt), F.lit(1))}


def stage_report(df: DataFrame, stages: list[str], failed: str = "failed_stage", reason: str = "reason") -> DataFrame:
    """stage_stats() with the stage's place `i` and `reasons`, a map of the counts of each reason."""
    order = F.create_map(*(x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))))
    counts = df.where(F.col(failed).isNotNull()).groupBy(F.col(failed).alias("stage"), F.col(reason).alias("r")).agg(F.count("*").alias("k"))
    maps = counts.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("r", F.lit("none")), "k")))).alias("reasons"))
    return stage_stats(df, stages, failed, reason).join(F.broadcast(maps), "stage", "left").withColumn("i", order[F.col("stage")])


def calibrated(pairs: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """measure, low, high: exact percentiles (of the values that occur) of lengths and ratios."""
    long = pairs.select(F.explode(F.create_map(*(x for k, c in _measures().items() for x in (F.lit(k), c.cast("double"))))).alias("measure", "value"))
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")
    return long.groupBy("measure").agg(at(low).alias("low"), at(high).alias("high"))


def calibrated_fast(pairs: DataFrame, low: float = 0.025, high: float = 0.975, accuracy: int = 10_000) -> DataFrame:
    """calibrated() by mergeable sketches: no sort and nothing but sketches is shuffled."""
    row = pairs.agg(*(F.percentile_approx(c.cast("double"), [low, high], accuracy).alias(k) for k, c in _measures().items()))
    return row.select(F.explode(F.create_map(*(x for k in row.columns for x in (F.lit(k), F.col(k))))).alias("measure", "v")).select("measure", F.col("v")[0].alias("low"), F.col("v")[1].alias("high"))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, p25, p50, p75, min and max of columns read as numbers; what is no number is left out."""
    long = df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string").try_cast("double"))))).alias("column", "v"))
    at = [F.expr(f"percentile(v, {p})").alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return long.groupBy("column").agg(F.avg("v").alias("mean"), *at, F.min("v").alias("min"), F.max("v").alias("max"))


def corpus(df: DataFrame, group: str, text: str, measure: Column | None = None) -> DataFrame:
    """Per group: documents, and characters (or another measure) at the ends and at 25, 50, 75 and 95 per cent of the sorted rows (row int(n·p), 1 at least).

    Lengths are counted first, so what is sorted is distinct lengths and not rows.
    """
    sizes = df.groupBy(group, (F.length(text) if measure is None else measure).alias("len")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(group)
    ranked = sizes.withColumn("upto", F.sum("k").over(w.orderBy("len"))).withColumn("n", F.sum("k").over(w))
    at = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * p)), F.col("len"))).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95)]
    return ranked.groupBy(group).agg(F.max("n").alias("n"), F.min("len").alias("min"), *at, F.max("len").alias("max"))


def described_corpus(df: DataFrame, group: str, text: str, key: str, samples: int = 4, seed: int = 42) -> DataFrame:
    """Per group: corpus() of characters and of words, and a random sample of rows' keys."""
    measures = [corpus(df, group, text, m).select(group, *(F.col(c).alias(f"{name}_{c}") for c in ("min", "p25", "p50", "p75", "p95", "max")), *(["n"] if name == "chars" else [])) for name, m in (("chars", F.length(text)), ("words", T.word_count(F.col(text))))]
    chosen = capped(df.select(group, key), group, key, {}, samples, seed).groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return measures[0].join(measures[1], group).join(chosen, group)


def audited(judged: DataFrame, rate: float, key: str = "seq", seed: int = 42) -> DataFrame:
    """A random share of the rejected rows, for people to look at."""
    return judged.where(F.col("failed_stage").isNotNull() & chosen(rate, seed, key))


def grouped_variants(df: DataFrame, question: str, order: str) -> DataFrame:
    """Rows by the normalised question, each group's rows as structs in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in df.columns if c != order))))
    return df.groupBy(T.question_key(F.col(question)).alias("key")).agg(rows.alias("variants"), F.count("*").alias("n"))


def document_stats(df: DataFrame, words: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(words).alias("mean"), F.min(words).alias("min"), F.max(words).alias("max"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Values by how often they occur, the most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def agreement(df: DataFrame, group: str, hit: Column, score: Column) -> DataFrame:
    """Per group: rows, hits, their share in per cent, and the sum of scores without nulls."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(100 * F.count_if(hit) / F.count("*"), 2).alias("percent"), F.sum(score).alias("score"))


def by_source(df: DataFrame, source: str) -> DataFrame:
    """Rows by source, and of all (source null)."""
    return df.rollup(source).agg(F.count("*").alias("n"))


def label_balance(df: DataFrame, word: Column) -> DataFrame:
    return df.groupBy(F.when(word == "CORRECT", F.lit("correct")).otherwise(F.lit("error")).alias("label")).agg(F.count("*").alias("n"))


def joined_text(df: DataFrame, group: str, order: str, columns: list[str], least: int = 2) -> DataFrame:
    """Columns of each group joined by spaces in order, the rows and words; groups of fewer than `least` rows are left out."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    out = df.groupBy(group).agg(rows.alias("__rows"), F.count("*").alias("n")).where(F.col("n") >= least)
    texts = [F.array_join(F.col(f"__rows.{c}"), " ").alias(c) for c in columns]
    done = out.select(group, *texts, "n")
    return done.withColumn("word_count", T.word_count(F.col(columns[0])))
