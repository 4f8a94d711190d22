"""Joins: line-aligned files, leakage, membership, resuming, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import first_of_each


def aligned(left: DataFrame, right: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Rows of equal ordinal; what one side has beyond the other is left out."""
    return left.join(right, ordinal)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return first_of_each(df, [key], [F.col(order).desc()])


def enrich(items: DataFrame, local: DataFrame, key: str, order: str) -> DataFrame:
    """Every item, with the last local row of its key if there is one. A hash of keys decides; Spark broadcasts the local side only if its size is below its threshold."""
    return items.join(last_of_each(local, key, order).drop(order), key, "left")


def without_leaks(df: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't held out; null keys stay."""
    return df.join(held_out.select(key).distinct(), key, "left_anti").select(*df.columns)


def flagged(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """Every row, and whether its key is a member."""
    marks = members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def overlap(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of both sides, each with its last rows as structs."""
    side = lambda d, name: d.groupBy(key).agg(F.max_by(F.struct(*(c for c in d.columns if c != key)), order).alias(name))
    return side(left, "left").join(side(right, "right"), key)


def cached(items: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Items with a cached value, and those without."""
    known = cache.dropDuplicates([key])
    return items.join(known, key), items.join(known.select(key), key, "left_anti")


def scattered(values: DataFrame, row: str, field: str, value: str) -> DataFrame:
    """Values back to their rows: row and a map of fields."""
    return values.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def in_input_order(inputs: DataFrame, predictions: DataFrame, key: str, order: str, said: str) -> DataFrame:
    """Predictions for the inputs, in the inputs' order; of repeated ones the last."""
    return inputs.select(key, order).join(last_of_each(predictions, key, said).drop(order), key).orderBy(order)


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs without output yet. By id, so a failed item in the middle is found."""
    return without_leaks(inputs, done, key)


def capped(df: DataFrame, caps: DataFrame, corpus: str, order: list[Column | str]) -> DataFrame:
    """As many rows of each corpus as its cap says, in the given order; corpora without a cap are whole."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(corpus).orderBy(*order)))
    return ranked.join(caps.select(corpus, F.col("cap").alias("__cap")), corpus, "left").where("__cap is null or __n <= __cap").drop("__n", "__cap")


def compared(runs: DataFrame, metric: str, label: str, value: str, labels: list) -> DataFrame:
    """A row for each metric, a column for each run; null where a run lacks it."""
    return runs.groupBy(metric).pivot(label, labels).agg(F.max(value))
