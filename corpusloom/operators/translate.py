"""Translation as a seam: a function over a batch of texts, with a cache, retries and pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as T
from ..sources.ingest import retried
from . import joins
from .tables import small_batches

Translate = Callable[[list[str]], list[str]]


def translated(df: DataFrame, text: str, translate: Translate, name: str, attempts: int = 5, batch: int = 32, wait: float = 2.0) -> DataFrame:
    """Adds what `translate` makes of the texts, `batch` at a time; a batch that fails is tried again, and a last failure fails the task, which Spark tries again. Null and blank texts stay as they are."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            todo = [i for i, t in enumerate(s) if t is not None and t.strip()]
            out = s.astype(object).where(s.notna(), None).tolist()
            for k in range(0, len(todo), batch):
                at = todo[k : k + batch]
                for i, t in zip(at, retried(lambda at=at: translate([s.iloc[i] for i in at]), attempts, wait)):
                    out[i] = t
            yield pd.Series(out, dtype=object)

    small_batches(df.sparkSession)
    return df.withColumn(name, run(F.col(text)))


def with_cache(df: DataFrame, text: str, cache: DataFrame, translate: Translate, name: str = "translation", **how) -> tuple[DataFrame, DataFrame]:
    """Rows with translations, and the cache's new rows (key, translation).

    The key is a hash of the text, so a text is translated once however often it
    occurs; `cache` has the rows of earlier runs. Write the new rows before the result is used.
    """
    keyed = df.withColumn("__key", T.content_key(F.col(text)))
    asked = keyed.select(F.col("__key").alias("key"), text).where(F.col(text).isNotNull()).dropDuplicates(["key"])
    known, unknown = joins.cached(asked, cache.select("key", "translation"), "key")
    fresh = translated(unknown, text, translate, "translation", **how).select("key", "translation")
    both = known.select("key", "translation").unionByName(fresh)
    return keyed.join(both.select(F.col("key").alias("__key"), F.col("translation").alias(name)), "__key", "left").drop("__key"), fresh


def in_pieces(df: DataFrame, key: str, text: str, translate: Translate, limit: int = 3000, **how) -> DataFrame:
    """key and text of documents translated piece by piece and put together again."""
    return chunking.from_pieces(translated(chunking.to_pieces(df, key, text, limit), "piece", translate, "piece", **how), key, text)


def back_translated(df: DataFrame, text: str, translate: Translate, name: str = "source", limit: int = 30_000, **how) -> DataFrame:
    """Adds the translation of each text, sent in pieces of whole sentences of at most `limit` bytes; quotes around a text go before."""
    keep = df.columns
    numbered = df.withColumn("__id", F.monotonically_increasing_id())
    pieces = numbered.select(*keep, "__id", F.posexplode(chunking.split_by_bytes(T.peel_quotes(F.col(text)), limit)).alias("__at", "__piece"))
    said = translated(pieces, "__piece", translate, "__said", **how)
    rows = F.array_sort(F.collect_list(F.struct("__at", "__said")))
    done = said.groupBy(*keep, "__id").agg(rows.alias("__rows"))
    return done.select(*keep, F.array_join(F.col("__rows.__said"), " ").alias(name))
