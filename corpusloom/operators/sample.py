"""Sorting, limits, seeded samples and mixtures. Draws come from md5 of seed and id, so they depend on neither partitions nor order of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved


def draw(seed: int, *ids: Column | str) -> Column:
    """A text that orders rows at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in ids)))


def uniform(seed: int, *ids: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(draw(seed, *ids), 1, 13), 16, 10).cast("double") / float(1 << 52)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def sampled(df: DataFrame, key: str, n: int | None, seed: int = 42) -> DataFrame:
    """n rows without replacement; all if n is null, none if it isn't positive."""
    return df if n is None else df.limit(0) if n <= 0 else df.orderBy(draw(seed, key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def capped(df: DataFrame, group: str, key: str, caps: dict[str, int], default: int | None = None, seed: int = 42) -> DataFrame:
    """A random part of each group, as large as its cap. Spark keeps only a group's best rows of each partition before the shuffle."""
    most = F.lit(default)
    for name, cap in caps.items():
        most = F.when(F.col(group) == name, F.lit(cap)).otherwise(most)
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(draw(seed, key), key))).withColumn("__cap", most)
    largest = None if default is None else max([default, *caps.values()])
    kept = ranked if largest is None else ranked.where(F.col("__n") <= largest)
    return kept.where("__cap is null or __n <= __cap").drop("__n", "__cap")


def chosen(ratio: float, seed: int, *ids: Column | str) -> Column:
    """True for about `ratio` of rows."""
    return uniform(seed, *ids) < ratio


def best(df: DataFrame, score: str, order: str, n: int) -> DataFrame:
    """The n rows of the highest scores."""
    return df.orderBy(F.col(score).desc(), order).limit(n)


def quality_split(df: DataFrame, score: str, order: str, n_val: int, n_train: int | None = None) -> DataFrame:
    """Rows with `split`: of the best, min(n_val, a twentieth) but 50 at least go to validation (a tenth if that were all), the next n_train to training.

    The rank is taken in two steps, so no task sees all rows: a range shuffle by
    score, places within each partition, and the count of the rows before it.
    """
    n = F.col("__total")
    v = F.greatest(F.lit(50), F.least(F.lit(n_val), F.floor(n * 0.05)))
    v = F.when(v >= n, F.greatest(F.lit(1), F.floor(n / 10))).otherwise(v)
    ranked = ranks(df, [F.col(score).desc(), F.col(order)]).crossJoin(F.broadcast(df.agg(F.count("*").alias("__total"))))
    split = F.when(F.col("rank") <= v, F.lit("validation")).otherwise(F.lit("train"))
    out = ranked.withColumn("split", split)
    if n_train is not None:
        out = out.where(F.col("rank") <= v + n_train)
    return out.drop("rank", "__total")


def ranks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with `rank` from 1 by a total order, over all partitions.

    The rows are written once as the range shuffle has placed them: what counts the
    partitions and what reads them must see the same ones, also after an executor is lost.
    """
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    counted = placed.withColumn("__p", F.shiftrightunsigned("__m", 33))
    sizes = counted.groupBy("__p").agg(F.count("*").alias("__k"), F.min("__m").alias("__first"))
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a row for each partition: small whatever the data's size
    return counted.join(F.broadcast(starts.select("__p", "__first", "__before")), "__p").withColumn("rank", F.col("__before") + F.col("__m") - F.col("__first") + 1).drop("__m", "__p", "__first", "__before")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def interleaved(parts: dict[str, DataFrame], shares: dict[str, float], key: str, seed: int = 42) -> DataFrame:
    """A mixture by shares that ends when every part was used in full; shorter parts repeat.

    The mixture's size is that of the part that takes longest, n / share. Each part is
    drawn in rounds of its random order, the last round in part.
    """
    sized = [df.select(F.lit(name).alias("part"), F.lit(float(shares[name])).alias("share")).groupBy("part", "share").agg(F.count("*").alias("n")) for name, df in parts.items()]
    sizes = concatenated(sized)
    total = sizes.agg(F.max(F.ceil(F.col("n") / F.col("share"))).alias("total"))
    plan = F.broadcast(sizes.crossJoin(F.broadcast(total)).select("part", "n", F.round(F.col("total") * F.col("share")).cast("long").alias("want")))
    out = []
    for name, df in parts.items():
        own = ranks(df.withColumn("__d", draw(seed, F.lit(name), key)), [F.col("__d"), F.col(key)]).withColumn("part", F.lit(name)).join(plan, "part")
        times = F.floor((F.col("want") - F.col("rank")) / F.col("n")) + 1
        out.append(own.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("rank", "n", "want", "__d"))
    return concatenated(out)


def mixed(parts: dict[str, DataFrame], caps: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Parts, each capped (a negative cap takes all), in one random order."""
    cut = [sampled(df, key, None if caps.get(name, -1) < 0 else caps[name], seed).withColumn("part", F.lit(name)) for name, df in parts.items()]
    both = concatenated(cut)
    return both.orderBy(draw(seed, "part", key), "part", key)


def by_suffix(names: Column) -> Column:
    """The number at the end of a checkpoint's name."""
    return F.regexp_extract(names, r"(\d+)$", 1).try_cast("int")
