"""Scores of predictions, and the choice of a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, predicted: Column, gold: Column, group: list[str] | None = None) -> DataFrame:
    """n, accuracy, and the share of predictions that could be read; null predictions are wrong."""
    hit = F.coalesce((predicted == gold).cast("int"), F.lit(0))
    aggregates = [F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(predicted.isNotNull().cast("int")).alias("parsed")]
    return df.groupBy(*group).agg(*aggregates) if group else df.agg(*aggregates)


def accuracy_by_source(df: DataFrame, predicted: Column, gold: Column, source: str) -> DataFrame:
    """accuracy() of each source and of all rows (source null), in one pass."""
    hit = F.coalesce((predicted == gold).cast("int"), F.lit(0))
    return df.withColumn("__hit", hit).rollup(source).agg(F.count("*").alias("n"), F.avg("__hit").alias("accuracy"))


def error_scores(df: DataFrame, pair: Column, wrong: Column, right: Column) -> DataFrame:
    """Detection and correction of error pairs: struct<wrong,right> against the gold words."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.agg(F.count("*").alias("n"), share(pair["wrong"] == wrong).alias("detection"), share(pair["right"] == right).alias("correction"), share(pair["wrong"].isNotNull() & pair["right"].isNotNull()).alias("parsed"))


def same_number(a: Column, b: Column) -> Column:
    """Equal as texts without blanks, signs of dollars and boxes, or as numbers."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\boxed\{([^{}]*)\}", "$1"), r"[\s$]|(?<=\d),(?=\d{3}\b)|\.$", "")
    numbers = bare(a).try_cast("double") == bare(b).try_cast("double")
    return F.coalesce((bare(a) == bare(b)) | F.coalesce(numbers, F.lit(False)), F.lit(False))


#: Tokens whose n-grams are counted at once; rows of one key aren't parted.
AT_ONCE = 1 << 17


def _coded(texts: list) -> np.ndarray:
    """A number for each token of texts (whose tokens are characters) or of lists of tokens, one after the other."""
    if texts and isinstance(texts[0], str):
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return pa.array([t for x in texts for t in x], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)


def _named(keys: np.ndarray) -> np.ndarray:
    """0, 1, … for the different keys."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def _counted(rows: list[tuple], orders: int) -> np.ndarray:
    """matched (clipped by the rows of one group), n-grams of predictions and of references, for every n. rows: group, prediction, reference."""
    groups = np.repeat(np.array([g for g, _, _ in rows], np.int64), 2)
    sides = [x for _, p, r in rows for x in (p, r)]
    sizes = np.array([len(x) for x in sides], np.int64)
    side = np.repeat(np.arange(len(sides)) % 2, sizes)
    tokens = _named(_coded(sides))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    # an n-gram is known by the (n - 1)-gram before it and its last token, and the first by group and token: nothing is hashed away
    name = np.repeat(groups, sizes) - (groups[0] if len(groups) else 0)
    width, out = len(tokens) + 1, np.zeros((orders, 3), np.int64)
    for n in range(1, orders + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            break
        new = np.zeros(len(tokens), np.int64)
        new[at] = _named(name[at] * width + tokens[at + n - 1])
        name = new
        p, r = (np.bincount(name[at[side[at] == k]], minlength=len(at)) for k in (0, 1))
        out[n - 1] = np.minimum(p, r).sum(), p.sum(), r.sum()
    return out


def _matches(rows: DataFrame, predicted: Column, reference: Column, orders: int) -> DataFrame:
    """n, match, pred, ref, summed over rows for every n: matched (clipped), n-grams of the predictions, n-grams of the references. Texts of characters or arrays of tokens.

    Rows of one id are counted together. They meet by a shuffle of the rows; n-grams
    are counted where they are, and a task sends their sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, group, last = np.zeros((orders, 3), np.int64), [], 0, 0, None
        for b in batches:
            for key, p, r in zip(*(b.column(c).to_pylist() for c in range(3))):
                if key != last:
                    if size >= AT_ONCE:
                        total, held, size = total + _counted(held, orders), [], 0
                    group, last = group + 1, key
                held.append((group, p, r))
                size += len(p) + len(r)
        total = total + _counted(held, orders)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, orders + 1), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], names=["n", "match", "pred", "ref"])

    met = rows.repartition("id").sortWithinPartitions("id").select("id", predicted, reference)
    return met.mapInArrow(run, "n int, match long, pred long, ref long").groupBy("n").agg(*(F.sum(c).alias(c) for c in ("match", "pred", "ref")))


def _marks(c: str) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"), 0)


def _pairs(df: DataFrame, key: str, predicted: str, reference: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(predicted).alias("pred"), F.col(reference).alias("ref"))


def bleu(df: DataFrame, key: str, predicted: str, reference: str) -> DataFrame:
    """Corpus BLEU (four orders, clipped, brevity penalty, halving smoothing of orders without a match), tokens being words and single signs."""
    total = _matches(_pairs(df, key, predicted, reference), _marks("pred"), _marks("ref"), 4).groupBy().agg(*(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(1, 5) for c in ("match", "pred", "ref")))
    logs, empty, halves = F.lit(0.0), F.lit(False), F.lit(1.0)
    for n in range(1, 5):
        none = (F.col(f"match{n}") == 0) & (F.col(f"pred{n}") > 0)
        halves = F.when(none, halves * 2).otherwise(halves)
        precision = F.when(none, 1 / (halves * F.col(f"pred{n}"))).otherwise(F.try_divide(F.col(f"match{n}"), F.col(f"pred{n}")))
        logs, empty = logs + F.ln(precision), empty | (F.col(f"pred{n}") == 0)
    brevity = F.when(F.col("pred1") >= F.col("ref1"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref1") / F.greatest(F.col("pred1"), F.lit(1))))
    return total.select(F.when(empty | (F.col("match1") == 0), F.lit(0.0)).otherwise(brevity * F.exp(logs / 4) * 100).alias("bleu"))


def chrf(df: DataFrame, key: str, predicted: str, reference: str, char_order: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """Corpus chrF++: the mean F score of character n-grams (blanks aside) and word n-grams."""
    chars = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s", "")
    rows = _pairs(df, key, predicted, reference)
    parts = _matches(rows, chars("pred"), chars("ref"), char_order).unionByName(_matches(rows, _marks("pred"), _marks("ref"), word_order))
    p, r = F.try_divide("match", "pred"), F.try_divide("match", "ref")
    score = F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))
    return parts.where("pred > 0 or ref > 0").select(score.alias("f")).agg(F.coalesce(F.avg("f") * 100, F.lit(0.0)).alias("chrf"))


def checkpoint_score(metrics: DataFrame, run: str, stage: int = 1) -> DataFrame:
    """run and score from metrics (run, metric, value); a missing metric counts as 0."""
    value = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    score = value("MT.BLEU") / 100 + (value("GC.detection") + value("GC.correction")) / 2 + (value("SC.detection") + value("SC.correction")) / 2
    if stage == 2:
        score = score + value("MT_CS.chrF++") / 100 + value("QA.accuracy") + value("MR.accuracy")
    return metrics.groupBy(run).agg(score.alias("score"))


def arg_max(scores: DataFrame, run: str, score: str = "score") -> DataFrame:
    """The run of the highest score, of equals the first."""
    return scores.orderBy(F.col(score).desc(), run).limit(1)


def submission(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Parts one after the other, each in its own order, with the given columns alone."""
    out = None
    for i, df in enumerate(parts):
        one = df.select(F.lit(i).alias("__part"), F.col(order).alias("__order"), *keys)
        out = one if out is None else out.unionByName(one)
    return out.orderBy("__part", "__order").select(*keys)
