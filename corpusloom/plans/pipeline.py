"""The staged cleaning pipeline: any selection of nine stages, in order, with the first failed stage and its reason on every row.

Row stages before and after the deduplication are projections; only stage 2 shuffles.
Rows that an earlier stage rejects don't take part in it, so they can't displace a
good duplicate.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean, dedup, stats

STAGES = dict(enumerate("unicode dedup language uk_quality structural entity copy_source semantic composite".split(), 1))


@dataclass(frozen=True)
class Config:
    """Thresholds and model seams. A seam that is None makes its stage pass everything, as with a model that isn't installed. `near_threshold` None takes near duplicates out of stage 2."""

    pair: str = "en-uk"
    overrides: dict = field(default_factory=dict)
    uk_quality_min: float = 0.0
    embed_sim_min: float = 0.85
    composite_min: float = 0.50
    lid_min: float = 0.95
    near_threshold: float | None = 0.90
    latin: float | None = None
    compose: bool = True
    weights: dict | None = None
    identify: Callable | None = None
    encode: Callable | None = None
    estimate: Column | None = None


def selected(stages: list[int] | str) -> list[int]:
    """Known stages in order; unknown ones are named in a warning."""
    wanted = list(STAGES) if stages == "all" else [int(s) for s in (stages.split(",") if isinstance(stages, str) else stages)]
    for s in set(wanted) - set(STAGES):
        logging.getLogger(__name__).warning("there is no stage %s", s)
    return sorted(set(wanted) & set(STAGES))


def _stage(df: DataFrame, name: str, outcome: Column, score: str | None = None) -> DataFrame:
    """Records the outcome of rows that no stage has rejected yet."""
    alive = F.col("failed_stage").isNull()
    done = df.withColumn("__o", F.when(alive, outcome))
    failed = F.col("__o.reason").isNotNull()
    done = done.withColumn("reason", F.coalesce("reason", "__o.reason")).withColumn("failed_stage", F.when(alive & failed, F.lit(name)).otherwise(F.col("failed_stage")))
    return (done.withColumn(score, F.col("__o.score")) if score else done).drop("__o")


def judge(pairs: DataFrame, stages: list[int] | str = (1, 2, 5, 6, 7), config: Config = Config()) -> DataFrame:
    """Every pair (seq, source, target) with its scores, failed_stage and reason."""
    src, tgt = F.col("source"), F.col("target")
    df = pairs.withColumn("failed_stage", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    for k in selected(stages):
        name = STAGES[k]
        if k == 1:
            df = df.withColumn("source", T.unicode_clean(src, config.compose)).withColumn("target", T.unicode_clean(tgt, config.compose))
            df = _stage(df, name, clean.empty(src, tgt))
        elif k == 2:
            df = _dedup(df, config)
        elif k == 3:
            df = _stage(df, name, clean.language(src, tgt, config.pair, config.identify, config.lid_min))
        elif k == 4:
            df = _stage(df, name, clean.quality(tgt, config.uk_quality_min), "uk_quality_score")
        elif k == 5:
            df = _stage(df, name, clean.structural(src, tgt, config.pair, config.overrides), "structural_score")
        elif k == 6:
            df = _stage(df, name, clean.entity(src, tgt), "entity_score")
        elif k == 7:
            df = _stage(df, name, clean.copied(src, tgt, config.pair, config.latin))
        elif k == 8:
            df = _semantic(df, config)
        else:
            here = {n: f"{n}_score" for n in (STAGES[8], STAGES[4], STAGES[5])}
            scores = {n: F.col(c) for n, c in here.items() if c in df.columns}
            if config.estimate is not None:
                scores["qe"] = clean.sigmoid(config.estimate)
            df = _stage(df, name, clean.estimated(scores, config.composite_min, config.weights), "composite_score")
    return df


def _dedup(df: DataFrame, config: Config) -> DataFrame:
    alive, gone = df.where("failed_stage is null"), df.where("failed_stage is not null")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source", "target").orderBy("seq"))
    marked = alive.withColumn("__n", n).withColumn("reason", F.when(F.col("__n") > 1, F.lit("exact"))).drop("__n")
    if config.near_threshold is not None:
        kept = dedup.near_keep(marked.where("reason is null").select("seq", "source"), "seq", "source", config.near_threshold)
        marked = marked.join(kept.select("seq", F.lit(True).alias("__kept")), "seq", "left")
        marked = marked.withColumn("reason", F.when(F.col("reason").isNull() & F.col("__kept").isNull(), F.lit("near")).otherwise(F.col("reason"))).drop("__kept")
    marked = marked.withColumn("failed_stage", F.when(F.col("reason").isNotNull(), F.lit("dedup")))
    return marked.select(*df.columns).unionByName(gone)


def _semantic(df: DataFrame, config: Config) -> DataFrame:
    from ..operators.retrieve import encoded

    if config.encode is None:
        return _stage(df, "semantic", clean.semantic(None, None))
    ready = df.withColumn("__q", F.concat(F.lit("query: "), "source")).withColumn("__p", F.concat(F.lit("passage: "), "target"))
    ready = encoded(encoded(ready, "__q", config.encode, "__a"), "__p", config.encode, "__b")
    return _stage(ready, "semantic", clean.semantic(F.col("__a"), F.col("__b"), config.embed_sim_min), "semantic_score").drop("__q", "__p", "__a", "__b")


def run_stages(pairs: DataFrame, stages: list[int] | str = (1, 2, 5, 6, 7), config: Config = Config()) -> DataFrame:
    """The pairs that pass all stages, in order of seq: source, target."""
    return judge(pairs, stages, config).where("failed_stage is null").orderBy("seq").select("source", "target")


def run_passes(pairs: DataFrame, passes: list[list[int]], config: Config = Config()) -> DataFrame:
    """run_stages() several times, each over what the last one kept: for corpora whose deduplication comes after all other stages."""
    for stages in passes:
        pairs = judge(pairs, stages, config).where("failed_stage is null").select("seq", "source", "target")
    return pairs.orderBy("seq").select("source", "target")


def statistics(judged: DataFrame, stages: list[int] | str) -> DataFrame:
    return stats.stage_stats(judged, [STAGES[k] for k in selected(stages)])


def report(judged: DataFrame, stages: list[int] | str) -> DataFrame:
    """statistics() with each stage's reasons; write.statistics() makes a file of it."""
    return stats.stage_report(judged, [STAGES[k] for k in selected(stages)])


def with_calibration(pairs: DataFrame, config: Config) -> Config:
    """The configuration with length, character ratio and word ratio bounds at the 2.5 and 97.5 per cent points of the data. Four rows come to the driver."""
    from dataclasses import replace

    found = {r.measure: (r.low, r.high) for r in stats.calibrated_fast(pairs).collect()}
    names = {"src": "src_chars", "tgt": "tgt_chars", "chars": "char_ratio", "words": "word_ratio"}
    return replace(config, overrides=config.overrides | {k: found[m] for k, m in names.items() if m in found})
