"""Corpus builders as configuration: sources, paragraph windows, stages and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, filters, segment
from ..operators.sample import quality_split
from .pipeline import Config, run_passes


@dataclass(frozen=True)
class Corpus:
    """Stages of each pass over the corpus, and thresholds."""

    passes: tuple[tuple[int, ...], ...]
    similarity: float
    near: float = 0.90
    sentences: tuple[int, int] | None = None
    chars: tuple[int, int] | None = None
    saturation: float = 600
    weights: tuple[float, float, float] = (0.55, 0.25, 0.20)


CORPORA = {
    "eubookshop": Corpus(((1, 2, 3, 5, 6, 7, 8),), 0.78, sentences=(3, 15), chars=(80, 4000)),
    "elrc": Corpus(((1, 2, 3, 5, 6, 7, 8, 9),), 0.89, sentences=(2, 12), chars=(80, 5000), saturation=700, weights=(0.50, 0.30, 0.20)),
    "wikimedia": Corpus(((1, 2, 3, 4, 5, 6, 7, 8),), 0.87, near=0.93, saturation=400),
    "nllb": Corpus(((1, 3, 4, 5, 6, 7, 8), (2,)), 0.85),
    "fiction": Corpus(((1, 2, 3, 6, 7, 8),), 0.87),
}

#: Caps by corpus for training mixtures.
CAPS = {"cs-uk": {"nllb": 58_000, "elrc": 2_000}, "en-uk": {"nllb": 34_000, "dochplt": 20_000, "macocu": 64_000}}


def build(name: str, pairs: DataFrame, config: Config = Config(pair="cs-uk"), group: str | None = None) -> DataFrame:
    """The corpus's paragraphs (where it has windows and a document column), cleaned by its stages: source, target."""
    from dataclasses import replace

    c = CORPORA[name]
    if c.sentences and group:
        paragraphs = segment.paragraphs(pairs, [group], "seq", ["source", "target"], c.sentences, c.chars)
        pairs = paragraphs.select(F.concat_ws("|", group, F.format_string("%09d", "window")).alias("seq"), "source", "target")
    if name == "wikimedia":
        pairs = pairs.where(filters.long_enough(F.col("source"), F.col("target")))
    return run_passes(pairs, [list(p) for p in c.passes], replace(config, embed_sim_min=c.similarity, near_threshold=c.near))


def scored(name: str, pairs: DataFrame, pair: str = "cs-uk") -> DataFrame:
    """Adds `quality`, by which paragraphs are ranked."""
    c, src, tgt = CORPORA[name], F.col("source"), F.col("target")
    return pairs.withColumn("quality", segment.quality(src, tgt, clean.structural(src, tgt, pair)["score"], clean.uk_quality(tgt), c.saturation, c.weights))


def splits(name: str, pairs: DataFrame, n_val: int, n_train: int | None = None, pair: str = "cs-uk") -> DataFrame:
    """seq, source, target, quality and split: the best paragraphs for validation."""
    return quality_split(scored(name, pairs, pair), "quality", "seq", n_val, n_train)
