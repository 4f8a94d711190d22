"""The row stages on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.pipeline import Config, judge, selected


def judged(stream: DataFrame, stages: list[int] | str = (1, 5, 6, 7), config: Config = Config()) -> DataFrame:
    """judge() of a stream of pairs, by the stages that look at one row at a time; stage 2 goes through first_seen()."""
    return judge(stream, [k for k in selected(stages) if k != 2], config)


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped, so it doesn't grow with the stream."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
