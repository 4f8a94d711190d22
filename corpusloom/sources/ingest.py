"""Bringing files to where Spark reads them, and datasets that such a job has dropped. The only module that opens addresses; no query uses the network."""

from __future__ import annotations

import shutil
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retried(call: Callable[[], object], attempts: int = 5, wait: float = 2.0, grow: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """What `call` gives, after up to `attempts` tries. Between them it waits as long as the error's `retry_after` says, else `wait` seconds, growing."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k + 1 == attempts:
                raise
            after = getattr(e, "retry_after", None)
            sleep(float(after) if after is not None else wait * grow**k)
    raise ValueError("attempts must be positive")


def fetched(url: str, folder: str, attempts: int = 3, opener: Callable = urllib.request.urlopen) -> str:
    """The address's file in a folder; one that is there already isn't fetched again. A file appears under its name when it is whole."""
    path = Path(folder, url.rstrip("/").rsplit("/", 1)[-1])
    if not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)

        def get() -> None:
            part = path.with_name(path.name + ".part")
            with opener(url) as source, open(part, "wb") as sink:
                shutil.copyfileobj(source, sink)
            part.rename(path)

        retried(get, attempts)
    return str(path)


def copied(source: str, target: str) -> str:
    """A file or folder at a second place, which it replaces."""
    if Path(source).is_dir():
        shutil.copytree(source, target, dirs_exist_ok=True)
    else:
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(source, target)
    return target


def dropped(spark: SparkSession, folder: str, pattern: str = "*.parquet", split: str | None = None) -> DataFrame:
    """A dataset that an ingest job has left as Parquet files below a folder; of one split (the part of the file's name before a dash) if it is named."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(folder)
    return df if split is None else df.where(F.regexp_extract("_metadata.file_name", r"^([^-.]+)", 1) == split)
