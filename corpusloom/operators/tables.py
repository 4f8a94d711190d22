"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def saved(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the folder that executors share; it cuts the lineage and survives their loss."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of an Arrow batch of texts. A batch lies in the memory of its Python worker several times over: as it came, as Python's texts, and as what is made of them.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows a batch from here on, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, a few tasks each: a small file is read by one task, however much is made of its rows then."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="corpusloom-")
