"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a temporary one; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    elif "://" not in base and base.startswith("/"):
        base = "file://" + base if spark.sparkContext.master.startswith("local") else base
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch. Texts are long, and a batch lies in the memory of the JVM and of its Python worker at once.
ARROW_ROWS = 1000


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, what the worker has freed goes back to the system, as it stays for further tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def small_batches(spark: SparkSession) -> None:
    """At most ARROW_ROWS rows a batch from here on, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def save(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives executors."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes saved tables. Only what nothing reads any more: results of theirs must have been saved."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def filtered(docs: DataFrame, run) -> DataFrame:
    """mapInArrow that keeps rows with all their columns, whatever the columns' names (a name may hold dots)."""
    small_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(lambda it: trimmed(run(it)), plain.schema).toDF(*docs.columns)


#: Bits of a bitmap of ids, by the number of ids; the most is what is broadcast and sent to the driver at worst, 64 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
_BLOCK_BITS = 1 << 20


class Bitmap(NamedTuple):
    """Which ids a table holds, with false hits that a join removes. Beyond MOST_BITS / BITS_EACH ids it lets more through, and rows are shuffled that needn't be."""

    bits: int
    data: Broadcast

    def column(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(self.bits))

    def load(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.data.value), np.uint8)


def bitmap(rows: DataFrame, key: str) -> Bitmap:
    """The ids of a saved table. Executors mark and merge the bits; the driver sees the finished blocks alone."""
    spark = rows.sparkSession
    bits = LEAST_BITS
    count = rows.count()
    while bits < min(MOST_BITS, count * BITS_EACH):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            order = np.sort(at)
            for k in np.unique(order // _BLOCK_BITS).tolist():
                own = order[np.searchsorted(order, k * _BLOCK_BITS) : np.searchsorted(order, (k + 1) * _BLOCK_BITS)] - k * _BLOCK_BITS
                np.bitwise_or.at(blocks.setdefault(k, np.zeros(_BLOCK_BITS // 8, np.uint8)), own >> 3, np.left_shift(1, own & 7).astype(np.uint8))
        for k, x in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(x.tobytes(), 1)])], names=["block", "marks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.uint8)
                blocks[k] = blocks[k] | x if k in blocks else x
        for k, x in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(x.tobytes(), 1)])], names=["block", "marks"])

    schema = "block long, marks binary"
    marks = np.zeros(bits // 8, np.uint8)
    placed = rows.select(F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits)).alias("bit"))
    for block, raw in placed.mapInArrow(mark, schema).repartition("block").mapInArrow(merge, schema).collect():
        marks[block * _BLOCK_BITS // 8 : (block + 1) * _BLOCK_BITS // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return Bitmap(bits, spark.sparkContext.broadcast(zlib.compress(marks.tobytes(), 1)))


Batches = Iterator[pa.RecordBatch]


def marked(df: DataFrame, key: str, marks: Bitmap) -> DataFrame:
    """The rows with two more columns at the end, for sided()."""
    return df.withColumn("__known", F.col(key).isNotNull()).withColumn("__bit", marks.column(key))


def sided(batches: Batches, marks: Bitmap, wanted: bool) -> Batches:
    """Of marked() rows those whose key may be marked, or all others (those of null keys among them), without the two columns. To be called inside a mapInArrow function: two of them in a row would need two Python workers a task."""
    mark = marks.load()
    for b in batches:
        if b.num_rows:
            bit, known = b.column(b.num_columns - 1).to_numpy(), b.column(b.num_columns - 2).to_numpy(zero_copy_only=False)
            hit = ((mark[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1) & known
            b = b.filter(pa.array(hit == wanted))
        yield pa.RecordBatch.from_arrays(b.columns[:-2], schema=pa.schema(list(b.schema)[:-2]))


def parted(df: DataFrame, key: str, marks: Bitmap) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be marked, and all others, each with all columns."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    rows = marked(plain, f"c{df.columns.index(key)}", marks)
    near, rest = (rows.mapInArrow(lambda it, w=w: sided(it, marks, w), plain.schema).toDF(*df.columns) for w in (True, False))
    return near, rest
