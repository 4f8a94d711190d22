"""Writers."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.filters import filled


def tsv(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    """Pairs on one line each: rows that lack a side go, white space becomes single spaces, quotes stay as they are."""
    both = df.where(filled(F.col("source"), F.col("target"))).select(T.collapse(F.col("source")).alias("source"), T.collapse(F.col("target")).alias("target"))
    both.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("compression", compression).csv(path)


def jsonl(df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "errorifexists", compression: str = "none") -> None:
    """Lines of JSON with the keys in the given order; nulls are written."""
    (df.select(*keys) if keys else df).write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


def json_array(df: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One indented JSON array, for small tables that people read; a larger table is an error."""
    rows = [r[0] for r in df.limit(limit + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write lines of JSON")
    import json

    Path(path).write_text(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2), "utf-8")


def json_arrays(df: DataFrame, path: str, rows: int = 10_000, chars: int = 1 << 25) -> None:
    """A folder of files that are one JSON array each, for tables of any size: the tasks write their own rows, and a file ends at so many rows or characters, so who reads one never holds more."""

    def array(held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["[\n" + ",\n".join(held) + "\n]"])], names=["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(x.as_py())
                size += len(held[-1])
                if len(held) >= rows or size >= chars:
                    yield array(held)
                    held, size = [], 0
        if held:
            yield array(held)

    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def parallel(df: DataFrame, source: str, target: str, order: str = "seq") -> None:
    """Two folders of text files whose lines are aligned; tabs and line feeds become spaces."""
    flat = df.orderBy(order).select(*(F.translate(c, "\n\t\r", "   ").alias(c) for c in ("source", "target")))
    flat.select("source").write.text(source)
    flat.select("target").write.text(target)


def archive(folder: str, path: str, prefix: str) -> int:
    """A folder's files as a zip archive below a prefix; their number."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_")))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, f"{prefix}/{p.relative_to(folder)}")
    return len(files)


def nowhere(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def resumed(inputs: DataFrame, path: str, key: str, work, schema: str) -> DataFrame:
    """Appends what `work` makes of the inputs whose key the table at `path` lacks; the whole table. A run that breaks off goes on where it was."""
    spark = inputs.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    left = inputs if not there else inputs.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
    work(left).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def statistics(table: DataFrame, path: str, pair: str, dataset: str) -> dict:
    """A pipeline's statistics (stage, n_in, n_out, n_rejected, retention, reasons; a row for each stage) as one JSON file, and what it says."""
    import json

    stages = [{"stage": r.stage, "n_in": r.n_in, "n_out": r.n_out, "n_rejected": r.n_rejected, "retention_pct": r.retention, "reject_reasons": dict(sorted((r.reasons or {}).items()))} for r in table.orderBy("i").collect()]
    said: dict = {"lang_pair": pair, "dataset": dataset, "stages": stages}
    if stages:
        said |= {"total_in": stages[0]["n_in"], "total_out": stages[-1]["n_out"]}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(said, ensure_ascii=False, indent=2), "utf-8")
    return said
