"""Readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.filters import filled, filled_choices, keyed_question
from ..operators.sample import draw

PAIR = "source string, target string"


def tsv(spark: SparkSession, path: str, schema: str = PAIR, quoted: bool = False, malformed: str = "PERMISSIVE") -> DataFrame:
    """A table with a header line, tabs between fields, plain or compressed. Without `quoted`, quotes are text."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", malformed)
    return reader.option("quote", '"' if quoted else "").csv(path)


def tsv_columns(spark: SparkSession, path: str) -> DataFrame:
    """A table with all its columns as text, for descriptions; all of its rows count."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def pairs_tsv(spark: SparkSession, path: str, source: str = "source", target: str = "target", cap: int | None = None, seed: int = 42) -> DataFrame:
    """The two columns of a table, found by its header, without rows that lack a side; at most `cap` of them, at random. A path without files gives no rows."""
    try:
        raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PAIR)
    both = raw.select(T.strip(F.col(f"`{source}`")).alias("source"), T.strip(F.col(f"`{target}`")).alias("target")).where(filled(F.col("source"), F.col("target")))
    return both if cap is None else both.orderBy(draw(seed, "source", "target")).limit(cap)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm)
    return found is not None and len(found) > 0


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """ord (from 0) and line of text files, in their order.

    Files are read as they lie, one task a split; each split's lines are counted, the
    counts (a number for each split) are summed, and every line gets its own place. Two
    reads, nothing is sorted and no line passes through Python. Spark reads large files
    first, so a folder's files are ordered by name and not by split.
    """
    # where a line stands is known by file, block and its place in the block
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", "block", "first", before.alias("before"))
    return lines.join(starts, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("ord"), F.col("value").alias("line"))


def parallel(spark: SparkSession, source: str, target: str, ids: str | None = None, strip_numbers: bool = False, strict: bool = False) -> DataFrame:
    """seq, source, target (and id) of line-aligned files. Pairs with a blank side go after the lines are aligned, so nothing shifts; what one file has beyond the other is left out, or with `strict` is an error. Files that aren't there give no rows, unless `strict`."""
    if not strict and not all(exists(spark, p) for p in (source, target)):
        return spark.createDataFrame([], "seq long, source string, target string" + (", id string" if ids else ""))
    left, right = numbered_lines(spark, source), numbered_lines(spark, target)
    if strict and (a := left.count()) != (b := right.count()):
        raise ValueError(f"{source} has {a} lines, {target} {b}")
    side = lambda d, n: d.select("ord", (T.strip(T.strip_line_number(F.col("line"))) if strip_numbers else T.strip(F.col("line"))).alias(n))
    out = side(left, "source").join(side(right, "target"), "ord")
    if ids:
        out = out.join(numbered_lines(spark, ids).select("ord", F.col("line").alias("id")), "ord")
    return out.where(filled(F.col("source"), F.col("target"))).withColumnRenamed("ord", "seq")


def moses_zip(spark: SparkSession, path: str, source: str, target: str, strip_numbers: bool = False, strict: bool = False) -> DataFrame:
    """file, seq, source, target (and id) of zip archives that hold files by language extension. One archive is read by one task, line by line. With `strip_numbers` a number and a tab before a line go; with `strict`, sides of different length are an error."""
    number = re.compile(r"^\s*\d+\s*\t") if strip_numbers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    sides = {k: next((n for n in z.namelist() if n.endswith(f".{k}")), None) for k in (source, target, "ids")}
                    if sides[source] is None or sides[target] is None:
                        continue
                    handles = [io.TextIOWrapper(z.open(n), "utf-8", "replace", newline="\n") if n else None for n in sides.values()]
                    rows: list[tuple] = []
                    for i, (s, t) in enumerate(zip_longest(handles[0], handles[1]) if strict else zip(handles[0], handles[1])):
                        if s is None or t is None:
                            raise ValueError(f"{name}: the sides differ in length from line {i + 1} on")
                        if number:
                            s, t = number.sub("", s), number.sub("", t)
                        key = handles[2].readline().rstrip("\n") if handles[2] else None
                        if s.strip() and t.strip():
                            rows.append((name, i, s.strip(), t.strip(), key))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, seq long, source string, target string, id string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["file", "seq", "source", "target", "id"])


def jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Lines of JSON, plain or compressed; blank lines are skipped. With `tolerant`, an archive that breaks off gives the rows before the break."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    return (reader.option("ignoreCorruptFiles", True) if tolerant else reader).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array (or object)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


QUESTION = "question string, answers array<struct<marker:string,text:string>>, correct_answers array<string>, subject string, possible_answers map<string,string>, correct_answer_num int"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question, answers, correct_answers, subject from an array of lettered questions or from lines of numbered ones (*.jsonl)."""
    raw = jsonl(spark, path, QUESTION) if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")) else json_array(spark, path, QUESTION)
    letters = F.transform(T.lettered_answers(F.col("possible_answers")), lambda a: a["marker"])
    numbered = F.col("possible_answers").isNotNull()
    return raw.select(
        "question",
        F.when(numbered, T.lettered_answers(F.col("possible_answers"))).otherwise(F.col("answers")).alias("answers"),
        F.when(numbered, F.array(F.get(letters, F.col("correct_answer_num")))).otherwise(F.col("correct_answers")).alias("correct_answers"),
        F.coalesce("subject", F.lit("")).alias("subject"),
    )


def pairs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """source and target of lines that call them src and tgt, or en and uk; without blank sides."""
    raw = jsonl(spark, path, "src string, en string, tgt string, uk string")
    both = raw.select(T.strip(T.first_of(F.col("src"), F.col("en"))).alias("source"), T.strip(T.first_of(F.col("tgt"), F.col("uk"))).alias("target"))
    return both.where(filled(F.col("source"), F.col("target")))


def parquet(spark: SparkSession, path: str, pattern: str | None = None, excluding: str | None = None) -> DataFrame:
    """Parquet files below a folder whose names match; files whose path holds `excluding` are left out."""
    reader = spark.read.option("recursiveFileLookup", True) if pattern else spark.read
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)
    return df if excluding is None else df.where(~F.contains(F.col("_metadata.file_path"), F.lit(excluding)))


def stories(spark: SparkSession, path: str, gap: int = 3) -> DataFrame:
    """file, story, paragraph, text of plain or compressed text files."""
    from ..operators.segment import stories as split

    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n", -1)).alias("ord", "line"))
    return split(lines, "file", "ord", "line", gap)


def passages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each usable question of files of passages (text, mcqs of stem, choices, key): text, question, choices, key, answers with markers, and the marker of the key, which is the text of a choice."""
    raw = json_array(spark, path, "text string, mcqs array<struct<stem:string,choices:array<string>,key:string>>")
    rows = raw.select(T.strip(F.col("text")).alias("text"), F.explode("mcqs").alias("m")).where(keyed_question(F.col("m.key"), F.col("m.choices")))
    out = rows.select("text", T.strip(F.col("m.stem")).alias("question"), filled_choices(F.col("m.choices")).alias("choices"), T.strip(F.col("m.key")).alias("key"))
    answers = T.lettered_answers(T.choices_map(F.col("choices")))
    return out.select("*", answers.alias("answers"), F.get(answers, (F.array_position("choices", F.col("key")) - 1).cast("int"))["marker"].alias("correct"))


def annotated(documents: DataFrame) -> DataFrame:
    """A row for each aligned sentence of documents (doc, annotator, source array, target array): id, source, target."""
    rows = documents.select("doc", "annotator", F.posexplode(F.arrays_zip("source", "target")).alias("n", "p"))
    identifier = F.concat(F.col("doc"), F.lit("-a"), F.col("annotator").cast("string"), F.lit("-"), F.lpad(F.col("n").cast("string"), 5, "0"))
    return rows.select(identifier.alias("id"), F.col("p.source").alias("source"), F.col("p.target").alias("target"))
