"""Operator 8, line dedup: drop lines that many documents share.

Lines are exploded with their positions, normalised (lower case, blanks collapsed,
trimmed) and hashed; the distinct documents (ids) of each hash are counted; lines of
more than `threshold` documents are dropped and the rest is put together by position.

Only hashes and positions are shuffled for the counts (a document's repeats of a line
fall away before the shuffle).  Positions to drop come back as one array per text;
texts that lose nothing stay where they are, and only the others are shuffled.  Joins
are merges at every size: how many lines are over the threshold has no bound.

With `copies_once` the documents of one text count as one.  It is for corpora that
still hold copies: else a text copied more often than the threshold loses every line
in all of its copies, and no later step can keep one of them.

Defined results: blank lines are never dropped; a null text stays null; rows of a null
id are cleaned but count as no document (with `copies_once` their texts count);
repeated ids and repeated rows count once and are each cleaned alike; other columns
pass through, whatever their names; `n_chars`, where it exists, is set to the new
length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: More documents than this share boilerplate: published line filters act from a handful to some hundred documents.
THRESHOLD = 20


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\f]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Hash of each normalised line."""
    return F.transform(_lines(text), lambda x: F.xxhash64(normalised(x)))


def frequent(docs: DataFrame, threshold: int = THRESHOLD, copies_once: bool = False) -> DataFrame:
    """For each text that holds lines over the threshold: `text` (its hash) and the positions of those lines."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text"), _hashes(F.col("text")).alias("lines")).where("lines is not null")
    rows = shared.save(hashed, "line-hashes")  # read twice; a small part of the texts' size
    filled = F.col("line") != F.xxhash64(F.lit(""))
    by = "text" if copies_once else "doc_id"
    held = rows.where(F.col(by).isNotNull()).select(by, F.explode(F.array_distinct("lines")).alias("line")).where(filled).distinct()
    over = held.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("line")
    placed = rows.select("text", F.posexplode("lines").alias("at", "line")).where(filled)
    return placed.join(over.hint("merge"), "line", "left_semi").groupBy("text").agg(F.collect_set("at").alias("drop"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row number, text, positions to text without these lines, and how many went."""
    for b in batches:
        texts, drops = b.column(0).to_pylist(), b.column(1)
        out, gone = [], np.zeros(b.num_rows, np.int64)
        for i, t in enumerate(texts):
            if t is not None and drops[i].is_valid:
                lines = t.split("\n")
                stays = np.ones(len(lines), bool)
                stays[np.asarray(drops[i].values)] = False
                gone[i] = len(lines) - int(stays.sum())
                t = "\n".join([lines[k] for k in np.flatnonzero(stays).tolist()])
            out.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(gone), *b.columns[2:]], names=["text", "gone", *b.schema.names[2:]])


def dedup(docs: DataFrame, threshold: int = THRESHOLD, copies_once: bool = False) -> DataFrame:
    """The documents without their frequent lines, and `__dropped`, how many went."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = f"c{docs.columns.index('text')}"
    found = shared.save(frequent(docs, threshold, copies_once), "lines")
    near, rest = shared.parted(plain.withColumn("key", F.xxhash64(at)), "key", shared.bitmap(found, "text"))
    others = [c for c in names if c != at]
    joined = near.join(found.select(F.col("text").alias("key"), "drop").hint("merge"), "key", "left").select(at, "drop", *others)
    schema = ", ".join(["text string, gone long", *(f"{c} {plain.schema[c].dataType.simpleString()}" for c in others)])
    done = joined.mapInArrow(_without, schema).withColumnRenamed("text", at).unionByName(rest.drop("key").withColumn("gone", F.lit(0).cast("long")))
    length = lambda c: F.length(at).cast(plain.schema[c].dataType)
    out = [length(c).alias(c) if name == "n_chars" else F.col(c) for c, name in zip(names, docs.columns)]
    return done.select(*out, "gone").toDF(*docs.columns, "__dropped")


def clean(docs: DataFrame, threshold: int = THRESHOLD, copies_once: bool = False) -> DataFrame:
    """As dedup(), with the columns of `docs` alone."""
    out = dedup(docs, threshold, copies_once)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = f"""
with l as (select doc_id, md5(text) t, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) pos from documents),
n as (select doc_id, t, pos, raw, trim(regexp_replace(lower(raw), '[ \\t\\r\\f]+', ' ', 'g')) norm from l),
f as (select norm from n where norm <> '' group by norm having count(distinct doc_id) > {THRESHOLD}),
u as (select distinct t, pos, raw, norm from n),
k as (select t, string_agg(raw, chr(10) order by pos) filter (where norm not in (select norm from f)) txt, count(*) filter (where norm in (select norm from f)) dropped from u group by t)
select doc_id, case when dropped = 0 then text else coalesce(txt, '') end as text, cast(coalesce(dropped, 0) as bigint) as n_dropped
from documents left join k on k.t = md5(text)
"""
