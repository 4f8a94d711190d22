"""Operator 2, WARC: a two-level capture index.

`write` stores captures as gzip-per-record WARC files, one per partition, and
returns their index entries: a sortable key (host labels reversed, port, path;
scheme, fragment, "www." and letter case of the host dropped), the file, the
offset and the length.  `build` range-partitions the entries by key and packs
every run of BLOCK sorted entries into a zlib-compressed block of an index file;
the directory keeps one row per block: first key, last key, file, offset, length.
`lookup` routes each key to the one index file whose key range holds it, and the
directory rows to the tasks of their file; there binary search in the sparse
directory gives the block, one range read fetches it, a second binary search
finds the entries, and each capture is one range read of its WARC file.

Files go to the folder that all executors share (spark.checkpoint.dir).  They are
written under a name of the task attempt and renamed when complete, so a retried
task can't leave a half file under a name that is read.

Defined results: a null or empty url is indexed under the empty key; a null
payload is stored as empty; repeated urls give one entry each, ordered by capture
id; rows that repeat in full are separate captures; other columns are ignored;
an empty table gives an empty directory and empty results.
"""

from __future__ import annotations

import bisect
import gzip
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Entries of a block, as in published capture indexes.
BLOCK = 3000


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sort_key(url: Column) -> Column:
    """com,example,www)/path?query of a url."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?:]*)", 1), r"(?i)^www[0-9]*\.", ""))
    port = F.regexp_extract(bare, r"^[^/?]*?(:[0-9]+)(?:[/?]|$)", 1)
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.when(bare == "", F.lit("")).otherwise(key)


def _record(number: int, url: str, payload: bytes) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:capture:{number}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", 6, mtime=0)


def payload_of(record: bytes) -> bytes:
    """The payload of one compressed record."""
    raw = gzip.decompress(record)
    head, _, rest = raw.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return rest[:size]


class _Writer:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, kind: str) -> None:
        from pyspark import TaskContext

        task = TaskContext.get()
        self.fs, root = _files(folder)
        self.fs.create_dir(root)
        self.name = f"{kind}-{task.stageId() if task else 0}-{task.partitionId() if task else 0}-{task.taskAttemptId() if task else 0}"
        self.path, self.part, self.at = f"{root}/{self.name}", f"{root}/.{self.name}.part", 0
        self.out = self.fs.open_output_stream(self.part)

    def add(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


ENTRY = "key string, id long, url string, file string, offset long, length long"


def write(captures: DataFrame, folder: str) -> DataFrame:
    """Stores captures (id, url, payload, key); their index entries. Runs when the result does, so read it once or save it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            if not b.num_rows:
                continue
            writer = writer or _Writer(folder, "warc")
            ids, urls, payloads, keys = (b.column(k).to_pylist() for k in range(4))
            at = [writer.add(_record(i if i is not None else -1, u or "", (p or "").encode())) for i, u, p in zip(ids, urls, payloads)]
            yield pa.RecordBatch.from_arrays(
                [b.column(3), b.column(0), b.column(1), pa.array([writer.name] * len(at)), pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64())],
                names=["key", "id", "url", "file", "offset", "length"],
            )
        if writer:
            writer.close()

    return captures.select("id", "url", "payload", "key").mapInArrow(run, ENTRY)


def build(entries: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Packs sorted entries into index files; the directory: first, last, file, offset, length, n of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows, held = None, [], []

        def pack(lines: list[tuple]) -> None:
            nonlocal writer
            writer = writer or _Writer(folder, "index")
            at = writer.add(zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode()))
            rows.append((lines[0][0], lines[-1][0], writer.name, *at, len(lines)))

        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(6)))
            while len(held) >= block:
                pack(held[:block])
                held = held[block:]
        if held:
            pack(held)
        if writer:
            writer.close()
            names = ["first", "last", "file", "offset", "length", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)

    ordered = entries.repartitionByRange(F.col("key")).sortWithinPartitions("key", "id", "file", "offset")
    return ordered.mapInArrow(run, "first string, last string, file string, offset long, length long, n long")


class Index:
    """The directory in memory, and block and record access. Directory rows are one in `block` entries."""

    def __init__(self, folder: str, directory: list[tuple]) -> None:
        self.fs, self.root = _files(folder)
        self.rows = sorted(directory)
        self.first = [r[0] for r in self.rows]
        self.open: dict[str, object] = {}
        self.block_at, self.block_keys, self.block = -1, [], []

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 64:
                self.open.popitem()[1].close()
            self.open[file] = self.fs.open_input_file(f"{self.root}/{file}")
        return self.open[file].read_at(length, offset)

    def load(self, k: int) -> None:
        if self.block_at != k:
            lines = [json.loads(x) for x in zlib.decompress(self.read(*self.rows[k][2:5])).decode().split("\n")]
            self.block_at, self.block, self.block_keys = k, lines, [x[0] for x in lines]

    def find(self, key: str) -> list[tuple[int, list]]:
        """(block number, entry) of every capture of a key: binary search in the directory, then in each block that may hold it."""
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        out = []
        while k < len(self.rows) and self.rows[k][0] <= key:
            if self.rows[k][1] >= key:
                self.load(k)
                at = bisect.bisect_left(self.block_keys, key)
                while at < len(self.block) and self.block_keys[at] == key:
                    out.append((k, self.block[at]))
                    at += 1
            k += 1
        return out


LOCATED = "key string, id long, url string, block long, file string, offset long, length long"
FOUND = "key string, id long, url string, block long, offset long, length long, payload string"
#: Bits of an offset within one range of a file; records of a range are read by one task, in order.
_RANGE = 26


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Every capture of the distinct keys, with its payload.

    Entries are found by index file; then records are read by ranges of the stored
    files, in order, so reading is spread as the records are and not as the index is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out, size = Index(folder, []), [], 0
        for b in batches:
            for key, i, url, block, file, offset, length in zip(*(b.column(k).to_pylist() for k in range(7))):
                payload = payload_of(index.read(file, offset, length)).decode("utf-8", "replace")
                out.append((key, i, url, block, offset, length, payload))
                size += len(payload)
                if size > 1 << 22:
                    yield _batch(out, FOUND)
                    out, size = [], 0
        if out:
            yield _batch(out, FOUND)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = locate(keys, directory, folder).repartition(parts, "file", F.shiftright("offset", _RANGE))
    return found.sortWithinPartitions("file", "offset").mapInArrow(run, FOUND)


def locate(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Where the captures of the distinct keys are stored.

    `directory` must be a saved table. The driver reads one key per index file
    (there are as many as range partitions) to route by; directory rows and keys
    meet in a shuffle by file, so no task holds more than one file's directory.
    """
    rows = directory.select("first", "last", "file", "offset", "length", "n")
    routes = sorted(tuple(r) for r in rows.groupBy("file").agg(F.min("first").alias("lo")).select("lo", "file").collect())
    lows, files = [r[0] for r in routes], [r[1] for r in routes]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect.bisect_right(lows, k) - 1 for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([files[max(0, i)] for i in at] if files else [None] * len(at), pa.string()), b.column(0)], names=["file", "ask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, file, out = None, [], None, []
        for b in batches:
            for f, ask, *row in zip(*(b.column(k).to_pylist() for k in range(7))):
                if f != file:
                    index, held, file = None, [], f
                if ask is None:
                    held.append((row[0], row[1], f, *row[2:]))
                    continue
                index = index or Index(folder, held)
                out += [(e[0], e[1], e[2], k, e[3], e[4], e[5]) for k, e in index.find(ask)]
                if len(out) > 1 << 14:
                    yield _batch(out, LOCATED)
                    out = []
        if out:
            yield _batch(out, LOCATED)

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(route, "file string, ask string").where("file is not null")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "file"]
    both = asked.select("file", "ask", *nothing).unionByName(rows.select("file", F.lit(None).cast("string").alias("ask"), "first", "last", "offset", "length", "n"))
    return both.repartition("file").sortWithinPartitions(F.col("file"), F.col("ask").asc_nulls_first(), "first").mapInArrow(run, LOCATED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows), kinds)], names=list(names))


def index(captures: DataFrame, block: int = BLOCK) -> tuple[DataFrame, str]:
    """The saved directory of captures (id, url, payload), and the folder of the files."""
    folder = shared.folder(captures.sparkSession, "captures")
    keyed = captures.select("id", "url", "payload").withColumn("key", sort_key(F.col("url")))
    entries = shared.save(write(keyed, folder), "entries")
    return shared.save(build(entries, folder, block), "directory"), folder


def round_trip(pages: DataFrame) -> DataFrame:
    """Indexes all pages and looks every url of them up: page_id, url, sort_key, html."""
    captures = pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    directory, folder = index(captures)
    found = lookup(captures.select(sort_key(F.col("url")).alias("key")), directory, folder)
    return found.select(F.col("id").alias("page_id"), "url", F.col("key").alias("sort_key"), F.col("payload").alias("html"))


ORACLE = r"""
with b as (select *, regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') bare from pages),
h as (select *, lower(regexp_replace(regexp_extract(bare, '^(?:[^/?@]*@)?([^/?:]*)', 1), '(?i)^www[0-9]*\.', '')) host,
             regexp_extract(bare, '^[^/?]*?(:[0-9]+)(?:[/?]|$)', 1) port, regexp_replace(bare, '^[^/?]*', '') rest from b)
select page_id, url, case when bare = '' then '' else array_to_string(list_reverse(string_split(host, '.')), ',') || port || ')' || case when rest like '/%' then rest else '/' || rest end end as sort_key,
       coalesce(html, '') as html from h
"""
