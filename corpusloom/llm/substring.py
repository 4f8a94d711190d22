"""Operator 10, substring dedup: suffix automata of reference shards, matching statistics of streamed documents.

A word of a document is removed if it lies in a span of at least LENGTH words that
an earlier document (one of a smaller id) holds too; spans are maximal, and case,
punctuation and spacing don't count.

1. Winnowing fingerprints: of every LENGTH - GRAM + 1 consecutive n-grams of GRAM
   words the least hash is kept, so documents that share a span of LENGTH words
   share a fingerprint inside it.  Only fingerprints are shuffled; the least id
   that holds one leads it.
2. Documents that share fingerprints send, for each leader, the words around
   those fingerprints, as far as a span of LENGTH words can reach.
3. Each leader's group is streamed in id order against suffix automata of its
   reference shards (of at most SHARD_WORDS words each): matching statistics
   mark the ends of spans of LENGTH words; what stays unmarked joins the
   reference.  Equal stretches are recognised by a digest.

Automata of all shards would grow with the corpus, so they aren't broadcast: a
shard is built in the one task that holds the documents which can match it.

Defined results: null, empty and short texts (fewer than LENGTH words) pass
unchanged, so do rows of a null id; rows that repeat an id are one document (each
is cut by what its own text shares with smaller ids, never by one another); other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textops

LENGTH = 50
GRAM = 25
SHARD_WORDS = 150_000


def _slide(x: np.ndarray, width: int, op: Callable) -> np.ndarray:
    size, y = 1, x
    while size * 2 <= width:
        y = op(y[:-size], y[size:])
        size *= 2
    if size < width:
        y = op(y[: len(y) - (width - size)], y[width - size :])
    return y


def fingerprints(w: textops.Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (of the chunk) and hashes of the winnowed n-grams."""
    if len(w.hash) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = textops.ngram_hashes(w.hash, gram)
    width = length - gram + 1
    least = _slide(h, width, np.minimum)
    least = np.where(w.doc[: len(least)] == w.doc[length - 1 :], least, np.uint64(0))  # windows across documents choose nothing
    pad = np.zeros(width - 1, np.uint64)
    best = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
    at = np.flatnonzero((best == h) & (h > 0))
    return at, h[at]


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of q's sequences that end in p's and c alone."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nxt[q]))
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, sequence: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            p = last
            q = nxt[p].get(c)
            if q is not None:
                last = q if length[q] == length[p] + 1 else self._split(p, q, c)
                continue
            last = self._state(length[p] + 1, 0, {})
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, q, c)

    def statistics(self, sequence: list[int]) -> Iterator[int]:
        """For each position the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        v = size = 0
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            q = nxt[v].get(c)
            if q is None:
                size = 0
            else:
                v, size = q, size + 1
            yield size


def repeats(group: list[tuple[int, int, np.ndarray]], length: int = LENGTH, shard: int = SHARD_WORDS) -> list[tuple[int, int, int]]:
    """(stretch, from, to): word ranges that earlier ids of the group hold. group: (id, position of the stretch, its words), in id order."""
    ends = [np.zeros(len(x), bool) for _, _, x in group]
    done = np.array([len(x) < length for _, _, x in group])
    seen: dict[bytes, int] = {}
    for k, (i, _, x) in enumerate(group):
        owner = seen.setdefault(xxhash.xxh128_digest(x.tobytes()), i)
        if owner < i and not done[k]:
            ends[k][length - 1 :] = True
            done[k] = True
    words = [None if d else x.tolist() for d, (_, _, x) in zip(done, group)]
    at = 0
    while at < len(group):
        automaton, held, k, full = Automaton(), 0, at, False
        while k < len(group):
            more = k
            while more < len(group) and group[more][0] == group[k][0]:
                more += 1
            for j in range(k, more):
                if words[j] is not None and held:
                    ends[j] |= np.fromiter(automaton.statistics(words[j]), np.int64, len(words[j])) >= length
            if not full:
                for j in range(k, more):
                    if words[j] is None:
                        continue
                    new = ~ends[j]
                    new[: length - 1] = False
                    edge = np.diff(np.concatenate(([0], new.astype(np.int8), [0])))
                    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                        automaton.add(words[j][a - length + 1 : b])
                        held += b - a + length - 1
                at, full = more, held >= shard
            k = more
    out = []
    for k, ((_, start, x), e) in enumerate(zip(group, ends)):
        if e.any():
            step = np.zeros(len(x) + 1, np.int64)
            hit = np.flatnonzero(e)
            np.add.at(step, hit - length + 1, 1)
            np.add.at(step, hit + 1, -1)
            edge = np.diff(np.concatenate(([0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0])))
            out += [(k, start + a, start + b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    return out


def _emit_prints(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        ids = b.column(0).to_numpy()
        for i, j in textops.chunks(texts):
            w = textops.words(texts[i:j])
            at, h = fingerprints(w, length, gram)
            doc = w.doc[at]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[i:j][doc[new]])], names=["fp", "doc_id"])


def _stretches(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each leader of a document's fingerprints the words around them."""
    for b in batches:
        texts = b.column(1).to_pylist()
        ids, prints, leaders, keys = b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist()
        for i, j in textops.chunks(texts):
            w = textops.words(texts[i:j])
            at, h = fingerprints(w, length, gram)
            edge = np.searchsorted(at, w.first)
            out: list[tuple] = []
            for d in range(j - i):
                fp = np.asarray(prints[i + d].values).view(np.uint64)
                lead = np.asarray(leaders[i + d].values)
                order = np.argsort(fp)
                fp, lead = fp[order], lead[order]
                here, hash_ = at[edge[d] : edge[d + 1]], h[edge[d] : edge[d + 1]]
                k = np.minimum(np.searchsorted(fp, hash_), len(fp) - 1)
                hit = fp[k] == hash_
                here, of = here[hit], lead[k[hit]]
                first, last = int(w.first[d]), int(w.first[d + 1])
                for leader in np.unique(of).tolist():
                    lo = np.maximum(here[of == leader] - (length - gram), first)
                    hi = np.minimum(here[of == leader] + length, last)
                    cut = np.flatnonzero(lo[1:] > hi[:-1])
                    for x, y in zip(lo[np.concatenate(([0], cut + 1))].tolist(), hi[np.concatenate((cut, [len(hi) - 1]))].tolist()):
                        out.append((leader, ids[i + d], x - first, w.hash[x:y].tobytes(), keys[i + d]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["leader", "doc_id", "start", "words", "key"])


def _stream(batches: Iterator[pa.RecordBatch], length: int, shard: int) -> Iterator[pa.RecordBatch]:
    group: list[tuple[int, int, np.ndarray]] = []
    keys: list[int] = []
    leader = None

    def flush() -> Iterator[pa.RecordBatch]:
        found = repeats(group, length, shard)
        if found:
            k, lo, hi = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([group[x][0] for x in k]), pa.array([keys[x] for x in k]), pa.array(lo), pa.array(hi)], names=["doc_id", "key", "lo", "hi"])

    for b in batches:
        for lead, i, start, raw, key in zip(*(b.column(k).to_pylist() for k in range(5))):
            if lead != leader:
                yield from flush()
                group, keys, leader = [], [], lead
            group.append((i, start, np.frombuffer(raw, np.uint64)))
            keys.append(key)
    yield from flush()


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD_WORDS) -> DataFrame:
    """doc_id, key (xxhash64 of the text), lo, hi: word ranges (of the text's own words, from 0) that earlier documents hold; ranges of one text may touch or overlap."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    prints = texts.mapInArrow(lambda it: _emit_prints(it, length, gram), "fp long, doc_id long")
    by = Window.partitionBy("fp")
    led = prints.withColumn("leader", F.min("doc_id").over(by)).withColumn("last", F.max("doc_id").over(by)).where("leader < last").select("doc_id", "fp", "leader")
    members = shared.save(led.groupBy("doc_id").agg(F.collect_list("fp").alias("fps"), F.collect_list("leader").alias("leaders")), "members")
    near, _ = shared.parted(texts, "doc_id", shared.bitmap(members, "doc_id"))
    sent = near.join(members, "doc_id").select("doc_id", "text", "fps", "leaders", F.xxhash64("text").alias("key")).mapInArrow(lambda it: _stretches(it, length, gram), "leader long, doc_id long, start long, words binary, key long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "leader").sortWithinPartitions("leader", "doc_id", "start").mapInArrow(lambda it: _stream(it, length, shard), "doc_id long, key long, lo long, hi long")


def cut(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without its words of the ranges and what lies between them; how many words went."""
    w = textops.words([text])
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        hi = min(hi, len(w.start))
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        elif lo < hi:
            merged.append([lo, hi])
    out, at = [], 0
    for lo, hi in merged:
        out.append(text[at : w.start[lo]])
        at = int(w.end[hi - 1])
    return "".join([*out, text[at:]]), sum(hi - lo for lo, hi in merged)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text without repeated spans, n_removed words, and the spans' word ranges."""
    found = shared.save(spans(docs, length, gram, shard).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, 0) if not r or t is None else cut(t, [(x["lo"], x["hi"]) for x in r]) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()), b.column(2)], names=["doc_id", "text", "n_removed", "spans"])

    schema = "doc_id long, text string, n_removed long, spans array<struct<lo:bigint,hi:bigint>>"
    marks = shared.bitmap(found, "doc_id")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in shared.sided(batches, marks, False):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.zeros(b.num_rows, np.int64)), pa.nulls(b.num_rows, kind)], names=["doc_id", "text", "n_removed", "spans"])

    # only documents that lose something meet their spans; all others stay where they are
    rows = docs.select("doc_id", "text")
    near, _ = shared.parted(rows, "doc_id", marks)
    joined = near.withColumn("key", F.xxhash64("text")).join(found, ["doc_id", "key"], "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema).unionByName(shared.marked(rows, "doc_id", marks).mapInArrow(rest, schema))
