"""Operator 6, n-gram Jaccard join: adaptive multi-match prefixes.

Documents are sets of word n-grams; the join finds every pair of sets whose
Jaccard similarity is at least `threshold`.

Sets are ordered by a global order, rare n-grams first.  Similar sets of n
n-grams share at least T = ceil(threshold * n); so their prefixes of n - T + k
n-grams share at least k, for any k.  A longer prefix costs more postings but
demands more matches.  Each set chooses its own k from the candidates that the
frequencies of its prefix lead one to expect, and a pair is verified only if it
shares min(k1, k2) n-grams of both prefixes of that length (AdaptJoin; Wang, Li
and Feng 2012).

1. Frequencies: every partition counts its words and, by documents, its n-grams in
   two tables of fixed size; the tables are summed.  An n-gram's expected
   frequency is that of its words together, if they were independent, or what its
   cell holds beyond chance, if that is more (as for the n-grams of boilerplate,
   whose share of the corpus doesn't shrink as it grows).  It orders n-grams and
   estimates candidates; collisions affect cost and never the result.
2. Clusters: sets of a large group of near copies share all of a long prefix, and all
   of their pairs would be emitted once for each n-gram of it.  So sets that share a
   least n-gram (by one of three orders) are held against the first of them, and what
   is similar to it by chains forms a cluster.  A cluster meets as a whole, without any
   list of its pairs.
3. Postings (n-gram, set, position level, cluster) are shuffled by n-gram; partitions
   sort them in numpy and emit the pairs of each n-gram that lie in no common cluster,
   summed per partition.  Sets that share a passage share all of its n-grams, and each
   partition would emit their pairs again; so n-grams that are frequent beyond chance
   (a small part of all postings) go to an eighth of the partitions.
4. Everything with enough matches is verified exactly.  Compressed texts meet, those
   of a cluster together, those of other candidates at a common neighbour, in meetings
   of at most BLOCK sets and MEETING_GRAMS n-grams (larger ones are cut into slots
   and every two slots meet, so no pair is lost).  Sets are computed again where they
   meet, since n-gram hashes are several times as large as the text; a cluster's
   overlaps are matrix products.
5. A meeting returns the number of links of each of its sets and a spanning forest,
   so what leaves it is as large as the meeting and not as its pairs.  Components of
   the forests are the classes.

Documents with equal sets are one set from the start (the set's 64-bit signature
and size stand for it), so thousands of copies cost no more than one; each of them
counts all the others as links.

Defined results: words are case-folded; a text of fewer than n words is one gram
of all of its words; a text without words is compared as a whole, so equal ones
pair; null texts and null ids pair with nothing; repeated rows of an id count once
(an id with several texts takes part with each); other columns are never read; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import components
from . import shared, textops

N = 2
THRESHOLD = 0.7
#: Cells of the frequency tables.
WORD_CELLS = 1 << 20
GRAM_CELLS = 1 << 22
#: Longest extension of a prefix, and what a posting costs against a candidate pair.
MOST = 4
POSTING_COST = 1.0
#: Documents beyond chance from which an n-gram counts as frequent, the bit that says so, and the share of partitions for such n-grams.
FREQUENT, _FREQUENT_BIT, FREQUENT_SHARE = 32, 1 << 15, 8
#: Most sets and n-grams of a slot of a meeting.
BLOCK = 512
MEETING_GRAMS = 1 << 22
#: No cluster.
NONE = -(1 << 63)


class Frequencies(NamedTuple):
    """Summed tables: occurrences of words, documents of n-grams, all words, and what a cell of n-grams holds by chance."""

    words: np.ndarray
    grams: np.ndarray
    total: float
    chance: float


def cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    """The frequency table's cell of each hash."""
    return (hashes >> np.uint64(64 - int(math.log2(cells)))).astype(np.int64)


def gram_sets(texts: list[str], n: int = N, frequency: Frequencies | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes (int64) of all texts in order, where each text's begin, and their expected frequencies (0 without a table)."""
    w = textops.words(texts)
    per = np.diff(w.first)
    grams = textops.ngram_hashes(w.hash, n)
    whole = np.flatnonzero(w.doc[: len(grams)] == w.doc[n - 1 :]) if len(grams) else np.empty(0, np.int64)
    doc, value = w.doc[whole], grams[whole]
    expected = np.zeros(len(whole), np.float32)
    if frequency is not None and len(whole):
        share = frequency.words[cell(w.hash, WORD_CELLS)]
        expected = share[whole]
        for k in range(1, n):
            expected = expected * (share[whole + k] / np.float32(max(1.0, frequency.total)))
        expected = np.maximum(expected, frequency.grams[cell(value, GRAM_CELLS)] - np.float32(frequency.chance))
    few = np.flatnonzero(per < n)
    if len(few):
        own = np.array(
            [np.uint64(textops.hash_bytes(texts[d]) & (2**64 - 1)) if per[d] == 0 else textops.mix(w.hash[w.first[d] : w.first[d + 1]] + np.arange(1, per[d] + 1, dtype=np.uint64)).sum(dtype=np.uint64) for d in few.tolist()],
            np.uint64,
        )
        doc, value, expected = np.concatenate((doc, few)), np.concatenate((value, own)), np.concatenate((expected, np.zeros(len(few), np.float32)))
    value = value.view(np.int64)
    order = np.lexsort((value, doc))
    doc, value, expected = doc[order], value[order], expected[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value, expected = doc[new], value[new], expected[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1)), expected


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textops.mix(grams.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)))
        size = np.diff(first).astype(np.uint64)
        return textops.mix((total[first[1:]] - total[first[:-1]]) + size * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def required(size: np.ndarray, threshold: float) -> np.ndarray:
    """Least number of n-grams that a set shares with any similar one."""
    return np.maximum(1, np.ceil(size * threshold - 1e-9).astype(np.int64))


def prefixes(grams: np.ndarray, first: np.ndarray, expected: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The postings of each set: set number, n-gram, level (the shortest prefix it belongs to, from 1), and the sets' own k."""
    size = np.diff(first)
    n_sets = len(size)
    doc = np.repeat(np.arange(n_sets), size)
    order = np.lexsort((grams, expected, doc))
    g, f = grams[order], expected[order]
    rank = np.arange(len(g)) - first[doc] + 1
    need = required(size, threshold)
    level = np.maximum(1, rank - (size - need)[doc])
    hits = np.stack([np.bincount(doc[level <= k], f[level <= k], n_sets) for k in range(1, MOST + 1)])
    length = (size - need) + np.arange(1, MOST + 1)[:, None]
    # a random candidate has few matches: the k-th match divides the expected candidates by about k
    cost = POSTING_COST * length + hits / np.arange(1, MOST + 1)[:, None] ** 2
    cost[np.arange(1, MOST + 1)[:, None] > need] = np.inf
    own = np.argmin(cost, axis=0) + 1 if n_sets else np.empty(0, np.int64)
    keep = level <= own[doc]
    return doc[keep], g[keep], level[keep], own


_SEEDS = tuple(np.uint64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def blocks(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three blocks of each set, each of its least n-grams by two orders. Two sets share one with the squared probability of their similarity; sets that have no more than a common n-gram in common hardly ever do."""
    x = grams.view(np.uint64)
    if not len(x):
        return np.empty((0, len(_SEEDS) // 2), np.int64)
    least = [np.minimum.reduceat((x ^ s) * _ODD, first[:-1]) for s in _SEEDS]
    return np.stack([textops.mix(textops.mix(a) + b) for a, b in zip(least[::2], least[1::2])], axis=1).view(np.int64)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SCAN = "doc_id long, sig long, n int, blocks array<long>, part int, counts binary"
_PART = 1 << 16


def _scan(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Signatures and blocks of the documents, then the partition's frequency table in compressed parts."""
    table = np.zeros(WORD_CELLS + GRAM_CELLS, np.int32)
    names = [x.split()[0] for x in _SCAN.split(", ")]
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in textops.chunks(texts):
            grams, first, _ = gram_sets(texts[i:j], n)
            for base, cells, hashes in ((0, WORD_CELLS, textops.words(texts[i:j]).hash), (WORD_CELLS, GRAM_CELLS, grams.view(np.uint64))):
                at, count = np.unique(cell(hashes, cells), return_counts=True)
                table[base + at] += count.astype(np.int32)
            m = j - i
            own = pa.ListArray.from_arrays(np.arange(0, 3 * m + 1, 3, dtype=np.int32), pa.array(blocks(grams, first).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), pa.array(signatures(grams, first)), pa.array(np.diff(first).astype(np.int32)), own, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    for k in range(0, len(table), _PART):
        if table[k : k + _PART].any():
            raw = zlib.compress(table[k : k + _PART].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))), pa.array([k // _PART], pa.int32()), pa.array([raw])], names=names)


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(raw), np.int32).astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    for k, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype(np.float32).tobytes(), 1)])], names=["part", "counts"])


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Postings to pairs of no common cluster (a < b, the k they need, the n-grams they share here): all n-grams of a partition at once, sorted in numpy."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    gram, sig, meta, cluster = (np.concatenate([b.column(k).to_numpy() for b in tables]) for k in range(4))
    del tables
    order = np.lexsort((sig, gram))
    new = np.ones(len(order), bool)
    new[1:] = (gram[order[1:]] != gram[order[:-1]]) | (sig[order[1:]] != sig[order[:-1]])  # copies of a document post alike
    order = order[new]
    gram, sig, meta, cluster = gram[order], sig[order], meta[order], cluster[order]
    head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    count = np.diff(np.concatenate((head, [len(gram)])))
    size, level, own = meta >> 16, (meta >> 8) & 127, meta & 255
    many = count > 1
    head, count = head[many], count[many]
    held: list[tuple[np.ndarray, ...]] = []
    pending = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        a, b, k = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, k = a[order], b[order], k[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        n = np.diff(np.concatenate((at, [len(a)])))
        for i in range(0, len(at), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(a[at[s]]), pa.array(b[at[s]]), pa.array(k[at[s]].astype(np.int32)), pa.array(n[s].astype(np.int32))], names=["a", "b", "k", "n"])
        held.clear()

    # one step of the loop pairs every posting with the d-th one after it in its group
    end = np.repeat(head + count, count)
    member = textops.ragged(head, count)
    d = 1
    while len(member):
        alive = member + d < end
        member, end = member[alive], end[alive]
        if not len(member):
            break
        for i in range(0, len(member), 1 << 18):
            x = member[i : i + (1 << 18)]
            y = x + d
            k = np.minimum(own[x], own[y])
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            met = (cluster[x] == cluster[y]) & (cluster[x] != NONE)
            ok = ~met & (np.maximum(level[x], level[y]) <= k) & (small >= threshold * large - 1e-9)
            if not ok.any():
                continue
            x, y, k = x[ok], y[ok], k[ok]
            held.append((sig[x], sig[y], k))  # sorted by signature within a group: x < y
            pending += len(x)
            if pending > 1 << 19:
                yield from flush()
                pending = 0
        d += 1
    yield from flush()


def _deflate(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _inflate(data: bytes) -> str:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass")


class Meeting:
    """Sets that meet: as a whole, or as explicit pairs. `slot` tells the two sides of a meeting of two slots apart."""

    def __init__(self, whole: bool, apart: bool) -> None:
        self.whole, self.apart = whole, apart
        self.sigs: list[int] = []
        self.slots: list[int] = []
        self.copies: list[int] = []
        self.pairs: list[tuple[int, int]] = []


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets, as matrix products over slices of their elements."""
    m, size = len(sets), np.array(list(map(len, sets)))
    if m == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[size[0], common], [common, size[1]]], np.float32)
    of = np.repeat(np.arange(m), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number)[number] > 1 if len(number) else new  # what one set alone holds adds nothing
    number, of = number[often], of[often]
    number = np.cumsum(np.concatenate(([0], (number[1:] != number[:-1]).astype(np.int64)))) if len(number) else number
    out = np.zeros((m, m), np.float32)
    distinct = int(number[-1]) + 1 if len(number) else 0
    width = max(1, min(distinct, (1 << 23) // m))
    edges = np.searchsorted(number, np.arange(0, distinct + width, width))
    for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if x < y:
            part = np.zeros((m, width), np.float32)
            part[of[x:y], number[x:y] - i * width] = 1
            out += part @ part.T
    return out


def _close(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Jaccard similarities of every two sets, 0 where they are below the threshold."""
    size = np.array(list(map(len, sets)), np.float64)
    common = overlaps(sets).astype(np.float64)
    j = common / np.maximum(size[:, None] + size[None, :] - common, 1)
    j[j < threshold - 1e-12] = 0
    np.fill_diagonal(j, 0)
    return j


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (least member, member) of the components of an adjacency matrix."""
    left, out = near.any(axis=1), []
    for i in range(len(near)):
        if left[i]:
            reached, new = np.zeros(len(near), bool), np.zeros(len(near), bool)
            new[i] = True
            while new.any():
                reached |= new
                new = near[new].any(axis=0) & ~reached
            left &= ~reached
            out += [(i, k) for k in np.flatnonzero(reached).tolist() if k != i]
    return out


_MET = "hub long, i int, j int, whole boolean, a long, b long, slot int, copies long, body binary"
_FOUND = "a long, b long, links long, jaccard double"


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, n: int, listed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one meeting after the other: first its sets (as texts), then its pairs, if it has any. Small meetings are worked on together.

    With `listed` all pairs (a, b, jaccard); else the links of each set (a, links) and the edges of a spanning forest (a, b).
    """
    bodies: dict[int, bytes] = {}
    meetings: list[Meeting] = []
    size, key = 0, None
    there: set[int] = set()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["a", "b", "links", "jaccard"])

    def of(m: Meeting, sets: dict[int, np.ndarray]) -> list[tuple]:
        if not m.whole:
            number = {x: k for k, x in enumerate(m.sigs)}
            found = []
            for a, b in m.pairs:
                x, y = sorted((sets[a], sets[b]), key=len)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                j = common / (len(x) + len(y) - common)
                if j >= threshold - 1e-12:
                    found.append((number[a], number[b], j))
            if listed:
                return [(*sorted((m.sigs[x], m.sigs[y])), None, j) for x, y, j in found]
            links, root = [0] * len(m.sigs), list(range(len(m.sigs)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            edges = []
            for x, y, _ in found:
                links[x] += m.copies[y]
                links[y] += m.copies[x]
                if (p := top(x)) != (q := top(y)):
                    root[q] = p
                    edges.append((x, y))
        else:
            j = _close([sets[x] for x in m.sigs], threshold)
            slot = np.array(m.slots)
            if m.apart:
                j[slot[:, None] == slot[None, :]] = 0
            if listed:
                x, y = np.nonzero(np.triu(j))
                return [(*sorted((m.sigs[p], m.sigs[q])), None, j[p, q]) for p, q in zip(x.tolist(), y.tolist())]
            links = ((j > 0) @ np.array(m.copies, np.float64)).astype(np.int64).tolist()
            edges = _forest(j > 0)
        return [(m.sigs[k], None, x, None) for k, x in enumerate(links) if x] + [(*sorted((m.sigs[x], m.sigs[y])), None, None) for x, y in edges]

    def flush() -> Iterator[pa.RecordBatch]:
        sigs, sets = list(bodies), {}
        texts = [_inflate(bodies[x]) for x in sigs]
        for i, j in textops.chunks(texts):
            grams, first, _ = gram_sets(texts[i:j], n)
            sets.update(zip(sigs[i:j], (grams[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist()))))
        rows: list[tuple] = []
        for m in meetings:
            rows += of(m, sets)
            if len(rows) > 1 << 16:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)
        bodies.clear()
        meetings.clear()

    for b in batches:
        for hub, i, j, whole, x, y, slot, copies, body in zip(*(c.to_pylist() for c in b.columns)):
            if (hub, i, j, whole) != key:
                if size > textops.CHUNK_CHARS:
                    yield from flush()
                    size = 0
                key = (hub, i, j, whole)
                meetings.append(Meeting(whole, i != j))
                there = set()
            m = meetings[-1]
            if y is not None:
                m.pairs.append((x, y))
                continue
            if x in there:
                continue  # a repeated row
            there.add(x)
            m.sigs.append(x)
            m.slots.append(slot)
            m.copies.append(copies)
            if x not in bodies:
                bodies[x] = body
                size += int.from_bytes(body[:8], "little")
    yield from flush()


class Joined:
    """The join's tables: `docs` (doc_id, sig), `sets` (sig, doc_id of the least document, copies, n) of all sets, and `found`: what _verify() returns of signatures with a < b."""

    def __init__(self, docs: DataFrame, sets: DataFrame, found: DataFrame) -> None:
        self.docs, self.sets, self.found = docs, sets, found


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _at_hubs(pairs: DataFrame) -> DataFrame:
    """hub, i, j, a, b: where pairs meet, at the least neighbour of their first set; large meetings are cut into slots by hash."""
    near = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    hub = near.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("hub"))
    placed = pairs.join(hub, pairs.a == hub.x).select("hub", "a", "b")
    sizes = placed.select("hub", F.explode(F.array("a", "b")).alias("sig")).distinct().groupBy("hub").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("cuts"))
    return placed.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("a"), "cuts").cast("int").alias("i"), F.pmod(F.xxhash64("b"), "cuts").cast("int").alias("j"), "a", "b")


def _whole(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """Sets (sig, root) that meet as clusters; those too large for one meeting are cut into slots, and every two slots meet."""
    members = clusters.join(sets, "sig").withColumnsRenamed({"root": "hub", "sig": "a"})
    large = members.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(MEETING_GRAMS))).cast("int").alias("cuts")).where("cuts > 1")
    slotted = members.join(large, "hub", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("slot", F.pmod(F.xxhash64("a"), "cuts").cast("int"))
    met = slotted.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return met.select("hub", F.least("slot", "t").alias("i"), F.greatest("slot", "t").alias("j"), F.lit(True).alias("whole"), "a", "doc_id", "slot", "copies")


def _verified(texts: DataFrame, sets: DataFrame, placed: DataFrame, whole: DataFrame | None, threshold: float, n: int, listed: bool) -> DataFrame:
    """What _verify() makes of the pairs of `placed` (a table) and the clusters of `whole`."""
    at_pairs = placed.select("hub", "i", "j", F.explode(F.array("a", "b")).alias("a")).distinct().join(sets.select(F.col("sig").alias("a"), "doc_id", "copies"), "a")
    at_pairs = at_pairs.select("hub", "i", "j", F.lit(False).alias("whole"), "a", "doc_id", F.lit(0).alias("slot"), "copies")
    uses = shared.save(at_pairs if whole is None else at_pairs.unionByName(whole), "uses")

    # the least document of each set that meets others gives its text
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).to_pylist()
            for i, j in textops.chunks(text):
                grams, first, _ = gram_sets(text[i:j], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(signatures(grams, first)), pa.array(map(_deflate, text[i:j]), pa.binary())], names=["doc_id", "a", "body"])

    marks = shared.bitmap(uses, "doc_id")
    given = shared.marked(texts, "doc_id", marks).mapInArrow(lambda it: shared.trimmed(give(shared.sided(it, marks, True))), "doc_id long, a long, body binary")
    columns = [x.split()[0] for x in _MET.split(", ")]
    sent = given.join(uses, ["doc_id", "a"]).withColumn("b", _null("long")).select(columns)
    pairs = placed.withColumns({"whole": F.lit(False), "slot": _null("int"), "copies": _null("long"), "body": _null("binary")}).select(columns)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.unionByName(pairs).repartition(parts, "hub", "i", "j", "whole").sortWithinPartitions("hub", "i", "j", "whole", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(lambda it: shared.trimmed(_verify(it, threshold, n, listed)), _FOUND)


def join(documents: DataFrame, threshold: float = THRESHOLD, n: int = N, listed: bool = False, links: bool = True) -> Joined:
    """With `listed` every pair of different sets, else links and forests; without `links` the forests alone."""
    spark = documents.sparkSession
    shared.small_batches(spark)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    scanned = shared.save(texts.mapInArrow(lambda it: shared.trimmed(_scan(it, n)), _SCAN), "signatures")
    rows = scanned.where("part is null")
    docs = rows.select("doc_id", "sig").distinct()
    counted = docs.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    sets = shared.save(counted.join(rows.groupBy("sig").agg(F.max("n").alias("n"), F.max("blocks").alias("blocks")), "sig"), "sets")
    table = np.zeros(WORD_CELLS + GRAM_CELLS, np.float32)
    for row in scanned.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_sum_parts, "part int, counts binary").collect():  # of fixed size
        table[row.part * _PART : (row.part + 1) * _PART] = np.frombuffer(zlib.decompress(row.counts), np.float32)
    words, cells = table[:WORD_CELLS], table[WORD_CELLS:]
    middle = float(np.median(cells))
    frequency = spark.sparkContext.broadcast(Frequencies(words, cells, float(words.sum()), middle + 4 * math.sqrt(middle + 1)))  # of fixed size

    # sets of one block are held against the least of them
    blocked = sets.select("sig", F.explode("blocks").alias("block"))
    led = blocked.groupBy("block").agg(F.min("sig").alias("a"), F.count("*").alias("n")).where("n > 1")
    tried = shared.save(_at_hubs(blocked.join(led, "block").where("a < sig").select("a", F.col("sig").alias("b")).distinct()), "tried")
    near = shared.save(_verified(texts, sets, tried, None, threshold, n, True).select("a", "b"), "near")
    clusters = shared.save(components(near).select(F.col("node").alias("sig"), "root"), "clusters")

    # of the documents of a cluster's sets, the least of each set posts, and says which cluster it is in
    members = shared.save(docs.join(clusters, "sig").select("doc_id").distinct(), "members")
    marks = shared.bitmap(members, "doc_id")
    inside, _ = shared.parted(texts, "doc_id", marks)
    givers = clusters.join(sets, "sig").select("doc_id", F.col("sig").alias("own"), "root")
    alone = {"own": _null("long"), "root": F.lit(NONE)}
    # merges at every size: a broadcast would leave two Python functions in one task, each with a worker of its own
    apart = inside.join(members.hint("merge"), "doc_id", "left_anti").withColumns(alone).unionByName(inside.join(givers.hint("merge"), "doc_id"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, mine, root = b.column(1).to_pylist(), b.column(2), b.column(3).to_numpy()
            for i, j in textops.chunks(text):
                grams, first, expected = gram_sets(text[i:j], n, frequency.value)
                doc, g, level, own = prefixes(grams, first, expected, threshold)
                size, sig = np.diff(first), signatures(grams, first)
                # an id with several texts: each is joined with the sets of all of them
                right = np.array([x is None or x == y for x, y in zip(mine.slice(i, j - i).to_pylist(), sig.tolist())], bool)[doc]
                doc, g, level = doc[right], g[right], level[right]
                # by the n-gram's hash alone, so that all of its postings go one way
                often = frequency.value.grams[cell(g.view(np.uint64), GRAM_CELLS)] - np.float32(frequency.value.chance) >= FREQUENT
                meta = (size[doc] << 16) | (level << 8) | own[doc] | np.where(often, _FREQUENT_BIT, 0)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(sig[doc]), pa.array(meta), pa.array(root[i:j][doc])], names=["gram", "sig", "meta", "cluster"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "gram long, sig long, meta long, cluster long"
    outside = shared.marked(texts.withColumns(alone), "doc_id", marks).mapInArrow(lambda it: shared.trimmed(post(shared.sided(it, marks, False))), schema)
    often = F.col("meta").bitwiseAND(F.lit(_FREQUENT_BIT)) != 0
    to = F.when(often, F.pmod("gram", F.lit(max(1, parts // FREQUENT_SHARE)))).otherwise(F.col("gram"))
    postings = outside.unionByName(apart.mapInArrow(lambda it: shared.trimmed(post(it)), schema)).repartition(parts, to)
    matched = postings.mapInArrow(lambda it: shared.trimmed(_pairs(it, threshold)), "a long, b long, k int, n int").groupBy("a", "b", "k").agg(F.sum("n").alias("n")).where("n >= k")
    candidates = shared.save(matched.select("a", "b"), "candidates")
    placed = shared.save(_at_hubs(candidates), "placed")
    found = _verified(texts, sets, placed, _whole(clusters, sets) if listed or links else None, threshold, n, listed)
    if not listed and not links:
        found = found.unionByName(near.select("a", "b", _null("long").alias("links"), _null("double").alias("jaccard")))
    found = shared.save(found, "found")
    shared.drop(spark, tried, near, clusters, members, candidates, placed)
    frequency.unpersist()
    return Joined(docs, sets, found)


def similar_sets(documents: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_a, doc_b, jaccard: every similar pair of different sets, each set by its least document. Its size is that of the pairs; similar() is linear."""
    found = join(documents, threshold, n, listed=True)
    first, second = (found.sets.select(F.col("sig").alias(k), F.col("doc_id").alias(f"doc_{k}")) for k in "ab")
    return found.found.join(first, "a").join(second, "b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard")


def _classes(found: Joined) -> DataFrame:
    """sig and root, the least document of all sets that hang together, of sets that have a link to another set."""
    roots = shared.save(components(found.found.where("b is not null")), "components")
    least = roots.join(found.sets.select(F.col("sig").alias("node"), "doc_id"), "node")
    return roots.join(least.groupBy("root").agg(F.min("doc_id").alias("least")), "root").select(F.col("node").alias("sig"), F.col("least").alias("root"))


def similar(documents: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, class_id, n_copies, n_links of every document: the least document that similarity connects it with, and how many other documents have an equal set, and a similar one (copies included)."""
    found = join(documents, threshold, n)
    links = found.found.where("b is null").groupBy(F.col("a").alias("sig")).agg(F.sum("links").alias("links"))
    sets = found.sets.select("sig", F.col("doc_id").alias("least"), "copies").join(_classes(found), "sig", "left").join(links, "sig", "left")
    others = F.col("copies") - 1
    sets = sets.select("sig", F.coalesce("root", "least").alias("class_id"), others.alias("n_copies"), (others + F.coalesce("links", F.lit(0))).alias("n_links"))
    return found.docs.select("doc_id", "sig").join(sets, "sig").select("doc_id", "class_id", "n_copies", "n_links")


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows, with all their columns, of one document (the least id) of each group that similarity holds together; rows of null ids or texts stay.

    An id with several texts goes if any of them belongs to a group of a smaller id.
    """
    found = join(documents, threshold, n, links=False)
    sets = found.sets.select("sig", F.col("doc_id").alias("least")).join(_classes(found), "sig", "left").select("sig", F.coalesce("root", "least").alias("root"))
    gone = shared.save(found.docs.join(sets, "sig").where("doc_id <> root").select("doc_id").distinct(), "gone")
    # only rows that may go are shuffled
    near, rest = shared.parted(documents, "doc_id", shared.bitmap(gone, "doc_id"))
    return near.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns)).unionByName(rest)
