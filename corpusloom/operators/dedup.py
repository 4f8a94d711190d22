"""Exact and near duplicates, and the components that near duplicates form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import saved

PERMUTATIONS, BANDS = 128, 32
#: Most signatures of a slot; larger buckets are cut into slots, and every two slots meet.
SLOT = 4096


def first_of_each(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. One shuffle on the key; nulls are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def exact(pairs: DataFrame, order: str = "seq") -> DataFrame:
    """The first of equal (source, target) pairs. Exact, where a Bloom filter would lose rows."""
    return first_of_each(pairs, ["source", "target"], [order])


def first_questions(df: DataFrame, question: str, order: str, dedup: bool = True) -> DataFrame:
    """The first row of each normalised question; without `dedup` every row."""
    if not dedup:
        return df
    return first_of_each(df.withColumn("__key", T.question_key(F.col(question))), ["__key"], [order]).drop("__key")


def by_priority(df: DataFrame, keys: list[str], priority: Column, order: str) -> DataFrame:
    """Of equal rows the one of the corpus that comes first."""
    return first_of_each(df, keys, [priority, order])


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter."""
    import math

    bits = int(-items * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / items * math.log(2)))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


#: Where an empty bin borrows from, attempt by attempt.
_PROBES = (_mixed(np.arange(PERMUTATIONS * 512, dtype=np.uint64) + np.uint64(1)) % np.uint64(PERMUTATIONS)).astype(np.int64).reshape(PERMUTATIONS, 512)


def signature(text: str, n: int = 5, short_alike: bool = False) -> np.ndarray:
    """MinHashes of a text's lower-case character n-grams: one hash a gram, the least of each of 128 bins, empty bins filled from others (Shrivastava 2017). A text of fewer than n characters is one gram; with `short_alike` all such texts are alike."""
    if short_alike and len(text) < n:
        return np.zeros(PERMUTATIONS, np.int32)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = max(1, len(cp) - n + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(cp))):
            h = h * np.uint64(0x9E3779B97F4A7C15) + cp[k : k + m] + np.uint64(1)
    h = np.sort(_mixed(h + np.uint64(len(cp) if len(cp) < n else n)))
    at = np.searchsorted(h, np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(57))
    least = h[np.minimum(at, m - 1)]
    full = (at < m) & (least >> np.uint64(57) == np.arange(PERMUTATIONS, dtype=np.uint64))
    out = ((least >> np.uint64(25)) & np.uint64(0x7FFFFFFF)).astype(np.int32)
    empty, k = np.flatnonzero(~full), 0
    while len(empty):
        source = _PROBES[empty, k % _PROBES.shape[1]] if k < _PROBES.shape[1] else np.full(len(empty), np.argmax(full))
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty, k = empty[~hit], k + 1
    return out


def signatures(docs: DataFrame, key: str, text: str, n: int = 5, short_alike: bool = False) -> DataFrame:
    """key and `signature`: 128 MinHashes of the character n-grams. One pass in numpy, nothing is shuffled; null texts have none."""
    rows = docs.where(F.col(text).isNotNull()).select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = [signature(t, n, short_alike) for t in b.column(1).to_pylist()]
            flat = np.concatenate(signed) if signed else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, PERMUTATIONS, dtype=np.int32), pa.array(flat))], names=[key, "signature"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, signature array<int>")


def _forest(met: np.ndarray, slots: np.ndarray, apart: bool, threshold: float) -> list[tuple[int, int, float]]:
    """Edges that hold together what similarity holds together. A row is compared with the others only while some of them are unreached, so a bucket of copies costs one comparison each."""
    left, out = np.ones(len(met), bool), []
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        queue = [first]
        while queue and left.any():
            i = queue.pop()
            others = np.flatnonzero(left & (slots != slots[i]) if apart else left)
            share = (met[others] == met[i]).mean(axis=1) if len(others) else np.empty(0)
            near = share >= threshold - 1e-12
            out += [(i, k, x) for k, x in zip(others[near].tolist(), share[near].tolist())]
            queue += others[near].tolist()
            left[others[near]] = False
    return out


def _all(met: np.ndarray, slots: np.ndarray, apart: bool, threshold: float) -> list[tuple[int, int, float]]:
    out = []
    for i in range(len(met) - 1):
        share = (met[i + 1 :] == met[i]).mean(axis=1)
        near = share >= threshold - 1e-12
        if apart:
            near &= slots[i + 1 :] != slots[i]
        out += [(i, i + 1 + k, share[k]) for k in np.flatnonzero(near).tolist()]
    return out


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (numbers of signatures) of every bucket, which come one after the other."""
    held, bucket, apart = [], None, False
    find = _forest if forest else _all

    def flush() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            names, slots, met = (np.array(x) for x in zip(*held))
            found = find(met, slots, apart, threshold)
            if found:
                a, b, x = zip(*found)
                p, q = names[list(a)], names[list(b)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(x)], names=["x", "y", "similarity"])
        held.clear()

    for b in batches:
        values = b.column(5).flatten().to_numpy().reshape(-1, PERMUTATIONS) if b.num_rows else []
        for k, (h, i, j, name, slot) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)))):
            if (h, i, j) != bucket:
                yield from flush()
                bucket, apart = (h, i, j), i != j
            held.append((name, slot, values[k]))
    yield from flush()


def resemblance(a: Column, b: Column) -> Column:
    """Share of equal MinHashes: an estimate of the Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _spans(threshold: float, bands: int) -> list[tuple[int, int]]:
    """First place and number of places of each band.

    Two signatures that agree in `threshold` differ in so many places at most; with one
    band more than that, some band is the same in both. Those bands find every such pair, as
    narrower and more ones do, and far fewer others. Where `bands` are fewer, they stay as they are.
    """
    enough = PERMUTATIONS - math.ceil(PERMUTATIONS * (threshold - 1e-12)) + 1
    if not 0 < enough < bands:
        return [(i * (PERMUTATIONS // bands), PERMUTATIONS // bands) for i in range(bands)]
    ends = [i * PERMUTATIONS // enough for i in range(enough + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _near(docs: DataFrame, key: str, text: str, threshold: float, bands: int, forest: bool) -> tuple[DataFrame, DataFrame]:
    """key and sig of all texts; x, y, similarity of different signatures. Every two signatures of one bucket are compared, or hang together by others that were.

    Texts of one signature are one from the start. Only hashes are shuffled to find
    the buckets; of buckets with the same members one is kept; signatures go to those
    that have two or more.
    """
    signed = saved(signatures(docs, key, text).withColumn("sig", F.xxhash64("signature")), "signatures")
    distinct = saved(signed.groupBy("sig").agg(F.first("signature").alias("signature")), "distinct")
    band = F.explode(F.array(*(F.xxhash64(F.lit(i), F.slice("signature", at + 1, n)) for i, (at, n) in enumerate(_spans(threshold, bands))))).alias("bucket")
    placed = saved(distinct.select("sig", band), "buckets")
    sized = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.shiftright("sig", 32)).alias("members"), F.bit_xor("sig").alias("mark")).where("n > 1")
    kept = sized.groupBy("members", "mark", "n").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / SLOT).cast("int").alias("cuts"))
    slot = F.pmod(F.xxhash64("sig"), F.col("cuts")).cast("int")
    sent = placed.join(kept, "bucket").withColumn("slot", slot).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    meeting = sent.select("bucket", F.least("slot", "t").alias("i"), F.greatest("slot", "t").alias("j"), "sig", "slot").join(distinct, "sig")
    ordered = meeting.select("bucket", "i", "j", "sig", "slot", "signature").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "sig")
    found = ordered.mapInArrow(lambda it: _meet(it, threshold, forest), "x long, y long, similarity double")
    return signed.select(key, "sig"), found


def near_pairs(docs: DataFrame, key: str, text: str, threshold: float = 0.85, bands: int = BANDS) -> DataFrame:
    """a < b and similarity of all pairs that agree in a band and in `threshold` of their MinHashes. As many rows as there are pairs; near_keep() needs far fewer."""
    signed, found = _near(docs, key, text, threshold, bands, forest=False)
    side = lambda k, s: signed.select(F.col(key).alias(k), F.col("sig").alias(s))
    other = found.dropDuplicates(["x", "y"]).join(side("p", "x"), "x").join(side("q", "y"), "y").select("p", "q", "similarity")
    same = side("p", "x").join(side("q", "x"), "x").where("p < q").select("p", "q", F.lit(1.0).alias("similarity"))
    return other.unionByName(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def near_components(docs: DataFrame, key: str, text: str, threshold: float = 0.85, bands: int = BANDS) -> DataFrame:
    """node (key) and root of all texts that are similar to another one, by chains of such pairs."""
    signed, found = _near(docs, key, text, threshold, bands, forest=True)
    roots = components(found, "x", "y")
    whole = signed.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(F.col(key).alias("node"), F.coalesce("root", "sig").alias("root"))
    many = whole.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return whole.join(many, "root", "left_semi").select("node", "root")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node it is connected with. Least neighbours and pointer jumping, each round a table; it ends when a round changes nothing."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = saved(step.join(far, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "was"), "roots")
        roots = new.select("node", "root")
        if new.where("root <> was").isEmpty():
            return roots


def near_keep(docs: DataFrame, key: str, text: str, threshold: float = 0.85) -> DataFrame:
    """One document of each component, the longest (of equals the least key), and all documents in none."""
    roots = near_components(docs, key, text, threshold)
    sized = saved(roots.join(docs.select(F.col(key).alias("node"), F.length(text).alias("len")), "node"), "sized")
    best = sized.groupBy("root").agg(F.min_by("node", F.struct(-F.col("len"), F.col("node"))).alias("best"))
    gone = sized.join(best, "root").where("node <> best").select(F.col("node").alias(key))
    return docs.join(gone, key, "left_anti").select(*docs.columns)
