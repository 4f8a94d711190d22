"""Operator 4, LM scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) P(word | class, context).  Classes are
slices of CLASS words of the vocabulary by frequency; the last class takes all
other words, by hash.  Both factors are softmaxes over sums of weight rows: a bias
and three hashed features of the context, the bigram, the trigram and the skip
bigram (the second word back without the first); rows of the word factor are
hashed with the class, and the context's words are told apart by their own hashes,
frequent or not.  So a word costs two softmaxes of 64, not one of 4096.

A slot of the last class is split further by the next digits of the hash, a softmax
of CLASS each, with as many levels as the counted vocabulary fills (LEVELS at
most).  Words that still share a place divide its probability by their counts, so
the probabilities of all counted words, and of one unseen word a place, sum to one.

1. Words are counted over the whole corpus; counts give vocabulary, classes,
   levels and the biases' first values.
2. Training is distributed: from the broadcast weights every partition takes
   gradient steps over all of its words, in batches of sparse rows (only rows of
   features that occur are touched), and sends what changed, in half precision by
   blocks of rows; changes are averaged by words seen, in steps of FAN partitions a
   task.  ROUNDS such passes.  As every partition trains by itself, weights depend on
   how the corpus is partitioned (not on which executor works on what, nor on tasks
   that are run again); there is no random draw.
3. Scoring runs the forward pass over the same sparse batches, from weights whose
   exponentials are taken once a task (unless a logit could reach the limits it is
   held in), so a word costs products and no exponential. Counts of the most
   frequent other words (TABLE at most) go along; where the vocabulary is larger,
   the rest of each text's words are joined with the table of counts.

What is broadcast has a fixed size (at most (2 + LEVELS) * ROWS * CLASS weights,
CLASS ** (LEVELS + 1) biases and TABLE counts); what is gathered grows with the
corpus.

Defined results: null, empty and word-less texts have n_words 0 and null scores;
null and repeated ids and repeated rows are scored row by row (and repeated rows
are trained on as often); a word that was never counted has the unseen word's
probability of its place; ties in frequency are ordered by hash; other columns
are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textops

CLASS = 64
CLASSES = 64
LEVELS = 2
TABLE = 1 << 18
ROWS = 1 << 14  # row numbers of all factors, (2 + LEVELS) * ROWS, must fit 16 bits
ROUNDS = 1
RATE = 0.5
BATCH = 8192  # must fit 16 bits, too
_BLOCK = 256
#: Rows whose logits are worked on together: they stay in the processor's cache, and no result depends on it.
_SLICE = 1024
#: Words of a batch on one weight row from which their gradients are added up as a product; no result depends on it but by rounding.
_LONG = 16
#: Logits are held within this of zero.
_MOST = 60.0
#: Partitions whose changes one task combines; more of them are combined in steps.
FAN = 64
_KINDS = 3


class Model(NamedTuple):
    """Vocabulary (sorted hashes and the word numbers they stand for) and weights: classes, words, then levels, by row; biases.

    `split` has the biases of each level by place; `shared` the counted weight of each last place; `other` and `other_count`
    the sorted hashes and counts of other words, all of them if `whole`, else the rest is in the table `counts`.
    """

    known: np.ndarray
    number: np.ndarray
    weights: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    split: tuple[np.ndarray, ...] = ()
    shared: np.ndarray = np.ones(CLASS)
    other: np.ndarray = np.empty(0, np.uint64)
    other_count: np.ndarray = np.empty(0)
    whole: bool = True
    counts: str = ""

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers: class * CLASS + place in the class."""
        other = (CLASSES - 1) * CLASS + (h % np.uint64(CLASS)).astype(np.int64)
        if not len(self.known):
            return other
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[k] == h, self.number[k], other)


class Features(NamedTuple):
    """Of every word of a chunk: number, weight rows of the class factor and of the word factor. Of the words of the last class: positions, and for each level weight rows, place and digit."""

    ids: np.ndarray
    rows_c: np.ndarray
    rows_w: np.ndarray
    tail: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _features(model: Model, w: textops.Words) -> Features:
    ids = model.numbers(w.hash)
    place = np.arange(len(ids)) - w.first[w.doc]
    a = np.zeros(len(ids), np.uint64)  # no word
    b = a.copy()
    a[1:], b[2:] = w.hash[:-1], w.hash[:-2]
    a[place < 1], b[place < 2] = 0, 0
    n = np.uint64(CLASS * CLASSES + 1)
    context = np.stack((a, n + a * n + b, n + n * n + b))
    by_class = textops.mix(context + np.uint64(7))
    bits = np.uint64(ROWS - 1)

    def rows(k: int, by: np.ndarray, node: np.ndarray) -> np.ndarray:
        return k * ROWS + (textops.mix(by ^ (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & bits).astype(np.int64)

    tail = np.flatnonzero(ids >= (CLASSES - 1) * CLASS) if model.split else np.empty(0, np.int64)
    levels = []
    for k, bias in enumerate(model.split, 1):
        h = w.hash[tail]
        node = (h % np.uint64(len(bias))).astype(np.int64)
        levels.append((rows(1 + k, by_class[:, tail], node), node, (h // np.uint64(len(bias)) % np.uint64(CLASS)).astype(np.int64)))
    return Features(ids, (by_class & bits).astype(np.int64), rows(1, by_class, ids // CLASS), tail, levels)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Logits are held within 60 of zero, so every sum is far from zero and from infinity, and probabilities add up to one."""
    np.exp(np.clip(x, -_MOST, _MOST, out=x), out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x


def _taken(table: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """table[rows], for row numbers that are known to be there: what is faster than an index doesn't check them."""
    return np.take(table, rows, axis=0, out=out, mode="clip")


def _factor(model: Model, rows: np.ndarray, bias: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of one factor, whose biases are the rows `node` of `bias`, or one row for all."""
    out = np.empty((rows.shape[1], CLASS), np.float32)
    more = np.empty((min(_SLICE, len(out)), CLASS), np.float32)
    for i in range(0, len(out), _SLICE):
        x = out[i : i + _SLICE]
        held = more[: len(x)]
        _taken(model.weights, rows[0, i : i + _SLICE], x)
        for k in range(1, _KINDS):
            x += _taken(model.weights, rows[k, i : i + _SLICE], held)
        x += bias if node is None else _taken(bias, node[i : i + _SLICE], held)
        _softmax(x)
    return out


def _forward(model: Model, ids: np.ndarray, rows_c: np.ndarray, rows_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all classes, and of all words of the right class."""
    return _factor(model, rows_c, model.class_bias), _factor(model, rows_w, model.word_bias, ids // CLASS)


def _sums(grad: np.ndarray, order: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of each run of rows of grad[order], the longest runs first. Most are short and added up side by side; long ones are products with ones."""
    out = _taken(grad, order[head])
    long = int(np.count_nonzero(size > _LONG))
    if long:
        rows = _taken(grad, order[textops.ragged(head[:long], size[:long])])
        ones, end = np.ones(size[0], grad.dtype), 0
        for i, n in enumerate(size[:long].tolist()):
            np.dot(ones[:n], rows[end : end + n], out=out[i])
            end += n
    for k in range(1, _LONG):
        more = int(np.count_nonzero(size > k))
        if more == long:
            break
        out[long:more] += _taken(grad, order[head[long:more] + k])
    return out


def _step(model: Model, energy: np.ndarray, rows: np.ndarray, wanted: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """One gradient step on the rows that the batch uses, scaled by the energy of each row's past gradients. `grad` holds the probabilities."""
    grad[np.arange(len(grad)), wanted] -= 1
    for k in range(_KINDS):
        order = np.argsort(rows[k].astype(np.uint16), kind="stable")
        ordered = rows[k][order]
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        size = np.diff(np.append(head, len(order)))
        by = np.argsort((len(order) - size).astype(np.uint16), kind="stable")
        head = head[by]
        total = _sums(grad, order, head, size[by])
        at = ordered[head]
        energy[at] += np.einsum("ij,ij->i", total, total)
        total *= (rate / np.sqrt(energy[at] + 1e-6))[:, None]
        model.weights[at] = np.subtract(_taken(model.weights, at), total, out=total)


def train_on(model: Model, chunks: Iterator[list[str]], rate: float = RATE) -> tuple[np.ndarray, int]:
    """The weights after gradient steps over all texts, and the number of words seen."""
    own = model._replace(weights=model.weights.copy())
    energy = np.zeros(len(own.weights), np.float32)
    seen = 0
    for texts in chunks:
        w = textops.words(texts)
        ids, rows_c, rows_w, tail, levels = _features(own, w)
        for i in range(0, len(ids), BATCH):
            s = slice(i, i + BATCH)
            c, x = _forward(own, ids[s], rows_c[:, s], rows_w[:, s])
            _step(own, energy, rows_c[:, s], ids[s] // CLASS, c, rate)
            _step(own, energy, rows_w[:, s], ids[s] % CLASS, x, rate)
        for bias, (rows, node, digit) in zip(own.split, levels):
            for i in range(0, len(tail), BATCH):
                s = slice(i, i + BATCH)
                _step(own, energy, rows[:, s], digit[s], _factor(own, rows[:, s], bias, node[s]), rate)
        seen += len(ids)
    return own.weights, seen


def _odds(model: Model) -> Model | None:
    """The model with the exponentials of weights and biases for them, if no logit can reach the limits within which logits are held."""
    most = max(float(np.abs(b).max(initial=0)) for b in (model.class_bias, model.word_bias, *model.split))
    if not most + _KINDS * float(np.abs(model.weights).max(initial=0)) < _MOST:
        return None
    return model._replace(weights=np.exp(model.weights), class_bias=np.exp(model.class_bias), word_bias=np.exp(model.word_bias), split=tuple(map(np.exp, model.split)))


def _logs(model: Model, odds: bool, rows: np.ndarray, wanted: np.ndarray, bias: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of what is wanted by one factor. A model of odds() takes products, and no exponential of any row."""
    out = np.empty(len(wanted))
    more, ones = np.empty((2, min(_SLICE, len(out)), CLASS), np.float32), np.ones(CLASS, np.float32)
    for i in range(0, len(out), _SLICE):
        s = slice(i, i + _SLICE)
        at = np.arange(len(wanted[s])), wanted[s]
        if odds:
            x, held = more[:, : len(at[0])]
            _taken(model.weights, rows[0, s], x)
            for k in range(1, _KINDS):
                x *= _taken(model.weights, rows[k, s], held)
            x *= bias if node is None else _taken(bias, node[s], held)
            p = x[at] / (x @ ones)
        else:
            p = _factor(model, rows[:, s], bias, None if node is None else node[s])[at]
        out[s] = np.log(np.maximum(p, 1e-30))
    return out


def _scores(model: Model, texts: list[str], odds: Model | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and summed log-probability of each text, without the counts of the words that the model has none of: those words' documents and hashes. `odds` is what _odds() makes of the model."""
    w = textops.words(texts)
    ids, rows_c, rows_w, tail, levels = _features(model, w)
    m, quick = odds or model, odds is not None
    out = _logs(m, quick, rows_c, ids // CLASS, m.class_bias) + _logs(m, quick, rows_w, ids % CLASS, m.word_bias, ids // CLASS)
    for bias, (rows, node, digit) in zip(m.split, levels):
        out[tail] += _logs(m, quick, rows, digit, bias, node)
    tail = np.flatnonzero(ids >= (CLASSES - 1) * CLASS)
    h = w.hash[tail]
    out[tail] -= np.log(model.shared[(h % np.uint64(len(model.shared))).astype(np.int64)])
    found = np.zeros(len(h), bool)
    if len(model.other) and len(h):
        k = np.minimum(np.searchsorted(model.other, h), len(model.other) - 1)
        found = model.other[k] == h
        out[tail[found]] += np.log(model.other_count[k[found]])
    rest = tail[~found]
    return np.diff(w.first), np.bincount(w.doc, out, len(texts)) if len(out) else np.zeros(len(texts)), w.doc[rest], w.hash[rest]


def _unseen(model: Model) -> float:
    """Log-weight of the unseen word of a place: one count for each slot of the last class, spread over its places."""
    return float(np.log(CLASS / len(model.shared)))


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log-probability of each text. Words that the model has no count of are unseen ones here; score() looks them up."""
    n, p, doc, _ = _scores(model, texts, _odds(model))
    return n, p + np.bincount(doc, minlength=len(texts)) * _unseen(model)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[str]]:
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        for i, j in textops.chunks(texts):
            yield texts[i:j]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and count of every word of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            h, n = h[order], n[order]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[head], np.add.reduceat(n, head)

        def out() -> Iterator[pa.RecordBatch]:
            h, n = merged()
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["word", "count"])

        for texts in _texts(batches, 0):
            h, n = np.unique(textops.words(texts).hash, return_counts=True)
            if len(h):
                held.append((h, n))
                size += len(h)
            if size > 1 << 20:
                held = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def start(docs: DataFrame) -> Model:
    """Vocabulary and biases from the counts of the whole corpus; other weights zero."""
    path = shared.folder(docs.sparkSession, "words")
    word_counts(docs).write.parquet(path)
    counts = docs.sparkSession.read.schema("word long, count long").parquet(path)
    size = (CLASSES - 1) * CLASS
    top = counts.orderBy(F.col("count").desc(), "word").limit(size).collect()
    h = np.array([r.word for r in top], np.int64).view(np.uint64)
    often = np.array([r["count"] for r in top], np.int64)

    # words of equal counts go to the model's own table together, or none of them
    of_count = sorted(((r["count"], r.n) for r in counts.groupBy("count").agg(F.count("*").alias("n")).collect()), reverse=True)
    total = np.cumsum([n for _, n in of_count])
    fits = int(np.searchsorted(total, TABLE, "right"))
    held = counts.where(F.col("count") >= of_count[fits - 1][0]).toArrow() if fits else None
    other = held["word"].to_numpy().view(np.uint64) if held else np.empty(0, np.uint64)
    other_count = held["count"].to_numpy().astype(np.float64) if held else np.empty(0)
    free = ~np.isin(other, h)
    other, other_count = other[free], other_count[free]
    by_hash = np.argsort(other)

    left = max(0, (int(total[-1]) if len(total) else 0) - len(top))
    levels = 0
    while levels < LEVELS and CLASS ** (levels + 2) <= left:
        levels += 1
    places = CLASS ** (levels + 1)
    weight = np.full(places, CLASS / places)
    sums = counts.groupBy(F.col("word").bitwiseAND(F.lit(places - 1)).alias("place")).agg(F.sum("count").alias("count")).toArrow()
    weight[sums["place"].to_numpy()] += sums["count"].to_numpy()
    np.subtract.at(weight, (h % np.uint64(places)).astype(np.int64), often)
    weight = np.maximum(weight, CLASS / places)  # rounding
    split = []
    for k in range(levels):
        node = CLASS ** (k + 1)
        of_digit = weight.reshape(-1, CLASS, node).sum(axis=0)
        split.append(np.log(of_digit / of_digit.sum(axis=0)).T.astype(np.float32).copy())

    n = np.ones(CLASS * CLASSES)
    n[: len(top)] += often
    n[size:] = weight.reshape(-1, CLASS).sum(axis=0)
    table = np.log(n / n.sum()).reshape(CLASSES, CLASS)
    by_class = np.log(np.exp(table).sum(axis=1))
    order = np.argsort(h)
    return Model(
        h[order], order.astype(np.int64), np.zeros(((2 + levels) * ROWS, CLASS), np.float32), by_class.astype(np.float32), (table - by_class[:, None]).astype(np.float32),
        tuple(split), weight, other[by_hash], other_count[by_hash], fits == len(of_count), path,
    )


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model of all documents."""
    spark = docs.sparkSession
    model = start(docs)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        step = rate / (1 + r)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            weights, seen = train_on(sent.value, _texts(batches, 0), step)
            if seen:
                change = (weights - sent.value.weights).astype(np.float16).reshape(-1, _BLOCK * CLASS)
                part = TaskContext.get().partitionId()
                for k, block in enumerate(change):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([seen], pa.int64()), pa.array([block.tobytes()])], names=["part", "block", "seen", "change"])

        def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for b in batches:
                for part, k, seen, raw in zip(*(b.column(c).to_pylist() for c in range(4))):
                    s = sums.setdefault((part, k), [0, np.zeros(_BLOCK * CLASS)])
                    s[0] += seen
                    s[1] += seen * np.frombuffer(raw, np.float16 if len(raw) == 2 * _BLOCK * CLASS else np.float32).astype(np.float64)
            for (part, k), (seen, total) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()])], names=["part", "block", "seen", "change"])

        schema, texts = "part int, block int, seen long, change binary", docs.select("text")
        changes, left = texts.mapInArrow(run, schema), texts.rdd.getNumPartitions()
        while True:
            left = -(-left // FAN)
            changes = changes.withColumn("part", (F.col("part") / FAN).cast("int")).repartition("part", "block").mapInArrow(combined, schema)
            if left <= 1:
                break
        weights = model.weights.copy()
        for row in changes.toLocalIterator():
            weights[row.block * _BLOCK : (row.block + 1) * _BLOCK] += np.frombuffer(row.change, np.float32).reshape(_BLOCK, CLASS)
        model = model._replace(weights=weights)
        sent.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_prob (natural, summed) and perplexity of a word."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        odds = _odds(sent.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in textops.chunks(texts):
                n, p, doc, h = _scores(sent.value, texts[i:j], odds)
                if sent.value.whole:
                    p, doc, h = p + np.bincount(doc, minlength=j - i) * _unseen(sent.value), doc[:0], h[:0]
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(0, np.int64)
                ends = pa.array(np.searchsorted(doc[head], np.arange(j - i + 1)).astype(np.int32))
                words, times = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[head].view(np.int64), np.diff(np.append(head, len(h)))))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + j - i)), b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(p, mask=n == 0), words, times], names=["row", "doc_id", "n_words", "log_prob", "words", "times"])
                row += j - i

    out = docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_words long, log_prob double, words array<long>, times array<long>")
    if not model.whole:
        out = shared.save(out, "scores")
        counts = spark.read.schema("word long, count long").parquet(model.counts)
        rest = out.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        known = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce(F.log("count"), F.lit(_unseen(model)))).alias("more"))
        out = out.drop("words", "times").join(known, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_words", "log_prob", F.exp(-F.col("log_prob") / F.col("n_words")).alias("perplexity"))
