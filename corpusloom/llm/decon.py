"""Operator 1, benchmark decontamination: CGK embedding, bit sampling, exact edit verification.

Items and windows are sequences of case-folded words.  The CGK random walk reads
a sequence and writes one symbol a step, staying or advancing by a random bit of
the symbol it stands on; sequences of small edit distance stay or fall back in
step and get embeddings of small Hamming distance.  Each repetition samples a few
positions of its own walk's embedding and hashes them; a window and an item that
agree are candidates, and repetitions (each with its own walk, sample and start
offset into the item) are added until an item with the largest allowed share of
edits is found with probability RECALL.  Candidates are verified by exact edit
distance (item against any substring of the region around the window).

Windows have the item's size and start at every word of every document.  The
embedding is evaluated lazily: the first sample is the window's first symbol, so
a table look-up per word and repetition decides which windows walk on; this
changes the cost and not the outcome.  Start offsets prefer words that few items
hold.

A document is contaminated by an item if the edit distance is at most
MAX_EDITS times the item's words.

Defined results: items of fewer than MIN_WORDS words match only where a document
holds all of their words in a row, without edits; null texts (of documents or items) and empty ones match nothing;
repeated items are reported each under its id; repeated rows and null ids of
documents are carried along row by row; other columns are never read; empty
tables give empty results.  The benchmark goes to the workers in slices of
SLICE_WORDS words, one pass over the documents each, so what is sent is bounded
whatever the benchmark's size; documents are not shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared, textops

MAX_EDITS = 0.2
MIN_WORDS = 6
RECALL = 0.98
SAMPLES = 3
SLICE_WORDS = 5_000_000
_PAD = np.uint64(0)
_TABLE_BITS = 22
#: Numbers in a row of the tables of exact verification, which hold several such rows.
_CELLS = 1 << 20


#: Words over which a repetition's samples spread; a walk takes two steps a word on average.
_REACH = 8


class Walks:
    """The random bits and sampled steps of every repetition."""

    def __init__(self, max_edits: float = MAX_EDITS, samples: int = SAMPLES, recall: float = RECALL, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.steps = 2 * _REACH
        sampled, miss = [], 1.0
        while miss > 1 - recall:
            sampled.append(np.sort(rng.choice(np.arange(2, self.steps), samples - 1, replace=False)))
            # it surely finds an item if no edit touches the words that the walk reads up to its last sample
            miss *= 1 - (1 - max_edits) ** (1 + sampled[-1][-1] / 2)
        self.reps, self.sampled = len(sampled), np.stack(sampled)
        self.factor = rng.integers(0, 1 << 63, (self.reps, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def embed(self, r: int, symbols: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the sampled steps of the windows at..end."""
        out = np.zeros(len(at), np.uint64)
        at = at.copy()
        top = len(symbols) - 1
        last, marks = int(self.sampled[r, -1]), set(self.sampled[r].tolist())
        with np.errstate(over="ignore"):
            for j in range(last + 1):
                here = np.where(at < end, symbols[np.minimum(at, top)], _PAD)
                if j in marks:
                    out = textops.mix(out * np.uint64(0x9E3779B97F4A7C15) + here + np.uint64(j))
                at += ((here * self.factor[r, j]) >> np.uint64(63)).astype(np.int64)
        return out


class Index:
    """Hash tables of a slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float) -> None:
        w = textops.words([t for _, t in items])
        self.symbols, self.first, self.ids = w.hash, w.first, np.array([i for i, _ in items], np.int64)
        self.max_edits = max_edits
        self.walks = Walks(max_edits)
        seen = Counter()
        for k in range(len(items)):
            seen.update(set(self.symbols[self.first[k] : self.first[k + 1]].tolist()))
        starts: list[list[tuple[int, int]]] = [[] for _ in range(self.walks.reps)]
        for k in range(len(items)):
            a, b = int(self.first[k]), int(self.first[k + 1])
            if b - a < MIN_WORDS:
                continue
            # a short item is walked from any of its words, as an edit would else hit the few starts; what lies beyond its end agrees
            short = b - a < 2 * _REACH
            room = b - a - SAMPLES + 1 if short else b - a - _REACH
            rare = sorted(range(room), key=lambda o: (seen[int(self.symbols[a + o])], o))
            # spread over the item, the rarer half first
            half = sorted(rare if short else rare[: (room + 1) // 2])
            for r in range(self.walks.reps):
                starts[r].append((k, half[r * len(half) // self.walks.reps]))
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = np.diff(self.first)
        for n in range(1, MIN_WORDS):
            item = np.flatnonzero(size == n)
            if len(item):
                code = textops.ngram_hashes(self.symbols, n)[self.first[item]]
                order = np.argsort(code, kind="stable")
                self.exact[n] = code[order], item[order]
        self.tables = []
        for r, found in enumerate(starts):
            item = np.array([k for k, _ in found], np.int64)
            offset = np.array([o for _, o in found], np.int64)
            at = self.first[item] + offset
            head = self.symbols[at] if len(at) else np.empty(0, np.uint64)
            order = np.argsort(head, kind="stable")
            item, offset, at, head = item[order], offset[order], at[order], head[order]
            code = self.walks.embed(r, self.symbols, at, self.first[item + 1]) if len(at) else head
            self.tables.append((head, item, offset, code))
        self.marks: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"marks": []}  # made where they are used: they are many times as large as what they are made of

    def marked(self) -> list[np.ndarray]:
        """For each repetition whether any first symbol begins with these bits."""
        if not self.marks:
            for head, *_ in self.tables:
                bits = np.zeros(1 << _TABLE_BITS, bool)
                bits[head >> np.uint64(64 - _TABLE_BITS)] = True
                self.marks.append(np.packbits(bits, bitorder="little"))
        return self.marks

    def candidates(self, symbols: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, start of the window as a word position of the chunk)."""
        out = []
        top = symbols >> np.uint64(64 - _TABLE_BITS)
        byte, bit = (top >> np.uint64(3)).astype(np.int64), (top & np.uint64(7)).astype(np.uint8)
        for r, (bits, (head, item, offset, code)) in enumerate(zip(self.marked(), self.tables)):
            at = np.flatnonzero((bits[byte] >> bit) & 1)
            lo, hi = np.searchsorted(head, symbols[at], "left"), np.searchsorted(head, symbols[at], "right")
            k = textops.ragged(lo, hi - lo)
            at = np.repeat(at, hi - lo)
            if not len(at):
                continue
            size = self.first[item[k] + 1] - self.first[item[k]]
            end = np.minimum(at - offset[k] + size, first[doc[at] + 1])
            same = self.walks.embed(r, symbols, at, end) == code[k]
            out.append(np.stack((doc[at[same]], item[k[same]], at[same] - offset[k[same]]), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)

    def verbatim(self, w: textops.Words) -> list[tuple[int, int]]:
        """(document, item) of the items below MIN_WORDS."""
        out = []
        for n, (code, item) in self.exact.items():
            grams = textops.ngram_hashes(w.hash, n)
            whole = w.doc[: len(grams)] == w.doc[n - 1 :] if len(grams) else np.empty(0, bool)
            grams, doc = grams[whole], w.doc[: len(grams)][whole]
            lo, hi = np.searchsorted(code, grams, "left"), np.searchsorted(code, grams, "right")
            k = textops.ragged(lo, hi - lo)
            out += zip(np.repeat(doc, hi - lo).tolist(), item[k].tolist())
        return out

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(document, item, edit distance, words) of the items that each text holds."""
        w = textops.words(texts)
        best = dict.fromkeys(self.verbatim(w), 0)
        found = self.candidates(w.hash, w.doc, w.first)
        d, k, at = found.T
        size = self.first[k + 1] - self.first[k]
        slack = np.ceil(size * self.max_edits).astype(np.int64)
        lo = np.maximum(at - slack, w.first[d])
        hi = np.minimum(at + size + slack, w.first[d + 1])
        order = np.argsort(size, kind="stable")  # alike sizes together
        d, k, lo, hi, size = d[order], k[order], lo[order], hi[order], size[order]
        i = 0
        while i < len(d):
            most_wide = max(1, _CELLS // max(1, int((hi - lo)[i : i + 512].max())))
            s = slice(i, i + min(512, most_wide))
            i = s.stop
            dist = distances(self.symbols, self.first[k[s]], size[s], w.hash, lo[s], hi[s] - lo[s])
            for x, y, z, most in zip(d[s].tolist(), k[s].tolist(), dist.tolist(), (self.max_edits * size[s]).tolist()):
                if z <= most and z < best.get((x, y), 1 << 30):
                    best[x, y] = z
        return [(x, y, z, int(self.first[y + 1] - self.first[y])) for (x, y), z in sorted(best.items())]


def distances(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Edit distance of each sequence of `a` to the nearest substring of its region of `b`, many pairs at once."""
    rows, width = int(a_len.max()), int(b_len.max())
    col = np.arange(width)
    region = np.where(col < b_len[:, None], b[np.minimum(b_at[:, None] + col, len(b) - 1)], np.uint64(0))
    inside = np.concatenate((np.ones((len(a_at), 1), bool), col < b_len[:, None]), axis=1)
    steps = np.arange(width + 1)
    prev = np.zeros((len(a_at), width + 1), np.int64)
    out = np.where(a_len == 0, 0, 1 << 30)
    for i in range(rows):
        live = i < a_len
        word = a[np.minimum(a_at + i, len(a) - 1)]
        now = np.empty_like(prev)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(prev[:, :-1] + (region != word[:, None]), prev[:, 1:] + 1)
        now = np.minimum.accumulate(now - steps, axis=1) + steps
        prev = now
        end = live & (a_len == i + 1)
        if end.any():
            out[end] = np.where(inside[end], now[end], 1 << 30).min(axis=1)
    return out


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in parts of bounded size; the driver holds one part at a time."""
    part: list[tuple[int, str]] = []
    size = 0
    for i, t in benchmark.select("item_id", "text").where("text is not null and item_id is not null").toLocalIterator():
        n = len(t) // 4 + 1
        if part and size + n > SLICE_WORDS:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += n
    if part:
        yield part


def find(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """doc_id, item_id, edit distance and item words of every contamination."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits long, n_words long"

    def one(part: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(part, max_edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                for i, j in textops.chunks(texts):
                    rows = index.value.matches(texts[i:j])
                    if rows:
                        d, k, z, n = (np.array(c, np.int64) for c in zip(*rows))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d + i)), pa.array(index.value.ids[k]), pa.array(z), pa.array(n)], names=["doc_id", "item_id", "edits", "n_words"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(one, _slices(benchmark)), spark.createDataFrame([], schema))


def clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The rows, with all their columns, that no item contaminates."""
    spark = docs.sparkSession
    at = docs.columns.index("text")

    def one(rows: DataFrame, part: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(Index(part, max_edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(at).to_pylist()]
                for i, j in textops.chunks(texts):
                    good = np.ones(j - i, bool)
                    good[[x[0] for x in index.value.matches(texts[i:j])]] = False
                    yield b.slice(i, j - i).filter(pa.array(good))

        return shared.filtered(rows, run)

    return reduce(one, _slices(benchmark), docs)
