"""Operator 5, token counts: edit-aware counting.

Each document keeps a segment tree whose leaves are its pre-tokens and whose
nodes hold sums of their token counts.  An edit (replace characters start..end
by a text) re-encodes only the touched region: from the start of the pre-token two
characters before it (of the one before that, if blanks end there), until the
scan of the new text meets an old pre-token boundary at or past the end of the
edit.  The split pattern looks no further than two characters past an apostrophe
and one past other pre-tokens or a row of blanks, and keeps no state, so outside
of the region nothing can change.  The
region's new counts replace the old leaves and only the sums above them are
renewed.

`recount` applies the edits that `rules` make (default: long digit runs, such as
card and phone numbers, are masked) to whole texts; `recount_edits` takes edits
from an array column.  Both count a document that has an edit by its tree, and write
no trees.  `kept` makes a table of trees (boundaries and leaf counts of every
document); `edited` applies edits to such a table and gives it as it is afterwards,
so a later batch of edits encodes nothing but the regions that it touches.  A region
that was re-encoded is one leaf from then on, with the sum of its pre-tokens.

Defined results: a null text counts as empty; edits are applied from the left,
an edit that overlaps an earlier one or lies outside the text is ignored (and
counted as such); null and repeated ids and repeated rows are handled row by
row; other columns are never read; an empty table gives an empty result.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe, pretokens, textops

RULES: tuple[tuple[str, str], ...] = ((r"[0-9]{7,}", "<number>"),)
#: Start, end and new text.
Edit = tuple[int, int, str]
SCHEMA = "doc_id long, n_tokens long, n_edits long, n_ignored long, n_reencoded long, n_tokens_after long"


class Tree:
    """Sums over leaves; a leaf changes in logarithmic time."""

    def __init__(self, leaves: np.ndarray) -> None:
        n = 1
        while n < len(leaves):
            n *= 2
        self.n = n
        node = np.zeros(2 * n, np.int64)
        node[n : n + len(leaves)] = leaves
        while n > 1:
            node[n // 2 : n] = node[n : 2 * n : 2] + node[n + 1 : 2 * n : 2]
            n //= 2
        self.node = node

    @property
    def total(self) -> int:
        return int(self.node[1])

    def assign(self, lo: int, hi: int, value: int) -> None:
        """Leaf `lo` gets the value and the leaves up to `hi` zero; sums above them are renewed."""
        node = self.node
        a, b = lo + self.n, max(lo + 1, hi) + self.n - 1
        node[a : b + 1] = 0
        node[a] = value
        while a > 1:
            a, b = a // 2, b // 2
            node[a : b + 1] = node[2 * a : 2 * b + 1 : 2] + node[2 * a + 1 : 2 * b + 2 : 2]

    def between(self, lo: int, hi: int) -> int:
        """Sum of leaves lo..hi-1."""
        out, a, b = 0, lo + self.n, hi + self.n
        while a < b:
            if a & 1:
                out += int(self.node[a])
                a += 1
            if b & 1:
                b -= 1
                out += int(self.node[b])
            a, b = a // 2, b // 2
        return out


class Document:
    """A text with the starts of its leaves, in order, and their count tree. Leaves that an edit has merged have one start, and their sum stands in the first of them."""

    def __init__(self, text: str, starts: list[int], counts: np.ndarray) -> None:
        self.text, self.starts = text, starts
        self.tree = Tree(counts)

    @property
    def counts(self) -> np.ndarray:
        return self.tree.node[self.tree.n : self.tree.n + len(self.starts)]

    def edit(self, edits: list[Edit], count: Callable[[str], int]) -> tuple[int, int, int]:
        """Applies edits (start, end, new text); numbers applied, ignored and of pre-tokens re-encoded. `count` gives the tokens of a pre-token."""
        good, last = [], 0
        for s, e, new in sorted((x for x in edits if x[0] is not None and x[1] is not None), key=lambda x: x[:2]):
            if last <= s <= e <= len(self.text):
                good.append((s, e, new or ""))
                last = e
        parts, at, shift, ends, shifts = [], 0, 0, [], []
        for s, e, new in good:
            parts += [self.text[at:s], new]
            ends.append(s + shift + len(new))
            shift += len(new) - (e - s)
            shifts.append(shift)
            at = e
        text = "".join([*parts, self.text[at:]])
        starts, scan, again, k = self.starts, pretokens.compiled().match, 0, 0

        def first(leaf: int) -> int:
            return bisect_left(starts, starts[leaf]) if starts else 0

        def leaf_of(edit: tuple[int, int, str]) -> int:
            """The leaf of the second character before the edit, or of the row of blanks that ends at its start."""
            leaf = first(max(0, bisect_right(starts, edit[0] - 2) - 1))
            return first(leaf - 1) if leaf and self.text[starts[leaf] - 1].isspace() else leaf

        moved = np.zeros(len(starts) + 1, np.int64)  # differences of what is added to each start
        flat: list[tuple[int, int, int]] = []
        while k < len(good):
            leaf = leaf_of(good[k])
            left, before = starts[leaf] if starts else 0, shifts[k - 1] if k else 0
            pos, total, hi = left + before, 0, -1
            while hi < 0:
                if pos >= ends[k]:
                    old = pos - shifts[k]
                    if k + 1 < len(good) and (not starts or old > starts[leaf_of(good[k + 1])]):
                        k += 1  # the next edit belongs to this region
                        continue
                    j = bisect_left(starts, old)
                    if j < len(starts) and starts[j] == old and old > left:
                        hi = j
                        continue
                if pos == len(text):
                    k, hi = len(good) - 1, len(starts)
                    continue
                end = scan(text, pos).end()
                total += count(text[pos:end])
                again += 1
                pos = end
            self.tree.assign(leaf, hi, total)
            flat.append((leaf, hi, left + before))
            moved[min(hi, len(starts))] += shifts[k] - before
            k += 1
        places = np.asarray(starts, np.int64) + np.cumsum(moved[:-1])
        for leaf, hi, at in flat:
            places[leaf:hi] = at
        self.starts = places.tolist() or [0] * bool(text)
        self.text = text
        return len(good), len(edits) - len(good), again


def by_rules(rules: tuple[tuple[str, str], ...]) -> Callable[[str], list[Edit]]:
    """The edits that replace every match of a pattern; of overlapping ones the leftmost."""
    compiled = [(re.compile(p), new) for p, new in rules]

    def edits(text: str) -> list[Edit]:
        return [(*m.span(), new) for p, new in compiled for m in p.finditer(text)]

    return edits


def _run(path: str, edits_of: Callable[[str], list] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)

        def count(piece: str) -> int:
            return int(coder.counts([piece])[0])

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            given = None if edits_of else [[(e["start"], e["end"], e["text"]) for e in x or [] if e] for x in b.column(2).to_pylist()]
            for i, j in textops.chunks(texts):
                joined, begin, end = pretokens.starts(texts[i:j])
                tokens = coder.counts([joined[x:y] for x, y in zip(begin.tolist(), end.tolist())])
                base = np.concatenate(([0], np.cumsum(np.fromiter(((len(t) + 1) for t in texts[i:j]), np.int64, j - i))))
                edge = np.searchsorted(begin, base)
                total = np.concatenate(([0], np.cumsum(tokens)))
                before = np.diff(total[edge])
                rows = np.zeros((5, j - i), np.int64)
                rows[0] = rows[4] = before
                for d in range(j - i):
                    edits = edits_of(texts[i + d]) if edits_of else given[i + d]
                    if edits:
                        doc = Document(texts[i + d], (begin[edge[d] : edge[d + 1]] - base[d]).tolist(), tokens[edge[d] : edge[d + 1]])
                        rows[1:4, d] = doc.edit(edits, count)
                        rows[4, d] = doc.tree.total
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


KEPT = "doc_id long, text string, starts array<int>, counts array<int>, n_tokens long"
EDITED = KEPT + ", n_edits long, n_ignored long, n_reencoded long"
_NAMES = [x.split()[0] for x in EDITED.split(", ")]


def _lists(rows: list) -> pa.Array:
    return pa.array([np.asarray(x, np.int32) for x in rows], pa.list_(pa.int32()))


def kept(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, text, its leaves' starts and counts, n_tokens. Null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in textops.chunks(texts):
                joined, begin, end = pretokens.starts(texts[i:j])
                tokens = coder.counts([joined[x:y] for x, y in zip(begin.tolist(), end.tolist())])
                base = np.concatenate(([0], np.cumsum(np.fromiter(((len(t) + 1) for t in texts[i:j]), np.int64, j - i))))
                edge = np.searchsorted(begin, base)
                spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
                starts, leaves = [begin[x:y] - base[d] for d, (x, y) in enumerate(spans)], [tokens[x:y] for x, y in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(texts[i:j]), _lists(starts), _lists(leaves), pa.array([int(x.sum()) for x in leaves], pa.int64())], names=_NAMES[:5])

    return docs.select("doc_id", "text").mapInArrow(run, KEPT)


def edited(trees: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """A table of kept() with a column `edits` (array<struct<start:int,end:int,text:string>>) as it is after them, and the numbers of edits applied, ignored, and of pre-tokens encoded. Rows without edits cost nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)

        def count(piece: str) -> int:
            return int(coder.counts([piece])[0])

        for b in batches:
            texts, starts, leaves, given = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            totals, did = [], []
            for d, edits in enumerate(given):
                asked = [(e["start"], e["end"], e["text"]) for e in edits or [] if e]
                if asked:
                    doc = Document(texts[d] or "", starts[d] or [], np.array(leaves[d] or [], np.int64))
                    did.append(doc.edit(asked, count))
                    texts[d], starts[d], leaves[d] = doc.text, doc.starts, doc.counts
                    totals.append(doc.tree.total)
                else:
                    did.append((0, 0, 0))
                    totals.append(sum(leaves[d] or []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), _lists(starts), _lists(leaves), pa.array(totals, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*did))] if b.num_rows else [], names=_NAMES if b.num_rows else [])

    rows = trees.select("doc_id", "text", "starts", "counts", "edits")
    return rows.mapInArrow(lambda it: run(b for b in it if b.num_rows), EDITED)


def recount(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, path: str = bpe.VOCABULARY) -> DataFrame:
    """Token counts before and after the edits that the rules make."""
    return docs.select("doc_id", "text").mapInArrow(_run(path, by_rules(rules)), SCHEMA)


def recount_edits(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """Token counts before and after the edits in the column `edits`: array<struct<start:int,end:int,text:string>>."""
    return docs.select("doc_id", "text", "edits").mapInArrow(_run(path, None), SCHEMA)
