"""Operator 7, quality rules: repetition coverage of each document.

Rolling hashes of word n-grams (n = 2..10) and of lines find what repeats
*inside* a document; the measures are shares of the document's word characters:

* ``top_n`` (n = 2, 3, 4): characters inside the most frequent n-gram
  (overlapping occurrences count once per word);
* ``dup_n`` (n = 5..10): characters inside second and later occurrences of
  n-grams, each word counted once;
* ``dup_lines``: share of non-blank lines that are second or later occurrences,
  ``dup_line_chars`` the same by characters.

Repetition counts from the second occurrence on.  One thing is no repetition: a
page's header that comes back as its footer.  If the first line (FRAME_CHARS
characters at most) occurs a second time, that is among the last two lines, and
nowhere else, the second one is left out before anything is measured; lines that are
blank don't count, and a text of fewer than three lines has no such frame.

Limits are those published for web text (Rae et al. 2021, table A1).  The
document is rejected if any measure exceeds its limit.

Defined results: null, empty and word-less texts have all measures 0 and are
kept; null ids are carried along; repeated rows are judged row by row; columns
other than doc_id and text are never read, so clashing names do no harm; an
empty table gives an empty result.  Nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared, textops

TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUP = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINES, LINE_CHARS = 0.30, 0.20
FRAME_CHARS = 120
MEASURES = [f"top_{n}" for n in TOP] + [f"dup_{n}" for n in DUP] + ["dup_lines", "dup_line_chars"]
LIMITS = np.array([*TOP.values(), *DUP.values(), LINES, LINE_CHARS])


def _later(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key occurs twice or more, ordered by key and position; where each key's group begins; group sizes."""
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    member = np.zeros(len(s), bool)
    member[:-1] |= same
    member[1:] |= same
    idx, k = order[member], s[member]
    again = np.lexsort((idx, k))
    idx, k = idx[again], k[again]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return idx, head, np.diff(np.concatenate((head, [len(k)])))


def unframed(text: str) -> str:
    """Without a first line's only other occurrence at the end."""
    if "\n" not in text:
        return text
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    if len(at) < 3 or len(first := lines[at[0]].strip()) > FRAME_CHARS:
        return text
    hits = [i for i in at if lines[i].strip() == first]
    if len(hits) != 2 or hits[1] not in at[-2:]:
        return text
    del lines[hits[1]]
    return "\n".join(lines)


def measure(texts: list[str]) -> np.ndarray:
    """Measures of every text, in the order of MEASURES."""
    out = np.zeros((len(texts), len(MEASURES)))
    texts = list(map(unframed, texts))
    w = textops.words(texts)
    n_docs = len(texts)
    size = (w.end - w.start).astype(np.float64)
    total = np.maximum(np.bincount(w.doc, size, n_docs), 1.0)
    with np.errstate(over="ignore"):
        salt = textops.mix((np.arange(n_docs, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    for col, n in enumerate([*TOP, *DUP]):
        grams = textops.ngram_hashes(w.hash, n)
        if not len(grams):
            continue
        whole = np.flatnonzero(w.doc[: len(grams)] == w.doc[n - 1 :])
        idx, head, count = _later(grams[whole] ^ salt[w.doc[whole]])
        if not len(idx):
            continue
        at = whole[idx]
        if n in TOP:
            # the group with most occurrences of each document, the earliest of equals
            d = w.doc[at[head]]
            pick = np.lexsort((at[head], -count, d))
            pick = pick[np.concatenate(([True], d[pick][1:] != d[pick][:-1]))]
            at = at[textops.ragged(head[pick], count[pick])]
        else:
            first = np.zeros(len(at), bool)
            first[head] = True
            at = at[~first]
        step = np.bincount(at, minlength=len(size) + 1)[: len(size) + 1].astype(np.int64)
        step -= np.bincount(at + n, minlength=len(size) + 1)[: len(size) + 1]
        covered = np.cumsum(step)[: len(size)] > 0
        out[:, col] = np.bincount(w.doc[covered], size[covered], n_docs) / total
    for i, t in enumerate(texts):
        if "\n" in t:
            counts = Counter(x for x in map(str.strip, t.split("\n")) if x)
            often = [(x, c - 1) for x, c in counts.items() if c > 1]
            if often:
                out[i, -2] = sum(c for _, c in often) / counts.total()
                out[i, -1] = sum(len(x) * c for x, c in often) / sum(len(x) * c for x, c in counts.items())
    return out


def _reasons(bad: np.ndarray) -> list[str]:
    return [",".join(m for m, b in zip(MEASURES, row) if b) if row.any() else "" for row in bad]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, every measure, `rejected` and the names of the exceeded limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in textops.chunks(texts):
                m = measure(texts[i:j])
                bad = m > LIMITS
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(m[:, k]) for k in range(len(MEASURES))), pa.array(bad.any(1)), pa.array(_reasons(bad))],
                    names=["doc_id", *MEASURES, "rejected", "reasons"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} double" for m in MEASURES) + ", rejected boolean, reasons string")


def keep(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text breaks no limit."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for i, j in textops.chunks(texts):
                good = ~(measure(texts[i:j]) > LIMITS).any(1)
                yield b.slice(i, j - i).filter(pa.array(good))

    return shared.filtered(docs, run)


def _oracle() -> str:
    parts = []
    for n in [*TOP, *DUP]:
        gram = " || ' ' || ".join(["w"] + [f"lead(w, {k}) over (partition by r order by p)" for k in range(1, n)])
        base = f"g{n} as (select r, p, {gram} g from w), c{n} as (select r, p, g, count(*) over (partition by r, g) c, row_number() over (partition by r, g order by p) i, min(p) over (partition by r, g) f from g{n} where g is not null)"
        if n in TOP:
            hit = f"h{n} as (select r, p from (select r, p, g, c, first_value(g) over (partition by r order by c desc, f) best from c{n} where c > 1) where g = best)"
        else:
            hit = f"h{n} as (select r, p from c{n} where i > 1)"
        cover = f"v{n} as (select r, sum(len) s from (select distinct w.r, w.p, w.len from h{n} h join w on w.r = h.r and w.p between h.p and h.p + {n - 1}) group by r)"
        parts += [base, hit, cover]
    cols = ", ".join(f"(coalesce(v{n}.s, 0) / coalesce(greatest(tot.s, 1), 1))::double as {'top' if n in TOP else 'dup'}_{n}" for n in [*TOP, *DUP])
    joins = " ".join(f"left join v{n} on v{n}.r = d.r" for n in [*TOP, *DUP])
    limits = {**{f"top_{n}": v for n, v in TOP.items()}, **{f"dup_{n}": v for n, v in DUP.items()}, "dup_lines": LINES, "dup_line_chars": LINE_CHARS}
    bad = " or ".join(f"{k} > {v}" for k, v in limits.items())
    why = ", ".join(f"case when {k} > {v} then '{k}' end" for k, v in limits.items())
    return f"""
with d0 as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
a0 as (select r, unnest(string_split(t, chr(10))) raw, generate_subscripts(string_split(t, chr(10)), 1) p from d0),
a1 as (select r, p, raw, trim(raw, ' ' || chr(9) || chr(13)) l from a0),
a2 as (select r, p, l, row_number() over (partition by r order by p) k, count(*) over (partition by r) m, first_value(l) over (partition by r order by p) f from a1 where l <> ''),
a3 as (select r, max(p) p from a2 where l = f and m >= 3 and length(f) <= {FRAME_CHARS} group by r having count(*) = 2 and max(k) >= max(m) - 1),
d1 as (select a1.r, string_agg(raw, chr(10) order by a1.p) t from a1 join a3 on a3.r = a1.r and a3.p <> a1.p group by a1.r),
d as (select d0.r, doc_id, coalesce(d1.t, d0.t) t from d0 left join d1 on d1.r = d0.r),
x as (select r, unnest(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) w, generate_subscripts(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), 1) p from d),
w as (select r, p, w, length(w) len from x),
tot as (select r, sum(len) s from w group by r),
{", ".join(parts)},
l0 as (select r, trim(unnest(string_split(t, chr(10))), ' ' || chr(9) || chr(13)) l from d),
l1 as (select r, l, count(*) c from l0 where l <> '' group by r, l),
l2 as (select r, sum(c - 1) / sum(c) a, sum(length(l) * (c - 1)) / sum(length(l) * c) b from l1 group by r),
m as (select d.doc_id, {cols}, coalesce(l2.a, 0)::double as dup_lines, coalesce(l2.b, 0)::double as dup_line_chars
from d left join tot on tot.r = d.r left join l2 on l2.r = d.r {joins})
select *, ({bad}) as rejected, concat_ws(',', {why}) as reasons from m
"""


ORACLE = _oracle()
