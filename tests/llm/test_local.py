"""Operators that judge or encode row by row: quality rules, byte-level BPE, token counts."""

from collections import Counter
from itertools import pairwise

import numpy as np
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, counts, pretokens, quality

DOCS = "doc_id long, text string, rejected string, `a.b` int, __text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(400)], n))


def rows(texts):
    return [(i, t, "no", 1, "x") for i, t in enumerate(texts)]


def brute_unframed(text):
    """The text without its first line's second occurrence, if that is its only other one and among the last two lines."""
    lines = (text or "").split("\n")
    filled = [x.strip() for x in lines if x.strip()]
    if len(filled) > 2 and len(filled[0]) <= quality.FRAME_CHARS and filled.count(filled[0]) == 2 and filled[0] in filled[-2:]:
        last = max(i for i, x in enumerate(lines) if x.strip() == filled[0])
        return "\n".join(lines[:last] + lines[last + 1 :])
    return text or ""


def brute_measure(text):
    text = brute_unframed(text)
    words = regex.findall(r"[\p{L}\p{N}\p{M}]+", text.lower())
    total = max(1, sum(map(len, words)))
    out = []
    for n in [*quality.TOP, *quality.DUP]:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        often = {g: c for g, c in Counter(grams).items() if c > 1}
        hit = set()
        if often and n in quality.TOP:
            most = max(often.values())
            best = next(g for g in grams if often.get(g) == most)
            hit = {k for i, g in enumerate(grams) if g == best for k in range(i, i + n)}
        elif often:
            seen = set()
            for i, g in enumerate(grams):
                if g in often and g in seen:
                    hit |= set(range(i, i + n))
                seen.add(g)
        out.append(sum(len(words[k]) for k in hit) / total)
    lines = Counter(x for x in map(str.strip, text.split("\n")) if x)
    later = {x: c - 1 for x, c in lines.items() if c > 1}
    out.append(sum(later.values()) / max(1, lines.total()))
    out.append(sum(len(x) * c for x, c in later.items()) / max(1, sum(len(x) * c for x, c in lines.items())))
    return out


def test_quality_measures_equal_brute_force():
    rng = np.random.default_rng(1)
    texts = ["", "one", "same " * 50, "a b\n" * 9, prose(rng, 300), prose(rng, 60) + " buy now cheap here" * 9, "\n".join(["head", prose(rng, 40), "head", prose(rng, 40), "head"])]
    texts += [" ".join(rng.choice(WORDS, 40)) for _ in range(30)]
    texts += ["\n".join(" ".join(rng.choice(WORDS[:3], 2)) for _ in range(12)) for _ in range(20)]
    body = prose(rng, 80)
    texts += ["head\n" + body + "\n head \nAll rights reserved.\n\n", "head\n" + body + "\nhead\nx\ny", "a\na", "a\n\na\n", "a\nb\na", "a\nb\na\nb", "h" * 121 + "\nb c\n" + "h" * 121, body + "\n" + body, body + " " + body]
    got = quality.measure(texts)
    assert np.allclose(got, [brute_measure(t) for t in texts])
    # a passage that is there twice is repetition, a header that comes back at the end is none
    rejected = (got > quality.LIMITS).any(axis=1)
    assert rejected[-2:].all() and not rejected[-9]


def test_quality_keeps_clean_rows_and_columns(spark):
    rng = np.random.default_rng(2)
    good, bad = prose(rng, 500), "spam and eggs " * 200
    docs = spark.createDataFrame([*rows([good, bad, None, "", good, bad, prose(rng, 200_000)]), (None, bad, None, None, None)], DOCS)
    kept = quality.keep(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6]
    scored = {r.doc_id: r for r in quality.score(docs).collect()}
    assert scored[1].rejected and "top_3" in scored[1].reasons and scored[None].rejected
    assert not scored[2].rejected and scored[2].top_2 == 0 and scored[0].reasons == ""
    assert quality.score(docs.limit(0)).count() == quality.keep(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab'srevdlm 1 \n\t.,é 中🙂"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_pretokens_equal_the_pattern(texts):
    pieces, per_text = pretokens.split(texts)
    expected = [regex.findall(pretokens.PATTERN, t) for t in texts]
    assert per_text.tolist() == [len(x) for x in expected]
    assert pieces == [p for x in expected for p in x]


def reference_coder():
    ranks = {b: r for r, b in enumerate(bpe.read_ranks(bpe.VOCABULARY))}
    return tiktoken.Encoding("own", pat_str=pretokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_ids_equal_another_encoder(text):
    ids, _ = bpe.load(bpe.VOCABULARY).encode([text])
    assert ids.tolist() == reference_coder().encode_ordinary(text)
    assert bpe.load(bpe.VOCABULARY).decode(ids).decode() == text


def test_bpe_round_trip(spark):
    rng = np.random.default_rng(3)
    texts = ["Hello  world's\n\n end ", "", None, "приклад 中文 🙂", prose(rng, 100_000), "a" * 50_000, "Hello"]
    docs = spark.createDataFrame([*rows(texts), *rows(texts[:2]), (None, "x", None, None, None)], DOCS)
    coded = bpe.encode(docs)
    got = coded.collect()
    assert len(got) == 10 and all(r.exact for r in got)
    coder = reference_coder()
    for r in got:
        text = "x" if r.doc_id is None else texts[r.doc_id]
        assert (r.ids, r.n_tokens) == ((None, None) if text is None else ((x := coder.encode_ordinary(text)), len(x)))
    back = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    assert bpe.encode(docs.limit(0)).count() == 0


def test_bpe_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Bpe(bpe.VOCABULARY)
    for text in ("one two three four five", "six seven eight nine", "one two three"):
        assert coder.encode([text])[0].tolist() == reference_coder().encode_ordinary(text)


def test_tree_sums():
    leaves = np.arange(1, 12)
    tree = counts.Tree(leaves)
    assert tree.total == 66 and tree.between(2, 5) == 12
    tree.assign(3, 6, 100)
    assert tree.total == 66 - 15 + 100 and tree.between(3, 6) == 100 and counts.Tree(np.empty(0, np.int64)).total == 0


def apply(text, edits):
    out, at, used = [], 0, 0
    for s, e, new in sorted(edits, key=lambda x: x[:2]):
        if at <= s <= e <= len(text):
            out += [text[at:s], new]
            at, used = e, used + 1
    return "".join([*out, text[at:]]), used


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_edited_counts_equal_a_full_recount(data):
    letters = st.text(st.sampled_from("ab'srevl  1\n.é🙂"), max_size=30)
    text = data.draw(letters)
    place = st.integers(0, len(text))
    edits = [(min(a, b), max(a, b), new) for a, b, new in data.draw(st.lists(st.tuples(place, place, letters), max_size=4))]
    coder = bpe.load(bpe.VOCABULARY)
    _, begin, end = pretokens.starts([text])
    doc = counts.Document(text, begin.tolist(), coder.counts([text[a:b] for a, b in zip(begin.tolist(), end.tolist())]))
    used, ignored, _ = doc.edit(edits, lambda p: int(coder.counts([p])[0]))
    expected, n = apply(text, edits)
    assert (doc.text, used, ignored) == (expected, n, len(edits) - n)
    assert doc.tree.total == len(coder.encode([expected])[0])


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_rounds_of_edits_equal_a_full_recount(data):
    letters = st.text(st.sampled_from("ab'srevl  1\n.é🙂"), max_size=20)
    text = data.draw(letters)
    coder = bpe.load(bpe.VOCABULARY)
    _, begin, end = pretokens.starts([text])
    doc = counts.Document(text, begin.tolist(), coder.counts([text[a:b] for a, b in zip(begin.tolist(), end.tolist())]))
    for _ in range(data.draw(st.integers(2, 5))):
        place = st.integers(0, len(text))
        edits = [(min(a, b), max(a, b), new) for a, b, new in data.draw(st.lists(st.tuples(place, place, letters), max_size=3))]
        doc.edit(edits, lambda p: int(coder.counts([p])[0]))
        text, _ = apply(text, edits)
        assert doc.text == text and doc.tree.total == len(coder.encode([text])[0]) == int(doc.counts.sum())
        assert doc.starts == sorted(doc.starts) and len(doc.counts) == len(doc.starts)
        doc = counts.Document(doc.text, doc.starts, doc.counts)  # as a table gives it back


def test_kept_trees_take_up_later_edits(spark):
    rng = np.random.default_rng(5)
    texts = ["one two three", "", None, prose(rng, 20_000), "same"]
    trees = counts.kept(spark.createDataFrame([*rows(texts), (None, "x y", None, None, None)], DOCS))
    coder, now = bpe.load(bpe.VOCABULARY), {i: t or "" for i, t in enumerate(texts)} | {None: "x y"}
    for round_ in range(3):
        given = {i: [(min(3, len(t)), min(5, len(t)), f" new{round_}")] for i, t in now.items() if i != 4}
        edits = spark.createDataFrame([(i, x) for i, x in given.items()], "id long, edits array<struct<start:int,end:int,text:string>>")
        joined = trees.join(edits, trees.doc_id.eqNullSafe(edits.id), "left").drop("id")
        done = counts.edited(joined).cache()
        for r in done.collect():
            now[r.doc_id] = apply(now[r.doc_id], given.get(r.doc_id, []))[0]
            assert r.text == now[r.doc_id] and r.n_tokens == len(coder.encode([r.text])[0]) and r.n_reencoded <= 12 * (round_ + 1) and r.n_edits == (r.doc_id != 4)
        trees = done.select(*trees.columns)
    assert counts.edited(joined.limit(0)).count() == counts.kept(spark.createDataFrame([], DOCS)).count() == 0


def test_recount(spark):
    rng = np.random.default_rng(4)
    texts = ["call 5551234567 or 18005551234 now", "", None, "nothing here", prose(rng, 50_000) + " 1234567890 " + prose(rng, 50_000)]
    docs = spark.createDataFrame([*rows(texts), (None, "id 1234567", None, None, None), (0, texts[0], None, None, None)], DOCS)
    coder = bpe.load(bpe.VOCABULARY)
    got = counts.recount(docs).collect()
    assert len(got) == 7
    for r in got:
        text = "id 1234567" if r.doc_id is None else texts[r.doc_id] or ""
        after = regex.sub("[0-9]{7,}", "<number>", text)
        assert (r.n_tokens, r.n_tokens_after) == (len(coder.encode([text])[0]), len(coder.encode([after])[0]))
        assert r.n_reencoded < 100 and r.n_ignored == 0
    given_edits = spark.createDataFrame([(1, "abc def", [(0, 3, "xyz"), (2, 4, "!"), (90, 91, "z"), (None, 1, "q")]), (2, "a", None)], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    r = counts.recount_edits(given_edits).orderBy("doc_id").collect()
    assert (r[0].n_edits, r[0].n_ignored, r[0].n_tokens_after) == (1, 3, len(coder.encode(["xyz def"])[0])) and r[1].n_edits == 0
    assert counts.recount(docs.limit(0)).count() == 0


def test_edges_are_ordered():
    _, begin, end = pretokens.starts(["a b", "", " c"])
    assert all(a < b for a, b in pairwise(begin.tolist())) and (end > begin).all()
