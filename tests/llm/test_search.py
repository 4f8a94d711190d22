"""Searches against brute force: decontamination, n-gram Jaccard join, substring dedup."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import decon, ngramjoin, substring, textops

DOCS = "doc_id long, text string, sig string, root int, `a.b` int, bit long"
VOCABULARY = [f"w{i}" for i in range(3000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "keep", 1, 2, 3) for i, t in rows], DOCS)


def edited(rng, words, share):
    out = []
    for w in words:
        if rng.random() < share:
            out += rng.choice([[], [rng.choice(VOCABULARY)], [w, rng.choice(VOCABULARY)]])
        else:
            out.append(w)
    return out


def substring_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(prev[j - 1] + (a != b), prev[j] + 1, now[-1] + 1))
        prev = now
    return min(prev)


def test_decontamination_recall_and_exactness(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=rng.randint(8, 60)))) for k in range(60)] + [(90, "too short item"), (91, None), (92, "")]
    items.append((93, items[0][1]))
    docs = []
    for i in range(150):
        words = rng.choices(VOCABULARY, k=rng.randint(0, 150))
        if i % 2:
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, items[rng.randrange(60)][1].split(), rng.choice([0, 0.05, 0.1, 0.15]))
        docs.append((i, rng.choice([" ", "  ", ", "]).join(words)))
    docs += [(200, None), (201, ""), (None, items[5][1].upper()), (202, items[5][1]), (202, items[5][1]), (203, " ".join(rng.choices(VOCABULARY, k=100_000)) + " " + items[7][1])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    docs_table = table(spark, docs)
    got = [tuple(r) for r in decon.find(docs_table, benchmark).collect()]
    expected = set()
    for i, t in docs[:150]:
        words = t.replace(",", " ").split()
        for k, x in items[:60] + items[63:]:
            item = x.split()
            if len(item) >= decon.MIN_WORDS and (d := substring_distance(item, words)) <= decon.MAX_EDITS * len(item):
                expected.add((i, k, d))
    found = {(i, k, d) for i, k, d, _ in got if i is not None and i < 150}
    assert {x[:2] for x in found} <= {x[:2] for x in expected}
    assert len({x[:2] for x in found}) >= 0.95 * len(expected) and len(found & expected) >= 0.95 * len(found)
    assert {0, 93} <= {k for *_, k in [(i, k) for i, k, _, _ in got]} or not any(k in (0, 93) for _, k, _ in expected)
    assert (None, 5, 0) in {x[:3] for x in got} and sum(x[:3] == (202, 5, 0) for x in got) == 2 and (203, 7, 0) in {x[:3] for x in got}
    bad = {i for i, *_ in got}
    clean = decon.clean(docs_table, benchmark)
    assert clean.dtypes == docs_table.dtypes and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert decon.find(docs_table.limit(0), benchmark).count() == decon.find(docs_table, benchmark.limit(0)).count() == 0
    assert decon.clean(docs_table, benchmark.limit(0)).count() == len(docs)


def test_benchmark_in_several_slices(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=20))) for k in range(30)]
    docs = table(spark, [(k, t) for k, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decon, "SLICE_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in decon.find(docs, benchmark).collect()} == {(k, k) for k in range(30)}
    assert decon.clean(docs, benchmark).count() == 0


def test_short_items_with_an_edit_and_verbatim_ones():
    rng = random.Random(9)
    for n in range(decon.MIN_WORDS, 13):
        items = [rng.sample(VOCABULARY, n) for _ in range(150)]
        index = decon.Index([(k, " ".join(x)) for k, x in enumerate(items)], decon.MAX_EDITS)
        docs = []
        for x in items:
            at = rng.randrange(n)
            docs.append(" ".join([*rng.choices(VOCABULARY, k=30), *x[:at], "edited", *x[at + 1 :], *rng.choices(VOCABULARY, k=30)]))
        found = {(d, k) for d, k, *_ in index.matches(docs)}
        recall = sum((k, k) in found for k in range(len(items))) / len(items)
        assert recall >= 0.95, (n, recall)
    short = decon.Index([(1, "one two"), (2, "a b c d e"), (3, "c"), (4, "one two"), (5, "")], decon.MAX_EDITS)
    assert [(d, k, z, n) for d, k, z, n in short.matches(["x One, two y", "a b c d", "b", "", "one", "two a b c d e"])] == [(0, 0, 0, 2), (0, 3, 0, 2), (1, 2, 0, 1), (5, 1, 0, 5), (5, 2, 0, 1)]


def gram_set(text, n):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else {("text", text)}


def near_corpus(rng):
    docs = []
    for g in range(25):
        base = rng.choices(VOCABULARY[:800], k=rng.randint(3, 200))
        for _ in range(rng.randint(1, 5)):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1, 0.2]))))
    docs += ["", "", "!!!", "one", "one", "One", "two words", "two words", docs[0]] + [docs[3]] * 30
    docs += ["the same header of all pages " * 2 + " ".join(rng.choices(VOCABULARY, k=4)) for _ in range(60)]
    docs.append(" ".join(rng.choices(VOCABULARY, k=50_000)))
    docs.append(docs[-1] + " more")
    return docs


def brute_pairs(texts, n=ngramjoin.N, threshold=ngramjoin.THRESHOLD):
    sets = [gram_set(t, n) for t in texts]
    out = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            common = len(sets[i] & sets[j])
            if common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                out[i, j] = common / (len(sets[i]) + len(sets[j]) - common)
    return out


def test_jaccard_join_finds_exactly_the_pairs(spark, monkeypatch):
    texts = near_corpus(random.Random(9))
    expected = brute_pairs(texts)
    docs = table(spark, [*enumerate(texts), (None, texts[0]), (900, None), (0, texts[0])])
    sets = [gram_set(t, ngramjoin.N) for t in texts]
    least = [sets.index(x) for x in sets]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in expected:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    for block, frequent in ((ngramjoin.BLOCK, ngramjoin.FREQUENT), (3, 2)):
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
        pairs = [tuple(r) for r in ngramjoin.similar_sets(docs).collect()]
        got = {(a, b): j for a, b, j in pairs}
        want = {(i, j): v for (i, j), v in expected.items() if least[i] == i and least[j] == j}
        assert len(pairs) == len(got) and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        rows = {r.doc_id: tuple(r)[1:] for r in ngramjoin.similar(docs).collect()}
        assert rows == {i: (top(i), least.count(least[i]) - 1, sum(i in k for k in expected)) for i in range(len(texts))}


def test_overlaps_equal_plain_intersections(monkeypatch):
    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 40):
        sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(m)]
        assert ngramjoin.overlaps(sets)[~np.eye(m, dtype=bool)].tolist() == [len(np.intersect1d(x, y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j]
    near = np.zeros((6, 6), bool)
    near[0, 3] = near[3, 0] = near[3, 5] = near[5, 3] = near[1, 2] = near[2, 1] = True
    assert ngramjoin._forest(near) == [(0, 3), (0, 5), (1, 2)]


def test_shared_grams_without_any_pair(spark):
    """Sets of one word against many: a shared n-gram, and sizes too far apart to be a pair."""
    long = " ".join(VOCABULARY[:300])
    docs = table(spark, [(1, "w0 w1"), (2, long), (3, "w5 w6 w7"), (4, "w6 w7")])
    assert ngramjoin.similar_sets(docs).count() == 0 and ngramjoin.one_of_each(docs).count() == 4


def test_pairs_of_a_partition_whose_grams_give_none():
    """One n-gram that sets of 3 and of 300 n-grams share, and one that nobody shares."""
    rows = [(7, 1, (3 << 16) | (1 << 8) | 1, ngramjoin.NONE), (7, 2, (300 << 16) | (1 << 8) | 1, ngramjoin.NONE), (8, 2, (300 << 16) | (1 << 8) | 1, ngramjoin.NONE)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["gram", "sig", "meta", "cluster"])
    assert list(ngramjoin._pairs(iter([batch]), 0.7)) == list(ngramjoin._pairs(iter([batch.slice(0, 0)]), 0.7)) == []


def test_one_of_each_group_stays(spark):
    texts = near_corpus(random.Random(10))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute_pairs(texts):
        a, b = sorted((top(i), top(j)))
        root[b] = a
    docs = table(spark, [*enumerate(texts), (None, texts[0]), (900, None)])
    kept = ngramjoin.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(texts)) if top(i) == i} | {None, 900}
    assert ngramjoin.one_of_each(docs.limit(0)).count() == ngramjoin.similar(docs.limit(0)).count() == ngramjoin.similar_sets(docs.limit(0)).count() == 0
    assert ngramjoin.one_of_each(docs.where("doc_id = 0")).count() == 1


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 8), (8, 7)], "a long, b long")
    assert {r.node: r.root for r in ngramjoin.components(edges).collect()} == {**{i: 100 for i in range(100, 161)}, 7: 7, 8: 7}


def brute_repeats(docs, length):
    """Word positions of each document inside a span of `length` words that a document of a smaller id holds."""
    seen, out = {}, {}
    for i, t in sorted((i, t) for i, t in docs if i is not None and t is not None):
        words = t.lower().split()
        hit = set()
        for k in range(len(words) - length + 1):
            g = tuple(words[k : k + length])
            if seen.get(g, i) < i:
                hit |= set(range(k, k + length))
            seen.setdefault(g, i)
        out[i, t] = hit
    return out


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    passages = [rng.choices(VOCABULARY, k=rng.randint(9, 60)) for _ in range(12)]
    docs = []
    for i in range(120):
        words = rng.choices(VOCABULARY, k=rng.randint(0, 80))
        for _ in range(rng.choice([0, 1, 1, 3])):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(words))
            words[at:at] = p[lo : rng.randint(lo, len(p))]
        docs.append((i, " ".join(words)))
    docs += [(500 + i, docs[i % 3][1]) for i in range(20)] + [(700, None), (701, ""), (702, "w1 w2"), (703, " ".join(rng.choices(VOCABULARY, k=60_000)))]
    docs.append((704, docs[-1][1]))
    rows = [*docs, (None, docs[0][1]), docs[50]]
    for shard in (substring.SHARD_WORDS, 40):
        got = substring.dedup(table(spark, rows), length=12, gram=6, shard=shard).collect()
        assert len(got) == len(rows)
        expected = brute_repeats(docs, 12)
        for r in got:
            text = dict(docs).get(r.doc_id, docs[0][1])
            hit = expected.get((r.doc_id, text), set())
            assert r.n_removed == len(hit) and {k for s in r.spans or [] for k in range(s.lo, s.hi)} == hit
            if text is None:
                assert r.text is None
            else:
                assert r.text.split() == [w for k, w in enumerate(text.split()) if k not in hit]
    assert substring.dedup(table(spark, rows).limit(0)).count() == 0


def test_equal_ids_do_not_cut_one_another(spark):
    text = " ".join(VOCABULARY[:100])
    got = substring.dedup(table(spark, [(1, text), (1, text), (1, text + " tail"), (2, "x " + text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 100]


def test_matching_statistics_equal_brute_force():
    rng = random.Random(12)
    for _ in range(50):
        parts = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(3)]
        query = [rng.randrange(3) for _ in range(40)]
        automaton = substring.Automaton()
        for p in parts:
            automaton.add(p)
        grams = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        expected = [max((m for m in range(1, k + 2) if tuple(query[k + 1 - m : k + 1]) in grams), default=0) for k in range(len(query))]
        assert list(automaton.statistics(query)) == expected


def test_word_hashes_tell_words_apart_and_fold_case():
    w = textops.words(["Straße ABC abc", "", "x-y é"])
    assert w.first.tolist() == [0, 3, 3, 6] and w.hash[1] == w.hash[2] and len(set(w.hash.tolist())) == 5
    assert np.array_equal(textops.words(["abc"]).hash, w.hash[1:2])
