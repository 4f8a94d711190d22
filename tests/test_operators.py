"""Operators on small tables against plain Python, and whatever the partitions are."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clean, dedup, evaluate, filters, joins, records, retrieve, sample, segment, stats
from corpusloom.plans import corpora
from corpusloom.plans.pipeline import Config, judge, run_passes, run_stages, selected, statistics, with_calibration

C = F.col
GOOD = ("The quick brown fox jumps over the lazy dog.", "Швидка руда лисиця стрибає через ледачого собаку.")


def pairs(spark, rows):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "seq long, source string, target string")


def reasons(spark, rows, **how):
    stages = how.pop("stages")
    return {r.seq: r.reason for r in judge(pairs(spark, rows), stages, Config(**how)).collect()}


def test_structural(spark):
    rows = [GOOD, ("short", "ok tooo"), ("x" * 1001, "y" * 900), (GOOD[0], "a"), (GOOD[0], "b" * 1201), (GOOD[0], "twelve chars"), ("a b c d e f g h i j k l", "abcdefghijkl mnopqrst")]
    assert reasons(spark, rows, stages=[5]) == {0: None, 1: "src_too_short", 2: "src_too_long", 3: "tgt_too_short", 4: "tgt_too_long", 5: "char_ratio", 6: "word_ratio"}
    got = judge(pairs(spark, [("He said (it. " * 2, 'Він "сказав" це ( так.')]), [5]).collect()[0]
    assert got.structural_score == pytest.approx((1 + 0.4 + 0.3) / 3)


def test_entity_and_copy(spark):
    rows = [("In 1999 and 5", "У 1999 та 5"), ("In 1999", "У 1998"), ("1 a 2 b 3 c 4", "one"), ("see www.a.b", "див."), ("5% a 6% b 7%", "5 a 6 b 7")]
    assert reasons(spark, rows, stages=[6]) == {0: None, 1: "large_number", 2: "number_count", 3: "url", 4: "percent"}
    rows = [GOOD, (GOOD[0], "x"), (GOOD[0], GOOD[0].upper()), ("а б в г ґ", "а б в г ґ"), ("see http://a.b it", "See http://a.b it!")]
    assert reasons(spark, rows, stages=[7]) == {0: None, 1: "char_ratio_oob", 2: "high_latin_in_target", 3: "high_token_overlap", 4: None}


def test_uk_quality(spark):
    def brute(t):
        cyr = [c for c in t if "А" <= c <= "я" or c in "ҐґЄєІіЇї"]
        if not cyr:
            return 0.5
        words = t.lower().split()
        func = min(1, sum(w in clean.RUSSIAN for w in words) / max(1, len(words)) * 10)
        return min(1, max(0, sum(c in "іїєґІЇЄҐ" for c in cyr) / len(cyr) * 0.5 + (1 - min(1, sum(c in "ыэъЫЭЪ" for c in cyr) / len(cyr) * 5)) * 0.3 + (1 - func) * 0.2))

    texts = ["їжак і єнот", "это был он", "plain", "", "ёж", "так там", "мы были"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean.uk_quality(C("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == pytest.approx({t: brute(t) for t in texts})


def test_stages_attribute_the_first_failure(spark):
    rows = [GOOD, GOOD, ("", GOOD[1]), ("x", "y"), (None, None), ("In 2001 they came here now.", "У 2002 вони прийшли сюди."), GOOD]
    judged = judge(pairs(spark, rows), [1, 2, 5, 6, 7])
    assert [(r.failed_stage, r.reason) for r in judged.orderBy("seq").collect()] == [(None, None), ("dedup", "exact"), ("unicode", "empty"), ("structural", "src_too_short"), ("unicode", "empty"), ("entity", "large_number"), ("dedup", "exact")]
    table = {r.stage: r for r in statistics(judged, [1, 2, 5, 6, 7]).collect()}
    assert [(table[s].n_in, table[s].n_out) for s in ("unicode", "dedup", "structural", "entity", "copy_source")] == [(7, 5), (5, 3), (3, 2), (2, 1), (1, 1)]
    assert table["unicode"].retention == 71.43
    assert [tuple(r) for r in run_stages(pairs(spark, rows)).collect()] == [GOOD]
    for n in (1, 7):
        assert [tuple(r) for r in run_stages(pairs(spark, rows).repartition(n)).collect()] == [GOOD]
    assert run_stages(pairs(spark, []), "all").count() == 0 and selected("9,1,12") == [1, 9]


def test_model_seams(spark):
    who = lambda ts: [("uk" if any("а" <= c <= "я" for c in t.lower()) else "en", 0.99) for t in ts]
    assert reasons(spark, [GOOD, GOOD[::-1]], stages=[3], identify=who) == {0: None, 1: "source_language"}
    encode = lambda ts: np.array([[len(t), 1.0] if "§" not in t else [-1.0, 0] for t in ts])
    assert reasons(spark, [GOOD, ("§", "b")], stages=[8], encode=encode) == {0: None, 1: "semantic"}
    out = judge(pairs(spark, [GOOD]), [4, 5, 9], Config(estimate=F.lit(0.0))).collect()[0]
    assert out.composite_score == pytest.approx((out.uk_quality_score * 0.35 + out.structural_score * 0.15 + 0.5 * 0.15) / 0.65)
    assert with_calibration(pairs(spark, [GOOD] * 10), Config()).overrides["src"] == (len(GOOD[0]),) * 2


def test_corpora(spark):
    rows = [(i, "d1" if i < 30 else "d2", f"This is the sentence number {i} of the text.", f"Це є речення під номером {i} цього тексту.") for i in range(60)]
    table = spark.createDataFrame(rows, "seq long, doc string, source string, target string")
    built = corpora.build("eubookshop", table, Config(pair="cs-uk", latin=1.0), group="doc")
    assert 0 < built.count() < 20 and built.columns == ["source", "target"]
    split = corpora.splits("elrc", table.drop("doc"), 10, 5)
    assert Counter(r.split for r in split.collect()) == {"validation": 50, "train": 5}


def test_filters(spark):
    def keep(rows, schema, predicate):
        return [r.i for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").where(predicate).orderBy("i").collect()]

    assert keep([("1.2", "0.99", "0.99"), ("x", "1", "1"), (None, "1", "1"), ("1.2", "0.9", "1")], "l string, a string, b string", filters.mined(C("l"), C("a"), C("b"))) == [0]
    assert keep([(None,), (1.3,), (1.0,)], "l double", filters.laser_or_unscored(C("l"))) == [0, 1]
    assert keep([("— так",), ("«Так».",), ("так — ні",), ("",)], "t string", filters.dialogue(C("t"))) == [0, 1]
    assert keep([("Добре слово",), ("Good word",), ("12345 слово 678",), ("",)], "t string", filters.clean_prose(C("t"))) == [0]
    assert keep([("a" * 30 + " b c d e", "z" * 31 + " b c d e"), ("a b", "c d"), (None, "x")], "a string, b string", filters.long_enough(C("a"), C("b"))) == [0]
    assert keep([("a b c", "d e f"), ("a b", "d e f"), ("a b c d e f g h i j", "a b c")], "a string, b string", filters.word_window(C("a"), C("b"))) == [0]
    assert keep([("en_uk",), (None,), ("cs_uk",)], "p string", filters.of_pair(C("p"), None)) == [0, 1]
    assert keep([("x", ["x", "y "]), ("y", [" y ", "x", None]), ("a", ["x", "y"]), ("x", ["x", " "]), (None, ["x", "y"]), (" ", ["x", "y"]), ("x", list("xyzuvw"))], "k string, m array<string>", filters.keyed_question(C("k"), C("m"))) == [0, 1]
    assert keep([("2", ["a", "b"]), ("3", ["a", "b"]), ("x", ["a", "b"]), ("1", ["", "b"])], "k string, m array<string>", filters.numbered_question(C("k"), C("m"))) == [0]
    assert keep([(r"\frac{1}{2}",), (r"\фрак{1}",)], "t string", filters.sound_latex(C("t"))) == [0]
    assert keep([("довге речення тут",), ("коротко",)], "t string", filters.usable_choice(C("t"))) == [0]
    files = spark.createDataFrame([("a.tsv",), ("b.tsv",)], "f string")
    assert [r.f for r in filters.excluding(files, "f", spark.createDataFrame([("b.tsv",)], "n string")).collect()] == ["a.tsv"]
    body, sentences = " ".join(["слово"] * 300), [["слово"] * 2, ["— так"] * 2]
    assert keep([(body, sentences[0]), (body, sentences[1]), ("слово", sentences[0])], "b string, s array<string>", filters.chunk_kept(C("b"), C("s"))) == [0]


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=60)) for _ in range(12)]
    rows = list(enumerate(base)) + [(100 + i, t + " end") for i, t in enumerate(base[:5])] + [(200, "ab"), (201, "cd"), (202, None), (203, ""), (204, "ab")]
    rows += [(300 + i, base[7]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, root int")
    kept = {r.id for r in dedup.near_keep(docs, "id", "text").collect()}
    assert kept == {100, 101, 102, 103, 104, 5, 6, 7, 8, 9, 10, 11, 200, 201, 202, 203}
    signed = {r.id: r.signature for r in dedup.signatures(docs, "id", "text").collect()}
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    for i, j in itertools.combinations([0, 1, 100, 101], 2):
        a, b = grams(dict(rows)[i]), grams(dict(rows)[j])
        assert abs(np.mean(np.array(signed[i]) == np.array(signed[j])) - len(a & b) / len(a | b)) < 0.15
    expected = {(i, j) for i, j in itertools.combinations(sorted(signed), 2) if np.mean(np.array(signed[i]) == np.array(signed[j])) >= 0.85}
    assert {(r.a, r.b) for r in dedup.near_pairs(docs, "id", "text").collect()} == expected
    assert dedup.near_keep(docs.limit(0), "id", "text").count() == 0 and dedup.bloom_size(50_000_000, 0.001) == (718879378, 10)


def test_a_bucket_led_by_an_unlike_row_loses_nothing(monkeypatch):
    """Rows 1 and 2 agree in 0.86 of their places, row 0 is unlike both; also where the bucket is cut into slots."""
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 1 << 30, (3, 128)).astype(np.int32)
    c[:110] = b[:110]
    met = np.stack([a, b, c])
    one = np.zeros(3, int)
    assert [x[:2] for x in dedup._forest(met, one, False, 0.85)] == [x[:2] for x in dedup._all(met, one, False, 0.85)] == [(1, 2)]
    assert [x[:2] for x in dedup._forest(met, np.array([0, 0, 1]), True, 0.85)] == [(1, 2)] and not dedup._forest(met, np.array([0, 1, 1]), True, 0.85)


def test_slots_of_a_large_bucket_all_meet(spark, monkeypatch):
    rng = random.Random(6)
    base = rng.choices([f"w{i}" for i in range(900)], k=200)
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(12)] + [(50, " ".join(rng.choices([f"w{i}" for i in range(900)], k=90)))]
    monkeypatch.setattr(dedup, "SLOT", 3)
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r.id for r in dedup.near_keep(docs, "id", "text").collect()} == {10, 50} and dedup.near_pairs(docs, "id", "text").count() == 66


def test_stages_without_scores_and_passes(spark):
    rows = [GOOD, GOOD]
    assert reasons(spark, rows, stages=[9]) == {0: "composite", 1: "composite"}
    assert [tuple(r) for r in run_passes(pairs(spark, rows), [[1, 5], [2]]).collect()] == [GOOD] and run_stages(pairs(spark, rows), [1, 5]).count() == 2
    long = " ".join(f"Sentence number {i} has words of its own." for i in range(40))
    near = [(long, GOOD[1]), (long + " End.", GOOD[1])]
    assert reasons(spark, near, stages=[2]) == {0: "near", 1: None} and reasons(spark, near, stages=[2], near_threshold=None) == {0: None, 1: None}
    assert corpora.CORPORA["nllb"].passes == ((1, 3, 4, 5, 6, 7, 8), (2,)) and all(c.near >= 0.9 for c in corpora.CORPORA.values())


def test_other_orders_are_any_but_the_old_one(spark):
    df = spark.range(400).select("id", F.array(*(F.struct(F.lit(m).alias("marker"), F.lit(m).alias("text")) for m in "абв")).alias("a"))
    got = Counter(tuple(r.o) for r in df.select(records.another_order(C("a"), C("id")).alias("o")).collect())
    assert set(got) == set(itertools.permutations(range(3))) - {(0, 1, 2)} and min(got.values()) > 30
    few = df.limit(3).select(records.another_order(F.slice("a", 1, 2), C("id")).alias("two"), records.another_order(F.slice("a", 1, 1), C("id")).alias("one"), records.another_order(F.slice("a", 1, 0), C("id")).alias("none")).distinct().collect()
    assert [tuple(r) for r in few] == [([1, 0], [0], [])]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, key string")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("c", 3, "z")], "key string, seq int, v string")
    assert sorted((r.n, r.v) for r in joins.enrich(left, right, "key", "seq").collect()) == [(1, "y"), (2, None), (3, None)]
    assert sorted(r.n for r in joins.without_leaks(left, right, "key").collect()) == [2, 3]
    assert sorted((r.n, r.m) for r in joins.flagged(left, right, "key", "m").collect()) == [(1, True), (2, False), (3, False)]
    hit, miss = joins.cached(left, right.select("key", "v").where("v <> 'x'"), "key")
    assert [r.v for r in hit.collect()] == ["y"] and sorted(r.n for r in miss.collect()) == [2, 3]
    assert [(r.key, r.v) for r in joins.in_input_order(left.withColumn("seq", C("n")), right, "key", "seq", "seq").collect()] == [("a", "y")]
    caps = spark.createDataFrame([("a", 1)], "key string, cap int")
    assert sorted(r.v for r in joins.capped(right, caps, "key", [C("seq")]).collect()) == ["x", "z"]
    cells = spark.createDataFrame([(1, "q", "A"), (1, "a", "B")], "row int, field string, value string")
    assert joins.scattered(cells, "row", "field", "value").collect()[0].fields == {"q": "A", "a": "B"}


def test_ranks_samples_and_mixtures(spark):
    df = spark.range(1000).withColumn("s", C("id") % 7)
    for n in (1, 9):
        got = {r.id: r["rank"] for r in sample.ranks(df.repartition(n), [C("s").desc(), C("id")]).collect()}
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and sorted(got.values()) == list(range(1, 1001))
    a, b = ({r.id for r in sample.sampled(df.repartition(n), "id", 50).collect()} for n in (1, 8))
    assert a == b and len(a) == 50 and sample.sampled(df, "id", 0).count() == 0 and sample.sampled(df, "id", None).count() == 1000
    assert 230 < df.where(sample.chosen(0.25, 1, "id")).count() < 270 or 200 < df.where(sample.chosen(0.25, 1, "id")).count() < 300
    mix = sample.interleaved({"x": df.select("id"), "y": spark.range(10)}, {"x": 0.8, "y": 0.2}, "id").collect()
    assert Counter(r.part for r in mix) == {"x": 1000, "y": 250} and set(Counter(r.id for r in mix if r.part == "y").values()) == {25}
    whole = sample.mixed({"x": df.select("id"), "y": spark.range(10)}, {"x": 5, "y": -1}, "id").collect()
    assert Counter(r.part for r in whole) == {"x": 5, "y": 10}
    split = sample.quality_split(df, "s", "id", 500).collect()
    assert Counter(r.split for r in split) == {"validation": 50, "train": 950} and {r.s for r in split if r.split == "validation"} == {6}


def test_top_k_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[10] = v[11]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    expected = {(q, int(k)) for q in range(60) for k in np.lexsort((np.arange(60), -sims[q]))[:4]}
    for limit in (retrieve.SLICE, 100):
        monkeypatch.setattr(retrieve, "SLICE", limit)
        got = retrieve.top_k(df, df.repartition(5), "id", "v", 4)
        assert {(r.query, r.key) for r in got.collect()} == expected
    assert retrieve.top_k(df.limit(0), df, "id", "v").count() == 0 and retrieve.retrieved(got).count() == len({k for _, k in expected})
    assert retrieve.pooled(np.ones((1, 3, 4)), np.array([[1, 1, 0]])).tolist() == [[0.5] * 4]


def test_top_k_holds_blocks_of_bounded_size(spark, monkeypatch):
    """No row passes through the driver, copies are equally near whichever block they are in, and a cell's memory is that of its vectors."""
    import tracemalloc

    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("rows come to the driver")

    rng = np.random.default_rng(8)
    v = np.repeat(rng.normal(size=(150, 9)).astype(np.float32), 40, axis=0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<float>").repartition(3)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    monkeypatch.setattr(retrieve, "SLICE", 5000)
    got = {}
    for r in retrieve.top_k(df.where("id % 40 = 7"), df, "id", "v", 5).collect():
        got.setdefault(r.query, []).append(r.key)
    assert {q: sorted(ks) for q, ks in got.items()} == {q: [q - 7 + i for i in range(5)] for q in range(7, 6000, 40)}

    raw = rng.normal(size=(40_000, 8)).astype(np.float32)
    packs = [(0, side, 4, np.arange(at, at + 250).tobytes(), raw[at : at + 250].tobytes()) for side in (0, 1) for at in range(0, 40_000 if side == 0 else 1000, 250)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*packs)], names=["cell", "side", "width", "keys", "v"])
    tracemalloc.start()
    n = sum(b.num_rows for b in retrieve._meet(iter([batch]), 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all similarities at once would be 320 MB
    assert n == 3000 and most < 60e6


def test_packing():
    words = lambda n: " ".join(["w"] * n)
    sizes = lambda ns: [[len(s.split()) for s in g] for g in segment.packed([words(n) for n in ns], 5, 10)]
    assert sizes((4, 3, 5, 12, 2, 9, 1)) == [[4, 3], [5], [12], [2, 9, 1]] and sizes((6, 5, 1)) == [[6], [5, 1]] and sizes((6, 5, 2, 6, 1)) == [[6], [5, 2], [6, 1]]
    assert sizes((9, 3)) == [[9, 3]] and sizes((3, 9)) == [[3, 9]]
    assert segment.packed([], 5, 10) == [] and segment.packed(["a"], 5, 10) == [["a"]]


def test_paragraph_windows(spark):
    rows = [(d, i, f"{d}-{i}") for d, n in (("a", 100), ("b", 2), ("c", 3)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc string, seq int, text string")
    one, two = (segment.paragraphs(table.repartition(n), ["doc"], "seq", ["text"], (3, 6), (0, 10_000)).orderBy("doc", "window").collect() for n in (1, 6))
    assert one == two and "b" not in {r.doc for r in one} and all(3 <= r.n <= 6 for r in one)
    said = " ".join(r.text for r in one if r.doc == "a").split()
    assert said == [f"a-{i}" for i in range(len(said))] and len(said) > 94


def test_stories(spark):
    lines = ["", "a", "b", "", "c", "", "", "", "d", " ", "", "e"]
    table = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, ord int, line string")
    got = segment.stories(table, "file", "ord", "line").orderBy("story", "paragraph").collect()
    assert [(r.story, r.paragraph, r.text) for r in got] == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "d"), (2, 2, "e")]


def test_variants(spark):
    rows = [(k, f"q{k}", [("А", "w"), ("Б", "x"), ("В", "y"), ("Г", "z")][: 1 + k % 4], ["А"]) for k in range(40)] + [(90, "bad", [("А", "w")], ["Б"]), (91, "none", [], [])]
    table = spark.createDataFrame(rows, "id long, question string, answers array<struct<marker:string,text:string>>, correct_answers array<string>")
    got = records.variants(table, "id", 3).collect()
    by = {k: [r for r in got if r.id == k] for k in range(40)}
    assert all(len(v) == min(3, [1, 2, 6, 24][k % 4]) for k, v in by.items()) and len(got) == sum(map(len, by.values()))
    for r in got:
        assert [a.text for a in r.answers if a.marker == r.correct_answers[0]] == ["w"]
    assert all(len({tuple(a.text for a in r.answers) for r in v}) == len(v) for v in by.values())
    assert {r.prefix for r in got if r.variant < 2} == {""} and all(r.prefix for r in got if r.variant == 2)
    picked = records.picked(records.variants(table, "id", 3), "id", C("id") < 20).collect()
    assert {(r.id, r.variant) for r in picked if r.id in (3, 23, 1)} == {(3, 1), (3, 2), (23, 0), (23, 2), (1, 0), (1, 1)}


def test_records(spark):
    row = spark.createDataFrame([("q", {"1": "b", "0": "a"}, 1, "кроки", "Б")], "t string, o map<string,string>, n int, r string, l string")
    m = row.select(records.question(C("t"), C("o"), C("n")).alias("m"), records.reasoned(C("t"), C("r"), F.lit("А: a"), C("l"), "sys", F.lit(False)).alias("x"), records.reasoned(C("t"), C("r"), F.lit("А: a"), C("l"), "sys", F.lit(True)).alias("i"), records.numbered("id-", C("n")).alias("k")).collect()[0]
    assert [x.content for x in m.m][1:] == ["q\n\n0. a\n1. b\n\nAnswer:", "1"]
    assert m.x[2].content == "кроки\nВідповідь: Б" and [x.content for x in m.i] == ["sys", "q\n\nкроки\n\nА: a", "Б"] and m.k == "id-00001"
    prompts = row.select(records.rendered(records.correction("gc", C("t")), True).alias("p"), records.translation(C("t"), C("r"), F.lit("cz")).alias("c"), records.bilingual_problem(C("t"), C("t"), C("r")).alias("b"), records.bilingual_question(C("t"), C("o"), C("t"), C("o"), C("n")).alias("q")).collect()[0]
    assert prompts.p.endswith("<|im_start|>assistant\n") and prompts.c[0].content == records.PROMPTS["mt_cs"] and prompts.b[2].content.endswith("Solution:\nкроки") and prompts.q[2].content.endswith("Answer: 1")


def test_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a dog", "a dog")], "id long, p string, r string")
    assert evaluate.bleu(df, "id", "p", "r").collect()[0][0] == pytest.approx(100) and evaluate.chrf(df, "id", "p", "r").collect()[0][0] == pytest.approx(100)
    off = spark.createDataFrame([(1, "the cat is on the mat now", "the cat sat on the mat")], "id long, p string, r string")
    # by hand: 5 of 7, 3 of 6, 1 of 5, none of 4 (smoothed to 1 / (2 · 4))
    assert evaluate.bleu(off, "id", "p", "r").collect()[0][0] == pytest.approx(100 * (5 / 7 * 3 / 6 * 1 / 5 * 1 / 8) ** 0.25)
    assert 50 < evaluate.chrf(off, "id", "p", "r").collect()[0][0] < 90
    assert evaluate.bleu(df.limit(0), "id", "p", "r").collect()[0][0] == 0 and evaluate.chrf(df.limit(0), "id", "p", "r").collect()[0][0] == 0
    acc = evaluate.accuracy(spark.createDataFrame([("1", "1"), (None, "1"), ("2", "1"), ("1", "1")], "p string, g string"), C("p"), C("g")).collect()[0]
    assert (acc.n, acc.accuracy, acc.parsed) == (4, 0.5, 0.75)
    nums = spark.createDataFrame([("1,200", "1200"), ("\\boxed{5}", "5.0"), ("x", "y"), ("$3$.", "3"), (None, "1")], "a string, b string")
    assert [r[0] for r in nums.select(evaluate.same_number(C("a"), C("b"))).collect()] == [True, True, False, True, False]
    m = spark.createDataFrame([("r1", "MT.BLEU", 10.0), ("r2", "MT.BLEU", 10.0), ("r3", "GC.detection", 0.1)], "run string, metric string, value double")
    assert evaluate.arg_max(evaluate.checkpoint_score(m, "run"), "run").collect()[0].run == "r1"
    both = evaluate.submission([df.select("id", "p"), df.select("id", C("r").alias("p"))], ["p", "id"], "id").collect()
    assert [r.id for r in both] == [1, 2, 1, 2]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 0.0, "CORRECT"), ("b", None, "CORRECT")], "g string, s double, w string")
    assert {r.g: (r.n, r.hits, r.percent, r.score) for r in stats.agreement(df, "g", C("s") == 1, C("s")).collect()} == {"a": (2, 1, 50.0, 1.0), "b": (1, 0, 0.0, None)}
    assert {r.label: r.n for r in stats.label_balance(df, C("w")).collect()} == {"error": 1, "correct": 2}
    assert [(r.g, r.n) for r in stats.histogram(df, "g").collect()] == [("a", 2), ("b", 1)]
    text = spark.createDataFrame([(1, i, f"t{i}") for i in (2, 0, 1)] + [(2, 0, "alone")], "c int, i int, t string")
    assert [(r.c, r.t, r.n, r.word_count) for r in stats.joined_text(text, "c", "i", ["t"]).collect()] == [(1, "t0 t1 t2", 3, 3)]


def test_ngrams_are_counted_where_the_rows_are(spark, monkeypatch):
    """Against plain counts, for any slices; rows of one key count together, and no n-gram is a row."""
    rng = random.Random(4)
    said = lambda: None if rng.random() < 0.1 else " ".join(rng.choices(["да", "ні", "\U0001f600x", ",", "a1"], k=rng.randrange(9)))
    rows = [(i // 3 if i < 12 else i, said(), said()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, pred string, ref string").repartition(3)
    tokens = {"c": (lambda t: [*"".join((t or "").split())]), "w": lambda t: re.findall(r"\w+|[^\w\s]", t or "")}
    for at_once in (1, 60, evaluate.AT_ONCE):
        monkeypatch.setattr(evaluate, "AT_ONCE", at_once)
        for kind, columns in (("c", [F.regexp_replace(F.coalesce(C(c), F.lit("")), r"\s", "") for c in ("pred", "ref")]), ("w", [evaluate._marks(c) for c in ("pred", "ref")])):
            got = evaluate._matches(df, *columns, 4)
            assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
            want = {}
            for n in range(1, 5):
                grams = lambda t, n=n, kind=kind: [tuple(x[i : i + n]) for x in [tokens[kind](t)] for i in range(len(x) - n + 1)]
                p, r = (Counter((row[0], g) for row in rows for g in grams(row[k])) for k in (1, 2))
                want[n] = (sum((p & r).values()), sum(p.values()), sum(r.values()))
            assert {x.n: (x.match, x.pred, x.ref) for x in got.collect()} == want


def test_bands_are_no_more_than_lose_nothing():
    """Pairs that just reach the threshold agree in a band wherever they differ; unlike ones rarely do."""
    rng = np.random.default_rng(9)
    for threshold in (0.8, 0.85, 0.9, 1.0):
        spans = dedup._spans(threshold, dedup.BANDS)
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == dedup.PERMUTATIONS
        most = sum(k / dedup.PERMUTATIONS >= threshold - 1e-12 for k in range(dedup.PERMUTATIONS))
        hardest = np.linspace(0, dedup.PERMUTATIONS - 1, most).astype(int) if most else []
        for places in [hardest, *(rng.choice(dedup.PERMUTATIONS, most, replace=False) for _ in range(200))]:
            same = np.ones(dedup.PERMUTATIONS, bool)
            same[places] = False
            assert any(same[a : a + n].all() for a, n in spans)
    assert len(dedup._spans(0.85, 32)) == 20 and dedup._spans(0.5, 32) == [(4 * i, 4) for i in range(32)]
    unlike = rng.random((3000, dedup.PERMUTATIONS)) < 0.5
    met = lambda spans: np.mean([any(x[a : a + n].all() for a, n in spans) for x in unlike])
    assert met(dedup._spans(0.85, 32)) < met(dedup._spans(0.5, 32)) / 3
