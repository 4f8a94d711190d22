"""Line dedup, chat collapse, capture index."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, lines, warc

DOCS = "doc_id long, text string, n_chars int, __text string, __drop string, `a.b` int"


def brute_lines(rows, threshold, copies_once):
    norm = lambda x: " ".join(x.replace("\t", " ").replace("\r", " ").lower().split(" ")).strip()
    squash = lambda x: " ".join(p for p in norm(x).split(" ") if p)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if copies_once or i is not None:
                holders[squash(x)].add(t if copies_once else i)
    bad = {k for k, v in holders.items() if k and len(v) > threshold}
    return {t: None if t is None else "\n".join(x for x in t.split("\n") if squash(x) not in bad) for _, t in rows}


@pytest.mark.parametrize("copies_once", [False, True])
def test_lines_equal_brute_force(spark, copies_once):
    rng = random.Random(5)
    pool = ["Share this", "share  THIS ", "Follow us", "", "  ", "unique a", "unique b", "x\ty", "X Y", "é", "É"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 6))) + rng.choice(["", "\n", f"\nown {i}"]) for i in range(60)]
    texts += [None, "", "\n\n", texts[0], texts[0], "Share this", "word " * 100_000, *["copied\nlines"] * 6, "\n".join(f"line {i}" for i in range(20_000)) + "\nFollow us"]
    rows = [*((i, t, 0, "keep", "me", 7) for i, t in enumerate(texts)), (None, texts[3], None, None, None, None), (3, texts[3], 0, "keep", "me", 7), *[(None, "nobody", 0, "keep", "me", 7)] * 6, *[(3, "again", 0, "keep", "me", 7)] * 6]
    docs = spark.createDataFrame(rows, DOCS)
    got = lines.dedup(docs, 4, copies_once).collect()
    expected = brute_lines([r[:2] for r in rows], 4, copies_once)
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, expected[r[1]] or "") for r in rows)
    for r in got:
        assert r.text is None or r.n_chars == len(r.text)
        if r.doc_id is not None and r.doc_id > 3 and r.text:
            assert r["__dropped"] == texts[r.doc_id].count("\n") - r.text.count("\n") and r["__text"] == "keep"
    clean = lines.clean(docs, 4, copies_once)
    assert clean.columns == docs.columns and [t for _, t in clean.dtypes] == [t for _, t in docs.dtypes]
    assert lines.clean(docs.limit(0)).count() == 0


def test_line_counts_by_id_or_by_text(spark):
    copies = spark.createDataFrame([(i, "shared\nbody", 0, "", "", 0) for i in range(50)], DOCS)
    assert {r.text for r in lines.dedup(copies, 4).collect()} == {""}
    assert {r.text for r in lines.dedup(copies, 4, copies_once=True).collect()} == {"shared\nbody"}
    apart = spark.createDataFrame([(i, f"shared\nbody {i}", 0, "", "", 0) for i in range(5)], DOCS)
    for once in (False, True):
        assert {r.text for r in lines.dedup(apart, 4, once).collect()} == {f"body {i}" for i in range(5)}
        assert {r["__dropped"] for r in lines.dedup(apart, 5, once).collect()} == {0}


TURNS = "conv_id long, turn int, role string, text string, __pos int, h string"


def brute_chat(rows):
    convs = defaultdict(set)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].add((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: tuple((r, t) for *_, r, t in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        if not any((len(o) > len(s) and o[: len(s)] == s) or (o == s and k < c) for k, o in seqs.items()):
            out[c] = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s)
    return out


def test_chat_equals_brute_force(spark):
    rng = random.Random(6)
    rows, cid = [], 0
    for _ in range(40):
        full = [(k, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "", None, "long " * 2000])) for k in range(rng.randint(1, 7))]
        for size in {len(full), rng.randint(1, len(full)), rng.randint(1, len(full))}:
            cid += 1
            rows += [(cid, *t, 9, "x") for t in full[:size]]
    rows += [(1001, 1, "user", "b", 0, ""), (1001, 1, "user", "a", 0, ""), (1001, None, "system", "s", 0, ""), (None, 1, "user", "lost", 0, "")]
    rows += rows[:10]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.collapse(table).collect()}
    expected = brute_chat(rows)
    assert {c: r.chat for c, r in got.items()} == expected
    assert all(r.n_turns == r.chat.count("<|im_start|>") for r in got.values())
    assert chat.collapse(table.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, key string, file string"
URLS = ["http://www.Example.com/a?q=1#top", "https://example.com/a?q=1", "http://sub.example.com:8080/", "example.org", "", None, "http://user@host.net/x/y", "http://b.io?z"]


@pytest.fixture()
def pages(spark):
    rows = [(i, URLS[i % len(URLS)], [f"<p>{i} ü</p>", None, "", "z" * 300_000][i % 4], "clash", "clash") for i in range(120)]
    return spark.createDataFrame([*rows, rows[0], (None, "http://n.ull/", "<n>", None, None)], PAGES)


def test_sort_keys(spark, pages):
    keys = {r.url: r.k for r in pages.select("url", warc.sort_key(F.col("url")).alias("k")).collect()}
    assert [keys[u] for u in URLS] == ["com,example)/a?q=1", "com,example)/a?q=1", "com,example,sub:8080)/", "org,example)/", "", "", "net,host)/x/y", "io,b)/?z"]


def test_capture_index_returns_every_capture(spark, pages):
    captures = pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"))
    directory, folder = warc.index(captures, block=7)
    rows = directory.orderBy("first", "file", "offset").collect()
    assert sum(r.n for r in rows) == 122 and max(r.n for r in rows) <= 7 and all(r.first <= r.last for r in rows)
    wanted = spark.createDataFrame([("com,example)/a?q=1",), ("no,such)/",), ("",), (None,), ("com,example)/a?q=1",)], "key string")
    found = warc.lookup(wanted, directory, folder).collect()
    expected = [(r.page_id, r.html or "") for r in pages.collect() if not r.url or "xample.com/a" in r.url]
    assert sorted((r.id, r.payload) for r in found) == sorted(expected)
    everything = warc.round_trip(pages).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    assert sorted(((r.page_id, r.url, r.html) for r in everything), key=key) == sorted(((r.page_id, r.url, r.html or "") for r in pages.collect()), key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0
