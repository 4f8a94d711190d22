"""The pipeline, and what it must do to planted rows."""

import random

import numpy as np
import regex
from test_exchange import brute_lines
from test_local import brute_measure, reference_coder
from test_search import brute_pairs, substring_distance

import corpus_pipeline
from corpusloom.llm import decon, lines, quality

VOCABULARY = [f"v{i}" for i in range(5000)]


def test_stages_work_on_planted_documents(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    item = prose(30)
    clean = [prose(rng.randint(50, 300)) for _ in range(40)]
    rows = list(enumerate(clean))
    rows += [(100, "buy now " * 300), (101, prose(40) + " " + item + " " + prose(40)), (102, clean[3]), (103, clean[4] + " extra word"), (104, None), (105, "")]
    rows += [(200 + i, "Read more on our site\n" + prose(60)) for i in range(25)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r[0] for r in docs.select("doc_id").collect()})
    everything = {i for i, _ in rows}
    assert seen[0] == everything - {100} and seen[1] == seen[0]
    assert seen[2] == seen[1] - {102, 103} and seen[3] == seen[2] - {101} == seen[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert not any("Read more" in t for i, t in texts.items() if i >= 200)
    assert all(texts[i] == t for i, t in rows if i < 104 and i != 100)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == seen[4] and whole.columns == ["doc_id", "ids", "n_tokens", "exact"]


def brute_run(rows, items):
    """The five stages in plain Python: doc_id to token ids."""
    docs = {i: t for i, t in rows if not (np.array(brute_measure(t)) > quality.LIMITS).any()}
    cleaned = brute_lines(list(docs.items()), lines.THRESHOLD, True)
    docs = {i: cleaned[t] for i, t in docs.items()}
    names = [i for i, t in docs.items() if t is not None]
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs([docs[i] for i in names]):
        x, y = sorted((top(names[a]), top(names[b])))
        root[y] = x
    docs = {i: t for i, t in docs.items() if top(i) == i}
    words = lambda t: regex.findall(r"[\p{L}\p{N}\p{M}]+", t.lower())
    leaks = lambda t: any((n := len(words(x))) and substring_distance(words(x), words(t)) <= decon.MAX_EDITS * n * (n >= decon.MIN_WORDS) for x in items if x)
    coder = reference_coder()
    return {i: None if t is None else coder.encode_ordinary(t) for i, t in docs.items() if not leaks(t or "")}


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices(VOCABULARY, k=n))
    items = [prose(25), prose(12), "three words only", None, ""]
    texts = [prose(rng.randint(5, 120)) for _ in range(50)]
    texts += [t + " " + prose(rng.randint(0, 6)) for t in texts[:15]] + texts[:5] * 2
    texts += ["spam eggs " * 40, prose(30) + "\n" + prose(30), "head\n" + prose(40) + "\nhead", None, "", "", "one", prose(20) + " " + items[0] + " " + prose(9), "and Three, words only!"]
    texts += ["Shared line\n" + prose(40) for _ in range(22)] + ["copied line\nbody of it"] * 25
    half = prose(40)
    texts.append(half + "\n" + half)
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute_run(rows, items) and 60 < len(got) < len(texts) - 40


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
