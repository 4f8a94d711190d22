"""Seams, files and command lines that no query covers."""

import io
import json
import random
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as command
from corpusloom.functions import text as T
from corpusloom.operators import dedup, retrieve, stats, translate
from corpusloom.plans import mixtures
from corpusloom.plans.pipeline import judge, report
from corpusloom.sources import catalogue, ingest, read, write

EN, UK = "The quick brown fox jumps over the lazy dog number {}.", "Швидка руда лисиця стрибає через ледачого собаку номер {}."


def test_composition_equals_python(spark):
    rng = random.Random(1)
    pool = ["a", "é", "й", "Å", "각", "̈́", "豈", "\U0002f800", "й", "क़", "x", "̣̇", "\U0001d15e"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(200)] + [None, ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.nfc(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_retries_wait_as_they_are_told():
    waits, left = [], [ValueError("x"), ValueError("y")]

    def call():
        if left:
            e = left.pop()
            e.retry_after = 7 if not left else None
            raise e
        return "done"

    assert ingest.retried(call, sleep=waits.append) == "done" and waits == [2.0, 7.0]
    with pytest.raises(ZeroDivisionError):
        ingest.retried(lambda: 1 / 0, 2, sleep=waits.append)


def test_fetched_files_are_kept(tmp_path):
    calls = []

    def opener(url):
        calls.append(url)
        return io.BytesIO(b"body")

    for _ in range(2):
        path = ingest.fetched("http://x.y/a.zip", str(tmp_path), opener=opener)
    assert calls == ["http://x.y/a.zip"] and open(path, "rb").read() == b"body"
    assert open(ingest.copied(path, str(tmp_path / "b" / "c")), "rb").read() == b"body"


def test_catalogues_and_dropped_datasets(spark, tmp_path):
    assert catalogue.moses(spark).count() == 15 and catalogue.recipe(spark, "ces-ukr").count() == 18 and catalogue.recipe(spark, "eng-ukr").count() == 52 and catalogue.recipe(spark, "ukr").count() == 10
    for name in ("train-00000", "validation-00000"):
        spark.range(3).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert ingest.dropped(spark, str(tmp_path)).count() == 6 and ingest.dropped(spark, str(tmp_path), split="train").count() == 3


def test_translation_is_asked_once_a_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, " ")], "id int, t string")
    cache = spark.createDataFrame([("x", "y")], "key string, translation string")
    out, fresh = translate.with_cache(rows, "t", cache, lambda ts: [t.upper() for t in ts])
    assert {r.id: r.translation for r in out.collect()} == {1: "A", 2: "A", 3: None, 4: "B", 5: " "} and fresh.count() == 3
    back = translate.back_translated(spark.createDataFrame([(1, "«Раз. Два.»"), (2, "")], "id int, t string"), "t", lambda ts: [t.upper() for t in ts], limit=12)
    assert {r.id: r.source for r in back.collect()} == {1: "РАЗ. ДВА.", 2: ""}


def test_embeddings_are_kept_by_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id int, t string")
    encode = lambda ts: np.array([[len(t), 1.0] for t in ts])
    never = lambda ts: np.array([[9.0, 9.0] for t in ts])
    for how in (encode, never):
        got = retrieve.cached_embeddings(rows, "t", how, str(tmp_path / "cache"))
        assert {r.id: r.embedding for r in got.collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None}


def test_pseudo_documents_of_every_size(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"s{i}", f"t{i}", (np.eye(4)[i % 4] + rng.normal(0, 0.01, 4)).tolist()) for i in range(12)]
    df = spark.createDataFrame(rows, "seq int, source string, target string, embedding array<double>")
    docs = retrieve.pseudo_documents(df, "seq", "source", "target", "embedding", (3, 12, 40)).collect()
    three = sorted(d.source for d in docs if d.chunk_size == 3)
    assert three == sorted(" ".join(f"s{i}" for i in range(k, 12, 4)) for k in range(4)) and all(d.n_sentences == d.word_count == len(d.target.split()) for d in docs)
    assert [d.n_sentences for d in docs if d.chunk_size == 12] == [12] and not [d for d in docs if d.chunk_size == 40]


def test_short_texts_alike_by_flag(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd")], "id int, t string")
    assert dedup.signatures(docs, "id", "t", short_alike=True).select("signature").distinct().count() == 1 and dedup.signatures(docs, "id", "t").select("signature").distinct().count() == 2


def test_statistics_file(spark, tmp_path):
    rows = [(i, EN.format(i), UK.format(i)) for i in range(3)] + [(9, "x", "y"), (10, EN.format(1), UK.format(1))]
    judged = judge(spark.createDataFrame(rows, "seq long, source string, target string"), [1, 2, 5])
    said = write.statistics(report(judged, [1, 2, 5]), str(tmp_path / "s" / "x.json"), "en-uk", "x")
    assert json.loads((tmp_path / "s" / "x.json").read_text()) == said and (said["total_in"], said["stages"][2]["reject_reasons"]) == (5, {"src_too_short": 1})
    assert said["stages"][1]["n_rejected"] >= 1 and said["total_out"] == said["stages"][2]["n_out"]
    assert stats.audited(judged, 1.0).count() == said["total_in"] - said["total_out"]


def test_lettered_chats_and_messages(spark):
    chat = str([{"role": "system", "content": "s"}, {"role": "user", "content": "Питання?\nА: раз\nБ: два"}, {"role": "assistant", "content": "Б"}])
    rows = spark.createDataFrame([(1, chat), (2, "[{'role': 'user', 'content': 'x'}]"), (3, None)], "id int, messages string")
    assert [r.messages[2].content for r in mixtures.lettered_questions(rows).collect()] == ["1"] and [r.messages[2].content for r in mixtures.lettered_questions(rows, numbered=False).collect()] == ["Б"]
    assert mixtures.first_messages(rows).count() == 2 and mixtures.first_messages(rows, "s", 1).count() == 1


def test_command_lines(spark, tmp_path, capsys):
    rows = [(EN.format(i), UK.format(i * 7919)) for i in range(80)] + [("x", "y")]
    table = "source\ttarget\n" + "".join(f"{a}\t{b}\n" for a, b in rows)
    (tmp_path / "in.tsv").write_text(table)
    out = tmp_path / "out"
    command.main(["clean", "--input", str(tmp_path / "in.tsv"), "--output", str(out), "--stages", "1,2,5", "--no-near"])
    assert json.loads((tmp_path / "out.stats.json").read_text())["total_out"] == read.tsv(spark, str(out)).count() == 80
    command.main(["clean", "--input", str(tmp_path / "in.tsv"), "--stats-only"])
    (tmp_path / "mt" / "en-uk").mkdir(parents=True)
    (tmp_path / "mt" / "en-uk" / "nllb.tsv").write_text(table)
    (tmp_path / "mt" / "en-uk" / "open_subtitles.tsv").write_text(table)
    command.main(["convert", "--input", str(tmp_path / "mt"), "--output", str(tmp_path / "chat")])
    assert spark.read.json(str(tmp_path / "chat" / "en-uk" / "train")).count() == 81
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        for k, side in enumerate(("cs", "uk")):
            z.writestr(f"a.{side}", "".join(f"Tohle je věta {i} textu.\n" if k == 0 else f"Це є речення {i} тексту.\n" for i in range(200)))
    command.main(["corpus", "eubookshop", "--input", str(tmp_path / "c.zip"), "--output", str(tmp_path / "corpus")])
    assert read.tsv(spark, str(tmp_path / "corpus" / "train")).columns == ["source", "target"]
    (tmp_path / "q.jsonl").write_text(json.dumps({"question": "q", "possible_answers": {"0": "a", "1": "b", "2": "c"}, "correct_answer_num": 1}))
    command.main(["augment", "--input", str(tmp_path / "q.jsonl"), "--output", str(tmp_path / "q")])
    assert spark.read.json(str(tmp_path / "q")).count() == 3
    (tmp_path / "s.txt").write_text("Швидка руда лисиця стрибає\n\nлежить собака\n")
    command.main(["spelling", "--input", str(tmp_path / "s.txt"), "--output", str(tmp_path / "sc"), "--correct-ratio", "0"])
    assert {r.original_sentence for r in spark.read.json(str(tmp_path / "sc")).collect()} == {"Швидка руда лисиця стрибає", "лежить собака"}
    (tmp_path / "m.jsonl").write_text("".join(json.dumps({"run": r, "metric": "MT.BLEU", "value": v}) + "\n" for r, v in (("a", 1.0), ("b", 9.0))))
    capsys.readouterr()
    command.main(["choose", "--input", str(tmp_path / "m.jsonl")])
    assert capsys.readouterr().out.strip().endswith("b")
    vectors = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "seq long, embedding array<double>")
    vectors.write.parquet(str(tmp_path / "v"))
    vectors.where("seq = 2").write.parquet(str(tmp_path / "d"))
    command.main(["select", "--input", str(tmp_path / "in.tsv"), "--output", str(tmp_path / "sel"), "--queries", str(tmp_path / "d"), "--vectors", str(tmp_path / "v"), "--top-k", "1"])
    assert [r.src for r in spark.read.json(str(tmp_path / "sel")).collect()] == [EN.format(2)]
    assert command.parser().parse_args(["export", "--input", "a", "--output", "b"]).prefix == "submission"
