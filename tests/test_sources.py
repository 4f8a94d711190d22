"""Readers and writers on small files, and streams."""

import bz2
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import streaming
from corpusloom.sources import read, write


def text(path, body):
    path.write_text(body, "utf-8")
    return str(path)


def test_tables(spark, tmp_path):
    p = text(tmp_path / "a.tsv", 'source\ttarget\textra\nhe said "hi\tвін\t1\n \tx\t2\nonly\n a \tб\t3\n')
    assert [tuple(r) for r in read.pairs_tsv(spark, p).collect()] == [('he said "hi', "він"), ("a", "б")]
    assert read.pairs_tsv(spark, p, cap=1).count() == 1 and read.pairs_tsv(spark, str(tmp_path / "none.tsv")).count() == 0
    df = spark.createDataFrame([('a "q"\tb', " c\nd "), (None, "x"), ("e", "  ")], read.PAIR)
    write.tsv(df, str(tmp_path / "out"), "gzip")
    assert [tuple(r) for r in read.tsv(spark, str(tmp_path / "out")).collect()] == [('a "q" b', "c d")]


def test_parallel_files(spark, tmp_path):
    s, t = text(tmp_path / "s", "1\tone\n\n3\tthree\n4\tfour\n"), text(tmp_path / "t", "1\tодин\nдва\n3\tтри\n")
    assert [tuple(r) for r in read.parallel(spark, s, t, strip_numbers=True).orderBy("seq").collect()] == [(0, "one", "один"), (2, "three", "три")]
    with pytest.raises(ValueError):
        read.parallel(spark, s, t, strict=True)
    write.parallel(spark.createDataFrame([(2, "b\nb", "y"), (1, "a\ta", "x")], "seq int, source string, target string"), str(tmp_path / "os"), str(tmp_path / "ot"))
    assert [tuple(r) for r in read.parallel(spark, str(tmp_path / "os"), str(tmp_path / "ot")).orderBy("seq").select("source", "target").collect()] == [("a a", "x"), ("b b", "y")]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("c.en-uk.en", "one\n\nthree\nfour\n")
        z.writestr("c.en-uk.uk", "один\nдва\nтри\n")
        z.writestr("c.en-uk.ids", "i1\ni2\ni3\n")
    assert [(r.seq, r.source, r.target, r.id) for r in read.moses_zip(spark, str(tmp_path / "m.zip"), "en", "uk").collect()] == [(0, "one", "один", "i1"), (2, "three", "три", "i3")]


def test_json(spark, tmp_path):
    p = text(tmp_path / "a.jsonl", '{"src": " a ", "uk": "б"}\n\n{"en": "c", "tgt": " "}\n')
    assert [tuple(r) for r in read.pairs_jsonl(spark, p).collect()] == [("a", "б")]
    whole = gzip.compress("".join(f'{{"n": {i}, "t": "{i * 7919}"}}\n' for i in range(100_000)).encode())
    (tmp_path / "cut.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    assert 1000 < read.jsonl(spark, str(tmp_path / "cut.jsonl.gz"), "n long", tolerant=True).count() < 100_000
    q = text(tmp_path / "q.jsonl", json.dumps({"question": "q", "possible_answers": {"0": "a", "1": "b"}, "correct_answer_num": 1}))
    r = read.questions(spark, q).collect()[0]
    assert ([tuple(a) for a in r.answers], r.correct_answers, r.subject) == ([("А", "a"), ("Б", "b")], ["Б"], "")
    q = text(tmp_path / "q.json", json.dumps([{"question": "q", "answers": [{"marker": "А", "text": "x"}], "correct_answers": ["А"], "subject": "s"}]))
    assert read.questions(spark, q).collect()[0].correct_answers == ["А"]
    write.jsonl(spark.createDataFrame([("b", None, 1)], "x string, y string, z int"), str(tmp_path / "o"), ["z", "y"])
    assert [x for p in (tmp_path / "o").glob("*.json") for x in p.read_text().splitlines()] == ['{"z":1,"y":null}']
    write.json_array(spark.range(3), str(tmp_path / "arr.json"))
    assert json.loads((tmp_path / "arr.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]
    assert write.archive(str(tmp_path / "o"), str(tmp_path / "o.zip"), "sub") >= 1 and zipfile.ZipFile(tmp_path / "o.zip").namelist()[0].startswith("sub/")
    p = text(tmp_path / "rc.json", json.dumps([{"text": " t ", "mcqs": [{"stem": "q1 ", "choices": ["x ", "", "y"], "key": " y"}, {"stem": "q2", "choices": ["x"], "key": "x"}, {"stem": "q3", "choices": ["x", "y"], "key": "z"}, {"stem": "q4", "choices": ["x", "y"], "key": None}]}]))
    got = read.passages(spark, p).collect()
    assert [(r.text, r.question, r.choices, r.key, [tuple(a) for a in r.answers], r.correct) for r in got] == [("t", "q1", ["x", "y"], "y", [("А", "x"), ("Б", "y")], "Б")]


def test_json_arrays_of_bounded_size(spark, tmp_path):
    """Any number of rows, none of them through the driver; also none at all."""
    path = str(tmp_path / "arrays")
    write.json_arrays(spark.range(25).repartition(2).select("id", F.lit(None).cast("string").alias("x")), path, rows=4)
    found = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part-*")]
    assert max(map(len, found)) == 4 and sorted(r["id"] for f in found for r in f) == list(range(25)) and all(r["x"] is None for f in found for r in f)
    assert read.json_array(spark, path, "id long").count() == 25
    write.json_arrays(spark.range(0), path + "-none")
    assert read.json_array(spark, path + "-none", "id long").count() == 0


def test_other_files(spark, tmp_path):
    (tmp_path / "s.txt.bz2").write_bytes(bz2.compress("a\nb\n\n\n\nc\n".encode()))
    assert [(r.story, r.text) for r in read.stories(spark, str(tmp_path / "s.txt.bz2")).orderBy("story").collect()] == [(1, "a b"), (2, "c")]
    for k, n in (("x", "train-1"), ("skip", "train-2"), ("x", "test-1")):
        spark.range(1).write.mode("append").parquet(f"{tmp_path}/pq/{k}/{n}.parquet")
    assert read.parquet(spark, f"{tmp_path}/pq", "*.parquet").count() == 3 and read.parquet(spark, f"{tmp_path}/pq", "*.parquet", "/skip/").count() == 2
    docs = spark.createDataFrame([("d", 1, ["a", "b"], ["c", "d"])], "doc string, annotator int, source array<string>, target array<string>")
    assert [tuple(r) for r in read.annotated(docs).collect()] == [("d-a1-00000", "a", "c"), ("d-a1-00001", "b", "d")]


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    seen = []

    def work(df):
        seen.append(df.count())
        return df.select("id", (F.col("id") * 2).alias("v"))

    path, schema = str(tmp_path / "done"), "id long, v long"
    assert write.resumed(spark.range(3), path, "id", work, schema).count() == 3
    assert write.resumed(spark.range(5), path, "id", work, schema).count() == 5 and seen == [3, 2]
    write.nowhere(spark.range(3))


def test_streams(spark, tmp_path):
    rows = [(i, "The quick brown fox jumps.", "Швидка руда лисиця стрибає.", f"2024-01-01 00:00:{i:02d}") for i in range(4)] + [(9, "x", "y", "2024-01-01 00:00:09")]
    spark.createDataFrame(rows, "seq long, source string, target string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, source string, target string, ts timestamp").parquet(str(tmp_path / "in"))
    out = streaming.judged(streaming.first_seen(stream, ["source", "target"], "ts"), [1, 2, 5])
    query = out.writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select failed_stage from judged").collect()
    assert sorted(str(r[0]) for r in got) == ["None", "structural"]
