"""Every curation query runs; those with SQL give what DuckDB gives."""

import json
import os

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusloom import queries
from corpusloom.operators.sample import uniform


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(json.dumps([plain(r[i]) for i in order], default=str, ensure_ascii=False) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in os.listdir(SF):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{SF}/{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    c = duck.execute(queries.ORACLES[name])
    columns = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, c.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_cases_are_worked_on_by_all_cores(spark):
    """The parts are one small file, which one task reads."""
    assert queries.QUERIES["edge_chunks"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_stay_out_of_the_join_of_near_duplicates(spark):
    """Their lengths are taken below it."""
    lines = queries.QUERIES["near_dup_keep"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda what: next(i for i, x in enumerate(lines) if what in x)
    assert at("LeftAnti") < at("length(text")


def test_paragraphs_hold_every_line(spark, duck):
    """Windows against a walk over all lines of each source, with the sizes that the query's windows show."""
    docs = duck.execute("select source, text from documents where text is not null order by source, doc_id").fetchall()
    lines = {}
    for source, text in docs:
        lines.setdefault(source, []).extend(text.split("\n"))
    got = {}
    for r in queries.QUERIES["random_paragraphs"](spark, SF).collect():
        got.setdefault(r.source, {})[r.window] = (r.n, r.n_chars)
    assert got.keys() == lines.keys()
    for source, want in lines.items():
        ks = spark.range(1, len(want) // 3 + 2).selectExpr(f"'{source}' source", "cast(id as int) k")
        draws = [r.d for r in ks.select("k", uniform(42, "source", F.col("k")).alias("d")).orderBy("k").collect()]
        at, expected = 0, {}
        for window, d in enumerate(draws):
            rows = want[at : at + 3 + int(d * 13)]
            at += len(rows)
            n_chars = len(" ".join(rows))
            if len(rows) >= 3 and 80 <= n_chars <= 400_000:
                expected[window] = (len(rows), n_chars)
        assert got[source] == expected and at == len(want)
