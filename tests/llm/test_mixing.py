from collections import Counter

import duckdb
import pytest

from graphloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy int, tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "tok " * (i % 9 + 1), "big" if i % 5 else "small", None, 3) for i in range(2000)]
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (None, "a b", None, None, 1), (5002, "", "void", None, 1), rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


def test_against_sql(spark, docs):
    documents = docs.toArrow()  # noqa: F841, read by the SQL
    want = Counter(duckdb.sql(mixing.SQL).fetchall())
    got = mixing.mixed(docs).selectExpr("doc_id", "source", "round(_rate, 9)", "_copy").collect()
    assert Counter(tuple(r) for r in got) == want


def test_weights_are_met(spark, docs):
    out = mixing.mixed(docs, {"big": 1.0, "small": 3.0}).withColumn("n", mixing.token_count("text")).groupBy("source").sum("n").collect()
    n = dict(out)
    assert set(n) == {"big", "small"} and abs(n["small"] / sum(n.values()) - 0.75) < 0.03


def test_copies_follow_rates(spark, docs):
    out = mixing.mixed(docs, {"big": 1.0, "small": 9.0})
    assert out.columns == [*docs.columns, "_rate", "_copy"]
    rates = {r.source: r.rate for r in mixing.source_rates(docs, {"big": 1.0, "small": 9.0}).collect()}
    assert rates[None] == 0 and rates["void"] == 0
    for (_, source), n in Counter((r.doc_id, r.source) for r in out.where("doc_id <> 0").collect()).items():
        assert n - int(rates[source]) in (0, 1)


def test_empty(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names_and_many_copies(spark):
    rows = [(1, "w " * 4000, "large", 0.5, None, "c", "s"), ("2", "w", "tiny", None, 1, None, None)]
    docs = spark.createDataFrame([tuple(r) for r in [(str(rows[0][0]), *rows[0][1:]), rows[1]]], "doc_id string, text string, source string, rate double, _rate int, _copy string, _source string")
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "__rate", "__copy"]
    got = out.collect()
    copies = sorted(r["__copy"] for r in got if r.doc_id == "2")
    assert copies == list(range(len(copies))) and 2000 <= len(copies) <= 2001 and {r._copy for r in got if r.doc_id == "1"} <= {"c"}
