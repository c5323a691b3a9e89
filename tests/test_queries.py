"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    found = plans.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    got = Counter(tuple(r) for r in found.select(*columns).collect())
    assert got
    if name in plans.ORACLE_SQL:
        cursor = sql.execute(plans.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        order = [names.index(c) for c in columns]
        want = Counter(tuple(r[i] for i in order) for r in cursor.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
