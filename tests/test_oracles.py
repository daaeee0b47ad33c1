"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).split('.')[0]} AS SELECT * FROM '{f}'")
    return c


def shown(rows):
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    answer = con.execute(ORACLE_SQL[name])
    asked = [d[0] for d in answer.description]
    assert sorted(asked) == names
    at = [asked.index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in answer.fetchall()]
    assert shown(tuple(r[n] for n in names) for r in got.collect()) == shown(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
