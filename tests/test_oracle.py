"""Every query against its SQL in DuckDB, at the size that ORACLE_SF names."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from sylva.plans import catalogue

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(catalogue.oracle_sql())


def plain(value):
    return f"{value + 0.0:.5f}" if isinstance(value, float) and not math.isnan(value) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in rel.fetchall())
    assert sorted(names) == columns
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_scores(spark):
    row = catalogue.queries()["tree_scores"](spark, SF).first()
    assert 0 < row.n_matched <= row.n_ref
