"""Derived views cover their whole tables, at a size above the smallest."""

import os
from collections import Counter

import duckdb
import pytest
from test_oracle import plain

from sylva.plans import catalogue
from sylva.sources.views import view

SF = "/root/testdata/sf0.01"


def test_date_cells_whole(spark):
    """Each cell's date is the latest of all its orders."""
    want = dict(duckdb.sql(f"SELECT o_orderkey % 400, max((year(o_orderdate)+20)*10000 + month(o_orderdate)*100 + day(o_orderdate)) FROM '{SF}/orders.parquet' GROUP BY 1").fetchall())
    got = {r.cell_id: r.meta_date for r in view(spark, SF, "date_cells").collect()}
    assert got == {c: d for c, d in want.items() if c % 13}


@pytest.mark.parametrize("name", ["provenance", "most_recent_height", "image_days"])
def test_dates_at_next_size(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = catalogue.queries()[name](spark, SF)
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in rel.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
