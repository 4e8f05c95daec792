"""Parsing of building attributes, the temporal predicate's truth table, overlays and stems on small planted cases."""

import pytest
from pyspark.sql import functions as F

from sylva.functions import shapes
from sylva.operators import buildings, polygons

BOX = [[(8.0, 8.0), (18.0, 8.0), (18.0, 18.0), (8.0, 18.0)]]
RINGS = "array<array<struct<x:double,y:double>>>"


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")


def test_number(spark):
    values = ["12 m", "10 ft", "3.5", " 7 m ", "-4", "1e3", "nan", "inf", "tall", "", None, "12m"]
    got = [r.v for r in texts(spark, values).select(buildings.number(F.col("t")).alias("v")).collect()]
    assert got == [12, pytest.approx(3.048), 3.5, 7, -4, 1000, None, None, None, None, None, 12]
    ok = texts(spark, ["12 m", "nan", None, "-inf"]).select(buildings.number(F.col("t"), strict=True).alias("v"))
    assert [r.v for r in ok.collect()] == [12, None, None, None]
    with pytest.raises(Exception, match="must be numeric"):
        texts(spark, ["tall"]).select(buildings.number(F.col("t"), strict=True)).collect()


def test_years(spark):
    got = texts(spark, ["1999", "2020-05", "2020-05-06", "1990.0", "~1990", "none", "", None, "19990"]).select(buildings.optional_year(F.col("t")).alias("v"))
    assert [r.v for r in got.collect()] == [1999, 2020, 2020, 1990, None, None, None, None, None]
    assert [r.v for r in texts(spark, ["1800", "2020-02-29", None]).select(buildings.year(F.col("t")).alias("v")).collect()] == [1800, 2020, None]
    for bad in ("1799", "2019-02-30", "x"):
        with pytest.raises(Exception, match="neither a year"):
            texts(spark, [bad]).select(buildings.year(F.col("t"))).collect()
    paths = texts(spark, ["/a/buildings_osm__2026-08-19__src.geojson", "/a__2020-01-01__/plain.geojson", "b__asof-2021-02-03__c"])
    assert [r.v for r in paths.select(buildings.snapshot_year(F.col("t")).alias("v")).collect()] == [2026, None, 2021]
    assert paths.select(buildings.snapshot_year(F.col("t"), F.lit(1990)).alias("v")).first().v == 1990
    assert buildings.observed([2020, 1700, 2018]) == ([2018, 2020], True) and buildings.observed([], [2001]) == ([2001], True) and buildings.observed([1700]) == ([], False)


def test_tags(spark):
    rows = [(1, "nan", '"height"=>"12 m","min_height"=> "3","start_date"=>"1990"'), (2, "8", '"height"=>"12 m"'), (3, None, '"name"=>"a \\"b\\"","end_date"=>"2025"'), (4, None, None)]
    df = spark.createDataFrame(rows, "fid int, height string, other_tags string").withColumn("snapshot_year", F.lit(2020))
    got = {r.fid: r for r in buildings.attributes(df).collect()}
    assert (got[1].roof, got[1].bottom, got[1].start) == (12, 3, 1990) and got[2].roof == 8 and got[3].end == 2025 and got[4].roof is None and got[4].bottom == 0
    assert df.select(buildings.tag(F.col("other_tags"), "name").alias("v")).collect()[2].v == 'a "b"'


@pytest.mark.parametrize(("start", "end", "snap", "lo", "hi", "state"), [
    (None, None, 2026, 2024, 2024, "active"), (None, None, 2026, 2023, 2023, "unknown"), ("2010", None, 2026, 2020, 2020, "active"), ("2010", "2025", None, 2020, 2024, "active"), ("2025", None, 2026, 2020, 2020, "absent"),
    (None, "2015", 2026, 2020, 2020, "absent"), ("2020", None, 2026, 2020, 2020, "unknown"), ("~1990", None, 2026, 2025, 2025, "unknown"), ("none", None, 2026, 2025, 2025, "active"), ("2010", None, None, 2020, 2020, "unknown"),
])
def test_temporal(spark, start, end, snap, lo, hi, state):
    row = spark.createDataFrame([(start, end, snap)], "construction_year string, demolition_year string, snapshot_year int")
    assert buildings.attributes(row.withColumns({c: F.lit(None).cast("string") for c in ("height", "min_height")})).select(buildings.temporal(lo, hi, 2).alias("s")).first().s == state


def pixels(spark, n=30, h=20.0):
    return spark.range(n * n).select((F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"), F.lit(h).alias("h"))


def test_overlay(spark):
    foot = spark.createDataFrame([(1, BOX, "active", 12.0, 0.0), (2, [[(1.0, 1.0), (4.0, 1.0), (1.0, 4.0)]], "active", None, 0.0), (3, [], "active", 9.0, 0.0)], f"fid int, rings {RINGS}, state string, roof double, bottom double")
    px = pixels(spark)
    assert polygons.excluded(px, foot, strict=True).count() == 100 + 6
    assert polygons.excluded(px, foot).count() == 0  # 20 m over a roof of 12 is overhang
    assert polygons.excluded(pixels(spark, h=14.0), foot).count() == 100
    assert polygons.excluded(pixels(spark, h=14.0), foot.withColumn("bottom", F.lit(15.0))).count() == 0
    assert polygons.excluded(pixels(spark, h=14.0), foot.withColumn("state", F.lit("unknown"))).count() == 0
    assert polygons.excluded(px.limit(0), foot).count() == polygons.excluded(px, foot.limit(0), strict=True).count() == 0
    hole = [BOX[0], [(11.0, 11.0), (15.0, 11.0), (15.0, 15.0), (11.0, 15.0)]]
    holed = spark.createDataFrame([(1, hole)], f"fid int, rings {RINGS}")
    assert polygons.touched(holed).count() == 100 - 16 and polygons.measured(holed).select(shapes.crossings(F.col("sides"), F.lit(13.0), F.lit(13.0)).alias("n")).first().n % 2 == 0
    with pytest.raises(Exception, match="valid nonempty"):
        polygons.validated(foot).collect()


def test_edges_belong(spark):
    foot = spark.createDataFrame([(1, BOX)], f"fid int, rings {RINGS}")
    points = spark.createDataFrame([(0, 8.0, 10.0), (1, 18.0, 18.0), (2, 13.0, 13.0), (3, 18.5, 13.0), (4, 7.999, 10.0), (5, None, 1.0)], "id int, x double, y double")
    assert {r.id for r in polygons.over_points(points, foot).collect()} == {0, 1, 2}
    assert {r.id for r in polygons.over_points(points, foot, edge=False).collect()} == {0, 2}


def stems(spark, crown, stem, state="active"):
    trees = spark.createDataFrame([(1, *stem, 20.0, 10.0)], "tree_id long, stem_x double, stem_y double, height_m double, ground_m double")
    label = spark.createDataFrame([(r, c, 1) for r, c in crown], "r int, c int, tree_id long")
    foot = spark.createDataFrame([(1, BOX, state, 12.0, 0.0)], f"fid int, rings {RINGS}, state string, roof double, bottom double")
    terrain = pixels(spark).select("r", "c", F.lit(12.0).alias("ground"))
    return polygons.constrained(trees, label, pixels(spark), foot, 2.0, terrain=terrain).first()


def test_stem_moves_or_goes(spark):
    crown = [(r, c) for r in range(8, 18) for c in range(8, 20)]
    moved = stems(spark, crown, (17.0, 13.0))
    assert moved.accepted and moved.status == 3 and 0 < moved.shift <= 2 and moved.stem_x > 18 and moved.building_height == 12 and (moved.height_m, moved.ground_m) == (18, 12)
    far = stems(spark, crown, (13.0, 13.0))
    assert not far.accepted and "shift limit" in far.reason and far.stem_x == 13
    none = stems(spark, [(r, c) for r, c in crown if c < 18], (13.0, 13.0))
    assert not none.accepted and "no same-crown support" in none.reason
    unsure = stems(spark, crown, (17.0, 13.0), "unknown")
    assert not unsure.accepted and "unresolved" in unsure.reason and unsure.status == 2
    clear = stems(spark, [(1, 1), (1, 2)], (1.5, 1.5))
    assert clear.accepted and clear.status == 0 and clear.shift == 0


def test_adjusted(spark):
    row = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 10.0, 20.0, 0.0, 8.0)], "stem_x double, stem_y double, top_x double, top_y double, ground_m double, height_m double, trunk_from_top_m double, slope_deg double")
    got = polygons.adjusted(row, F.lit(True), F.lit(3.0), F.lit(4.0), F.lit(12.0)).first()
    assert (got.trunk_from_top_m, got.height_m, got.slope_deg) == (5, 18, None)
    assert polygons.adjusted(row, F.lit(True), F.lit(3.0), F.lit(4.0), F.lit(None).cast("double")).first().height_m is None
    assert polygons.adjusted(row, F.lit(False), F.lit(3.0), F.lit(4.0), F.lit(12.0)).first() == row.first()
