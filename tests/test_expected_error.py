"""The expected error of the reading that a cell's weight names."""

from pyspark.sql import functions as F

from sylva.operators import heights


def test_by_weight(spark):
    rows = [(1, 6.0, 0.4), (2, 6.0, 1.0), (3, 6.0, 0.0), (4, None, 0.5), (5, 6.0, None), (6, -1.0, 1.0), (7, 40.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, height double, weight double")
    tables = {"meta": [(2.0, 20.0), (5.0, 21.0)], "eth": [(0.0, 30.0), (35.0, 31.0)]}
    got = lambda *a: {r.id: r.e for r in df.select("id", heights.expected_error(F.col("height"), *a).alias("e")).collect()}
    assert got(F.col("weight"), tables) == {1: 3.2, 2: 21.0, 3: 30.0, 4: None, 5: None, 6: 20.0, 7: 31.0}
    assert got(F.col("weight")) == {1: 3.2, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert got() == {1: 3.2, 2: 3.2, 3: 3.2, 4: None, 5: 3.2, 6: 1.3, 7: 7.5}
