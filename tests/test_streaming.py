"""A stream of points gives the cells that one batch over all of them gives."""

import random

from pyspark.sql import functions as F

from sylva.streaming import points


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.uniform(-5, 5), rng.uniform(0, 4), rng.uniform(0, 30), rng.choice([1, 2, 6, None]), rng.randint(1, 3)) for _ in range(500)]
    rows += [(None, 1.0, 99.0, 1, 1), (0.5, 0.5, None, 2, None)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], points.POINTS).write.parquet(str(tmp_path / "in"), mode="append")
    query = points.cells(points.arriving(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("cells_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    shown = lambda df: sorted(map(str, df.select("r", "c", "top", F.round("ground", 9), "n", "first_returns").collect()))
    got = shown(spark.table("cells_now"))
    assert got and got == shown(points.cells(spark.createDataFrame(rows, points.POINTS)))
