"""Readers and writers: GeoJSON, curves by region, files that may be missing, pinned copies, rasters by tile, runs that replace or restore."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sylva.operators import heights, overlays
from sylva.sinks import rasters, runs
from sylva.sources import files, footprints, geojson, tables

POLYGON = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]], [[1, 0.5], [2, 0.5], [2, 1], [1, 0.5]]]}


def docs(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)], "id int, document string")


def test_boxes(spark):
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": POLYGON}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [-7.5, 1e1, 99]}}]}
    got = geojson.read(docs(spark, collection, {"type": "Feature", "geometry": POLYGON}, POLYGON, "no json", None, "")).orderBy("id").collect()
    assert tuple(got[0].box) == (-7.5, 0, 4, 10) and [len(r.polygons) for r in got] == [1, 1, 1, 0, 0, 0]
    assert tuple(got[1].box) == tuple(got[2].box) == (0, 0, 4, 3) and got[3].box.xmin is None


def test_features(spark):
    many = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"acq_date": "2020-05-06"}, "geometry": POLYGON}, {"type": "Feature", "properties": {"acq_date": "2019-01-01"}, "geometry": {"type": "MultiPolygon", "coordinates": [POLYGON["coordinates"], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}}]}
    got = geojson.dated(docs(spark, many)).orderBy("place").collect()
    assert [r.acq_date for r in got] == ["2020-05-06", "2019-01-01"] and [len(r.rings) for r in got] == [2, 3] and len(got[0].rings[0]) == 3
    px = spark.createDataFrame([(0, 2), (9, 9), (50, 50)], "r int, c int")
    from sylva.operators import polygons

    dates = {(r.r, r.c): r.date for r in polygons.dated(px, geojson.dated(docs(spark, many)).withColumn("tile", F.lit(0))).collect()}
    assert dates == {(0, 2): 20190101, (9, 9): 20190101, (50, 50): 0}  # the later polygon wins
    back = geojson.features(docs(spark, {"type": "FeatureCollection", "features": [json.loads(r.feature) for r in geojson.written(spark.createDataFrame([(1, float("nan"), got[0].rings)], f"id int, h double, rings {'array<array<struct<x:double,y:double>>>'}")).collect()]})).first()
    assert back.rings == got[0].rings and back.properties["id"] == "1" and back.properties["h"] is None


def test_reference_trees(spark):
    point = lambda x, y: {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [x, y]}}
    shape = {"type": "Feature", "properties": {}, "geometry": POLYGON}
    of = lambda *f: geojson.features(docs(spark, {"type": "FeatureCollection", "features": [*f, {"type": "Feature", "properties": {}, "geometry": None}]}))
    tops = geojson.reference_trees(of(point(0, 0), point(5, 5), point(6, 1)), 0, 0, 5, 5).collect()
    assert [(r.x, r.y, r.read_as) for r in tops] == [(0, 0, "tops"), (5, 5, "tops")]
    assert [r.read_as for r in geojson.reference_trees(of(shape), 0, 0, 5, 5).collect()] == ["crowns"]
    with pytest.raises(Exception, match="neither points alone"):
        geojson.reference_trees(of(shape, point(1, 1)), 0, 0, 5, 5).collect()


def test_curves(spark, tmp_path):
    lines = ["kind,region,model,x_m,y"] + [f"{k},{r},{m},{x},{y}" for r in ("pooled", "north") for k, m in (("calibrated", "meta_v1"), ("calibrated", "eth"), ("matched", "meta_v1"), ("weight", "meta_v1")) for x, y in ((10, 3 if r == "north" else 2), (0, 1))]
    (tmp_path / "curves.csv").write_text("\n".join(lines))
    rows = tables.curves(spark, f"file://{tmp_path}/curves.csv")
    assert tables.table(rows, "north")["meta"] == [(0, 1), (10, 3)] and tables.table(rows)["weight"] == [(0, 1), (10, 2)]
    with pytest.raises(ValueError, match="south"):
        tables.table(rows, "south")
    head = "region,fit,reading,frame,band_m,n,mae,rmse,bias,median\n"
    own = "all,{0},blend,by_value,0-5,9,{1},1,1,1\nall,{0},eth calibrated,by_value,2-5,9,7,1,1,1\nall,{0},meta_v1 calibrated,by_value,0-9,9,8,1,1,1\nsite,{0},blend,by_value,0-5,9,99,1,1,1\n"
    (tmp_path / "both.csv").write_text(head + own.format("pooled", 1) + own.format("unseen", 2))
    (tmp_path / "one.csv").write_text(head + own.format("pooled", 1))
    assert tables.errors(tables.accuracy(spark, f"file://{tmp_path}/both.csv"))["blend"] == [(0, 2)]
    table = tables.errors(tables.accuracy(spark, f"file://{tmp_path}/one.csv"))
    cells = spark.createDataFrame([(3.0, 0.5), (3.0, 1.0), (1.0, 0.0), (None, 0.5), (3.0, None)], "h double, w double")
    assert [r.e for r in cells.select(heights.expected_error(F.col("h"), F.col("w"), table).alias("e")).collect()] == [1, 8, 7, None, None]


def test_recent_needs_dates(spark):
    cells = spark.createDataFrame([(1, 10.0, 20.0)], "cell_id long, top double, eth_m double")
    assert heights.applied(cells).first().height is not None
    with pytest.raises(ValueError, match="dates"):
        heights.applied(cells, recent=True)


def test_missing_and_kept(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    assert files.existing(spark, [f"file://{tmp_path}/a.bin", f"file://{tmp_path}/b.bin"]) == [f"file://{tmp_path}/a.bin"]
    calls = []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return b"\x00\xff data"

    assert files.tried(read, wait=0) == b"\x00\xff data" and len(calls) == 3
    assert files.tried(lambda: open(tmp_path / "none", "rb").read(), wait=0) is None
    with pytest.raises(OSError, match="down"):
        files.tried(lambda: (_ for _ in ()).throw(OSError("down")), wait=0)
    cache = f"file://{tmp_path}/cache"
    assert files.kept(spark, "https://host/x/y.bin", cache, lambda: b"\x01\xfe") == (b"\x01\xfe", False)
    assert files.kept(spark, "https://host/x/y.bin", cache, lambda: b"other") == (b"\x01\xfe", True)
    assert files.kept(spark, "https://host/none", cache, lambda: None) == (None, False)


def test_manifest(spark):
    extents = [[0, 0, 1, 1], [1, 0, 2, 1], [3, 0, 4, 1]]
    manifest = spark.createDataFrame([(f"s3://r/{i}.parquet", [float(x) for x in b]) for i, b in enumerate(extents)], "href string, bbox array<double>")
    assert footprints.files(manifest, 3, "s3://r/", 0.5, 0, 1, 1.5) == ["s3://r/0.parquet", "s3://r/1.parquet"]
    for count, prefix in ((4, "s3://r/"), (3, "s3://other/")):
        with pytest.raises(ValueError, match="incomplete"):
            footprints.files(manifest, count, prefix, 0, 0, 1, 1)


def test_pinned(spark, tmp_path):
    calls = []

    def fetch(bounds):
        calls.append(bounds)
        return "2026-01-01.0", spark.range(5)

    folder = str(tmp_path)
    assert footprints.pinned(spark, folder, (0, 0, 1, 1), fetch).count() == footprints.pinned(spark, folder, (0, 0, 1.0000000001, 1), fetch).count() == 5
    assert len(calls) == 1
    with pytest.raises(ValueError, match="another area"):
        footprints.pinned(spark, folder, (0, 0, 2, 1), fetch)
    spark.range(6).write.mode("overwrite").parquet(f"{folder}/buildings__2026-01-01__src.parquet")
    with pytest.raises(ValueError, match="changed"):
        footprints.pinned(spark, folder, (0, 0, 1, 1), fetch)


def test_raster_tables(spark, tmp_path):
    px = spark.range(400).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("h"))
    rasters.write(px, f"file://{tmp_path}/out", ["h"], side=8)
    assert sorted(os.listdir(tmp_path / "out")) == ["pixels", "statistics"] and len([d for d in os.listdir(tmp_path / "out/pixels") if d.startswith("tile=")]) == 9
    assert rasters.read(spark, f"file://{tmp_path}/out").drop("tile").exceptAll(px).isEmpty()
    told = spark.read.parquet(f"file://{tmp_path}/out/statistics").first()
    assert (told.band, told.min, told.max, told.n) == ("h", 1, 398 if 398 % 7 else 397, 400 - 58)
    assert overlays.halvings(4096, 100) == [2, 4, 8, 16] and overlays.halvings(255, 255) == [] and overlays.halvings(512, 512) == [2]
    assert rasters.statistics(px.limit(0)).first().n == 0


def test_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name in ("a", "b", "foreign"):
        (tmp_path / name).write_text("old")
    with runs.replaced(spark, folder, ["a", "b", "c"]) as staged:
        for name in ("a", "c"):
            open(f"{staged.removeprefix('file://')}/{name}", "w").write("new")
    have = lambda: {n: (tmp_path / n).read_text() for n in sorted(os.listdir(tmp_path)) if not n.endswith(".crc")}
    assert have() == {"a": "new", "c": "new", "foreign": "old"}
    with pytest.raises(RuntimeError), runs.replaced(spark, folder, ["a", "c"]) as staged:
        open(f"{staged.removeprefix('file://')}/a", "w").write("newer")
        raise RuntimeError
    assert have() == {"a": "new", "c": "new", "foreign": "old"}


def test_documents(spark, tmp_path):
    runs.document(spark, f"file://{tmp_path}", "report.json", {"grid": {"cell": 10}, "found": spark.range(1).select(F.lit(3).alias("trees"), F.lit(None).cast("int").alias("x")), "bands": spark.range(2)})
    assert json.loads((tmp_path / "report.json").read_text()) == {"grid": {"cell": 10}, "found": {"trees": 3, "x": None}, "bands": [{"id": 0}, {"id": 1}]}
    runs.readme(spark, f"file://{tmp_path}", "Run", {"trees": 3})
    assert "| trees | 3 |" in (tmp_path / "README.md").read_text()


def test_mosaic_years(spark):
    tiles = spark.createDataFrame([("a", 1.0, [2020]), ("a", 1.0, [2023, 2020])], "crs string, pixel double, years array<int>")
    assert tuple(overlays.mosaic_years(tiles).first()) == ([2020, 2023], True)
    assert overlays.mosaic_years(tiles.union(spark.createDataFrame([("a", 1.0, [])], tiles.schema))).first().complete is False
    with pytest.raises(Exception, match="share a CRS"):
        overlays.mosaic_years(tiles.union(spark.createDataFrame([("b", 1.0, [])], tiles.schema))).collect()


def las_file(path, points, kind=1, version=(1, 2)):
    """A LAS file of (x, y, z, class, return) with a scale of 0.01."""
    import struct

    head, stride = bytearray(375), {1: 28, 6: 30}[kind]
    head[:4], head[24], head[25], head[104] = b"LASF", *version, kind
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<HI", head, 105, stride, len(points) if version < (1, 4) else 0)
    firsts = sum(p[4] == 1 for p in points)
    struct.pack_into("<5I", head, 111, *((firsts if version < (1, 4) else 0), 0, 0, 0, 0))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    xs, ys, zs = zip(*[p[:3] for p in points], strict=True)
    struct.pack_into("<6d", head, 179, max(xs), min(xs), max(ys), min(ys), max(zs), min(zs))
    struct.pack_into("<2Q", head, 247, len(points), firsts)
    body = bytearray()
    for x, y, z, c, n in points:
        body += struct.pack("<3iH", round((x - 100) * 100), round((y - 200) * 100), round(z * 100), 7)
        body += (bytes([n | 0x40, c | 0x60]) if kind < 6 else bytes([n | 0x20, 0, c])).ljust(stride - 14, b"\0")
    path.write_bytes(bytes(head) + bytes(body))


@pytest.mark.parametrize(("kind", "version"), [(1, (1, 2)), (6, (1, 4))])
def test_las(spark, tmp_path, kind, version):
    from sylva.sources import las

    points = [(100 + i * 0.5, 200 + i % 7, i / 4, 2 if i % 3 else 5, 1 + i % 2) for i in range(1000)]
    las_file(tmp_path / "a.las", points, kind, version)
    uri = f"file://{tmp_path}/a.las"
    got = las.read(spark, [uri, uri], block=300).collect()
    assert sorted((round(r.x, 2), round(r.y, 2), round(r.z, 2), r.classification, r.return_number) for r in got) == sorted([(round(x, 2), y, z, c, n) for x, y, z, c, n in points] * 2)
    h = las.header(uri)
    assert (h.points, h.first_returns) == (1000, 500) and las.density([h]) == pytest.approx(500 / (499.5 * 6))
    (tmp_path / "b.las").write_bytes(b"no")
    with pytest.raises(ValueError, match="no LAS"):
        las.header(f"file://{tmp_path}/b.las")
    assert las.read(spark, []).isEmpty()


def test_ground(spark):
    import numpy as np

    from sylva.operators import terrain

    rng = np.random.default_rng(2)
    at = np.indices((60, 50)).astype(float)
    plane = 100 + 0.3 * at[0] - 0.2 * at[1]
    known = rng.random(plane.shape) < 0.4
    known[[0, -1], :] = known[:, [0, -1]] = True
    assert np.allclose(terrain.filled(np.where(known, plane, np.nan)), plane)
    assert np.isnan(terrain.filled(np.full((3, 3), np.nan))).all()
    cells = spark.createDataFrame([(int(r), int(c), float(plane[r, c])) for r, c in zip(*np.nonzero(known), strict=True)], "r int, c int, z double")
    wanted = spark.createDataFrame([(r, c) for r in range(60) for c in range(50)] + [(4000, 4000)], "r int, c int")
    got = {(r.r, r.c): r.z for r in terrain.ground(cells, wanted, block=16, margin=60).collect()}
    assert got.pop((4000, 4000)) is None and all(abs(z - plane[r, c]) < 1e-9 for (r, c), z in got.items()) and len(got) == 3000
    points = spark.createDataFrame([(0.5, 0.5, 3.0, 2), (0.6, 0.1, 5.0, 2), (0.5, 0.5, 30.0, 5)], "x double, y double, z double, classification int")
    assert [tuple(r) for r in terrain.ground_cells(points).collect()] == [(0, 0, 4.0)]
