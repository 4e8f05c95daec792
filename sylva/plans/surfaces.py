"""Queries over tile lists, grids, planes, terrain, reports and sources, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves, projection, tiles
from ..operators import heights, overlays, polygons, rasters, regions, reports
from ..sources import footprints as footprint_files
from ..sources import geojson, tables
from ..sources.views import view
from .catalogue import CELLS, CLIMB, ERROR, EXPECTED, PLACED, PROVENANCE, cells, durable, query, rounded
from .geometry import outlined

BOXES = PLACED + ", boxes AS (SELECT id, lon AS w, lat AS s, least(lon + 0.3e0*(id % 17), 179) AS e, lat + 0.2e0*(id % 13) AS n FROM placed)"


def boxes(spark, sf_dir):
    own = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919 % 3600).cast("double") / 10 - 180).alias("w"), ((F.col("c_custkey") * 104729 % 1600).cast("double") / 10 - 80).alias("s"))
    return own.select("id", "w", "s", F.least(F.col("w") + F.lit(0.3) * (F.col("id") % 17), F.lit(179.0)).alias("e"), (F.col("s") + F.lit(0.2) * (F.col("id") % 13)).alias("n"))


NAMED = "concat(CASE WHEN la < 0 THEN 'S' ELSE 'N' END, lpad(CAST(abs(la) AS VARCHAR), 2, '0'), CASE WHEN lo < 0 THEN 'W' ELSE 'E' END, lpad(CAST(abs(lo) AS VARCHAR), 3, '0'))"


@query(f"WITH {BOXES}, la AS (SELECT id, w, e, unnest(range(CAST(floor(s/3)*3 AS BIGINT), CAST(ceil(n/3)*3 AS BIGINT), 3)) AS la FROM boxes), lo AS (SELECT id, la, unnest(range(CAST(floor(w/3)*3 AS BIGINT), CAST(ceil(e/3)*3 AS BIGINT), 3)) AS lo FROM la) SELECT id, {NAMED} AS tile FROM lo")
def degree_tile_lists(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("id", F.explode(tiles.degree_tiles(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 3)).alias("tile"))


@query(f"WITH {BOXES}, la AS (SELECT id, w, e, unnest(range(CAST(floor(s) AS BIGINT), CAST(floor(n) AS BIGINT) + 1)) AS la FROM boxes), lo AS (SELECT id, la, unnest(range(CAST(floor(w) AS BIGINT), CAST(floor(e) AS BIGINT) + 1)) AS lo FROM la) SELECT id, {NAMED} AS tile FROM lo")
def terrain_tile_lists(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("id", F.explode(tiles.degree_tiles(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 1, closed=True)).alias("tile"))


SLIPPY = "CAST(greatest(0, least(511, floor(({0}+180)/360*512))) AS BIGINT)", "CAST(greatest(0, least(511, floor((1 - asinh(tan(radians({0})))/pi())/2*512))) AS BIGINT)"
DIGITS = "array_to_string(list_transform(range(8, -1, -1), lambda i: CAST(((tx >> i) & 1) + 2*((ty >> i) & 1) AS VARCHAR)), '')"


@query(f"WITH {BOXES}, ys AS (SELECT id, w, e, unnest(range({SLIPPY[1].format('n')}, {SLIPPY[1].format('s')} + 1)) AS ty FROM boxes), xs AS (SELECT id, ty, unnest(range({SLIPPY[0].format('w')}, {SLIPPY[0].format('e')} + 1)) AS tx FROM ys) SELECT id, {DIGITS} AS quadkey FROM xs")
def quadkey_lists(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("id", F.explode(tiles.quadkeys(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 9)).alias("quadkey"))


SHARES = ", ".join(f"({t!r}e0, {s!r}e0)" for t, s in projection.box_edge_points())
EAST, NORTH = projection.utm_sql("lon", "lat", "zone")


@query(f"""WITH {BOXES}, zoned AS (SELECT *, CAST(floor(((w + e)/2 + 180) % 360 / 6) AS INT) + 1 AS zone FROM boxes WHERE n > s AND e > w AND (s > 0 OR n < 0)), edge AS (SELECT id, zone, w + (e - w)*t AS lon, s + (n - s)*u AS lat FROM zoned CROSS JOIN (VALUES {SHARES}) AS v(t, u)),
box AS (SELECT id, zone, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT id, zone, {EAST} AS x, {NORTH} AS y FROM edge) GROUP BY id, zone)
SELECT id, CAST(CASE WHEN (s + n)/2 >= 0 THEN 32600 ELSE 32700 END + zone AS INT) AS epsg, CAST(floor(x0/10)*10 AS DOUBLE) AS "left", CAST(ceil(y1/10)*10 AS DOUBLE) AS top, CAST(ceil((ceil(y1/10)*10 - y0)/10) AS INT) AS height, CAST(ceil((x1 - floor(x0/10)*10)/10) AS INT) AS width FROM box JOIN zoned USING (id, zone)""")
def utm_grids(spark, sf_dir):
    b = boxes(spark, sf_dir).where("n > s and e > w and (s > 0 or n < 0)").withColumn("zone", projection.zone(F.col("w"), F.col("e")))
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("u")) for t, s in projection.box_edge_points()])).alias("p")
    edge = b.select("id", "zone", "w", "s", "e", "n", at)
    x, y = projection.utm(F.col("w") + (F.col("e") - F.col("w")) * F.col("p.t"), F.col("s") + (F.col("n") - F.col("s")) * F.col("p.u"), F.col("zone"))
    box = edge.select("id", "zone", "s", "n", x.alias("x"), y.alias("y")).groupBy("id", "zone", "s", "n").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    grid = projection.snapped(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return box.select("id", (F.when((F.col("s") + F.col("n")) / 2 >= 0, 32600).otherwise(32700) + F.col("zone")).cast("int").alias("epsg"), *[v.alias(n) for n, v in grid.items()])


@query("SELECT x, y, CAST(floor((150 - y)/2.5) AS INT) AS r, CAST(floor((x - 20)/2.5) AS INT) AS c, floor((150 - y)/2.5) BETWEEN 0 AND 39 AND floor((x - 20)/2.5) BETWEEN 0 AND 47 AS inside FROM found_trees")
def cells_of_points(spark, sf_dir):
    r, c, inside = projection.to_cell(F.col("x"), F.col("y"), 20.0, 150.0, 2.5, 40, 48)
    return view(spark, sf_dir, "found_trees").select("x", "y", r.alias("r"), c.alias("c"), inside.alias("inside"))


@query("SELECT round(first/area, 6) AS density, CASE WHEN first/area >= 40 THEN 0.25e0 WHEN first/area >= 6 THEN 0.5e0 ELSE 1e0 END AS pixel, n FROM (SELECT count(*) FILTER (return_number = 1) AS first, count(*) AS n, (max(x) - min(x))*(max(y) - min(y)) AS area FROM points)")
def point_density(spark, sf_dir):
    own = view(spark, sf_dir, "points").agg(F.count_if(F.col("return_number") == 1).alias("first"), F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    density = F.col("first") / F.col("area")
    return own.select(F.round(density, 6).alias("density"), tiles.pixel_for(density).alias("pixel"), "n")


COARSE = "coarse AS (SELECT CAST(floor(cell_id/across) AS INT) AS r, CAST(cell_id % across AS INT) AS c, CASE WHEN eth_m > 45 THEN 255 ELSE eth_m END AS h FROM eth_cells CROSS JOIN area)"
SPOTS = "spots AS (SELECT ref_id AS id, x/10 AS x, y/10 AS y FROM ref_trees)"


def bilinear_sql(source: str, where: str = "true") -> str:
    return f"""SELECT id, sum(w*h)/sum(w) AS h FROM (SELECT id, CAST(floor(y - 0.5) + a AS INT) AS r, CAST(floor(x - 0.5) + b AS INT) AS c, (CASE WHEN a = 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END)*(CASE WHEN b = 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END) AS w
FROM spots CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) AS k(a, b)) JOIN {source} USING (r, c) WHERE w > 0 AND h <> 255 AND {where} GROUP BY id"""


@query(f"WITH {COARSE}, {SPOTS}, one AS ({bilinear_sql('coarse', 'c < 12')}), two AS ({bilinear_sql('coarse', 'c >= 10')}) SELECT id, round(coalesce(two.h, one.h), 6) AS h FROM spots LEFT JOIN one USING (id) LEFT JOIN two USING (id)")
def overlaid_maps(spark, sf_dir):
    across = view(spark, sf_dir, "area").select("across")
    coarse = view(spark, sf_dir, "eth_cells").join(F.broadcast(across)).select(F.floor(F.col("cell_id") / F.col("across")).cast("int").alias("r"), (F.col("cell_id") % F.col("across")).cast("int").alias("c"), F.when(F.col("eth_m") > 45, 255.0).otherwise(F.col("eth_m")).alias("h"))  # one row
    at = view(spark, sf_dir, "ref_trees").select(F.col("ref_id").alias("id"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    parts = [overlays.warped(coarse.where(cut), at, 255.0).withColumn("tile", F.lit(i)) for i, cut in enumerate(("c < 12", "c >= 10"))]
    return rounded(overlays.overlaid(parts[0].unionByName(parts[1])), "h")


@query("""WITH size AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM canopy), spots AS (SELECT ref_id AS id, least(greatest(x*1.1 - 5 - 0.5, c0), c1) AS x, least(greatest(y*1.1 - 5 - 0.5, r0), r1) AS y FROM ref_trees CROSS JOIN size),
k AS (SELECT id, CAST(floor(y) + a AS INT) AS r, CAST(floor(x) + b AS INT) AS c, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END)*(CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM spots CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) AS k(a, b))
SELECT id, round(h, 6) AS h FROM spots LEFT JOIN (SELECT id, sum(w*h)/sum(w) AS h FROM k JOIN canopy USING (r, c) WHERE w > 0 GROUP BY id) USING (id)""")
def clamped_samples(spark, sf_dir):
    at = view(spark, sf_dir, "ref_trees").select(F.col("ref_id").alias("id"), (F.col("x") * F.lit(1.1) - 5).alias("x"), (F.col("y") * F.lit(1.1) - 5).alias("y"))
    return rounded(overlays.warped(view(spark, sf_dir, "canopy"), at, clamp=True), "h")


@query("SELECT r, c, CASE WHEN h <> 7 THEN greatest(h - 10, 0) END AS h FROM canopy")
def cleaned_canopy(spark, sf_dir):
    px = view(spark, sf_dir, "canopy").withColumn("h", F.when(F.col("h") == 7, float("nan")).when(F.col("h") == 1, float("-inf")).otherwise(F.col("h") - 10))
    return overlays.cleaned(px.withColumn("h", F.when(F.col("h") == float("-inf"), F.lit(-9.0)).otherwise(F.col("h"))))


@query("SELECT r, c, h FROM canopy WHERE r BETWEEN 12 AND 57 AND c BETWEEN 30 AND 80")
def windowed_pixels(spark, sf_dir):
    return overlays.window(view(spark, sf_dir, "canopy"), 12.4, 30.0, 57.2, 81.0)


TERRAIN = "bare AS (SELECT r, c, z FROM ground WHERE c < 120), surface AS (SELECT r, c, z + 3 AS z FROM ground WHERE c >= 60), terrain AS (SELECT r, c, coalesce((a.z + b.z)/2, a.z, b.z) AS z FROM bare a FULL JOIN surface b USING (r, c))"


def terrain(spark, sf_dir):
    z = view(spark, sf_dir, "ground")
    return overlays.terrain_mean(z.where("c < 120"), z.where("c >= 60").withColumn("z", F.col("z") + 3))


@query(f"WITH {TERRAIN} SELECT r, c, round(z, 6) AS z FROM terrain")
def terrain_mean(spark, sf_dir):
    return rounded(terrain(spark, sf_dir), "z")


@query(f"WITH {TERRAIN} SELECT r, c, round(CASE WHEN z IS NOT NULL THEN greatest(h + 90 - z, 0) END, 6) AS h FROM canopy LEFT JOIN terrain USING (r, c)")
def height_above_ground(spark, sf_dir):
    tops = view(spark, sf_dir, "canopy").withColumn("h", F.col("h") + 90)
    return rounded(overlays.above_ground(tops, terrain(spark, sf_dir)), "h")


@query("""WITH tops AS (SELECT DISTINCT CAST(floor(y) AS INT) AS r, CAST(floor(x) AS INT) AS c FROM found_trees), n AS (SELECT t.r, t.c, max(p.h) FILTER (p.r = t.r - 1) AS u, max(p.h) FILTER (p.r = t.r + 1) AS d, max(p.h) FILTER (p.c = t.c - 1) AS l, max(p.h) FILTER (p.c = t.c + 1) AS g, max(p.h) FILTER (p.r = t.r AND p.c = t.c) AS m
FROM tops t LEFT JOIN (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM canopy) p ON p.r = t.r + CASE k WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AND p.c = t.c + CASE k WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END GROUP BY t.r, t.c)
SELECT r, c, round(CASE WHEN u - 2*m + d < 0 THEN greatest(-0.49, least(0.49, (u - d)/(2*(u - 2*m + d)))) ELSE 0 END, 6) AS dy, round(CASE WHEN l - 2*m + g < 0 THEN greatest(-0.49, least(0.49, (l - g)/(2*(l - 2*m + g)))) ELSE 0 END, 6) AS dx FROM n""")
def summit_shifts(spark, sf_dir):
    tops = view(spark, sf_dir, "found_trees").select(F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c")).distinct()
    return rounded(overlays.summits(view(spark, sf_dir, "canopy"), tops), "dy", "dx")


@query("SELECT tile, min(h) AS min, max(h) AS max, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std, count(h) AS n FROM (SELECT CAST(CAST(floor(r/64) AS INT) AS VARCHAR) || '_' || CAST(CAST(floor(c/64) AS INT) AS VARCHAR) AS tile, h FROM canopy) GROUP BY tile")
def tile_statistics(spark, sf_dir):
    from ..sinks import rasters

    return rounded(rasters.statistics(rasters.tiled(view(spark, sf_dir, "canopy"), 64), "tile"), "mean", "std")


@query("SELECT CAST(floor(r/4) AS INT) AS r, CAST(floor(c/4) AS INT) AS c, h FROM canopy WHERE r % 4 = 2 AND c % 4 = 2")
def code_overview(spark, sf_dir):
    return overlays.thinned(view(spark, sf_dir, "canopy"), 2)


DATED = f"{CELLS}, src AS ({PROVENANCE} FROM cells), rows_ AS (SELECT source, flags, coalesce(meta_date, 0) AS date FROM src JOIN cells USING (cell_id)), n AS (SELECT greatest(count(*) FILTER (source > 0), 1) AS n, greatest(count(*) FILTER (source IN (1, 3)), 1) AS m FROM rows_)"
TOLD = " UNION ALL ".join([f"SELECT 'source' AS kind, '{name}' AS name, round_even(count(*) FILTER (source = {code})/max(n), 4) AS share FROM rows_, n" for name, code in (("both", 3), ("meta_alone", 1), ("eth_alone", 2))] + [f"SELECT 'flags', '{name}', round_even(count(*) FILTER (flags & {bit} > 0)/max(n), 4) FROM rows_, n" for name, bit in (("meta_above_table", 1), ("eth_above_table", 2), ("apart", 4))] + ["SELECT 'undated', 'meta_cells_undated', round_even(count(*) FILTER (source IN (1, 3) AND date = 0)/max(m), 4) FROM rows_, n", "SELECT 'date', concat(CAST(date//10000 AS VARCHAR), '-', lpad(CAST(date//100%100 AS VARCHAR), 2, '0'), '-', lpad(CAST(date%100 AS VARCHAR), 2, '0')), round_even(count(*)/max(m), 4) FROM rows_, n WHERE source IN (1, 3) AND date > 0 GROUP BY date"])


@query(f"WITH {DATED} {TOLD}")
def provenance_shares(spark, sf_dir):
    own = cells(spark, sf_dir)
    return reports.told(heights.provenance(own).join(own.select("cell_id", F.coalesce("meta_date", F.lit(0)).alias("date")), "cell_id"))


@query(f"""WITH {CELLS} SELECT round(count(*) FILTER (height >= 2 AND NOT coalesce(top > 0, false))/greatest(count(height), 1), 6) AS left_as_read, round(avg(coalesce(top > {curves.META[-1][0]}, false)::INT), 6) AS beyond_meta, round(avg(coalesce(eth_m > {curves.ETH[-1][0]}, false)::INT), 6) AS beyond_eth,
round(avg((eth_m IS NOT NULL)::INT), 6) AS eth_read, round(avg((top IS NOT NULL)::INT), 6) AS meta_read, round(avg({ERROR}), 6) AS expected_mae FROM cells""")
def run_shares(spark, sf_dir):
    own = cells(spark, sf_dir).withColumn("error", heights.expected_error(F.col("height")))
    out = reports.run_shares(own)
    return rounded(out, *out.columns)


RATED = "rated AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'unseen' ELSE 'pooled' END AS fit, CASE WHEN p_partkey % 5 = 0 THEN 'site' ELSE 'all' END AS region, CASE p_partkey % 2 WHEN 0 THEN 'blend' ELSE 'eth' END AS reading, CASE WHEN p_partkey % 7 < 4 THEN 'by_value' ELSE 'by_lidar' END AS frame, concat(CAST(p_size AS VARCHAR), '-', CAST(p_size + 3 AS VARCHAR)) AS band_m, p_partkey AS n, p_partkey/8e0 AS mae FROM part)"


@query(f"WITH {RATED}, own AS (SELECT *, bool_or(fit = 'unseen') OVER () AS any_unseen FROM rated WHERE region = 'all'), rows_ AS (SELECT band_m, CAST(split_part(band_m, '-', 1) AS DOUBLE) AS lo, CAST(split_part(band_m, '-', 2) AS DOUBLE) AS hi, n, mae FROM own WHERE fit = CASE WHEN any_unseen THEN 'unseen' ELSE 'pooled' END AND reading = 'blend' AND frame = 'by_value') SELECT band_m, lo, hi, n, mae, (SELECT min(lo) FROM rows_ b WHERE b.lo > a.lo) AS next_lo FROM (SELECT band_m, lo, hi, max(n) AS n, max(mae) AS mae FROM rows_ GROUP BY ALL) a")
def accuracy_by_band(spark, sf_dir):
    p = F.col("p_partkey")
    rated = view(spark, sf_dir, "part").select(F.when(p % 3 == 0, "unseen").otherwise("pooled").alias("fit"), F.when(p % 5 == 0, "site").otherwise("all").alias("region"), F.when(p % 2 == 0, "blend").otherwise("eth").alias("reading"), F.when(p % 7 < 4, "by_value").otherwise("by_lidar").alias("frame"), F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 3).cast("string")).alias("band_m"), p.alias("n"), (p / F.lit(8.0)).alias("mae"))
    best = tables.preferred(rated).groupBy("reading", "frame", "band_m").agg(F.max("n").alias("n"), F.max("mae").alias("mae"))
    return reports.band_rows(best, "blend", "by_value")


KNOTS = "knots AS (SELECT * FROM (VALUES " + ", ".join(f"({x!r}e0, {y!r}e0)" for x, y in curves.META) + ") AS v(x_m, y)), segments AS (SELECT x_m, y, lead(x_m) OVER (ORDER BY x_m) AS x1, lead(y) OVER (ORDER BY x_m) AS y1 FROM knots)"


@query(f"WITH {KNOTS} SELECT r, c, round(CASE WHEN s.x_m IS NULL THEN (SELECT arg_min(y, x_m) FROM knots) WHEN x1 IS NULL THEN y + (h - x_m) ELSE y + (h - x_m)*((y1 - y)/(x1 - x_m)) END, 6) AS h FROM canopy ASOF LEFT JOIN segments s ON h >= s.x_m")
def curve_from_table(spark, sf_dir):
    rows = spark.createDataFrame([("calibrated", "pooled", "meta_v1", x, y) for x, y in curves.META], "kind string, region string, model string, x_m double, y double")
    curve = tables.curve(rows, "calibrated", "pooled", "meta_v1")
    return view(spark, sf_dir, "canopy").select("r", "c", F.round(curves.lookup(F.col("h"), curve), 6).alias("h"))


FINE = f"{CELLS}, px AS (SELECT cell_id, v*1.1 AS v, CASE WHEN v > 48 THEN 160 WHEN v = 3 THEN NULL ELSE v - 0.5 END AS truth FROM fine_px), factors AS (SELECT cell_id, CASE WHEN coalesce(top > 0, false) THEN height/greatest(top, 1e-6) ELSE 1e0 END AS factor FROM cells), level AS (SELECT cell_id, avg(v) AS flat FROM px GROUP BY 1 HAVING count(*) >= {EXPECTED / 2}e0), used AS (SELECT greatest(truth, 0) AS t, v, factor, flat, cell_id FROM px JOIN level USING (cell_id) JOIN factors USING (cell_id) WHERE truth > -1 AND truth < 150 AND factor > 0)"


def fine_pixels(spark, sf_dir):
    px = view(spark, sf_dir, "fine_px").select("cell_id", (F.col("v") * F.lit(1.1)).alias("v"), F.when(F.col("v") > 48, 160.0).when(F.col("v") != 3, F.col("v") - F.lit(0.5)).alias("truth"))
    own = cells(spark, sf_dir)
    return px, own.select("cell_id", heights.fine_factor(F.col("height"), F.col("top")).alias("factor"))


@query(f"WITH {FINE}, e AS (SELECT {curves.band_sql('t')} AS band, 'crowns' AS reading, v - t AS e FROM used UNION ALL SELECT {curves.band_sql('t')}, 'as_read', v/factor - t FROM used UNION ALL SELECT {curves.band_sql('t')}, 'flat', flat - t FROM used) SELECT reading, band, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS bias FROM e GROUP BY GROUPING SETS ((reading), (reading, band)) HAVING band IS NULL OR count(*) >= 50")
def fine_accuracy(spark, sf_dir):
    return rounded(reports.fine_errors(*fine_pixels(spark, sf_dir), EXPECTED), "mae", "rmse", "bias")


@query(f"WITH {FINE}, m AS (SELECT avg(v) - avg(t) AS crowns, avg(v/factor) - avg(t) AS as_read FROM (SELECT greatest(truth, 0) AS t, v, factor, cell_id FROM px JOIN factors USING (cell_id) WHERE truth > -1 AND truth < 150 AND factor > 0) GROUP BY cell_id HAVING count(*) >= {EXPECTED / 2}e0) SELECT reading, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS bias FROM (SELECT 'crowns' AS reading, crowns AS e FROM m UNION ALL SELECT 'as_read', as_read FROM m) GROUP BY reading")
def cell_mean_accuracy(spark, sf_dir):
    return rounded(reports.cell_mean_errors(*fine_pixels(spark, sf_dir), EXPECTED), "mae", "rmse", "bias")


@query("""WITH bins AS (SELECT CAST(least(floor(greatest(h, 0)/0.25), 159) AS INT) AS bin, count(*) AS n FROM canopy WHERE h <= 40 GROUP BY 1), k AS (SELECT o, exp(-o*o/32e0) AS w FROM (SELECT unnest(range(-16, 17)) AS o)), total AS (SELECT sum(w) AS t FROM k),
moved AS (SELECT bin + o AS b, n*w/t AS w FROM bins, k, total), folded AS (SELECT CASE WHEN b < 0 THEN -1 - b WHEN b >= 160 THEN 319 - b ELSE b END AS bin, sum(w) AS w FROM moved GROUP BY 1) SELECT (bin + 0.5e0)*0.25 AS height, round(w/0.25, 6) AS density FROM folded""")
def height_curve(spark, sf_dir):
    return rounded(reports.height_curve(view(spark, sf_dir, "canopy"), "h", 40.0), "density")


@query("SELECT CAST(floor(y/20) AS INT) AS r, CAST(floor(x/20) AS INT) AS c, count(*)/0.04e0 AS trees_per_ha FROM found_trees GROUP BY 1, 2")
def tree_density(spark, sf_dir):
    return reports.trees_a_hectare(view(spark, sf_dir, "found_trees"), 200, 200)


@query("WITH t AS (SELECT ceil(max(height_m)/5)*5e0 AS tallest FROM found_trees), b AS (SELECT floor(height_m/(tallest/12)) AS band, tallest, 2 + (tree_id % 9)/4e0 AS diameter FROM found_trees, t) SELECT round((band + 0.5e0)*tallest/12, 6) AS height, quantile_cont(diameter, 0.5) AS diameter, count(*) AS n FROM b WHERE band < 12 GROUP BY band, tallest HAVING count(*) >= 10")
def diameter_by_height(spark, sf_dir):
    return rounded(reports.diameter_by_height(view(spark, sf_dir, "found_trees").withColumn("diameter", 2 + (F.col("tree_id") % 9) / F.lit(4.0))), "height")


SPREAD = "[round_even(quantile_cont({0}, 0.05), 2), round_even(quantile_cont({0}, 0.25), 2), round_even(quantile_cont({0}, 0.5), 2), round_even(quantile_cont({0}, 0.75), 2), round_even(quantile_cont({0}, 0.95), 2), round_even(max({0}), 2)]"


@query(f"""WITH land AS (SELECT count(h) AS held, count(*) FILTER (h >= 2) AS cover FROM canopy), own AS (SELECT count(*) AS crowned FROM owned), found AS (SELECT count(*) AS trees, array_to_string({SPREAD.format('height_m')}, ' ') AS height, count(*) FILTER (tree_id % 10 = 0) AS crowns_at_edge FROM found_trees)
SELECT trees, round_even(held*1e-4, 2) AS area_with_data_ha, round_even(trees/greatest(held*1e-4, 1e-9), 1) AS trees_per_ha, round_even(cover/greatest(held, 1), 3) AS canopy_cover, round_even(crowned/greatest(cover, 1), 3) AS canopy_in_crowns, height, crowns_at_edge FROM land, own, found""")
def run_summary(spark, sf_dir):
    trees = view(spark, sf_dir, "found_trees").withColumns({"diameter": F.col("height_m") / 4, "at_edge": F.col("tree_id") % 10 == 0})
    out = reports.summary(view(spark, sf_dir, "canopy"), view(spark, sf_dir, "owned"), trees).drop("diameter")
    return out.withColumn("height", F.array_join(F.transform("height", lambda v: v.cast("string")), " "))


@query("""WITH u AS (SELECT *, max(h) OVER w AS top, min(h) OVER w AS low FROM owned WINDOW w AS (PARTITION BY tree_id)), x AS (SELECT *, greatest(h - (top - 0.15e0*(top - low)), 0) AS w FROM u)
SELECT tree_id, CAST(count(*) AS DOUBLE) AS area, round(avg(h), 6) AS mean, round(2*sqrt(count(*)/pi()), 6) AS diameter, arg_max(r, (h, -r, -c)) AS top_r, arg_max(c, (h, -r, -c)) AS top_c, min(h) AS low, round(sum(w*(r + 0.5))/nullif(sum(w), 0), 6) AS stem_r, round(sum(w*(c + 0.5))/nullif(sum(w), 0), 6) AS stem_c FROM x GROUP BY tree_id""")
def crown_measures(spark, sf_dir):
    return rounded(reports.crown_measures(view(spark, sf_dir, "owned"), 0, 0), "mean", "diameter", "stem_r", "stem_c")


@query("SELECT DISTINCT tree_id FROM owned o CROSS JOIN (VALUES (-1,0),(0,-1),(0,1),(1,0)) AS s(a, b) WHERE NOT EXISTS (SELECT 1 FROM canopy p WHERE p.r = o.r + a AND p.c = o.c + b)")
def edge_crowns(spark, sf_dir):
    return reports.edge_crowns(view(spark, sf_dir, "owned"), view(spark, sf_dir, "canopy"))


HIGH = "high AS (SELECT CAST(floor(cell_id/across) AS INT) AS r, CAST(cell_id % across AS INT) AS c FROM eth_cells CROSS JOIN area WHERE eth_m >= 40)"


@query(f"WITH RECURSIVE {HIGH}, walk AS (SELECT r, c, r AS tr, c AS tc FROM high UNION SELECT w.r, w.c, h.r, h.c FROM walk w JOIN high h ON abs(h.r - w.tr) + abs(h.c - w.tc) = 1) SELECT r, c, CAST(min(tr*100000 + tc) AS BIGINT) AS root FROM walk GROUP BY r, c")
def cell_regions(spark, sf_dir):
    across = view(spark, sf_dir, "area").select("across")
    high = view(spark, sf_dir, "eth_cells").where("eth_m >= 40").join(F.broadcast(across)).select(F.floor(F.col("cell_id") / F.col("across")).cast("int").alias("r"), (F.col("cell_id") % F.col("across")).cast("int").alias("c"))  # one row
    return regions.components(high, durable(spark)).select("r", "c", (F.col("root.r").cast("long") * 100_000 + F.col("root.c")).alias("root"))


@query("""WITH bbox AS (SELECT fid, min(x0) AS xmin, min(y0) AS ymin, max(x0) AS xmax, max(y0) AS ymax FROM edges GROUP BY fid) SELECT fid AS id, height, min_height FROM bbox JOIN footprints f USING (fid) WHERE bbox.xmax >= 40 AND bbox.xmin <= 90 AND bbox.ymax >= 30 AND bbox.ymin <= 120 ORDER BY id""")
def windowed_footprints(spark, sf_dir):
    own = polygons.measured(outlined(spark, sf_dir)).select(F.col("fid").alias("id"), F.col("box").alias("bbox"), "rings").join(view(spark, sf_dir, "footprints").select(F.col("fid").alias("id"), "height", "min_height"), "id")
    return footprint_files.in_window(own, 40.0, 30.0, 90.0, 120.0).select("id", "height", "min_height")


@query("SELECT id, w <= 60 AND e >= -20 AND s <= 50 AND n >= 10 AS selected FROM (" + "SELECT c_custkey AS id, CAST((c_custkey*7919) % 3600 AS DOUBLE)/10 - 180 AS w, CAST((c_custkey*104729) % 1600 AS DOUBLE)/10 - 80 AS s, least(CAST((c_custkey*7919) % 3600 AS DOUBLE)/10 - 180 + 0.3e0*(c_custkey % 17), 179) AS e, CAST((c_custkey*104729) % 1600 AS DOUBLE)/10 - 80 + 0.2e0*(c_custkey % 13) AS n FROM customer)")
def selected_files(spark, sf_dir):
    manifest = boxes(spark, sf_dir).select("id", F.struct("w", "s", "e", "n").alias("bbox"))
    return footprint_files.selected(manifest.select("id", F.array("bbox.w", "bbox.s", "bbox.e", "bbox.n").alias("bbox")), -20.0, 10.0, 60.0, 50.0).select("id", "selected")


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'false' WHEN c_custkey % 4 = 0 THEN 'True' END AS complete, CASE WHEN c_custkey % 3 = 0 THEN [2015 + c_custkey % 5, 2016] ELSE [] END AS listed, CASE WHEN c_custkey % 5 = 0 THEN [2010] ELSE [] END AS one, CASE WHEN c_custkey % 2 = 0 THEN [CAST(2000 + c_custkey % 30 AS BIGINT)] ELSE [] END AS band FROM customer)
SELECT id, CASE WHEN complete = 'false' THEN '' ELSE array_to_string(list_sort(list_distinct(listed || one || band)), ',') END AS years FROM t""")
def raster_years(spark, sf_dir):
    k = F.col("c_custkey")
    tags = F.map_filter(F.create_map(F.lit("acquisition_dates_complete"), F.when(k % 9 == 0, "false").when(k % 4 == 0, "True"), F.lit("acquisition_years"), F.when(k % 3 == 0, F.to_json(F.array(2015 + k % 5, F.lit(2016).cast("long")))), F.lit("acquisition_date"), F.when(k % 5 == 0, "2010-05-06")), lambda _, v: v.isNotNull())
    own = view(spark, sf_dir, "customer").select(k.alias("id"), tags.alias("tags"), F.when(k % 2 == 0, F.array((2000 + k % 30).cast("int"), F.lit(0), F.lit(65535))).alias("band_years"))
    return overlays.years_of(own).select("id", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query("SELECT fid, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, CASE WHEN fid % 4 = 3 THEN 0 ELSE 1 END AS polygons FROM corners GROUP BY fid")
def geojson_boxes(spark, sf_dir):
    ring = F.array_sort(F.collect_list(F.struct("k", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("p"))))
    corners = view(spark, sf_dir, "corners").groupBy("fid").agg(F.transform(ring, lambda q: q["p"]).alias("ring"))
    ring_text = F.to_json(F.col("ring"))
    geometry = F.when(F.col("fid") % 4 == 0, F.format_string('{"type":"Polygon","coordinates":[%s]}', ring_text)).when(F.col("fid") % 4 == 1, F.format_string('{"type":"MultiPolygon","coordinates":[[%s]]}', ring_text)).when(F.col("fid") % 4 == 2, F.format_string('{"type":"Polygon","coordinates":[%s]}', ring_text)).otherwise(F.format_string('{"type":"LineString","coordinates":%s}', ring_text))
    document = F.when(F.col("fid") % 2 == 0, F.format_string('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":%s}]}', geometry)).when(F.col("fid") % 4 == 1, F.format_string('{"type":"Feature","geometry":%s}', geometry)).otherwise(geometry)
    own = geojson.read(corners.select("fid", document.alias("document")), "document")
    return own.select("fid", "box.*", F.size("polygons").alias("polygons"))


@query("SELECT tree_id, CAST(tree_id % 3 = 0 AS BOOLEAN) AS moved, CASE WHEN tree_id % 3 = 0 THEN x + 3 ELSE x END AS stem_x, CASE WHEN tree_id % 3 = 0 THEN y + 4 ELSE y END AS stem_y, CASE WHEN tree_id % 3 = 0 THEN 5e0 ELSE 0e0 END AS trunk_from_top_m, CASE WHEN tree_id % 3 <> 0 THEN 8e0 END AS slope_deg, CASE WHEN tree_id % 3 = 0 THEN height_m + 10 - 12 ELSE height_m END AS height_m, CASE WHEN tree_id % 3 = 0 THEN 12e0 ELSE 10e0 END AS ground_m FROM found_trees")
def adjusted_stems(spark, sf_dir):
    trees = view(spark, sf_dir, "found_trees").select("tree_id", F.col("x").alias("stem_x"), F.col("y").alias("stem_y"), F.col("x").alias("top_x"), F.col("y").alias("top_y"), "height_m", F.lit(0.0).alias("trunk_from_top_m"), F.lit(8.0).alias("slope_deg"), F.lit(10.0).alias("ground_m"), (F.col("tree_id") % 3 == 0).alias("moved"))
    out = polygons.adjusted(trees, F.col("moved"), F.col("stem_x") + 3, F.col("stem_y") + 4, F.lit(12.0))
    return out.drop("top_x", "top_y").withColumn("trunk_from_top_m", F.round("trunk_from_top_m", 9))


@query("SELECT cell_id, CASE WHEN count(*) >= 8 THEN max(greatest(v, 0)) END AS top, round(CASE WHEN count(*) >= 8 THEN avg(greatest(v, 0)) END, 6) AS mean, count(*) AS n FROM (SELECT cell_id, v FROM fine_px UNION ALL SELECT cell_id, v - 12 FROM fine_px WHERE c % 3 = 0) WHERE v > -1 AND v < 150 GROUP BY cell_id")
def cells_of_sources(spark, sf_dir):
    px = view(spark, sf_dir, "fine_px")
    both = px.select("cell_id", "v", F.lit(0).alias("source"), F.lit(1.0).alias("pixel")).unionByName(px.where("c % 3 = 0").select("cell_id", (F.col("v") - 12).alias("v"), F.lit(1).alias("source"), F.lit(-2.5).alias("pixel")))
    return rounded(heights.cells_of_sources(both), "mean")


PLATEAU = CLIMB.replace("FROM canopy a", "FROM low a").replace(", canopy b WHERE", ", low b WHERE").replace("FROM canopy LEFT", "FROM low LEFT")


@query(f"""WITH RECURSIVE low AS (SELECT r, c, floor(h/12) AS h FROM canopy WHERE r < 40 AND c < 40), {PLATEAU}, tops AS (SELECT DISTINCT to_r AS r, to_c AS c FROM roots),
meet AS (SELECT r, c, r AS tr, c AS tc FROM tops UNION SELECT m.r, m.c, t.r, t.c FROM meet m JOIN tops t ON abs(t.r - m.tr) <= 1 AND abs(t.c - m.tc) <= 1), named AS (SELECT r, c, min((tr, tc)) AS root FROM meet GROUP BY r, c)
SELECT DISTINCT w.r, w.c, n.root[1] AS to_r, n.root[2] AS to_c FROM roots w JOIN named n ON n.r = w.to_r AND n.c = w.to_c""")
def plateau_roots(spark, sf_dir):
    low = view(spark, sf_dir, "canopy").where("r < 40 and c < 40").withColumn("h", F.floor(F.col("h") / 12))
    return rasters.plateaus(rasters.climb(low, durable(spark)), durable(spark))


@query("SELECT greatest(10, 5*ceil(quantile_cont(h, 0.995)/5)) AS top FROM canopy")
def stretch_top(spark, sf_dir):
    return view(spark, sf_dir, "canopy").agg(F.greatest(F.lit(10.0), 5 * F.ceil(F.percentile("h", F.lit(0.995)) / 5).cast("double")).alias("top"))


# The frame of one place around the raster is without data; beyond it the frame goes on.
@query("""WITH s AS (SELECT r, c, h FROM canopy), n AS (SELECT a.r, a.c, max(b.h) FILTER (b.r = a.r - 1) AS u, max(b.h) FILTER (b.r = a.r + 1) AS d, max(b.h) FILTER (b.c = a.c - 1) AS l, max(b.h) FILTER (b.c = a.c + 1) AS g, any_value(a.h) AS h
FROM s a LEFT JOIN (SELECT *, unnest([0, 1, 2, 3]) AS k FROM s) b ON b.r = a.r + CASE k WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AND b.c = a.c + CASE k WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END GROUP BY a.r, a.c),
way AS (SELECT r, c, (coalesce(d, h) - coalesce(u, h))/greatest((d IS NOT NULL)::INT + (u IS NOT NULL)::INT, 1) AS y, (coalesce(g, h) - coalesce(l, h))/greatest((g IS NOT NULL)::INT + (l IS NOT NULL)::INT, 1) AS x FROM n),
k AS (SELECT o, exp(-o*o/2e0) AS w FROM (SELECT unnest(range(-4, 5)) AS o)), told AS (SELECT r + i.o AS r, c + j.o AS c, i.w*j.w AS w, y, x FROM way CROSS JOIN k i CROSS JOIN k j)
SELECT s.r, s.c, round(degrees(atan(sqrt(pow(sum(w*y)/sum(w), 2) + pow(sum(w*x)/sum(w), 2)))), 6) AS slope FROM s JOIN told USING (r, c) GROUP BY s.r, s.c""")
def smoothed_slope(spark, sf_dir):
    return rounded(rasters.gradient(view(spark, sf_dir, "canopy"), 1.0), "slope")
