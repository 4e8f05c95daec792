"""Named queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, tiles
from ..operators import buildings, crowns, heights, matching, rasters
from ..sources.views import view, with_views

#: Fine pixels that a full cell holds; the driver's tables give about 15 at sf 0.001 and 150 at 0.01.
EXPECTED = 20.0
Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None) -> Callable:
    def put(f: Callable) -> Callable:
        Q[f.__name__] = (f, sql and with_views(sql))
        return f

    return put


META, ETH, MATCHED = (lambda x, c=c: curves.lookup_sql(x, c) for c in (curves.META, curves.ETH, curves.MATCHED))
TOP = f"tops AS (SELECT cell_id, CASE WHEN count(*) >= {EXPECTED / 2}e0 THEN max(greatest(v, 0e0)) END AS top FROM fine_px WHERE v > -1 AND v < 150 GROUP BY cell_id)"
CELLS = f"""{TOP}, planes AS (SELECT cell_id, top, eth_m, meta_date, {META("top")} AS mc, {ETH("eth_m")} AS ec FROM tops FULL JOIN eth_cells USING (cell_id) LEFT JOIN date_cells USING (cell_id)),
weighed AS (SELECT *, CASE WHEN mc IS NOT NULL AND ec IS NOT NULL THEN {curves.lookup_sql("((mc+ec)/2)", curves.WEIGHT, False)} WHEN mc IS NOT NULL THEN 1e0 WHEN ec IS NOT NULL THEN 0e0 END AS weight FROM planes),
cells AS (SELECT *, CASE WHEN mc IS NOT NULL AND ec IS NOT NULL THEN weight*mc + (1-weight)*ec ELSE coalesce(mc, ec) END AS height, {MATCHED("top")} AS matched FROM weighed)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = heights.cell_top_and_mean(view(spark, sf_dir, "fine_px"), EXPECTED).select("cell_id", "top")
    planes = tops.join(view(spark, sf_dir, "eth_cells"), "cell_id", "full").join(view(spark, sf_dir, "date_cells"), "cell_id", "left")
    return planes.withColumns(heights.calibrate(F.col("top"), F.col("eth_m")))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {CELLS} SELECT cell_id, round(height, 6) AS height, round(weight, 6) AS weight, round(matched, 6) AS matched FROM cells")
def calibrated_height(spark, sf_dir):
    return rounded(cells(spark, sf_dir).select("cell_id", "height", "weight", "matched"), "height", "weight", "matched")


PROVENANCE = """SELECT cell_id, CASE WHEN top IS NOT NULL AND eth_m IS NOT NULL THEN 3 WHEN top IS NOT NULL THEN 1 WHEN eth_m IS NOT NULL THEN 2 ELSE 0 END AS source,
CAST(coalesce(round_even(100*weight, 0), 255) AS INT) AS weight_on_meta_pct,
CAST(CASE WHEN coalesce(weight >= 0.5, false) THEN CASE WHEN top IS NOT NULL THEN coalesce(meta_date,0)//10000 ELSE 0 END WHEN eth_m IS NOT NULL THEN 2020 ELSE 0 END AS INT) AS year,
CAST(CASE WHEN top IS NOT NULL THEN coalesce(meta_date,0)//10000 ELSE 0 END AS INT) AS meta_year, CAST(CASE WHEN top IS NOT NULL THEN coalesce(meta_date,0)//100%100 ELSE 0 END AS INT) AS meta_month,
CASE WHEN eth_m IS NOT NULL THEN 2020 ELSE 0 END AS eth_year,
coalesce(top > 33.56, false)::INT + 2*coalesce(eth_m > 37.83, false)::INT + 4*coalesce(abs(mc-ec) >= 10, false)::INT AS flags"""


@query(f"WITH {CELLS} {PROVENANCE} FROM cells")
def provenance(spark, sf_dir):
    return heights.provenance(cells(spark, sf_dir))


RECENT = f"""{CELLS}, recent AS (SELECT * REPLACE (CASE WHEN turn THEN CASE WHEN meta_date//10000 > 2020 THEN mc ELSE ec END ELSE height END AS height, CASE WHEN turn THEN (meta_date//10000 > 2020)::INT::DOUBLE ELSE weight END AS weight)
FROM (SELECT *, coalesce(mc IS NOT NULL AND ec IS NOT NULL AND meta_date//10000 > 0 AND meta_date//10000 <> 2020, false) AS turn FROM cells))"""


@query(f"WITH {RECENT} SELECT cell_id, round(height, 6) AS height, weight FROM (SELECT * REPLACE (round(weight, 6) AS weight) FROM recent)")
def most_recent_height(spark, sf_dir):
    return rounded(heights.most_recent(cells(spark, sf_dir)).select("cell_id", "height", "weight"), "height", "weight")


ERROR = "(CASE " + " ".join(f"WHEN height >= {e} THEN {x}e0" for e, x in reversed(list(zip(curves.BANDS, curves.ERRORS, strict=True)))) + f" WHEN height IS NOT NULL THEN {curves.ERRORS[0]}e0 END)"


@query(f"WITH {CELLS} SELECT cell_id, {curves.band_sql('height')} AS band, {ERROR} AS expected_abs_error_m FROM cells")
def expected_error(spark, sf_dir):
    return cells(spark, sf_dir).select("cell_id", curves.band(F.col("height")).alias("band"), heights.expected_error(F.col("height")).alias("expected_abs_error_m"))


@query(f"WITH {CELLS} SELECT cell_id, weight > 0 AND weight < 1 AS blended, CASE WHEN weight > 0 AND weight < 1 THEN {ERROR} END AS expected_abs_error_m FROM cells")
def expected_error_by_reading(spark, sf_dir):
    weight = F.col("weight")
    return cells(spark, sf_dir).select("cell_id", ((weight > 0) & (weight < 1)).alias("blended"), heights.expected_error(F.col("height"), weight).alias("expected_abs_error_m"))


@query(f"WITH {CELLS}, told AS ({PROVENANCE} FROM cells) SELECT source, flags, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM told GROUP BY source, flags")
def source_shares(spark, sf_dir):
    from pyspark.sql import Window

    told = heights.provenance(cells(spark, sf_dir)).groupBy("source", "flags").agg(F.count("*").alias("n"))
    return told.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(f"""WITH {CELLS} SELECT count(height) AS n, round(avg(height), 4) AS mean, round(quantile_cont(height, 0.05), 4) AS p5, round(quantile_cont(height, 0.25), 4) AS p25,
round(quantile_cont(height, 0.5), 4) AS p50, round(quantile_cont(height, 0.75), 4) AS p75, round(quantile_cont(height, 0.95), 4) AS p95 FROM cells""")
def height_summary(spark, sf_dir):
    p = F.percentile("height", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    got = cells(spark, sf_dir).agg(F.count("height").alias("n"), F.avg("height").alias("mean"), p.alias("p"))
    return got.select("n", F.round("mean", 4).alias("mean"), *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))])


@query(f"WITH {CELLS}, bands AS (SELECT unnest([0, 2, 5, 8, 12, 16, 20, 25, 35]) AS band) SELECT band, count(height) AS n FROM bands LEFT JOIN (SELECT height, {curves.band_sql('height')} AS band FROM cells) x USING (band) GROUP BY band")
def cells_per_band(spark, sf_dir):
    bands = spark.createDataFrame([(b,) for b in curves.BANDS], "band int")
    return bands.join(cells(spark, sf_dir).select("height", curves.band(F.col("height")).alias("band")), "band", "left").groupBy("band").agg(F.count("height").alias("n"))


FACTOR = "SELECT cell_id, CASE WHEN coalesce(top > 0, false) THEN height / greatest(top, 1e-6) ELSE 1e0 END AS factor FROM cells"


@query(f"WITH {CELLS}, factors AS ({FACTOR}) SELECT r, c, cell_id, round(v*factor, 6) AS p FROM fine_px JOIN factors USING (cell_id)")
def fine_product(spark, sf_dir):
    return rounded(heights.fine(view(spark, sf_dir, "fine_px"), cells(spark, sf_dir)), "p")


@query("SELECT CAST(floor(r/4) AS INT) AS r, CAST(floor(c/4) AS INT) AS c, round(avg(h), 6) AS h FROM canopy GROUP BY 1, 2")
def overview(spark, sf_dir):
    return rounded(heights.pyramid(view(spark, sf_dir, "canopy"), 2), "h")


@query("SELECT min(h) AS min, max(h) AS max, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) AS std FROM canopy")
def band_statistics(spark, sf_dir):
    return view(spark, sf_dir, "canopy").agg(F.min("h").alias("min"), F.max("h").alias("max"), F.round(F.avg("h"), 6).alias("mean"), F.round(F.stddev_pop("h"), 6).alias("std"))


@query(f"""WITH {CELLS}, e AS (SELECT height - truth_m AS e, {curves.band_sql("truth_m")} AS truth_band, {curves.band_sql("height")} AS reading_band FROM cells JOIN truth_cells USING (cell_id) WHERE height - truth_m IS NOT NULL)
SELECT truth_band, reading_band, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS bias, round(quantile_cont(e, 0.5), 6) AS median FROM e GROUP BY GROUPING SETS ((), (truth_band), (reading_band)) HAVING count(*) >= 5""")
def accuracy(spark, sf_dir):
    rows = cells(spark, sf_dir).join(view(spark, sf_dir, "truth_cells"), "cell_id")
    return rounded(heights.errors(rows, "height", "truth_m", 5), "mae", "rmse", "bias", "median")


AROUND = "(VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) AS o(k, dr, dc)"
NEAR = f"near AS (SELECT a.r, a.c, a.h, k, b.r AS nr, b.c AS nc, b.h AS nh FROM canopy a, {AROUND}, canopy b WHERE b.r = a.r + dr AND b.c = a.c + dc)"


@query(f"""WITH told AS (SELECT r + dr AS r, c + dc AS c, h AS nh FROM canopy, {AROUND}), stats AS (SELECT t.r, t.c, any_value(p.h) AS h, quantile_cont(nh, 0.5) AS median, count(*) FILTER (nh > p.h + 1.5) AS higher, count(*) AS n FROM told t LEFT JOIN canopy p ON t.r = p.r AND t.c = p.c GROUP BY t.r, t.c),
new AS (SELECT r, c, median FROM stats WHERE (higher >= 6 AND median - h > 1.5) OR (h IS NULL AND n >= 6)) SELECT r, c, coalesce(median, h) AS h FROM canopy FULL JOIN new USING (r, c)""")
def mended(spark, sf_dir):
    return rasters.mend(view(spark, sf_dir, "canopy"))


STEEP = f"{NEAR}, rise AS (SELECT *, (nh - h) / CASE WHEN abs(nr - r) + abs(nc - c) = 2 THEN sqrt(2e0) ELSE 1 END AS up FROM near), best AS (SELECT r, c, nr, nc FROM rise WHERE up > 0 QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY up DESC, k) = 1), step AS (SELECT r, c, coalesce(nr, r) AS to_r, coalesce(nc, c) AS to_c FROM canopy LEFT JOIN best USING (r, c))"


@query(f"WITH {STEEP} SELECT * FROM step")
def steepest_neighbour(spark, sf_dir):
    return rasters.steepest(view(spark, sf_dir, "canopy")).drop("h")


CLIMB = f"{STEEP}, walk AS (SELECT r, c, to_r, to_c FROM step UNION SELECT w.r, w.c, s.to_r, s.to_c FROM walk w JOIN step s ON s.r = w.to_r AND s.c = w.to_c WHERE s.to_r <> w.to_r OR s.to_c <> w.to_c), roots AS (SELECT w.r, w.c, w.to_r, w.to_c FROM walk w JOIN step s ON s.r = w.to_r AND s.c = w.to_c WHERE s.to_r = w.to_r AND s.to_c = w.to_c)"


def durable(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Cuts lineage in the folder of spark.checkpoint.dir; in local mode only, in one of this machine's."""

    def cut(df: DataFrame) -> DataFrame:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            named = spark.conf.get("spark.checkpoint.dir", None)
            if not named and not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
            context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sylva-checkpoints"))
        return df.checkpoint()

    return cut


@query(f"WITH RECURSIVE {CLIMB} SELECT DISTINCT r, c, to_r, to_c FROM roots")
def climb_roots(spark, sf_dir):
    return rasters.climb(view(spark, sf_dir, "canopy"), durable(spark))


@query(f"""WITH RECURSIVE {CLIMB}, named AS (SELECT DISTINCT r, c, to_r::BIGINT*100000 + to_c AS basin FROM roots)
SELECT least(x.basin, y.basin) AS a, greatest(x.basin, y.basin) AS b, max(least(n.h, n.nh)) AS saddle FROM near n JOIN named x ON x.r = n.r AND x.c = n.c JOIN named y ON y.r = n.nr AND y.c = n.nc WHERE x.basin <> y.basin GROUP BY 1, 2""")
def highest_passes(spark, sf_dir):
    px = view(spark, sf_dir, "canopy")
    return rasters.passes(px, rasters.climb(px, durable(spark)))


@query("SELECT r, c, h FROM canopy a WHERE NOT EXISTS (SELECT 1 FROM canopy b WHERE b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 AND (b.r-a.r)*(b.r-a.r) + (b.c-a.c)*(b.c-a.c) <= pow(greatest(3 + 0.02*a.h, 3)/2, 2) AND b.h > a.h)")
def window_tops(spark, sf_dir):
    return rasters.window_tops(view(spark, sf_dir, "canopy"), 3.0, 0.02)


@query(f"""WITH {NEAR}, s AS (SELECT r, c, max(nh) FILTER (k = 1) AS n0, max(nh) FILTER (k = 6) AS n1, max(nh) FILTER (k = 3) AS n2, max(nh) FILTER (k = 4) AS n3 FROM near GROUP BY r, c)
SELECT r, c, round(degrees(atan(sqrt(pow((coalesce(n1,h)-coalesce(n0,h))/greatest((n0 IS NOT NULL)::INT+(n1 IS NOT NULL)::INT,1),2) + pow((coalesce(n3,h)-coalesce(n2,h))/greatest((n2 IS NOT NULL)::INT+(n3 IS NOT NULL)::INT,1),2)))), 6) AS slope FROM canopy LEFT JOIN s USING (r, c)""")
def slope(spark, sf_dir):
    return rounded(rasters.gradient(view(spark, sf_dir, "canopy")), "slope")


@query("""WITH corner AS (SELECT ref_id AS id, CAST(floor(y) + a AS INT) AS r, CAST(floor(x) + b AS INT) AS c, (CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM ref_trees, (VALUES (0,0),(0,1),(1,0),(1,1)) AS k(a, b))
SELECT id, round(sum(w*h)/sum(w), 6) AS h FROM corner JOIN canopy USING (r, c) WHERE w > 0 GROUP BY id""")
def sampled_heights(spark, sf_dir):
    at = view(spark, sf_dir, "ref_trees").select(F.col("ref_id").alias("id"), "x", "y")
    return rounded(rasters.bilinear(view(spark, sf_dir, "canopy"), at), "h")


@query("SELECT CAST(floor(y) AS INT) AS r, CAST(floor(x) AS INT) AS c, avg(z) FILTER (classification = 2) AS ground, count(*) AS n, count(*) FILTER (return_number = 1) AS first_returns FROM points GROUP BY 1, 2")
def point_cells(spark, sf_dir):
    p = view(spark, sf_dir, "points")
    return p.groupBy(F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c")).agg(F.avg(F.when(F.col("classification") == 2, F.col("z"))).alias("ground"), F.count("*").alias("n"), F.count_if(F.col("return_number") == 1).alias("first_returns"))


@query("""WITH b(a) AS (SELECT unnest(range(8))), s AS (SELECT 0e0 AS dx, 0e0 AS dy UNION ALL SELECT 0.2*cos(a*pi()/4), 0.2*sin(a*pi()/4) FROM b)
SELECT CAST(floor(y + dy) AS INT) AS r, CAST(floor(x + dx) AS INT) AS c, max(z) AS h FROM points, s WHERE classification NOT IN (6,7,9,13,14,15,16,17,18) GROUP BY 1, 2""")
def spread_canopy(spark, sf_dir):
    return rasters.spread_tops(view(spark, sf_dir, "points"))


NUM = r"regexp_extract({0}, '^\s*([-+]?[0-9]*\.?[0-9]+)\s*(m|ft)?\s*$', {1})"
NUMBER = "(CASE WHEN " + NUM + " <> '' THEN CASE WHEN " + NUM.replace("{1}", "{2}") + " = 'ft' THEN CAST(" + NUM + " AS DOUBLE)*0.3048e0 ELSE CAST(" + NUM + " AS DOUBLE) END END)"
number_sql = lambda x: NUMBER.format(x, 1, 2)
tag_sql = lambda k: f"nullif(regexp_extract(other_tags, '\"{k}\"=>\"([^\"]*)\"', 1), '')"
year_sql = lambda x: rf"TRY_CAST(nullif(regexp_extract(regexp_replace(trim({x}), '\.0$', ''), '^([0-9]{{4}})(-[0-9]{{2}}(-[0-9]{{2}})?)?$', 1), '') AS INT)"
ATTRIBUTES = f"""raw AS (SELECT *, coalesce(construction_year, {tag_sql("start_date")}) AS start_text, coalesce(demolition_year, {tag_sql("end_date")}) AS end_text, coalesce(height, {tag_sql("height")}) AS height_text, coalesce(min_height, {tag_sql("min_height")}) AS min_text FROM footprints),
parsed AS (SELECT *, {number_sql("height_text")} AS roof, coalesce({number_sql("min_text")}, 0e0) AS bottom, {year_sql("start_text")} AS s, {year_sql("end_text")} AS e FROM raw),
b AS (SELECT *, CASE WHEN (start_text IS NOT NULL AND s IS NULL) OR (end_text IS NOT NULL AND e IS NULL) THEN 'unknown' WHEN coalesce(s > 2021, false) OR coalesce(e < 2018, false) THEN 'absent' WHEN coalesce(s BETWEEN 2018 AND 2021, false) OR coalesce(e BETWEEN 2018 AND 2021, false) THEN 'unknown'
WHEN coalesce(s < 2018, false) AND (coalesce(e > 2021, false) OR coalesce(snapshot_year >= 2021, false)) THEN 'active' WHEN abs(2018 - snapshot_year) <= 5 AND abs(2021 - snapshot_year) <= 5 THEN 'active' ELSE 'unknown' END AS state FROM parsed)"""


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings.attributes(view(spark, sf_dir, "footprints")).withColumn("state", buildings.temporal(2018, 2021))


@query(f"WITH {ATTRIBUTES} SELECT fid, round(roof, 6) AS roof, bottom, s AS start, e AS \"end\", state FROM b")
def building_states(spark, sf_dir):
    return rounded(footprints(spark, sf_dir).select("fid", "roof", "bottom", "start", "end", "state"), "roof")


EXCLUDED = "gone AS (SELECT DISTINCT r, c, h FROM canopy JOIN b ON b.state = 'active' AND roof > 0 AND r >= floor(ymin) AND r <= ceil(ymax) - 1 AND c >= floor(xmin) AND c <= ceil(xmax) - 1 AND h <= roof + 2 AND h >= bottom)"


@query(f"WITH {ATTRIBUTES}, {EXCLUDED} SELECT r, c, h FROM gone")
def building_exclusion(spark, sf_dir):
    return buildings.excluded(view(spark, sf_dir, "canopy"), footprints(spark, sf_dir))


@query(f"WITH {ATTRIBUTES}, {EXCLUDED} SELECT r, c, h FROM canopy ANTI JOIN gone USING (r, c)")
def canopy_without_buildings(spark, sf_dir):
    px = view(spark, sf_dir, "canopy")
    return px.join(buildings.excluded(px, footprints(spark, sf_dir)).select("r", "c"), ["r", "c"], "left_anti")


@query(f"WITH {ATTRIBUTES} SELECT tree_id, CASE WHEN coalesce(bool_or(state = 'unknown'), false) THEN 2 WHEN coalesce(bool_or(state = 'active'), false) THEN 1 ELSE 0 END AS status, round(max(roof) FILTER (state = 'active'), 6) AS building_height FROM found_trees LEFT JOIN b ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax GROUP BY tree_id")
def tree_building_status(spark, sf_dir):
    return rounded(buildings.tree_status(view(spark, sf_dir, "found_trees"), footprints(spark, sf_dir)), "building_height")


@query(f"WITH {ATTRIBUTES} SELECT state, count(*) AS n, count(roof) AS with_height FROM b GROUP BY state")
def building_report(spark, sf_dir):
    return footprints(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count("roof").alias("with_height"))


@query("SELECT tree_id, ref_id, round(sqrt((f.x-t.x)*(f.x-t.x) + (f.y-t.y)*(f.y-t.y)), 6) AS d FROM found_trees f JOIN ref_trees t ON sqrt((f.x-t.x)*(f.x-t.x) + (f.y-t.y)*(f.y-t.y)) <= 2")
def near_pairs(spark, sf_dir):
    return rounded(matching.near_pairs(view(spark, sf_dir, "found_trees"), view(spark, sf_dir, "ref_trees")), "d")


@query(None)
def tree_scores(spark, sf_dir):
    found, reference = view(spark, sf_dir, "found_trees"), view(spark, sf_dir, "ref_trees")
    return matching.scores(matching.greedy(matching.near_pairs(found, reference), durable(spark)), found, reference)


@query("SELECT count(*) AS n, round(avg(height_m), 6) AS mean, quantile_cont(height_m, 0.05) AS p5, quantile_cont(height_m, 0.5) AS p50, quantile_cont(height_m, 0.95) AS p95, max(height_m) AS max, count(*) / 4e0 AS trees_per_ha FROM found_trees")
def tree_summary(spark, sf_dir):
    p = F.percentile("height_m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return view(spark, sf_dir, "found_trees").agg(F.count("*").alias("n"), F.round(F.avg("height_m"), 6).alias("mean"), p[0].alias("p5"), p[1].alias("p50"), p[2].alias("p95"), F.max("height_m").alias("max"), (F.count("*") / F.lit(4.0)).alias("trees_per_ha"))


PLACED = "placed AS (SELECT c_custkey AS id, CAST((c_custkey*7919) % 3600 AS DOUBLE)/10 - 180 AS lon, CAST((c_custkey*104729) % 1600 AS DOUBLE)/10 - 80 AS lat FROM customer)"
QUAD = "array_to_string(list_transform(range(8, -1, -1), lambda i: CAST(((tx >> i) & 1) + 2*((ty >> i) & 1) AS VARCHAR)), '')"


@query(f"""WITH {PLACED}, t AS (SELECT *, CAST(greatest(0, least(511, floor((lon+180)/360*512))) AS INT) AS tx, CAST(greatest(0, least(511, floor((1 - asinh(tan(radians(lat)))/pi())/2*512))) AS INT) AS ty, CAST(floor(lat/3)*3 AS INT) AS s, CAST(floor(lon/3)*3 AS INT) AS w FROM placed)
SELECT id, {QUAD} AS quadkey, concat(CASE WHEN s < 0 THEN 'S' ELSE 'N' END, lpad(CAST(abs(s) AS VARCHAR), 2, '0'), CASE WHEN w < 0 THEN 'W' ELSE 'E' END, lpad(CAST(abs(w) AS VARCHAR), 3, '0')) AS tile,
CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon+180)/6) AS INT) % 60 + 1 AS INT) AS epsg,
round(2*6371008.8e0*asin(sqrt(pow(sin(radians(0.001e0)/2),2) + cos(radians(lat))*cos(radians(lat+0.001e0))*pow(sin(radians(0.001e0)/2),2))), 4) AS step_m FROM t""")
def tile_names(spark, sf_dir):
    placed = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919 % 3600).cast("double") / 10 - 180).alias("lon"), ((F.col("c_custkey") * 104729 % 1600).cast("double") / 10 - 80).alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    x, y = tiles.slippy(lon, lat, 9)
    placed = placed.withColumns({"tx": x, "ty": y})
    return placed.select("id", tiles.quadkey(F.col("tx"), F.col("ty"), 9).alias("quadkey"), tiles.degree_tile(lon, lat, 3).alias("tile"), tiles.utm_epsg(lon, lat).alias("epsg"), F.round(tiles.haversine(lon, lat, lon + F.lit(0.001), lat + F.lit(0.001)), 4).alias("step_m"))


@query(f"WITH {CELLS}, told AS ({PROVENANCE} FROM cells) SELECT cell_id, CASE WHEN flags = 0 THEN 'none' ELSE array_to_string(list_filter([CASE WHEN flags & 1 > 0 THEN 'meta above' END, CASE WHEN flags & 2 > 0 THEN 'eth above' END, CASE WHEN flags & 4 > 0 THEN 'maps apart' END], lambda x: x IS NOT NULL), ' + ') END AS name FROM told")
def flag_names(spark, sf_dir):
    return heights.provenance(cells(spark, sf_dir)).select("cell_id", tiles.flag_name(F.col("flags"), ["meta above", "eth above", "maps apart"]).alias("name"))


@query("""WITH bins AS (SELECT CAST(floor(h/0.25) AS INT) AS bin, count(*) AS n FROM canopy GROUP BY 1), k AS (SELECT o, exp(-o*o/32e0) AS w FROM (SELECT unnest(range(-16, 17)) AS o))
SELECT bin, round(sum(n*w) / (SELECT sum(w) FROM k), 6) AS n FROM (SELECT bin + o AS bin, n, w FROM bins, k) GROUP BY bin""")
def smoothed_histogram(spark, sf_dir):
    import math

    w = {o: math.exp(-o * o / 32) for o in range(-16, 17)}  # deviation of 1 m in bins of 0.25 m
    bins = view(spark, sf_dir, "canopy").groupBy(F.floor(F.col("h") / 0.25).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spread = bins.select("n", "bin", F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("w")) for o, x in w.items()])).alias("k"))
    return spread.groupBy((F.col("bin") + F.col("k.o")).alias("bin")).agg(F.round(F.sum(F.col("n") * F.col("k.w")) / F.lit(sum(w.values())), 6).alias("n"))


@query("SELECT cell_id, CAST(meta_date//10000 AS INT) AS year, concat(CAST(meta_date//10000 AS VARCHAR), '-', lpad(CAST(meta_date//100%100 AS VARCHAR), 2, '0'), '-', lpad(CAST(meta_date%100 AS VARCHAR), 2, '0')) AS day FROM date_cells")
def image_days(spark, sf_dir):
    return view(spark, sf_dir, "date_cells").select("cell_id", F.floor(F.col("meta_date") / 10000).cast("int").alias("year"), F.date_format(F.to_date(F.col("meta_date").cast("string"), "yyyyMMdd"), "yyyy-MM-dd").alias("day"))


@query("SELECT r, c, arg_min(h, tile) AS h FROM (SELECT r, c, h, 0 AS tile FROM canopy WHERE c < 120 UNION ALL SELECT r, c, h + 1, 1 FROM canopy WHERE c >= 80) GROUP BY r, c")
def mosaic(spark, sf_dir):
    px = view(spark, sf_dir, "canopy")
    both = px.where("c < 120").withColumn("tile", F.lit(0)).unionByName(px.where("c >= 80").select("r", "c", (F.col("h") + 1).alias("h"), F.lit(1).alias("tile")))
    return both.groupBy("r", "c").agg(F.min_by("h", "tile").alias("h"))


def trees_by(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowns.numbered(crowns.trees(view(spark, sf_dir, "canopy"), crowns.Rule(crowns=method)))


# Merging by markers and growing crowns follow an order that SQL cannot say; tests/test_crowns.py holds them against brute force.
@query(None)
def trees_watershed(spark, sf_dir):
    return crowns.table(trees_by("watershed", spark, sf_dir), 0.0, 200.0)


@query(None)
def trees_dalponte(spark, sf_dir):
    return crowns.table(trees_by("dalponte", spark, sf_dir), 0.0, 200.0)


@query(None)
def trees_silva(spark, sf_dir):
    return crowns.table(trees_by("silva", spark, sf_dir), 0.0, 200.0)


@query(None)
def crown_labels(spark, sf_dir):
    return crowns.labels(trees_by("watershed", spark, sf_dir))


@query(None)
def crown_outlines(spark, sf_dir):
    return crowns.outline_edges(crowns.labels(trees_by("watershed", spark, sf_dir)))


def queries() -> dict:
    from . import geometry, surfaces  # noqa: F401  they add theirs to Q

    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in Q.items() if sql}
