"""Queries over polygon footprints, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import buildings, polygons
from ..sources.views import view
from .catalogue import ATTRIBUTES, query, rounded

CROSSED = "(y0 > {y}) <> (y1 > {y}) AND {x} < x0 + ({y} - y0)*(x1 - x0)/nullif(y1 - y0, 0)"
ON = "(x1 - x0)*({y} - y0) = (y1 - y0)*({x} - x0) AND {x} BETWEEN least(x0, x1) AND greatest(x0, x1) AND {y} BETWEEN least(y0, y1) AND greatest(y0, y1)"
# An edge passes through the open unit square at (c, r).
IN, OUT = ("CASE WHEN {d} <> 0 THEN least(({low} - {s})/{d}, ({low} + 1 - {s})/{d}) WHEN {s} > {low} AND {s} < {low} + 1 THEN 0 ELSE 2 END", "CASE WHEN {d} <> 0 THEN greatest(({low} - {s})/{d}, ({low} + 1 - {s})/{d}) ELSE 1 END")
X, Y = {"d": "(x1 - x0)", "s": "x0", "low": "c"}, {"d": "(y1 - y0)", "s": "y0", "low": "r"}
PASSES = f"greatest({IN.format(**X)}, {IN.format(**Y)}, 0) < least({OUT.format(**X)}, {OUT.format(**Y)}, 1)"


def inside_sql(table: str, key: str, x: str, y: str, edge: bool) -> str:
    """key, fid of all points of a table under a footprint."""
    on = f" OR bool_or({ON.format(x=x, y=y)})" if edge else ""
    return f"SELECT {key}, fid FROM {table} CROSS JOIN edges GROUP BY {key}, fid HAVING count(*) FILTER ({CROSSED.format(x=x, y=y)}) % 2 = 1{on}"


TOUCHED = f"touched AS (SELECT r, c, fid FROM canopy JOIN edges ON true GROUP BY r, c, fid HAVING bool_or({PASSES}) OR count(*) FILTER ({CROSSED.format(x='(c + 0.5)', y='(r + 0.5)')}) % 2 = 1)"


def outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, rings of the footprints."""
    ring = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return view(spark, sf_dir, "corners").groupBy("fid").agg(F.array(ring).alias("rings"))


def shaped(spark: SparkSession, sf_dir: str, lo: int = 2018, hi: int = 2021) -> DataFrame:
    own = buildings.attributes(view(spark, sf_dir, "footprints")).withColumn("state", buildings.temporal(lo, hi))
    return own.select("fid", "roof", "bottom", "state").join(outlined(spark, sf_dir), "fid")


@query("SELECT fid, round(abs(sum(x0*y1 - x1*y0))/2, 6) AS area, min(x0) AS xmin, min(y0) AS ymin, max(x0) AS xmax, max(y0) AS ymax, count(*) AS corners FROM edges GROUP BY fid")
def footprint_shapes(spark, sf_dir):
    own = polygons.measured(polygons.validated(outlined(spark, sf_dir)))
    return own.select("fid", F.round(shapes.area(F.col("sides")), 6).alias("area"), "box.*", F.size("sides").cast("long").alias("corners"))


CUT = "SELECT fid, 2*k + t AS k, x0 + (x1 - x0)*(0.25 + t/2e0) AS x, y0 + (y1 - y0)*(0.25 + t/2e0) AS y FROM {0} CROSS JOIN (VALUES (0), (1)) AS v(t)"
JOINED = "SELECT fid, k, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM {0} WINDOW w AS (PARTITION BY fid ORDER BY k)"


@query(f"WITH cut1 AS ({CUT.format('edges')}), side1 AS ({JOINED.format('cut1')}), cut2 AS ({CUT.format('side1')}) SELECT fid, CAST(k AS INT) AS k, round(x, 6) AS x, round(y, 6) AS y FROM cut2")
def rounded_outlines(spark, sf_dir):
    own = outlined(spark, sf_dir).select("fid", F.posexplode(shapes.rounded(F.col("rings"))[0]).alias("k", "p"))
    return own.select("fid", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(inside_sql("found_trees", "tree_id", "x", "y", True))
def stems_in_footprints(spark, sf_dir):
    trees = view(spark, sf_dir, "found_trees").select("tree_id", "x", "y")
    return polygons.over_points(trees, outlined(spark, sf_dir)).select("tree_id", "fid")


@query(f"WITH held AS ({inside_sql('canopy', 'r, c', '(c + 0.5)', '(r + 0.5)', False)}) SELECT r, c, h FROM canopy SEMI JOIN held USING (r, c)")
def canopy_in_polygons(spark, sf_dir):
    return polygons.within(view(spark, sf_dir, "canopy"), outlined(spark, sf_dir))


@query(f"WITH {TOUCHED} SELECT * FROM touched")
def footprint_pixels(spark, sf_dir):
    return polygons.touched(outlined(spark, sf_dir)).join(view(spark, sf_dir, "canopy").select("r", "c"), ["r", "c"], "left_semi").select("r", "c", "fid")


@query(f"WITH {TOUCHED} SELECT r, c, h FROM canopy SEMI JOIN touched USING (r, c)")
def strict_exclusion(spark, sf_dir):
    return polygons.excluded(view(spark, sf_dir, "canopy"), outlined(spark, sf_dir), strict=True)


@query(f"WITH {ATTRIBUTES}, {TOUCHED} SELECT DISTINCT r, c, h FROM canopy JOIN touched USING (r, c) JOIN b USING (fid) WHERE state = 'active' AND roof > 0 AND h <= roof + 2 AND h >= bottom")
def roof_exclusion(spark, sf_dir):
    return polygons.excluded(view(spark, sf_dir, "canopy"), shaped(spark, sf_dir))


@query(f"""WITH held AS ({inside_sql('canopy', 'r, c', '(c + 0.5)', '(r + 0.5)', False)}), days AS (SELECT fid, fid % 2 AS tile, CASE WHEN fid % 11 = 0 THEN 0 ELSE CAST((2010 + fid % 13)*10000 + 601 + fid % 28 AS INT) END AS day FROM footprints),
last AS (SELECT r, c, tile, arg_max(day, fid) AS date FROM held JOIN days USING (fid) GROUP BY r, c, tile), first AS (SELECT r, c, arg_min(date, tile) AS date FROM last WHERE date > 0 GROUP BY r, c)
SELECT r, c, coalesce(date, 0) AS date FROM (SELECT DISTINCT r, c FROM canopy) LEFT JOIN first USING (r, c)""")
def polygon_dates(spark, sf_dir):
    day = F.when(F.col("fid") % 11 == 0, "0000-00-00").otherwise(F.concat((2010 + F.col("fid") % 13).cast("string"), F.lit("-06-"), F.lpad((1 + F.col("fid") % 28).cast("string"), 2, "0")))
    return polygons.dated(view(spark, sf_dir, "canopy"), outlined(spark, sf_dir).withColumns({"tile": F.col("fid") % 2, "place": F.col("fid"), "acq_date": day}))


MET = f"{ATTRIBUTES}, {TOUCHED}, met AS (SELECT DISTINCT tree_id, fid FROM owned JOIN touched USING (r, c))"


@query(f"WITH {MET} SELECT tree_id, CASE WHEN bool_or(state = 'unknown') THEN 2 WHEN bool_or(state = 'active') THEN 1 ELSE 0 END AS status, round(max(roof) FILTER (state = 'active' AND roof > 0), 6) AS building_height FROM met JOIN b USING (fid) GROUP BY tree_id")
def crown_building_status(spark, sf_dir):
    return rounded(polygons.crown_status(view(spark, sf_dir, "owned").select("r", "c", "tree_id"), shaped(spark, sf_dir)), "building_height")


@query(f"WITH {TOUCHED} SELECT r, c, tree_id FROM owned ANTI JOIN touched USING (r, c)")
def crowns_clipped(spark, sf_dir):
    return polygons.clipped(view(spark, sf_dir, "owned").select("r", "c", "tree_id"), outlined(spark, sf_dir))


INSIDE = inside_sql("found_trees", "tree_id", "x", "y", True)


@query(f"""WITH {MET}, inside AS ({INSIDE}), over_ AS (SELECT tree_id, fid, state, bottom FROM inside SEMI JOIN met USING (tree_id, fid) JOIN b USING (fid)),
stands AS (SELECT tree_id, bool_or(state = 'active' AND NOT bottom > 0) AS conflict, bool_or(state = 'unknown') AS unresolved FROM over_ GROUP BY tree_id),
free AS (SELECT o.tree_id, o.r, o.c, o.h FROM owned o JOIN stands s ON s.tree_id = o.tree_id AND s.conflict WHERE NOT EXISTS (SELECT 1 FROM touched t JOIN met m ON m.fid = t.fid AND m.tree_id = o.tree_id JOIN b ON b.fid = t.fid AND b.state = 'active' AND NOT b.bottom > 0 WHERE t.r = o.r AND t.c = o.c)),
weighed AS (SELECT *, greatest(h - 0.85e0*max(h) OVER (PARTITION BY tree_id), 0) AS w FROM free),
centre AS (SELECT tree_id, CASE WHEN sum(w) > 0 THEN sum(w*(r + 0.5))/sum(w) ELSE avg(r + 0.5) END AS mr, CASE WHEN sum(w) > 0 THEN sum(w*(c + 0.5))/sum(w) ELSE avg(c + 0.5) END AS mc FROM weighed GROUP BY tree_id),
placed AS (SELECT tree_id, r, c FROM weighed JOIN centre USING (tree_id) QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY round(pow(r + 0.5 - mr, 2) + pow(c + 0.5 - mc, 2), 9), r, c) = 1),
judged AS (SELECT f.tree_id, f.x, f.y, coalesce(conflict, false) AS conflict, coalesce(unresolved, false) AS unresolved, p.c + 0.5 AS nx, p.r + 0.5 AS ny, sqrt(pow(p.c + 0.5 - f.x, 2) + pow(p.r + 0.5 - f.y, 2)) AS away FROM found_trees f LEFT JOIN stands USING (tree_id) LEFT JOIN placed p USING (tree_id)),
told AS (SELECT *, CASE WHEN conflict AND nx IS NULL THEN 'no same-crown support outside building' WHEN conflict AND away > 2 THEN 'supported outside estimate exceeds declared shift limit' WHEN unresolved THEN 'temporal evidence unresolved at estimated stem' END AS reason FROM judged)
SELECT tree_id, reason, round(CASE WHEN conflict AND reason IS NULL THEN away ELSE 0 END, 6) AS shift, CAST(CASE WHEN conflict AND reason IS NULL THEN nx ELSE x END AS DOUBLE) AS stem_x, CAST(CASE WHEN conflict AND reason IS NULL THEN ny ELSE y END AS DOUBLE) AS stem_y FROM told""")
def stem_constraint(spark, sf_dir):
    label = view(spark, sf_dir, "owned")
    trees = view(spark, sf_dir, "found_trees").select("tree_id", F.col("x").alias("stem_x"), F.col("y").alias("stem_y"))
    out = polygons.constrained(trees, label.select("r", "c", "tree_id"), label.select("r", "c", "h"), shaped(spark, sf_dir))
    return rounded(out.select("tree_id", "reason", "shift", "stem_x", "stem_y"), "shift")


HELD = inside_sql("canopy", "r, c", "(c + 0.5)", "(r + 0.5)", False)


@query(f"""WITH square AS (SELECT fid, r, c FROM (SELECT fid, CAST(min(x0) AS INT) AS a, CAST(max(x0) AS INT) AS b, CAST(min(y0) AS INT) AS d, CAST(max(y0) AS INT) AS e FROM edges GROUP BY fid), range(0, 12) AS i(i), range(0, 12) AS j(j), LATERAL (SELECT d + i AS r, a + j AS c) WHERE d + i <= e AND a + j <= b),
held AS (SELECT s.fid, r, c FROM square s JOIN edges g ON g.fid = s.fid GROUP BY s.fid, r, c HAVING count(*) FILTER ({CROSSED.format(x='(c + 0.5)', y='(r + 0.5)')}) % 2 = 1),
sizes AS (SELECT tree_id, count(*) AS n FROM owned GROUP BY 1), own AS (SELECT fid, count(*) AS m FROM held GROUP BY 1), pairs AS (SELECT fid, tree_id, count(*) AS k FROM held JOIN owned USING (r, c) GROUP BY 1, 2),
best AS (SELECT fid, max(k/(n + m - k)) AS best FROM pairs JOIN sizes USING (tree_id) JOIN own USING (fid) GROUP BY fid)
SELECT fid AS ref_id, round(coalesce(best, 0), 6) AS best, coalesce(best, 0) >= 0.5 AS matched FROM footprints LEFT JOIN best USING (fid)""")
def crown_overlap(spark, sf_dir):
    reference = outlined(spark, sf_dir).withColumnRenamed("fid", "ref_id")
    return rounded(polygons.crown_iou(view(spark, sf_dir, "owned").select("r", "c", "tree_id"), reference), "best")


POLICIES = [("range", 2018, 2021, None, "recent", True), ("target", 2018, 2021, 2019, "recent", True), ("all_years", 2018, 2021, None, "all", True), ("undated", 2018, 2021, None, "recent", False), ("undated_target", 2018, 2021, 2016, "recent", False)]


def state_sql(lo: int, hi: int, policy: str, known: bool) -> str:
    if not known:
        return "'unknown'"
    near = f"WHEN abs({lo} - snapshot_year) <= 2 AND abs({hi} - snapshot_year) <= 2 THEN 'active' " if policy == "recent" else ""
    return f"""CASE WHEN (start_text IS NOT NULL AND s IS NULL) OR (end_text IS NOT NULL AND e IS NULL) THEN 'unknown' WHEN coalesce(s > {hi}, false) OR coalesce(e < {lo}, false) THEN 'absent' WHEN coalesce(s BETWEEN {lo} AND {hi}, false) OR coalesce(e BETWEEN {lo} AND {hi}, false) THEN 'unknown'
WHEN coalesce(s < {lo}, false) AND (coalesce(e > {hi}, false) OR coalesce(snapshot_year >= {hi}, false)) THEN 'active' {near}ELSE 'unknown' END"""


@query(f"WITH {ATTRIBUTES} " + " UNION ALL ".join(f"SELECT fid, '{n}' AS rule, {state_sql(t or lo, t or hi, p, k or t is not None)} AS state FROM parsed" for n, lo, hi, t, p, k in POLICIES))
def temporal_policies(spark, sf_dir):
    own = buildings.attributes(view(spark, sf_dir, "footprints"))
    each = [F.struct(F.lit(n).alias("rule"), buildings.temporal(lo, hi, 2, t, p, k).alias("state")) for n, lo, hi, t, p, k in POLICIES]
    return own.select("fid", F.explode(F.array(*each)).alias("x")).select("fid", "x.rule", "x.state")


@query(f"WITH {ATTRIBUTES}, {TOUCHED}, gone AS (SELECT DISTINCT r, c FROM canopy JOIN touched USING (r, c) JOIN b USING (fid) WHERE state = 'active' AND roof > 0 AND h <= roof + 2 AND h >= bottom) SELECT (SELECT count(*) FROM gone) AS excluded_pixels, (SELECT count(*) FROM canopy) AS grid_pixels, count(*) FILTER (state = 'active') AS active, count(*) FILTER (state = 'absent') AS absent, count(*) FILTER (state = 'unknown') AS unknown FROM b")
def exclusion_report(spark, sf_dir):
    px, own = view(spark, sf_dir, "canopy"), shaped(spark, sf_dir)
    counts = own.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("active", "absent", "unknown")])
    return polygons.excluded(px, own).agg(F.count("*").alias("excluded_pixels")).join(px.agg(F.count("*").alias("grid_pixels"))).join(counts)  # one row each
