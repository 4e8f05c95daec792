"""Derived raster, point, footprint and tree tables over the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # The study area's side in metres grows with the points: 200 at 60,000 and fewer, 800 at 600,000; cells are of 10 m.
    "area": "SELECT side, CAST(floor(side/10) AS BIGINT) AS across FROM (SELECT CAST(200*greatest(1, ceil(sqrt(count(*)/60000e0))) AS BIGINT) AS side FROM lineitem) AS sized",
    "points": """SELECT CAST((l_orderkey*7919 + l_linenumber*31) % (side*10) AS DOUBLE)/10 AS x,
        CAST((l_partkey*104729 + l_suppkey*1299709 + l_linenumber*17) % (side*10) AS DOUBLE)/10 AS y,
        CAST(l_quantity AS DOUBLE) AS z, CAST(l_linenumber AS INT) AS classification, CAST(1 + l_suppkey % 3 AS INT) AS return_number FROM lineitem CROSS JOIN area""",
    "fine_px": "SELECT CAST(floor(y) AS INT) AS r, CAST(floor(x) AS INT) AS c, CAST(floor(y/10)*across + floor(x/10) AS BIGINT) AS cell_id, z AS v FROM points CROSS JOIN area",
    "canopy": "SELECT r, c, max(v) AS h FROM fine_px GROUP BY r, c",
    "eth_cells": "SELECT CAST(p_partkey % (across*across) AS BIGINT) AS cell_id, CAST(max(p_size) AS DOUBLE) AS eth_m FROM part CROSS JOIN area WHERE (p_partkey % (across*across)) % 17 <> 0 GROUP BY 1",
    "date_cells": """SELECT CAST(o_orderkey % (across*across) AS BIGINT) AS cell_id, CAST(max((year(o_orderdate)+20)*10000 + month(o_orderdate)*100 + day(o_orderdate)) AS INT) AS meta_date
        FROM orders CROSS JOIN area WHERE (o_orderkey % (across*across)) % 13 <> 0 GROUP BY 1""",
    "truth_cells": "SELECT CAST(c_custkey % (across*across) AS BIGINT) AS cell_id, CAST(max((c_custkey*13) % 45) AS DOUBLE) AS truth_m FROM customer CROSS JOIN area GROUP BY 1",
    "footprints": """SELECT s_suppkey AS fid, CAST((s_suppkey*37) % (side-20) AS DOUBLE) AS xmin, CAST((s_suppkey*53) % (side-20) AS DOUBLE) AS ymin,
        CAST((s_suppkey*37) % (side-20) + 4 + s_suppkey % 7 AS DOUBLE) AS xmax, CAST((s_suppkey*53) % (side-20) + 4 + s_suppkey % 5 AS DOUBLE) AS ymax,
        CASE s_suppkey % 4 WHEN 0 THEN concat(CAST(10+s_nationkey AS STRING),' m') WHEN 1 THEN concat(CAST(40+s_nationkey AS STRING),' ft') WHEN 2 THEN CAST(10+s_nationkey AS STRING) END AS height,
        CASE WHEN s_suppkey % 9 = 0 THEN '3' END AS min_height,
        CASE WHEN s_suppkey % 6 = 0 THEN '~1990' WHEN s_suppkey % 6 < 4 THEN CAST(1995 + s_suppkey % 30 AS STRING) END AS construction_year,
        CASE WHEN s_suppkey % 10 = 7 THEN CAST(2010 + s_suppkey % 15 AS STRING) END AS demolition_year,
        CASE WHEN s_suppkey % 5 = 0 THEN concat('"start_date"=>"', CAST(1980 + s_suppkey % 40 AS STRING), '","height"=>"', CAST(9+s_nationkey AS STRING), ' m"') END AS other_tags,
        2020 AS snapshot_year FROM supplier CROSS JOIN area""",
    # The footprints' outlines: a box, a diamond or an L in turn; corners in order, edges from each corner to the next.
    "corners": """SELECT fid, k, CASE WHEN fid % 3 = 0 THEN CASE WHEN k IN (0, 3) THEN xmin ELSE xmax END WHEN fid % 3 = 1 THEN CASE k WHEN 0 THEN (xmin+xmax)/2 WHEN 1 THEN xmax WHEN 2 THEN (xmin+xmax)/2 ELSE xmin END
        ELSE CASE WHEN k IN (0, 5) THEN xmin WHEN k IN (1, 2) THEN xmax ELSE xmin + 2 END END AS x,
        CASE WHEN fid % 3 = 0 THEN CASE WHEN k IN (0, 1) THEN ymin ELSE ymax END WHEN fid % 3 = 1 THEN CASE k WHEN 0 THEN ymin WHEN 1 THEN (ymin+ymax)/2 WHEN 2 THEN ymax ELSE (ymin+ymax)/2 END
        ELSE CASE WHEN k IN (0, 1) THEN ymin WHEN k IN (2, 3) THEN ymin + 2 ELSE ymax END END AS y
        FROM footprints CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS v(k) WHERE k < 4 OR fid % 3 = 2""",
    "edges": """SELECT fid, k, x AS x0, y AS y0, coalesce(lead(x) OVER (PARTITION BY fid ORDER BY k), first_value(x) OVER (PARTITION BY fid ORDER BY k)) AS x1,
        coalesce(lead(y) OVER (PARTITION BY fid ORDER BY k), first_value(y) OVER (PARTITION BY fid ORDER BY k)) AS y1 FROM corners""",
    "ref_trees": "SELECT c_custkey AS ref_id, CAST((c_custkey*7919) % (side*10) AS DOUBLE)/10 AS x, CAST((c_custkey*104729) % (side*10) AS DOUBLE)/10 AS y FROM customer CROSS JOIN area",
    "found_trees": "SELECT p_partkey AS tree_id, CAST((p_partkey*7919 + p_size) % (side*10) AS DOUBLE)/10 AS x, CAST((p_partkey*104729 + 3*p_size) % (side*10) AS DOUBLE)/10 AS y, CAST(p_size AS DOUBLE) AS height_m FROM part CROSS JOIN area",
    # A smooth elevation of the study area's pixels, with a hole.
    "ground": "SELECT r, c, CASE WHEN (r*31 + c) % 97 <> 0 THEN 100 + r/10e0 + (c % 7)/4e0 END AS z FROM canopy",
    # Crowns by rule: each found tree owns the canopy pixels of a square around it, the nearest lower number where they meet.
    "owned": """SELECT r, c, CAST(min(tree_id) AS BIGINT) AS tree_id, max(h) AS h FROM found_trees CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS down(a) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS over_(b)
        JOIN canopy ON r = CAST(floor(y) AS INT) + a AND c = CAST(floor(x) AS INT) + b WHERE h >= 2 GROUP BY r, c""",
}


def needs(sql: str) -> list[str]:
    """The derived views that a text names, those they need first."""
    out: list[str] = []
    for v in re.findall(r"\w+", sql):
        if v in VIEWS and v not in out:
            out += [x for x in [*needs(VIEWS[v]), v] if x not in out]
    return out


def with_views(sql: str) -> str:
    """The SQL with its views in front, for DuckDB."""
    sql = sql.strip()
    used = needs(sql)
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    recursive = re.match(r"WITH RECURSIVE ", sql)
    rest = re.sub(r"^WITH (RECURSIVE )?", ", ", sql) if sql.startswith("WITH ") else f" {sql}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = dict.fromkeys(re.findall(r"(?:FROM|JOIN) (\w+)", VIEWS[name]))
    sql = re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", VIEWS[name])
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in used})
