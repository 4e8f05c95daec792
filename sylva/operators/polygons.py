"""Polygons against points, pixels and crowns: candidates meet by equi joins on buckets or pixels, exact predicates follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes

#: Side of a bucket, in map units. A polygon stands in every bucket that its box meets.
BUCKET = 16.0


def measured(polygons: DataFrame) -> DataFrame:
    """Adds sides (edges) and box to polygons with a column rings; polygons without corners go."""
    return polygons.withColumns({"sides": shapes.edges(F.col("rings")), "box": shapes.box(F.col("rings"))}).where("box.xmin is not null")


def validated(polygons: DataFrame) -> DataFrame:
    """polygons, or an error at the first whose rings are null, empty, of fewer than three corners or not finite."""
    finite = F.forall(F.flatten("rings"), lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    ok = F.coalesce(F.col("rings").isNotNull() & (F.size("rings") > 0) & F.forall("rings", lambda r: F.size(r) >= 3) & finite, F.lit(False))
    return polygons.withColumn("rings", F.when(ok, F.col("rings")).otherwise(F.raise_error(F.lit("footprints must be valid nonempty polygons")).cast(shapes.RINGS)))


def bucketed(polygons: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """A row for each polygon and bucket (bx, by) that its box meets."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"box.{a}") / bucket), F.floor(F.col(f"box.{b}") / bucket)))
    return measured(polygons).withColumn("bx", span("xmin", "xmax")).withColumn("by", span("ymin", "ymax"))


def over_points(points: DataFrame, polygons: DataFrame, edge: bool = True, bucket: float = BUCKET) -> DataFrame:
    """points (x, y) with the columns of each polygon over them; on an edge too unless edge is false."""
    test = shapes.covers if edge else shapes.contains
    placed = points.withColumns({"bx": F.floor(F.col("x") / bucket), "by": F.floor(F.col("y") / bucket)})
    near = placed.join(bucketed(polygons, bucket), ["bx", "by"]).where(F.col("x").between(F.col("box.xmin"), F.col("box.xmax")) & F.col("y").between(F.col("box.ymin"), F.col("box.ymax")))
    return near.where(test(F.col("sides"), F.col("x"), F.col("y"))).drop("bx", "by", "sides", "box", "rings")


def middle(name: str) -> Column:
    return F.col(name) + F.lit(0.5)


def burnt(pixels: DataFrame, polygons: DataFrame, order: str) -> DataFrame:
    """pixels (r, c) with the columns of the last polygon, by order, that holds their middle; those without one go."""
    names = [x for x in polygons.columns if x != "rings"]
    met = over_points(pixels.select("r", "c").distinct().withColumns({"x": middle("c"), "y": middle("r")}), polygons, edge=False)
    return met.groupBy("r", "c").agg(F.max_by(F.struct(*names), order).alias("p")).select("r", "c", "p.*")


def dated(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """r, c, date (yyyymmdd, 0 unknown): of each tile (tile, place) the last polygon's acq_date, of several tiles the first
    that has one."""
    each = over_points(pixels.select("r", "c").distinct().withColumns({"x": middle("c"), "y": middle("r")}), polygons, edge=False)
    by_tile = each.groupBy("r", "c", "tile").agg(F.max_by(F.regexp_replace("acq_date", "-", "").cast("int"), "place").alias("date"))
    first = by_tile.where("date > 0").groupBy("r", "c").agg(F.min_by("date", "tile").alias("date"))
    return pixels.select("r", "c").distinct().join(first, ["r", "c"], "left").select("r", "c", F.coalesce("date", F.lit(0)).alias("date"))


def within(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """The pixels whose middle lies in a polygon."""
    held = over_points(pixels.select("r", "c").distinct().withColumns({"x": middle("c"), "y": middle("r")}), polygons, edge=False).select("r", "c").distinct()
    return pixels.join(held, ["r", "c"], "left_semi")


def touched(polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """The polygons' columns with each pixel (r, c) whose square meets the polygon."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"box.{a}") / size).cast("int"), F.floor(F.col(f"box.{b}") / size).cast("int")))
    asked = measured(polygons).withColumn("r", span("ymin", "ymax")).withColumn("c", span("xmin", "xmax"))
    return asked.where(shapes.meets_square(F.col("sides"), F.col("c") * F.lit(size), F.col("r") * F.lit(size), F.lit(size))).drop("sides", "box", "rings")


def excluded(px: DataFrame, footprints: DataFrame, strict: bool = False, clearance: float = 2.0) -> DataFrame:
    """Pixels (r, c, h) to leave out: strict, every one that a footprint touches; else those on an active footprint with a height
    above 0, no higher than roof + clearance and no lower than its bottom. A null height is left out in strict mode alone."""
    if strict:
        return px.join(touched(footprints.select("rings")).select("r", "c").distinct(), ["r", "c"], "left_semi").select("r", "c", "h")
    solid = touched(footprints.where("state = 'active' and roof > 0").select("rings", "roof", "bottom"))
    return px.join(solid, ["r", "c"]).where((F.col("h") <= F.col("roof") + clearance) & (F.col("h") >= F.col("bottom"))).select("r", "c", "h").distinct()


def clipped(label: DataFrame, footprints: DataFrame) -> DataFrame:
    """Crown pixels (r, c, tree_id) that no footprint touches."""
    return label.join(touched(footprints.select("rings")).select("r", "c").distinct(), ["r", "c"], "left_anti")


def crown_status(label: DataFrame, footprints: DataFrame) -> DataFrame:
    """tree_id, status (2 if an unresolved footprint meets the crown, 1 an active one, 0 absent ones only), building_height (the
    highest roof above 0 of the active ones) of crowns that meet a footprint."""
    met = label.join(touched(footprints.select("rings", "fid", "state", "roof")), ["r", "c"])
    active = F.col("state") == "active"
    return met.groupBy("tree_id").agg(
        F.when(F.bool_or(F.col("state") == "unknown"), 2).when(F.bool_or(active), 1).otherwise(0).alias("status"),
        F.max(F.when(active & (F.col("roof") > 0), F.col("roof"))).alias("building_height"),
    )


def crown_iou(label: DataFrame, reference: DataFrame, least: float = 0.5) -> DataFrame:
    """ref_id, best (the largest share of the union with a found crown, 0 without one), matched; crowns and reference polygons
    as the pixels whose middle they hold."""
    pixels = touched(reference.select("rings", "ref_id")).select("r", "c", "ref_id")
    held = over_points(pixels.withColumns({"x": middle("c"), "y": middle("r"), "own": F.col("ref_id")}).drop("ref_id"), reference.select("rings", "ref_id"), edge=False).where("own = ref_id").select("r", "c", "ref_id")
    sizes, own = label.groupBy("tree_id").agg(F.count("*").alias("n")), held.groupBy("ref_id").agg(F.count("*").alias("m"))
    both = held.join(label, ["r", "c"]).groupBy("ref_id", "tree_id").agg(F.count("*").alias("both"))
    share = both.join(sizes, "tree_id").join(own, "ref_id").select("ref_id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("iou"))
    best = share.groupBy("ref_id").agg(F.max("iou").alias("best"))
    return reference.select("ref_id").distinct().join(best, "ref_id", "left").select("ref_id", F.coalesce("best", F.lit(0.0)).alias("best")).withColumn("matched", F.col("best") >= least)


def constrained(trees: DataFrame, label: DataFrame, canopy: DataFrame, footprints: DataFrame, most_shift: float = 2.0, top_share: float = 0.85, terrain: DataFrame | None = None) -> DataFrame:
    """Trees whose stem stands on a building, moved to supported canopy of their own crown or rejected.

    trees: tree_id, stem_x, stem_y and, with a terrain (r, c, ground), height_m and ground_m; label: r, c, tree_id; canopy: r, c, h.
    A stem that a solid active footprint covers is moved to the pixel nearest to the middle of the crown's pixels that no such
    footprint of this crown touches, weighted by their height over top_share of the highest (all alike if none is over it).
    Returns tree_id, accepted, reason, status (3 moved), shift, building_height, stem_x, stem_y, old_x, old_y, and height_m and
    ground_m if there is a terrain; the slope of a moved stem is no longer known, so callers null it."""
    solid = (F.col("state") == "active") & ~(F.coalesce("bottom", F.lit(0.0)) > 0)
    meets = label.join(touched(footprints.select("rings", "fid", "state", "bottom")), ["r", "c"]).select("tree_id", "fid").distinct()
    points = trees.select("tree_id", F.col("stem_x").alias("x"), F.col("stem_y").alias("y"))
    over = over_points(points, footprints.select("rings", "fid", "state", "bottom")).join(meets, ["tree_id", "fid"], "left_semi")
    stands = over.groupBy("tree_id").agg(F.bool_or(solid).alias("conflict"), F.bool_or(F.col("state") == "unknown").alias("unresolved"))
    asked = stands.where("conflict").select("tree_id")
    forbidden = touched(footprints.where(solid).select("rings", "fid")).join(meets.join(asked, "tree_id", "left_semi"), "fid").select("tree_id", "r", "c").distinct()
    free = label.join(asked, "tree_id", "left_semi").join(canopy.where("h is not null"), ["r", "c"]).join(forbidden, ["tree_id", "r", "c"], "left_anti")
    highest = free.groupBy("tree_id").agg(F.max("h").alias("top"))
    weighed = free.join(highest, "tree_id").withColumn("w", F.greatest(F.col("h") - F.col("top") * top_share, F.lit(0.0)))
    mean = lambda n: F.when(F.sum("w") > 0, F.sum(F.col("w") * middle(n)) / F.sum("w")).otherwise(F.avg(middle(n)))
    centre = weighed.groupBy("tree_id").agg(mean("r").alias("mean_r"), mean("c").alias("mean_c"))
    far = (middle("r") - F.col("mean_r")) * (middle("r") - F.col("mean_r")) + (middle("c") - F.col("mean_c")) * (middle("c") - F.col("mean_c"))
    placed = weighed.join(centre, "tree_id").groupBy("tree_id").agg(F.min_by(F.struct("r", "c"), F.struct(far, F.col("r"), F.col("c"))).alias("p")).select("tree_id", "p.r", "p.c")
    own = trees.join(stands, "tree_id", "left").join(placed, "tree_id", "left").join(crown_status(label, footprints), "tree_id", "left")
    if terrain is not None:
        own = own.join(terrain.select("r", "c", F.col("ground").alias("new_ground")), ["r", "c"], "left")
    own = own.withColumns({"conflict": F.coalesce("conflict", F.lit(False)), "unresolved": F.coalesce("unresolved", F.lit(False)), "new_x": middle("c"), "new_y": middle("r")})
    own = own.withColumn("away", F.hypot(F.col("new_x") - F.col("stem_x"), F.col("new_y") - F.col("stem_y")))
    reason = F.when(F.col("conflict") & F.col("r").isNull(), "no same-crown support outside building").when(F.col("conflict") & (F.col("away") > most_shift), "supported outside estimate exceeds declared shift limit").when(F.col("unresolved"), "temporal evidence unresolved at estimated stem")
    own = own.withColumn("reason", reason).withColumn("moved", F.col("conflict") & F.col("reason").isNull())
    out = own.select(
        "tree_id", F.col("reason").isNull().alias("accepted"), "reason", F.when(F.col("moved"), 3).otherwise(F.coalesce("status", F.lit(0))).alias("status"), F.when(F.col("moved"), F.col("away")).otherwise(0.0).alias("shift"), "building_height",
        F.when(F.col("moved"), F.col("new_x")).otherwise(F.col("stem_x")).alias("stem_x"), F.when(F.col("moved"), F.col("new_y")).otherwise(F.col("stem_y")).alias("stem_y"), F.col("stem_x").alias("old_x"), F.col("stem_y").alias("old_y"),
        *([F.when(F.col("moved"), F.col("height_m") + F.col("ground_m") - F.col("new_ground")).otherwise(F.col("height_m")).alias("height_m"), F.when(F.col("moved"), F.col("new_ground")).otherwise(F.col("ground_m")).alias("ground_m")] if terrain is not None else []),
    )
    return out


def adjusted(trees: DataFrame, moved: Column, x: Column, y: Column, ground: Column | None = None) -> DataFrame:
    """trees with the stem at (x, y) where moved: the distance from the top follows, the slope is unknown, and with a ground the
    height loses what the ground gains (null where either is unknown)."""
    new = {"stem_x": F.when(moved, x).otherwise(F.col("stem_x")), "stem_y": F.when(moved, y).otherwise(F.col("stem_y"))}
    if "trunk_from_top_m" in trees.columns:
        new["trunk_from_top_m"] = F.when(moved, F.hypot(x - F.col("top_x"), y - F.col("top_y"))).otherwise(F.col("trunk_from_top_m"))
    if "slope_deg" in trees.columns:
        new["slope_deg"] = F.when(~moved, F.col("slope_deg"))
    if ground is not None:
        new |= {"height_m": F.when(moved, F.col("height_m") + F.col("ground_m") - ground).otherwise(F.col("height_m")), "ground_m": F.when(moved, ground).otherwise(F.col("ground_m"))}
    return trees.withColumns(new)
