"""Building footprints: attribute parsing, the lifecycle predicate, overlay on pixels and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts that stand for no value, besides null.
NO_YEAR, NO_VALUE = ["", "none", "nan", "nat"], ["", "nan", "nat"]


def number(text: Column, strict: bool = False) -> Column:
    """'12 m' -> 12, '10 ft' -> 3.048, plain numbers, also with a sign or an exponent; not-a-number and infinity are null.
    Other text is null or, if strict, an error."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(m|ft)?\s*$"
    value, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    plain = F.trim(text).try_cast("double")
    plain = F.when(~F.isnan(plain) & (F.abs(plain) < F.lit(float("inf"))), plain)
    if strict:
        word = F.lower(F.trim(text)).rlike(r"^[-+]?(nan|inf|infinity)$")
        plain = F.when(text.isNotNull() & F.trim(text).try_cast("double").isNull() & ~word, F.raise_error(F.concat(F.lit("a building height must be numeric metres: "), text)).cast("double")).otherwise(plain)
    return F.when(value != "", F.when(unit == "ft", value.cast("double") * 0.3048).otherwise(value.cast("double"))).otherwise(plain)


def tag(tags: Column, key: str) -> Column:
    """A value of "key"=>"value" text, blanks allowed before the value, escapes undone; null if absent."""
    quoted = F.regexp_extract(tags, f'"{key}"=>\\s*("(?:[^"\\\\]|\\\\.)*")', 1)
    return F.when(quoted != "", F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "v string")["v"])


def field_value(row_tags: Column, *names: tuple[str, bool]) -> Column:
    """The first of the columns and tags of these names, in the order column, tag, next column, next tag; null-like texts
    of a column count as absent."""
    column = lambda n: F.when(~F.lower(F.col(n).cast("string")).isin(NO_VALUE), F.col(n).cast("string"))
    return F.coalesce(*[x for n, has in names for x in ([column(n)] if has else []) + [tag(row_tags, n)]])


def year(text: Column) -> Column:
    """A year of 1800 to 2200, or that of an ISO date; anything else is an error. Null stays null."""
    plain = F.when(text.rlike(r"^[0-9]{4}$") & text.try_cast("int").between(1800, 2200), text.try_cast("int"))
    dated = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.year(F.try_to_date(text, "yyyy-MM-dd")))
    return F.coalesce(plain, dated, F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("neither a year nor a date: "), text)).cast("int")))


def snapshot_year(path: Column, told: Column | None = None) -> Column:
    """The year that is told, else that of the date between double underscores in the file's name."""
    named = F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"__(?:asof-)?([0-9]{4}-[0-9]{2}-[0-9]{2})__", 1), F.lit(""))
    return year(named) if told is None else F.coalesce(year(told.cast("string")), year(named))


def optional_year(text: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD, a trailing .0 ignored -> the year; anything else null."""
    plain = F.regexp_replace(text, r"\.0$", "")
    return F.nullif(F.regexp_extract(plain, r"^([0-9]{4})(-[0-9]{2}(-[0-9]{2})?)?$", 1), F.lit("")).cast("int")


def attributes(footprints: DataFrame) -> DataFrame:
    """Adds roof, bottom (m), start_text, end_text, start, end: explicit columns first, then tags. Missing columns are absent values."""
    tags = F.col("other_tags") if "other_tags" in footprints.columns else F.lit(None).cast("string")
    value = lambda *names: field_value(tags, *[(n, n in footprints.columns) for n in names])
    start, end = value("construction_year", "start_date"), value("demolition_year", "end_date")
    real = lambda t: F.when(~F.lower(t).isin(NO_YEAR), t)
    return footprints.withColumns({"roof": number(value("height")), "bottom": F.coalesce(number(value("min_height")), F.lit(0.0)), "start_text": real(start), "end_text": real(end), "start": optional_year(real(start)), "end": optional_year(real(end))})


def observed(years: list[int], told: list[int] = ()) -> tuple[list[int], bool]:  # type: ignore[assignment]
    """The years between 1800 and 2200, or if none is given those told beforehand; and whether any is known."""
    held = sorted({int(y) for y in (years or told) if 1800 <= int(y) <= 2200})
    return held, bool(held)


def temporal(lo: int | None, hi: int | None, recent_years: int = 5, target: int | None = None, policy: str = "recent", known: bool = True) -> Column:
    """active, absent or unknown for the years observed, lo to hi. The order of the tests is part of the rule.

    Under the policy recent a target year stands for the years observed; without years, or without known years and such a
    target, all is unknown. Under another policy a near snapshot proves nothing."""
    start, end, snap = F.col("start"), F.col("end"), F.col("snapshot_year")
    aimed = target is not None and policy == "recent"
    if aimed:
        lo = hi = target
    if lo is None or hi is None or not (known or aimed):
        return F.lit("unknown")
    yes = lambda c: F.coalesce(c, F.lit(False))
    vague = (F.col("start_text").isNotNull() & start.isNull()) | (F.col("end_text").isNotNull() & end.isNull())
    near = yes(F.abs(F.lit(lo) - snap) <= recent_years) & yes(F.abs(F.lit(hi) - snap) <= recent_years) & F.lit(policy == "recent")
    return (
        F.when(vague, "unknown")
        .when(yes(start > hi) | yes(end < lo), "absent")
        .when(yes(start.between(lo, hi)) | yes(end.between(lo, hi)), "unknown")
        .when(yes(start < lo) & (yes(end > hi) | yes(snap >= hi)), "active")
        .when(near, "active")
        .otherwise("unknown")
    )


def touched(footprints: DataFrame) -> DataFrame:
    """fid with each pixel (r, c) whose unit square meets the box's inside."""
    rows = F.sequence(F.floor("ymin").cast("int"), (F.ceil("ymax") - 1).cast("int"))
    columns = F.sequence(F.floor("xmin").cast("int"), (F.ceil("xmax") - 1).cast("int"))
    return footprints.where("xmax > xmin and ymax > ymin").withColumn("r", F.explode(rows)).withColumn("c", F.explode(columns))


def excluded(px: DataFrame, footprints: DataFrame, clearance: float = 2.0) -> DataFrame:
    """Pixels on an active footprint whose height is no more than roof + clearance and at least its bottom."""
    solid = touched(footprints.where("state = 'active' and roof > 0").select("fid", "xmin", "xmax", "ymin", "ymax", "roof", "bottom"))
    return px.join(solid, ["r", "c"]).where((F.col("h") <= F.col("roof") + clearance) & (F.col("h") >= F.col("bottom"))).select("r", "c", "h").distinct()


def tree_status(trees: DataFrame, footprints: DataFrame) -> DataFrame:
    """tree_id, status (2 near an unknown building, 1 on an active one, else 0), building_height: footprints that cover the stem."""
    bucket = 16
    cells = footprints.withColumn("by", F.explode(F.sequence(F.floor(F.col("ymin") / bucket).cast("int"), F.floor(F.col("ymax") / bucket).cast("int")))).withColumn("bx", F.explode(F.sequence(F.floor(F.col("xmin") / bucket).cast("int"), F.floor(F.col("xmax") / bucket).cast("int"))))
    placed = trees.withColumns({"by": F.floor(F.col("y") / bucket).cast("int"), "bx": F.floor(F.col("x") / bucket).cast("int")})
    hit = placed.join(cells.select("by", "bx", "xmin", "xmax", "ymin", "ymax", "state", "roof"), ["by", "bx"]).where("x between xmin and xmax and y between ymin and ymax")
    stats = hit.groupBy("tree_id").agg(F.bool_or(F.col("state") == "unknown").alias("u"), F.bool_or(F.col("state") == "active").alias("a"), F.max(F.when(F.col("state") == "active", F.col("roof"))).alias("building_height"))
    return trees.join(stats, "tree_id", "left").select("tree_id", F.when(F.col("u"), 2).when(F.col("a"), 1).otherwise(0).alias("status"), "building_height")
