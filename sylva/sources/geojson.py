"""GeoJSON texts as columns: boxes, polygons, dated polygons. Documents are rows; nothing is parsed on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes

#: The innermost arrays of coordinates: their first two numbers.
PAIR = r"\[\s*(-?[0-9][0-9.eE+-]*)\s*,\s*(-?[0-9][0-9.eE+-]*)"
GEOMETRY = "struct<type:string,coordinates:string>"
DOCUMENT = f"struct<type:string,coordinates:string,geometry:{GEOMETRY},features:array<struct<geometry:{GEOMETRY},properties:map<string,string>>>>"


def geometries(document: Column) -> Column:
    """The geometries (type, coordinates as text) of a FeatureCollection, a Feature or a bare geometry."""
    doc = F.from_json(document, DOCUMENT)
    bare = F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates"))
    return F.when(doc["type"] == "FeatureCollection", F.transform(doc["features"], lambda f: f["geometry"])).otherwise(F.array(F.coalesce(doc["geometry"], bare)))


def rings(coordinates: Column, kind: Column) -> Column:
    """Rings of a Polygon's or MultiPolygon's coordinates, the repeated last corner dropped; null for other kinds."""
    flat = F.when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>")))
    open_ = lambda ring: F.when((F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    return F.transform(flat, lambda ring: F.transform(open_(ring), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def read(documents: DataFrame, column: str = "document") -> DataFrame:
    """documents with box (of the coordinates of all geometries) and polygons (the Polygon and MultiPolygon geometries alone).

    A text that is no GeoJSON, or has no coordinates, has a null box and no polygons."""
    shapes = documents.withColumn("_g", F.coalesce(geometries(F.col(column)), F.array().cast(f"array<{GEOMETRY}>")))
    texts = F.array_join(F.transform("_g", lambda g: F.coalesce(g["coordinates"], F.lit(""))), " ")
    numbers = lambda group: F.transform(F.regexp_extract_all(texts, F.lit(PAIR), F.lit(group)), lambda v: v.cast("double"))
    box = F.struct(F.array_min(numbers(1)).alias("xmin"), F.array_min(numbers(2)).alias("ymin"), F.array_max(numbers(1)).alias("xmax"), F.array_max(numbers(2)).alias("ymax"))
    return shapes.withColumns({"box": box, "polygons": F.filter("_g", lambda g: g["type"].isin("Polygon", "MultiPolygon"))}).drop("_g")


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """path, document: whole files as texts."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def features(documents: DataFrame, column: str = "document") -> DataFrame:
    """A row for each feature of FeatureCollections: place (its position), kind, rings, properties (map of texts); other columns stay."""
    own = documents.withColumn("_d", F.from_json(F.col(column), DOCUMENT)).select(*[c for c in documents.columns if c != column], F.posexplode("_d.features").alias("place", "_f"))
    kind, coordinates = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    point = F.from_json(coordinates, "array<double>")
    return own.withColumns({"kind": kind, "rings": rings(coordinates, kind), "x": F.when(kind == "Point", point[0]), "y": F.when(kind == "Point", point[1]), "properties": F.col("_f.properties")}).drop("_f")


def dated(documents: DataFrame, column: str = "document") -> DataFrame:
    """rings, acq_date, place of the dated polygons of image metadata; other columns (the tile) stay."""
    return features(documents, column).where("rings is not null").withColumn("acq_date", F.col("properties")["acq_date"]).drop("kind", "x", "y", "properties")


def reference_trees(found: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Reference features within the closed box: tops (x, y) if all are points, crowns (rings) if all are polygons, else an error.
    Features without a shape are left out. A polygon counts where the middle of its box lies."""
    some = found.where("kind is not null and (x is not null or size(rings) > 0)")
    kinds = some.agg(F.collect_set(F.when(F.col("kind") == "Point", "tops").when(F.col("kind").isin("Polygon", "MultiPolygon"), "crowns").otherwise("other")).alias("kinds"))
    sole = kinds.select(F.when((F.size("kinds") == 1) & (F.col("kinds")[0] != "other"), F.col("kinds")[0]).otherwise(F.raise_error(F.lit("neither points alone nor polygons alone")).cast("string")).alias("read_as"))
    box = shapes.box(F.col("rings"))
    middle = lambda n: F.coalesce(F.col(n), (box[f"{n}min"] + box[f"{n}max"]) / 2)
    return some.join(F.broadcast(sole)).where(middle("x").between(xmin, xmax) & middle("y").between(ymin, ymax))  # one row


def written(rows: DataFrame, rings_column: str = "rings", digits: int = 7) -> DataFrame:
    """feature: the text of a GeoJSON feature for each row, its other columns as properties; not-a-number is null."""
    close = lambda ring: F.concat(ring, F.slice(ring, 1, 1))
    coordinates = F.transform(F.col(rings_column), lambda ring: F.transform(close(ring), lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))))
    plain = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes if c != rings_column]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*plain).alias("properties"))
    return rows.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
