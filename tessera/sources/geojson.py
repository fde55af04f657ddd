"""GeoJSON collections as rows of features, lines and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.staging import Staging

GEOMETRY = "struct<type:string,coordinates:string,geometries:string>"


def once(value: Column) -> Column:
    """``value`` as a generator of one row: Spark repeats an expression in every filter and column above it, but not a generated one."""
    return F.explode(F.array(value))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, id, properties, type, coordinates, geometries) of each feature of the documents under ``path``.

    A document that is not a FeatureCollection gives no rows.  Coordinates stay
    JSON text until a geometry type says how deep they are.
    """
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return features(docs, "value")


def features(docs: DataFrame, json_col: str) -> DataFrame:
    """The features of documents in a column; see ``read_features``."""
    shape = "struct<type:string,features:array<struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:string>>>>"
    rest = [c for c in docs.columns if c != json_col]
    parsed = docs.select(*rest, once(F.from_json(json_col, shape)).alias("d")).where("d.type = 'FeatureCollection'")
    each = parsed.select(*rest, F.posexplode("d.features").alias("ordinal", "f"))
    return each.select(*rest, "ordinal", "f.id", "f.properties", "f.geometry.type", "f.geometry.coordinates", "f.geometry.geometries")


def _point(pair: Column) -> Column:
    """A struct (x, y) of the first two numbers, null if either is none."""
    x, y = F.get(pair, F.lit(0)).try_cast("double"), F.get(pair, F.lit(1)).try_cast("double")
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y")))


def _line(points: Column) -> Column:
    return F.filter(F.transform(points, _point), lambda p: p.isNotNull())


def lines(df: DataFrame) -> DataFrame:
    """One row per line of two valid points or more; ``line`` is an array of (x, y).  Other types give nothing."""
    text = F.col("coordinates")
    one = F.when(F.col("type") == "LineString", F.array(F.from_json(text, "array<array<string>>")))
    many = F.when(F.col("type") == "MultiLineString", F.from_json(text, "array<array<array<string>>>"))
    cut = F.filter(F.transform(F.coalesce(one, many), _line), lambda p: F.size(p) >= 2)
    return df.where(F.col("type").isin("LineString", "MultiLineString")).withColumn("line", F.explode(cut)).drop("coordinates", "geometries")


def polygons(df: DataFrame) -> DataFrame:
    """One row per polygon, of collections too; ``rings`` is an array of arrays of (x, y), outer first.

    Other types give nothing.  Collections may be nested to any depth: each round opens those of one level, until none is left.
    """
    staging = Staging(df.sparkSession, "polygons")
    rest = [c for c in df.columns if c not in ("type", "coordinates", "geometries")]
    text = F.col("coordinates")
    one = F.when(F.col("type") == "Polygon", F.array(F.from_json(text, "array<array<array<string>>>")))
    many = F.when(F.col("type") == "MultiPolygon", F.from_json(text, "array<array<array<array<string>>>>"))

    def direct(here: DataFrame) -> DataFrame:
        found = here.where(F.col("type").isin("Polygon", "MultiPolygon")).select(*rest, once(F.coalesce(one, many)).alias("_all")).select(*rest, F.explode("_all").alias("p"))
        return found.select(*rest, once(F.transform("p", _line)).alias("rings")).where(F.size("rings") > 0)

    out, level = direct(df), 0
    nested = staging.keep(df.where("type = 'GeometryCollection'").select(*rest, "geometries"), "level0")
    while nested.limit(1).count():
        inner = nested.select(*rest, F.explode(F.from_json("geometries", "array<struct<type:string,coordinates:string,geometries:string>>")).alias("g")).select(*rest, "g.type", "g.coordinates", "g.geometries")
        out, level = out.unionByName(direct(inner)), level + 1
        nested = staging.keep(inner.where("type = 'GeometryCollection'").select(*rest, "geometries"), f"level{level}")
    return out
