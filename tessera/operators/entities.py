"""Drawn entities and scene primitives: conversion both ways and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity type, primitive kind and the points that a drawing needs at least.
KINDS = [("line", "Polyline", 2), ("polygon", "Polygon", 3), ("point", "Box", 1), ("sphere", "Sphere", 1)]
DEFAULT_SIZE = 10.0


def _case(x: Column, pairs: list[tuple[str, object]]) -> Column:
    out = None
    for key, value in pairs:
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out


def to_primitive(entities: DataFrame) -> DataFrame:
    """``entities`` (type, points, ...) with ``kind``, ``finished`` and the default ``size`` of solids; unknown types raise an error."""
    kind = _case(F.col("type"), [(t, k) for t, k, _ in KINDS])
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown entity type "), F.coalesce("type", F.lit("null")))).cast("string"))
    least = _case(F.col("type"), [(t, n) for t, _, n in KINDS])
    solid = F.col("type").isin("point", "sphere")
    return entities.withColumns({"kind": kind, "finished": F.size("points") >= least, "size": F.when(solid, DEFAULT_SIZE)}).drop("type")


def to_entity(primitives: DataFrame) -> DataFrame:
    """The way back: ``kind`` becomes ``type``."""
    return primitives.withColumn("type", _case(F.col("kind"), [(k, t) for t, k, _ in KINDS])).drop("kind", "finished", "size")


def to_json(primitives: DataFrame, out: str = "json") -> DataFrame:
    """Each primitive as a JSON text in place of its columns but the id."""
    return primitives.select("id", F.to_json(F.struct(F.col("kind").alias("primitiveType"), "points", "size")).alias(out))


def from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """The primitives of JSON texts; texts that are no primitive have a null kind."""
    shape = "struct<primitiveType:string,points:array<struct<x:double,y:double,z:double>>,size:double>"
    return texts.select("id", F.from_json(column, shape).alias("_p")).select("id", F.col("_p.primitiveType").alias("kind"), "_p.points", "_p.size")


#: Kinds with one place, and kinds with a line of places.
SOLIDS, LINES = ("Box", "Sphere"), ("Polyline", "Polygon")


def primitive_json(primitives: DataFrame, out: str = "json") -> DataFrame:
    """(id, json) of primitives (id, kind, points, style): a solid's ``position`` or a line's ``points`` as arrays of numbers, and the style.

    ``style`` is JSON text; null is an empty object.  Unknown kinds raise an error.
    """
    place = lambda p: F.array(p["x"], p["y"], p["z"])
    kind = F.when(F.col("kind").isin(*SOLIDS, *LINES), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null")))).cast("string"))
    body = F.to_json(F.struct(kind.alias("primitiveType"), F.col("id").cast("string").alias("id"), F.when(F.col("kind").isin(*SOLIDS), place(F.get("points", F.lit(0)))).alias("position"), F.when(F.col("kind").isin(*LINES), F.transform("points", place)).alias("points")))
    return primitives.select("id", F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"style":'), F.coalesce("style", F.lit("{}")), F.lit("}")).alias(out))


def primitive_rows(texts: DataFrame, column: str = "json") -> DataFrame:
    """(id, kind, points, style) of JSON texts as ``primitive_json`` makes them; a text that is none, or of an unknown kind, has a null kind."""
    shape = "struct<primitiveType:string,id:string,position:array<double>,points:array<array<double>>,style:string>"
    place = lambda p: F.struct(*[F.get(p, F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    parsed = texts.select(F.from_json(column, shape).alias("_p"))
    known = F.when(F.col("_p.primitiveType").isin(*SOLIDS, *LINES), F.col("_p.primitiveType"))
    points = F.coalesce(F.transform("_p.points", place), F.when(F.col("_p.position").isNotNull(), F.array(place(F.col("_p.position")))))
    return parsed.select(F.col("_p.id").alias("id"), known.alias("kind"), points.alias("points"), F.col("_p.style").alias("style"))
