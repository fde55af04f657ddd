"""Terrain services: layer metadata, availability, and quantized-mesh tiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

LAYER = "struct<scheme:string,tiles:array<string>,version:string,maxzoom:int,available:string,valid_bounds:array<double>>"


def layer_metadata(df: DataFrame, json_col: str, max_zoom: int) -> DataFrame:
    """Metadata documents: y_origin (south for tms, else north), zoom limit (the smaller of both), tiles, version, bounds."""
    m = df.withColumn("_m", F.from_json(json_col, LAYER))
    return m.select(
        *df.columns,
        F.when(F.col("_m.scheme") == "slippyMap", "north").otherwise("south").alias("y_origin"),
        F.least(F.coalesce("_m.maxzoom", F.lit(max_zoom)), F.lit(max_zoom)).alias("max_zoom"),
        F.get(F.col("_m.tiles"), F.lit(0)).alias("template"),
        F.coalesce("_m.version", F.lit("")).alias("version"),
        F.when(F.size("_m.valid_bounds") == 4, F.col("_m.valid_bounds")).alias("valid_bounds"),
        F.col("_m.available").alias("available"),
    )


def availability_ranges(df: DataFrame, json_col: str = "available") -> DataFrame:
    """(z, start_x, end_x, start_y, end_y) of availability lists by level.

    A value that is no array of arrays gives no rows; malformed ranges inside a
    level are left out alone.
    """
    levels = F.from_json(json_col, "array<array<struct<startX:string,endX:string,startY:string,endY:string>>>")
    rest = [c for c in df.columns if c != json_col]
    each = df.select(*rest, F.posexplode(levels).alias("z", "_l")).select(*rest, "z", F.explode("_l").alias("_r"))
    number = lambda c: F.col(f"_r.{c}").try_cast("bigint")
    out = each.select(*rest, "z", number("startX").alias("start_x"), number("endX").alias("end_x"), number("startY").alias("start_y"), number("endY").alias("end_y"))
    return out.where("start_x is not null and end_x is not null and start_y is not null and end_y is not null")


def decode_mesh(payload: bytes) -> dict:
    """One quantized-mesh tile: heights range, channels u, v, h (0..32767) and triangle indices.

    Zigzag deltas are summed modulo 2**16, and an index is the number of zero
    codes before it less its code, as array operations.
    """
    low, high = struct.unpack_from("<ff", payload, 24)
    (n,) = struct.unpack_from("<I", payload, 88)
    codes = np.frombuffer(payload, "<u2", 3 * n, 92).reshape(3, n).astype(np.int64)
    channels = np.cumsum((codes >> 1) ^ -(codes & 1), axis=1) & 0xFFFF
    wide = n > 65536
    at = 92 + 6 * n
    at += -at % (4 if wide else 2)
    (triangles,) = struct.unpack_from("<I", payload, at)
    raw = np.frombuffer(payload, "<u4" if wide else "<u2", 3 * triangles, at + 4).astype(np.int64)
    zeros = np.cumsum(raw == 0)
    return {"low": low, "high": high, "u": channels[0], "v": channels[1], "h": channels[2], "indices": zeros - (raw == 0) - raw}


def read_meshes(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Decoded tiles: ``low``, ``high``, arrays ``u``, ``v``, ``h``, ``indices`` in place of the payload.

    A payload that is null or cut short gives nulls.
    """
    names = [c for c in df.columns if c != payload_col]
    schema = StructType(df.select(*names).schema.fields)
    for c in ("low", "high"):
        schema = schema.add(c, "double")
    for c in ("u", "v", "h", "indices"):
        schema = schema.add(c, ArrayType(LongType()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(batch.schema.get_field_index(payload_col)).to_pylist():
                try:
                    rows.append(decode_mesh(p) if p else {})
                except (struct.error, ValueError):
                    rows.append({})
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            numbers = [pa.array([r.get(c) for r in rows], pa.float64()) for c in ("low", "high")]
            lists = [pa.array([None if c not in r else r[c].tolist() for r in rows], pa.list_(pa.int64())) for c in ("u", "v", "h", "indices")]
            yield pa.RecordBatch.from_arrays([*kept, *numbers, *lists], [*names, "low", "high", "u", "v", "h", "indices"])

    return df.mapInArrow(decode, schema)


def encode_mesh(u: np.ndarray, v: np.ndarray, h: np.ndarray, indices: np.ndarray, low: float, high: float) -> bytes:
    """The inverse of ``decode_mesh``, for fixtures and sinks; vertices must be in order of their first use."""
    n = len(u)
    zigzag = lambda x: ((d << 1) ^ (d >> 63)).astype("<u2") if len(d := np.diff(np.asarray(x, np.int64), prepend=0)) else d
    seen = np.maximum.accumulate(np.concatenate(([-1], np.asarray(indices, np.int64))))[:-1] + 1
    codes = seen - np.asarray(indices, np.int64)
    body = struct.pack("<3d2f4d3d", 0, 0, 0, low, high, 0, 0, 0, 0, 0, 0, 0) + struct.pack("<I", n) + b"".join(zigzag(c).tobytes() for c in (u, v, h))
    wide = n > 65536
    body += b"\0" * (-len(body) % (4 if wide else 2))
    return body + struct.pack("<I", len(indices) // 3) + codes.astype("<u4" if wide else "<u2").tobytes()


def vertices(meshes: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """One row per vertex: number, lng, lat and height of meshes that carry their tile's west, south, east, north."""
    part = lambda c: F.get(F.col(c), F.col("i")).cast("double") / 32767
    each = meshes.where("u is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.size("u") - 1)))
    rest = [c for c in meshes.columns if c not in ("u", "v", "h", "indices", "low", "high")]
    return each.select(
        *rest,
        "i",
        (F.col("west") + part("u") * (F.col("east") - F.col("west"))).alias("lng"),
        (F.col("south") + part("v") * (F.col("north") - F.col("south"))).alias("lat"),
        ((F.col("low") + part("h") * (F.col("high") - F.col("low"))) * exaggeration).alias("height"),
    )
