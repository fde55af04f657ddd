"""Contents of 3D tiles, binary glTF with or without a batched model's header, as tables of vertices and triangles."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.anchoring import applied

#: Fixed values of the format: types of components and numbers of components.
COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
#: Rows that leave a task at once.
CHUNK = 65_536


def unwrapped(data: Column) -> Column:
    """The binary glTF inside a batched model (header of 28 bytes, then four tables of stated lengths); anything else passes through."""
    word = lambda at: F.conv(F.hex(F.reverse(F.substring(data, at + 1, 4))), 16, 10).cast("long")
    tables = sum((word(at) for at in (12, 16, 20, 24)), F.lit(28))
    return F.when((F.substring(data, 1, 4) == F.lit(b"b3dm")) & (F.octet_length(data) >= 28), F.substring(data, (tables + 1).cast("int"), F.octet_length(data))).otherwise(data)


def _document(data: bytes) -> tuple[dict, list[bytes]]:
    """The document of a binary glTF and its buffers; ValueError if it is none or a buffer lies elsewhere."""
    if len(data) < 20 or data[:4] != b"glTF" or struct.unpack_from("<I", data, 4)[0] != 2:
        raise ValueError("no binary glTF of version 2")
    chunks, at = {}, 12
    while at + 8 <= len(data):
        n, kind = struct.unpack_from("<I4s", data, at)
        if at + 8 + n > len(data):
            raise ValueError("a chunk is cut off")
        chunks.setdefault(kind, data[at + 8 : at + 8 + n])
        at += 8 + n
    doc = json.loads(chunks.get(b"JSON", b"null"))
    if not isinstance(doc, dict):
        raise ValueError("no document")
    buffers = []
    for b in doc.get("buffers", []):
        uri = b.get("uri")
        if uri is None:
            buffers.append(chunks.get(b"BIN\0", b""))
        elif uri.startswith("data:"):
            buffers.append(base64.b64decode(uri.split(",", 1)[1]))
        else:
            raise ValueError("a buffer lies elsewhere")
    return doc, buffers


def _accessor(doc: dict, buffers: list[bytes], index: int) -> np.ndarray:
    """The elements of an accessor, one a row; normalised whole numbers become shares of one."""
    a = doc["accessors"][index]
    kind, width, n = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
    if "bufferView" not in a:
        return np.zeros((n, width), kind)
    if "sparse" in a:
        raise ValueError("sparse accessors are not read")
    view = doc["bufferViews"][a["bufferView"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    step = view.get("byteStride") or kind.itemsize * width
    blob = buffers[view["buffer"]]
    if n and start + step * (n - 1) + kind.itemsize * width > len(blob):
        raise ValueError("an accessor reaches beyond its buffer")
    out = np.ndarray((n, width), kind, blob, start, (step, kind.itemsize)) if n else np.zeros((0, width), kind)
    return np.maximum(out / float(np.iinfo(kind).max), -1.0) if a.get("normalized") else out


def _local(node: dict) -> np.ndarray:
    """A node's transform to its parent."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def _triangles(mode: int, index: np.ndarray) -> np.ndarray:
    """Triangles of a primitive: separate ones, a strip or a fan; points and lines have none."""
    if mode == 4:
        return index[: len(index) // 3 * 3].reshape(-1, 3)
    k = np.arange(max(len(index) - 2, 0))
    if mode == 5:
        odd = k % 2
        return index[np.stack((k, k + 1 + odd, k + 2 - odd), 1)]
    if mode == 6:
        return index[np.stack((np.zeros_like(k), k + 1, k + 2), 1)]
    return np.zeros((0, 3), np.int64)


def primitives(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """Positions, normals and triangles of each primitive of a binary glTF's scene, in the scene's frame (Y up)."""
    doc, buffers = _document(data)
    scenes = doc.get("scenes")
    roots = scenes[doc.get("scene", 0)].get("nodes", []) if scenes else range(len(doc.get("nodes", [])))
    todo = [(r, np.eye(4), 0) for r in reversed(list(roots))]
    while todo:
        k, above, depth = todo.pop()
        if depth > len(doc["nodes"]):
            raise ValueError("the nodes run in a circle")
        node = doc["nodes"][k]
        world = above @ _local(node)
        for p in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else ():
            place = _accessor(doc, buffers, p["attributes"]["POSITION"]).astype(float)
            normal = _accessor(doc, buffers, p["attributes"]["NORMAL"]).astype(float) if "NORMAL" in p["attributes"] else None
            index = _accessor(doc, buffers, p["indices"])[:, 0].astype(np.int64) if "indices" in p else np.arange(len(place))
            if len(index) and index.max() >= len(place):
                raise ValueError("an index beyond the vertices")
            if normal is not None:
                normal = normal @ np.linalg.inv(world[:3, :3])
                size = np.linalg.norm(normal, axis=1, keepdims=True)
                normal = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0)
            yield place @ world[:3, :3].T + world[:3, 3], normal, _triangles(p.get("mode", 4), index)
        todo += [(c, world, depth + 1) for c in reversed(node.get("children", []))]


def _rows(df: DataFrame, name_col: str, data_col: str, make, schema: str, names: list[str]) -> DataFrame:
    """A narrow pass over contents that yields what ``make`` says of each, in chunks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                if data.as_py() is None:
                    continue
                for columns in make(data.as_py()):
                    n = len(columns[0])
                    for at in range(0, n, CHUNK):
                        m = min(CHUNK, n - at)
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * m, name.type), *[pa.array(c[at : at + m]) if c is not None else pa.nulls(m, pa.float64()) for c in columns]], names)

    kind = df.schema[name_col].dataType.simpleString()
    return df.select(F.col(name_col).alias("name"), unwrapped(F.col(data_col)).alias("data")).mapInArrow(read, f"name {kind}, {schema}")


def content_vertices(df: DataFrame, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """(name, primitive, id, x, y, z, nx, ny, nz) of every vertex of each content, turned to Z up.

    A content that is no glTF, or is damaged, gives no rows: see ``content_states``.  Null contents give none either.
    """

    def make(data: bytes):
        try:
            made = list(primitives(data))
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            return
        for k, (p, normal, _) in enumerate(made):
            n = len(p)
            up = lambda v: (v[:, 0], -v[:, 2], v[:, 1])
            yield (np.full(n, k, np.int32), np.arange(n, dtype=np.int64), *up(p), *(up(normal) if normal is not None else (None, None, None)))

    return _rows(df, name_col, data_col, make, "primitive int, id bigint, x double, y double, z double, nx double, ny double, nz double", ["name", "primitive", "id", "x", "y", "z", "nx", "ny", "nz"])


def content_triangles(df: DataFrame, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """(name, primitive, t, a, b, c) of every triangle of each content, by the ids of its primitive's vertices."""

    def make(data: bytes):
        try:
            made = list(primitives(data))
        except (ValueError, KeyError, IndexError, TypeError, struct.error):
            return
        for k, (_, _, t) in enumerate(made):
            yield (np.full(len(t), k, np.int32), np.arange(len(t), dtype=np.int64), *(np.ascontiguousarray(t[:, i], np.int64) for i in range(3)))

    return _rows(df, name_col, data_col, make, "primitive int, t bigint, a bigint, b bigint, c bigint", ["name", "primitive", "t", "a", "b", "c"])


def content_states(df: DataFrame, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """(name, state, problem, primitives, vertices, triangles) of each content, null ones too: ``loaded``, or ``failed`` and why."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    sizes = [(len(p), len(t)) for p, _, t in primitives(data or b"")]
                    rows.append(("loaded", None, len(sizes), sum(s for s, _ in sizes), sum(t for _, t in sizes)))
                except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
                    rows.append(("failed", f"{type(e).__name__}: {e}", 0, 0, 0))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]] if rows else [batch.column(0), *[pa.array([], k) for k in kinds]], ["name", "state", "problem", "primitives", "vertices", "triangles"])

    kind = df.schema[name_col].dataType.simpleString()
    return df.select(F.col(name_col).alias("name"), unwrapped(F.col(data_col)).alias("data")).mapInArrow(read, f"name {kind}, state string, problem string, primitives bigint, vertices bigint, triangles bigint")


def placed(vertices: DataFrame, transforms: DataFrame, name_col: str = "name") -> DataFrame:
    """The vertices moved by the column-major ``transform`` of their content (name, transform): a node's own, or one ``in_frame`` of the map.

    Transforms are one row a content; vertices of a content without one are left out.
    """
    met = vertices.join(transforms.select(F.col(name_col).alias("name"), F.col("transform").alias("_m")), "name")
    x, y, z = applied(F.col("_m"), (F.col("x"), F.col("y"), F.col("z")))
    return met.withColumns({"x": x, "y": y, "z": z}).select(*vertices.columns)

