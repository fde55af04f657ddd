"""Named queries with their SQL twins, gathered from ``tessera.queries``."""

from __future__ import annotations

from tessera.queries import conversion, geo, meshes, pixels, sources, terrain, tilesets, vector, views  # noqa: F401  they register their queries
from tessera.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
