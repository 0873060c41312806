"""The library's registered queries and the SQL that each must agree with."""

from __future__ import annotations

from . import cloud, depth, geometry, projection, raster, segmentation, sources

_MODULES = [segmentation, depth, projection, geometry, raster, cloud, sources]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
