"""All queries of the library, with their oracles."""

from __future__ import annotations

from . import composed, doctrine, ground, learning, pictures, pointwise, raster, rasters, relational, series, shapes, streams  # noqa: F401  (they register)
from .build import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
