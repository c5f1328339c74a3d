"""All registered queries outside the corpus operators, with their DuckDB SQL."""

from __future__ import annotations

from tiegrid.plans import queries_catalog, queries_features, queries_grid, queries_jobs, queries_points, queries_raster
from tiegrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_catalog", "queries_features", "queries_grid", "queries_jobs", "queries_points", "queries_raster"]
