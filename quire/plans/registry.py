"""All queries of the library and their SQL, whatever module has them."""

from __future__ import annotations

from quire.plans import catalog, families, golden, whole
from quire.plans.catalog import flagship, oracle_sql, queries

__all__ = ["catalog", "families", "flagship", "golden", "oracle_sql", "queries", "whole"]
