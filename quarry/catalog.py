"""Registry of every implemented query: Spark callables and DuckDB oracle SQL."""

from __future__ import annotations

from quarry import catalog_calls, catalog_flow, catalog_sensor

QUERIES = catalog_sensor.QUERIES | catalog_calls.QUERIES | catalog_flow.QUERIES
ORACLE = catalog_sensor.ORACLE | catalog_calls.ORACLE | catalog_flow.ORACLE
