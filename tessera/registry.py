"""All queries of the library's own operators, and the SQL to hold them against."""

from __future__ import annotations

from .queries import learning, logs, models, objects, pixels, processes, regions, rollups, runs, shapes, small, tables

MODULES = (rollups, logs, processes, runs, pixels, regions, objects, shapes, learning, models, tables, small)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update(_m.ORACLE_SQL)
