"""Registered queries over the test tables, and the DuckDB SQL that checks each."""

from __future__ import annotations

from . import kv, measures, more, space, store

MODULES = [kv, store, space, measures, more]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in MODULES:
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
