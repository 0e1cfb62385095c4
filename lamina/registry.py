"""Queries of the imaging operators and their SQL, by name."""

from __future__ import annotations

from lamina import queries

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
FLAGSHIP = queries.stitch
