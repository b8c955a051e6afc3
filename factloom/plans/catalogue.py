"""All queries of the library and their SQL."""

from __future__ import annotations

from factloom.plans import code, project, tables, texts

MODULES = (code, texts, tables, project)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
