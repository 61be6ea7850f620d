"""The registry of the engine's own queries and their SQL."""

from __future__ import annotations

from loomspec.plans import queries_data, queries_gold, queries_rules

QUERIES: dict = queries_gold.QUERIES | queries_data.QUERIES | queries_rules.QUERIES
ORACLE_SQL: dict[str, str] = queries_gold.ORACLE_SQL | queries_data.ORACLE_SQL | queries_rules.ORACLE_SQL
