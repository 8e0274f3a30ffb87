"""All queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import operator_queries, parser_queries, scalar_queries, state_queries

QUERIES = scalar_queries.QUERIES | state_queries.QUERIES | operator_queries.QUERIES | parser_queries.QUERIES
ORACLES = scalar_queries.ORACLES | state_queries.ORACLES | operator_queries.ORACLES | parser_queries.ORACLES
