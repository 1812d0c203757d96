"""All queries of the graph engine over the driver tables, and their SQL."""

from __future__ import annotations

from .plans import lookup, retrieval, structure, traversal  # noqa: F401  (they register their queries)

QUERIES = lookup.QUERIES
SQL = lookup.SQL
