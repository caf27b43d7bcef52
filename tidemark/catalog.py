"""The registered queries of every operator family and their DuckDB equivalents."""

from __future__ import annotations

from tidemark.plans import queries_data, queries_functions, queries_metadata, queries_relational, queries_validation  # noqa: F401  (each registers its queries)
from tidemark.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "val_l3_chunk"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
