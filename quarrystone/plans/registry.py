"""All queries of the register operators, with the SQL each is held against."""

from __future__ import annotations

from quarrystone.plans import export_queries, linkage_queries, relational_queries, survival_queries  # noqa: F401  (modules register their queries as they are imported)
from quarrystone.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
