"""The registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from codestrata.plans.oracles import oracle_sql
from codestrata.plans.queries import queries

__all__ = ["oracle_sql", "queries"]
