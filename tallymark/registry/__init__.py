"""Registered queries and their independent SQL, one module per subject."""

from tallymark.registry.core import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
