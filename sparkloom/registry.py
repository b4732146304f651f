"""All registered queries, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from sparkloom.plans import features, fusion, graphs, indexing, lexical, routing, vectors  # noqa: F401
from sparkloom.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
