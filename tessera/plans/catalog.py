"""Imports every module of queries, which registers them."""

from tessera.plans import agile_queries, audit_queries, content_queries, document_queries, envelope_queries, flow_queries, import_queries, macro_queries, report_queries, storage_queries, store_queries, stream_queries  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
