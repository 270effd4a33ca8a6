"""Feeds derived from the benchmark tables, with the queries and oracles over them."""

from feedledger.workload import ingest_queries, enrich_queries, report_queries  # noqa: I001  sections in order
from feedledger.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "enrich_queries", "ingest_queries", "report_queries"]
