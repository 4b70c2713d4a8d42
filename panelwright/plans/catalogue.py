"""Queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from panelwright.plans import collection_queries, corpus_tables, identity_queries, keyed_queries, panel_queries, quality_queries, review_queries, tracker_queries

_PARTS = (panel_queries, quality_queries, identity_queries, keyed_queries, collection_queries, review_queries, tracker_queries, corpus_tables)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
