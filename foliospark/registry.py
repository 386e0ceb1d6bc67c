"""Every registered query of the library but the training-data operators."""

from __future__ import annotations

from foliospark.plans import dom_queries, ledger_queries, library_queries, link_queries, record_queries, shelf_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (ledger_queries, text_queries, link_queries, dom_queries, library_queries, shelf_queries, record_queries, stream_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
