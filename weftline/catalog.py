"""All registered queries of the engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from weftline.plans import graph_queries, log_queries, source_queries

QUERIES: dict = graph_queries.QUERIES | log_queries.QUERIES | source_queries.QUERIES
ORACLES: dict[str, str] = graph_queries.ORACLES | log_queries.ORACLES | source_queries.ORACLES
