"""Registered queries of the core library and the SQL they are checked against."""

from __future__ import annotations

from ledgerlark import metric_queries, operator_queries, sql_shapes
from ledgerlark.streaming import stream_queries

QUERIES = {**metric_queries.QUERIES, **sql_shapes.QUERIES, **operator_queries.QUERIES, **stream_queries.QUERIES}
ORACLES = {**metric_queries.ORACLES, **sql_shapes.ORACLES, **operator_queries.ORACLES, **stream_queries.ORACLES}
