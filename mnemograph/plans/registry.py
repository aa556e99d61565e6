"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemograph.plans import corpus, evaluation, graphs, streams, vectors

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (vectors, graphs, evaluation, corpus, streams)
QUERIES: dict[str, Query] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "rt3_graph_retrieval"
