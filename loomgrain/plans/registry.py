"""The library's queries over the given tables, and the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrain.plans import block_queries, file_queries, graph_queries, image_queries, region_queries
from loomgrain.plans.base import ORACLES, REGISTERED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = REGISTERED
ORACLE_SQL: dict[str, str] = ORACLES
FLAGSHIP = region_queries.w2_region_texture

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "block_queries", "file_queries", "graph_queries", "image_queries", "region_queries"]
