"""All queries of the library, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import base
from palimpsest.plans import causal_queries, chat_queries, recall_queries, state_queries, stream_queries, world_queries  # noqa: F401  each module registers its queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["o_e1_end_to_end"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
