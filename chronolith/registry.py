"""All queries over the reference's operators, and the SQL that must give the same rows.

A plan module registers a query with @query(name, sql); the SQL is DuckDB's, over the same tables.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.storage import keep_batches_small

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "r1_bm25_topk"
PLANS = ("temporal", "retrieval", "evaluation", "calibration", "metrics", "localisation", "serving", "graph", "text", "sources", "streams", "helpers")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; Arrow functions over it take batches of bounded bytes."""
    keep_batches_small(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in PLANS:
        importlib.import_module(f"chronolith.plans.{name}")
