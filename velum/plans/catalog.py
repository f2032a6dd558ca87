"""The registered queries of the privacy and reconciliation operators, and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("text_queries", "record_queries", "config_queries")


def register(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with DuckDB SQL for its rows where SQL can express them."""

    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if oracle is not None:
            _ORACLES[query.__name__] = oracle
        return query

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"velum.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores. A table that has fewer splits than there are cores, as a small single file has, is dealt
    out before work that is heavy on each row; one with more, as any large table, stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts, spread."""
    return spread(table(spark, sf_dir, name).select(*columns))
