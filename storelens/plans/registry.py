"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def finalize(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so Spark and DuckDB agree bit-for-bit."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def rounded(sql: str, double_cols: list[str], digits: int = DIGITS) -> str:
    """Wrap oracle SQL so the listed double columns are rounded like ``finalize``."""
    if not double_cols:
        return sql
    rep = ", ".join(f'(round("{c}", {digits}) + 0.0) AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame query and its oracle."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[name] = wrapped
        if sql is not None:
            ORACLE[name] = rounded(sql, doubles or [])
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    import importlib
    for m in ("retention", "reviews", "features", "metrics", "drift", "monitoring", "content", "aspects", "sources", "models"):
        importlib.import_module(f"storelens.plans.q_{m}")
