"""Rank primitives that stay distributed (§ two-level rank / cumulative).

A window ``partitionBy(stratum).orderBy(x)`` puts a whole stratum in one task
(and an un-partitioned window the whole table). With a few large strata that is
one task per stratum. Instead:

1. an order-preserving bucket of the sort key (leading hex digits of the hash),
2. counts per (stratum, bucket) — a small table, strata × 16^digits rows,
3. exclusive prefix sums of those counts (window over the small table),
4. ``row_number`` within (stratum, bucket) + the bucket's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.hashing import hash_key


def stratified_rank(df: DataFrame, strata: list[str], id_col: str, seed: str | int,
                    digits: int = 3, rank_col: str = "_rank", size_col: str = "_n") -> DataFrame:
    """Add a 0-based rank by ``md5(seed|id)`` within each stratum and the stratum size.

    Equal to ``row_number() OVER (PARTITION BY strata ORDER BY md5, id) - 1``.
    """
    key = hash_key(F.col(id_col), seed)
    d = df.withColumn("_h", key).withColumn("_b", F.substring(F.col("_h"), 1, digits))
    counts = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ws = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*strata)
    offs = counts.select(*strata, "_b",
                         F.coalesce(F.sum("_c").over(ws), F.lit(0)).alias("_off"),
                         F.sum("_c").over(wt).alias(size_col))
    j = d.join(offs, [*strata, "_b"])
    w = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    out = j.withColumn(rank_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("bigint"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], rank_col, size_col)


def global_rank(df: DataFrame, order: Column, bucket: Column, rank_col: str = "_rank") -> DataFrame:
    """0-based global rank by ``order`` without a single-partition window.

    ``bucket`` must be monotone in ``order`` (e.g. a floor of the score).
    """
    d = df.withColumn("_o", order).withColumn("_b", bucket)
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_b", F.coalesce(
        F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    j = d.join(offs, "_b")
    w = Window.partitionBy("_b").orderBy("_o")
    return j.withColumn(rank_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("bigint")).drop("_o", "_b", "_off")


def exclusive_cumsum(df: DataFrame, order_col: str, value_cols: list[str], bucket: Column,
                     partition: list[str] | None = None, prefix: str = "cum_") -> DataFrame:
    """Σ of ``value_cols`` over rows strictly before each row in ``order_col``
    order (per ``partition``), without a one-task window.

    ``bucket`` must be monotone in ``order_col``: bucket totals (a small table)
    get their own prefix sums, rows add the running sum inside their bucket.
    """
    part = list(partition or [])
    d = df.withColumn("_b", bucket)
    tot = d.groupBy(*part, "_b").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wb = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*part, "_b", *[F.coalesce(F.sum(f"_t_{v}").over(wb), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    j = d.join(offs, [*part, "_b"])
    w = Window.partitionBy(*part, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    for v in value_cols:
        j = j.withColumn(f"{prefix}{v}", F.coalesce(F.sum(v).over(w), F.lit(0)) + F.col(f"_o_{v}"))
    return j.drop("_b", *[f"_o_{v}" for v in value_cols])
