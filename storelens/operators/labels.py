"""Churn labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.timeutil import add_days, ts_lit
from storelens.operators.clean import (DEFAULT_HORIZON_DAYS, DEFAULT_OBS_START, DEFAULT_SNAPSHOT,
                                       horizon_window, observation_window)

# Valid churn-rate band and sensitivity horizons.
MIN_CHURN_RATE = 0.15
MAX_CHURN_RATE = 0.80
SENSITIVITY_HORIZONS = [30, 60, 90, 120, 180]

CUST_IN = "`Customer ID`"


def retained_customers(clean: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                       obs_start: str = DEFAULT_OBS_START,
                       horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """J3 (retained side): observation customers with a horizon purchase (left semi)."""
    obs = observation_window(clean, obs_start, snapshot).select(F.col(CUST_IN).alias("CustomerID")).distinct()
    hz = horizon_window(clean, snapshot, horizon_days).select(F.col(CUST_IN).alias("CustomerID"))
    return obs.join(hz, "CustomerID", "left_semi")


def churned_customers(clean: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                      obs_start: str = DEFAULT_OBS_START,
                      horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """J3 (churned side): observation customers without a horizon purchase (left anti)."""
    obs = observation_window(clean, obs_start, snapshot).select(F.col(CUST_IN).alias("CustomerID")).distinct()
    hz = horizon_window(clean, snapshot, horizon_days).select(F.col(CUST_IN).alias("CustomerID"))
    return obs.join(hz, "CustomerID", "left_anti")


def churn_labels(clean: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                 obs_start: str = DEFAULT_OBS_START,
                 horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """A13 + J2: one row per observation-window customer.

    ``churned`` = no purchase in (snapshot+1d .. snapshot+horizon). The summary
    aggregate and the distinct horizon ids are both keyed by CustomerID, so
    the membership left join is co-partitioned.
    """
    obs = observation_window(clean, obs_start, snapshot)
    summary = obs.groupBy(F.col(CUST_IN).alias("CustomerID")).agg(
        F.min("InvoiceDate").alias("first_order_date"),
        F.max("InvoiceDate").alias("last_order_date"),
        F.countDistinct("Invoice").cast("bigint").alias("total_orders"),
        F.sum(F.col("Price") * F.col("Quantity")).alias("total_spend"),
    )
    hz = (horizon_window(clean, snapshot, horizon_days)
          .select(F.col(CUST_IN).alias("CustomerID")).distinct()
          .withColumn("_ret", F.lit(1)))
    out = summary.join(hz, "CustomerID", "left")
    return out.select("CustomerID", F.col("_ret").isNull().cast("int").alias("churned"),
                      "first_order_date", "last_order_date", "total_orders", "total_spend")


def churn_label_validity(labels: DataFrame, min_rate: float = MIN_CHURN_RATE,
                         max_rate: float = MAX_CHURN_RATE) -> DataFrame:
    """One-row report: rate, counts, validity and advice on the horizon."""
    g = labels.agg(F.count(F.lit(1)).alias("n_total"),
                   F.sum("churned").cast("bigint").alias("n_churned"))
    rate = F.col("n_churned") / F.col("n_total")
    return g.select(
        F.round(rate, 6).alias("churn_rate"), "n_total", "n_churned",
        (F.col("n_total") - F.col("n_churned")).alias("n_retained"),
        ((rate >= min_rate) & (rate <= max_rate)).alias("valid"),
        F.when(rate < min_rate, "increase_horizon").when(rate > max_rate, "decrease_horizon")
         .otherwise("ok").alias("advice"),
    )


def horizon_sensitivity(clean: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                        obs_start: str = DEFAULT_OBS_START,
                        horizons: list[int] | None = None) -> DataFrame:
    """Churn rate for several horizons in one pass.

    Per customer the first purchase from snapshot+1d onward; then ONE global
    aggregate with a conditional count per horizon, stacked into rows (no
    customers × horizons cross product).
    """
    hs = horizons or SENSITIVITY_HORIZONS
    s = ts_lit(snapshot)
    obs = observation_window(clean, obs_start, snapshot).select(F.col(CUST_IN).alias("CustomerID")).distinct()
    nxt = (clean.where(F.col("InvoiceDate") >= add_days(s, 1))
           .groupBy(F.col(CUST_IN).alias("CustomerID")).agg(F.min("InvoiceDate").alias("next_purchase")))
    j = obs.join(nxt, "CustomerID", "left")
    aggs = [F.count(F.lit(1)).alias("n")]
    for h in hs:
        aggs.append(F.count_if(F.col("next_purchase").isNull() | (F.col("next_purchase") > add_days(s, h))).alias(f"c{h}"))
    g = j.agg(*aggs)
    stack = ", ".join(f"{h}, c{h}" for h in hs)
    out = g.selectExpr("n", f"stack({len(hs)}, {stack}) as (horizon_days, n_churned)")
    return out.select(F.col("horizon_days").cast("int"), F.col("n").cast("bigint").alias("n_customers"),
                      F.col("n_churned").cast("bigint"),
                      F.round(F.col("n_churned") / F.col("n"), 6).alias("churn_rate"))
