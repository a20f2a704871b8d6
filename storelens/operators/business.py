"""Business views of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Estimator defaults and sensitivity grid.
REACH_PCT = 0.6
CONVERSION_RATE = 0.25
AVG_LTV = 480.0
COST_PER_OFFER = 15.0
CONVERSION_LEVELS = [0.10, 0.25, 0.45]
LTV_LEVELS = [200.0, 480.0, 800.0]


def _roi_cols(n_high, reach, conv, ltv, cost):
    targeted = n_high * reach
    saved = targeted * conv
    revenue = saved * ltv
    spend = targeted * cost
    return targeted, saved, revenue, spend


def retention_roi(bands: DataFrame, reach: float = REACH_PCT, conv: float = CONVERSION_RATE,
                  ltv: float = AVG_LTV, cost: float = COST_PER_OFFER) -> DataFrame:
    """B1: targeted = HIGH · reach, saved = targeted · conversion; revenue, cost,
    net and multiple (0 when cost is 0). Input: A19 band counts."""
    n = bands.agg(F.coalesce(F.sum(F.when(F.col("risk_band") == "HIGH", F.col("count"))), F.lit(0)).cast("double").alias("n"))
    t, s, r, c = _roi_cols(F.col("n"), F.lit(reach), F.lit(conv), F.lit(ltv), F.lit(cost))
    return n.select(F.col("n").cast("bigint").alias("n_high_risk"), t.alias("n_targeted"), s.alias("n_saved"),
                    r.alias("revenue_saved"), c.alias("campaign_cost"), (r - c).alias("net_roi"),
                    F.when(c > 0, r / c).otherwise(F.lit(0.0)).alias("roi_multiple"))


def roi_sensitivity(bands: DataFrame, reach: float = REACH_PCT, cost: float = COST_PER_OFFER) -> DataFrame:
    """B2 + J9: 3 × 3 net-ROI grid (conversion × LTV). The nine constant cells are
    exploded from an array on the one-row HIGH count — no join."""
    n = bands.agg(F.coalesce(F.sum(F.when(F.col("risk_band") == "HIGH", F.col("count"))), F.lit(0)).cast("double").alias("n"))
    cells = F.array(*[F.struct(F.lit(cv).alias("conversion_rate"), F.lit(lv).alias("avg_ltv"))
                      for cv in CONVERSION_LEVELS for lv in LTV_LEVELS])
    g = n.select("n", F.explode(cells).alias("c")).select("n", "c.*")
    t, s, r, c = _roi_cols(F.col("n"), F.lit(reach), F.col("conversion_rate"), F.col("avg_ltv"), F.lit(cost))
    return g.select("conversion_rate", "avg_ltv", (r - c).alias("net_roi"))


def overview_kpis(logs: DataFrame) -> DataFrame:
    """Total predictions, active modules, mean retention latency, model versions map."""
    g = logs.groupBy("module").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("lat"),
                                   F.max("model_version").alias("ver"))
    return g.agg(F.sum("n").cast("bigint").alias("total_predictions"),
                 F.count(F.lit(1)).cast("bigint").alias("active_modules"),
                 F.coalesce(F.max(F.when(F.col("module") == "retention", F.col("lat"))), F.lit(0.0)).alias("retention_avg_latency_ms"),
                 F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "ver")))).alias("model_versions"))


def band_share(bands: DataFrame) -> DataFrame:
    """Each band's count relative to the largest band (window over the tiny result)."""
    return bands.select("risk_band", "count",
                        (F.col("count") / F.max("count").over(Window.partitionBy())).alias("share_of_max"))
