"""File source / sink queries (S1, S2, S4, S7, S8, S9, S12): data derived from
the test tables is written to the shared scratch folder and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import splits as SP
from storelens.plans import oracle as O
from storelens.plans.q_features import FEATURE_CTES, FEATURE_DOUBLES, customer_features
from storelens.plans.q_reviews import REVIEWS, _reviews
from storelens.plans.registry import register
from storelens.session import scratch_path
from storelens.sources import files as FL
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables

TX = O.with_(O.TRANSACTIONS)


def _write_csv(df, name: str) -> str:
    path = scratch_path(spark=df.sparkSession, name=name) + ".csv"
    df.write.mode("overwrite").option("header", True).option("escape", '"') \
      .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)
    return path


@register("scan_transactions_csv", TX + "SELECT * FROM transactions", ["Price", "Customer ID"])
def q_scan_csv(spark, sf):
    """Transactions written as CSV with header, read back with the explicit schema"""
    path = _write_csv(FX.transactions(Tables(spark, sf)), "transactions")
    return FL.scan_transactions_csv(spark, path)


@register("union_transaction_years", TX + "SELECT * FROM transactions", ["Price", "Customer ID"])
def q_union_years(spark, sf):
    """Two yearly 'sheets' (odd / even order years) concatenated by name"""
    tx = FX.transactions(Tables(spark, sf))
    y = F.year("InvoiceDate")
    return FL.union_transaction_years(tx.where(y % 2 == 0), tx.where(y % 2 == 1))


@register("scan_feature_parquet", FEATURE_CTES + "SELECT CustomerID, recency_days, monetary_value, churned FROM features WHERE churned = 1",
          ["monetary_value"])
def q_scan_parquet(spark, sf):
    """S4 + S8: the feature table written (v2: real sentiment joined), read with pruning and pushdown"""
    path = FL.sink_feature_table(customer_features(spark, sf), scratch_path(spark, "feature_store"), real_sentiment=True,
                                 csv_copy=False)
    return FL.scan_feature_parquet(spark, path).where(F.col("churned") == 1).select("CustomerID", "recency_days",
                                                                                    "monetary_value", "churned")


@register("sink_feature_table", FEATURE_CTES + "SELECT * FROM features", FEATURE_DOUBLES)
def q_sink_features(spark, sf):
    """Parquet + CSV copy; the CSV copy is read back"""
    f = customer_features(spark, sf)
    base = scratch_path(spark, "feature_store")
    FL.sink_feature_table(f, base, real_sentiment=True, csv_copy=True)
    return spark.read.schema(f.schema).option("header", True).csv(f"{base}/rfm_behavioral_v2.csv")


SPLIT_SQL = O.with_(REVIEWS) + """, r AS (SELECT review_id, text, rating, label, source,
  row_number() OVER (PARTITION BY label ORDER BY md5('42|' || review_id), review_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS n FROM reviews)
SELECT review_id, text, CAST(rating AS INTEGER) AS rating, CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label, source,
  CASE WHEN rk < floor(n * 0.7) THEN 'train' WHEN rk < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM r"""


@register("sink_split_manifests", SPLIT_SQL)
def q_manifests(spark, sf):
    """S9 + S7: split manifests written in one partitioned pass, scanned back as labelled CSVs"""
    r = _reviews(spark, sf).select("review_id", "text", "rating", "label", "source")
    s = SP.stratified_split(r, "label", "review_id")
    path = FL.sink_split_manifests(s, scratch_path(spark, "manifests"))
    back = FL.scan_labelled_reviews(spark, path)  # split comes back as the partition column
    return back.select("review_id", "text", "rating", "label", "source", "split")


@register("scan_labelled_reviews", SPLIT_SQL.replace("SELECT review_id, text, CAST(rating", "SELECT * FROM (SELECT review_id, text, CAST(rating", 1)
          + ") WHERE length(trim(text)) > 0")
def q_labelled(spark, sf):
    """Labelled CSV with blank texts and unknown labels mixed in; defaults applied"""
    r = _reviews(spark, sf).select("review_id", "text", "rating", "label", "source")
    s = SP.stratified_split(r, "label", "review_id")
    noise = s.select("review_id", F.lit(" ").alias("text"), "rating", "label", "source", "split") \
             .where(F.col("review_id").endswith("0"))
    unknown = s.select("review_id", "text", "rating", F.lit("mixed").alias("label"), "source", "split") \
               .where(F.col("review_id").endswith("1"))
    path = FL.sink_split_manifests(s.unionByName(noise).unionByName(unknown), scratch_path(spark, "labelled"))
    return FL.scan_labelled_reviews(spark, path).select("review_id", "text", "rating", "label", "source", "split")


@register("perf_snapshot_append", O.with_(O.LOGS) + """, m AS (
  SELECT module || '_p50_latency_ms' AS metric, CAST(quantile_disc(latency_ms, 0.5) AS VARCHAR) AS value FROM logs GROUP BY module
  UNION ALL SELECT module || '_model_version', min(model_version) FROM logs GROUP BY module)
SELECT DATE '2024-01-29' AS snapshot_date, metric, CAST(value AS DOUBLE) AS value FROM m WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL""",
          ["value"])
def q_perf_snapshot(spark, sf):
    """Weekly snapshot keeps numeric metrics only"""
    lg = FX.prediction_logs(Tables(spark, sf))
    med = lg.groupBy("module").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("v"))
    m = med.select(F.concat("module", F.lit("_p50_latency_ms")).alias("metric"), F.col("v").cast("string").alias("value"))
    ver = lg.groupBy("module").agg(F.min("model_version").alias("v")).select(
        F.concat("module", F.lit("_model_version")).alias("metric"), F.col("v").alias("value"))
    return FL.perf_snapshot_append(m.unionByName(ver), "2024-01-29")
