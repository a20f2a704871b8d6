"""Sentiment merge, feature assembly (flagship) and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import clean as C
from storelens.operators import features as FE
from storelens.operators import labels as L
from storelens.operators import quality as Q
from storelens.plans import oracle as O
from storelens.plans.registry import register
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables

SNAP, OBS, HZ, SSNAP = FX.RETENTION_SNAPSHOT, FX.RETENTION_OBS_START, 90, FX.SENTIMENT_SNAPSHOT


def customer_features(spark, sf, with_labels: bool = True, snap: str = SNAP, obs_start: str = OBS):
    """J1 over the test tables: the full feature table of the retention model
    (fused form: three passes over the window lines, see ``customer_feature_table``)."""
    t = Tables(spark, sf)
    clean = C.clean_transactions(FX.transactions(t), country=None)
    return FE.customer_feature_table(clean, snap, obs_start, HZ if with_labels else None,
                                     FX.review_sentiment(t), FX.aspect_sentiment(t), SSNAP)


def customer_features_unfused(spark, sf, with_labels: bool = True, snap: str = SNAP, obs_start: str = OBS):
    """J1 as separate operators (RFM ⟕ behaviour ⟕ temporal ⟕ sentiment ⟕ labels)."""
    t = Tables(spark, sf)
    clean = C.clean_transactions(FX.transactions(t), country=None)
    obs = C.observation_window(clean, obs_start, snap)
    rfm = FE.rfm_features(obs, snap)
    beh = FE.behaviour_features(obs)
    tmp = FE.temporal_features(obs, snap)
    sent = FE.merge_sentiment(rfm.select("CustomerID"), FX.review_sentiment(t), FX.aspect_sentiment(t), SSNAP)
    labels = L.churn_labels(clean, snap, obs_start, HZ) if with_labels else None
    return FE.assemble_features(rfm, beh, tmp, sent, labels)


SENT_CTES = O.with_(O.SENTIMENT)
FEATURE_CTES = O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON, O.RFM, O.BEHAVIOUR, O.TEMPORAL,
                       O.LABELS, O.SENTIMENT) + """,
sentiment AS (
  SELECT r.CustomerID, coalesce(d.avg_sentiment_score, 0.0) AS avg_sentiment_score,
         coalesce(d.last_review_sentiment, 0.0) AS last_review_sentiment,
         coalesce(d.negative_review_count, 0) AS negative_review_count, coalesce(d.has_reviews, 0) AS has_reviews,
         coalesce(a.avg_battery_sentiment, 0.0) AS avg_battery_sentiment,
         coalesce(a.avg_shipping_sentiment, 0.0) AS avg_shipping_sentiment,
         coalesce(a.avg_price_sentiment, 0.0) AS avg_price_sentiment
  FROM rfm r LEFT JOIN doc_agg d USING (CustomerID) LEFT JOIN aspect_pivot a USING (CustomerID)),
features AS (
  SELECT r.*, coalesce(b.purchase_gap_cv, -1.0) AS purchase_gap_cv, b.category_diversity, b.is_single_purchase,
         b.return_rate, coalesce(t.purchase_trend, 0.0) AS purchase_trend,
         coalesce(t.time_decay_weight, 0.0) AS time_decay_weight,
         s.avg_sentiment_score, s.last_review_sentiment, s.negative_review_count, s.has_reviews,
         s.avg_battery_sentiment, s.avg_shipping_sentiment, s.avg_price_sentiment, l.churned
  FROM rfm r LEFT JOIN behaviour b USING (CustomerID) LEFT JOIN temporal t USING (CustomerID)
  LEFT JOIN sentiment s USING (CustomerID) LEFT JOIN labels l USING (CustomerID))
"""
def feature_sql(snap: str = SNAP, obs_start: str = OBS) -> str:
    """Oracle of ``customer_features`` for other dates (a nested WITH)."""
    return (FEATURE_CTES.replace(f"TIMESTAMP '{SNAP}'", f"TIMESTAMP '{snap}'")
            .replace(f"TIMESTAMP '{OBS}'", f"TIMESTAMP '{obs_start}'") + "SELECT * FROM features")


FEATURE_DOUBLES = ["monetary_value", "avg_order_value", "recency_days_log", "purchase_gap_cv", "return_rate",
                   "purchase_trend", "time_decay_weight", "avg_sentiment_score", "last_review_sentiment",
                   "avg_battery_sentiment", "avg_shipping_sentiment", "avg_price_sentiment"]


@register("customer_features", FEATURE_CTES + "SELECT * FROM features", FEATURE_DOUBLES)
def q_customer_features(spark, sf):
    """J1 flagship: RFM ⟕ behaviour ⟕ temporal ⟕ sentiment ⟕ labels"""
    return customer_features(spark, sf)


@register("assemble_features", FEATURE_CTES + "SELECT * EXCLUDE (churned) FROM features", FEATURE_DOUBLES)
def q_assemble(spark, sf):
    """J1 without labels, from the separate family operators"""
    return customer_features_unfused(spark, sf, with_labels=False)


@register("doc_sentiment_agg", SENT_CTES + "SELECT * FROM doc_agg", ["avg_sentiment_score", "last_review_sentiment"])
def q_doc_agg(spark, sf):
    """A10"""
    return FE.doc_sentiment_agg(FX.review_sentiment(Tables(spark, sf)), SSNAP)


@register("last_review_sentiment", SENT_CTES + "SELECT CustomerID, last_review_sentiment FROM doc_agg",
          ["last_review_sentiment"])
def q_last_review(spark, sf):
    """Last non-null score by date"""
    return FE.doc_sentiment_agg(FX.review_sentiment(Tables(spark, sf)), SSNAP).select("CustomerID", "last_review_sentiment")


@register("aspect_sentiment_pivot", SENT_CTES + "SELECT * FROM aspect_pivot",
          ["avg_battery_sentiment", "avg_shipping_sentiment", "avg_price_sentiment"])
def q_aspect_pivot(spark, sf):
    """A11"""
    return FE.aspect_sentiment_pivot(FX.aspect_sentiment(Tables(spark, sf)), SSNAP)


@register("sentiment_placeholders", """SELECT CAST(c_custkey AS VARCHAR) AS CustomerID, 0.0::DOUBLE AS avg_sentiment_score,
  0.0::DOUBLE AS last_review_sentiment, CAST(0 AS BIGINT) AS negative_review_count, 0 AS has_reviews,
  0.0::DOUBLE AS avg_battery_sentiment, 0.0::DOUBLE AS avg_shipping_sentiment, 0.0::DOUBLE AS avg_price_sentiment FROM customer""",
          ["avg_sentiment_score", "last_review_sentiment", "avg_battery_sentiment", "avg_shipping_sentiment", "avg_price_sentiment"])
def q_placeholders(spark, sf):
    """A12"""
    c = Tables(spark, sf).customer.select(F.col("c_custkey").cast("string").alias("CustomerID"))
    return FE.sentiment_placeholders(c)


@register("merge_sentiment", SENT_CTES + """, cust AS (SELECT CAST(c_custkey AS VARCHAR) AS CustomerID FROM customer)
SELECT c.CustomerID, coalesce(d.avg_sentiment_score, 0.0) AS avg_sentiment_score,
       coalesce(d.last_review_sentiment, 0.0) AS last_review_sentiment,
       coalesce(d.negative_review_count, 0) AS negative_review_count, coalesce(d.has_reviews, 0) AS has_reviews,
       coalesce(a.avg_battery_sentiment, 0.0) AS avg_battery_sentiment,
       coalesce(a.avg_shipping_sentiment, 0.0) AS avg_shipping_sentiment,
       coalesce(a.avg_price_sentiment, 0.0) AS avg_price_sentiment
FROM cust c LEFT JOIN doc_agg d USING (CustomerID) LEFT JOIN aspect_pivot a USING (CustomerID)""",
          ["avg_sentiment_score", "last_review_sentiment", "avg_battery_sentiment", "avg_shipping_sentiment", "avg_price_sentiment"])
def q_merge_sentiment(spark, sf):
    """J4 for every customer of the customer table"""
    t = Tables(spark, sf)
    cust = t.customer.select(F.col("c_custkey").cast("string").alias("CustomerID"))
    return FE.merge_sentiment(cust, FX.review_sentiment(t), FX.aspect_sentiment(t), SSNAP)


DEFAULTS_SQL = ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), {float(v)}) AS {c}" if c not in ("avg_sentiment_score", "last_review_sentiment")
    else f"CAST({float(v)} AS DOUBLE) AS {c}" for c, v in __import__("storelens.schemas", fromlist=["x"]).FEATURE_DEFAULTS.items())


@register("feature_defaults", FEATURE_CTES + f"""SELECT CustomerID, {DEFAULTS_SQL} FROM (
  SELECT * REPLACE (CASE WHEN frequency > 3 THEN NULL ELSE frequency END AS frequency) FROM features)""",
          list(__import__("storelens.schemas", fromlist=["x"]).FEATURE_DEFAULTS))
def q_feature_defaults(spark, sf):
    """A scoring request missing two sentiment columns and some frequencies"""
    f = customer_features(spark, sf, with_labels=False)
    f = f.drop("avg_sentiment_score", "last_review_sentiment")
    f = f.withColumn("frequency", F.when(F.col("frequency") > 3, F.lit(None)).otherwise(F.col("frequency")))
    out = C.feature_defaults(f)
    from storelens.schemas import FEATURE_DEFAULTS
    return out.select("CustomerID", *FEATURE_DEFAULTS)


@register("select_model_matrix", FEATURE_CTES + "SELECT CustomerID, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in __import__("storelens.schemas", fromlist=["x"]).FEATURE_COLUMNS)
    + ", CAST(churned AS INTEGER) AS churned FROM features WHERE churned IS NOT NULL",
    list(__import__("storelens.schemas", fromlist=["x"]).FEATURE_COLUMNS))
def q_model_matrix(spark, sf):
    """P12"""
    return C.select_model_matrix(customer_features(spark, sf))


# ---- data quality ---------------------------------------------------------

def suite_sql(rules: list[Q.Rule], table: str) -> str:
    """DuckDB twin of ``run_suite`` (one SELECT per rule, unioned)."""
    parts = []
    for i, r in enumerate(rules):
        col = f"'{r.column}'" if r.column else "NULL"
        if r.kind == "columns":
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_columns' AS rule, '{','.join(r.columns)}' AS column_name, "
                         f"1.0::DOUBLE AS observed, CAST(0 AS BIGINT) AS unexpected, true AS success")
        elif r.kind == "not_null":
            u = f'count(*) FILTER (WHERE "{r.column}" IS NULL)'
            frac = f"CASE WHEN count(*) > 0 THEN 1.0 - {u} / count(*) ELSE 1.0 END"
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_not_null' AS rule, {col} AS column_name, {frac} AS observed, CAST({u} AS BIGINT) AS unexpected, {frac} >= {r.mostly} AS success FROM {table}")
        elif r.kind == "between":
            lo = f"TIMESTAMP '{r.min_value}'" if isinstance(r.min_value, str) else r.min_value
            hi = f"TIMESTAMP '{r.max_value}'" if isinstance(r.max_value, str) else r.max_value
            c = f'"{r.column}"'
            u = f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT ({c} BETWEEN {lo} AND {hi}))"
            frac = f"CASE WHEN count({c}) > 0 THEN 1.0 - {u} / count({c}) ELSE 1.0 END"
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_between' AS rule, {col} AS column_name, {frac} AS observed, CAST({u} AS BIGINT) AS unexpected, {frac} >= {r.mostly} AS success FROM {table}")
        elif r.kind == "row_count":
            ok = f"count(*) BETWEEN {r.min_value} AND {r.max_value}"
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_row_count' AS rule, CAST(NULL AS VARCHAR) AS column_name, CAST(count(*) AS DOUBLE) AS observed, "
                         f"CAST(CASE WHEN {ok} THEN 0 ELSE 1 END AS BIGINT) AS unexpected, {ok} AS success FROM {table}")
        elif r.kind == "count_zero":
            u = f"count(*) FILTER (WHERE {r.predicate.replace('`', chr(34)).replace('TIMESTAMP_NTZ', 'TIMESTAMP')})"
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_zero_rows' AS rule, {col} AS column_name, CAST({u} AS DOUBLE) AS observed, CAST({u} AS BIGINT) AS unexpected, {u} = 0 AS success FROM {table}")
        elif r.kind == "compound_unique":
            keys = ", ".join(f'"{k}"' for k in r.columns)
            nn = " AND ".join(f'"{k}" IS NULL' for k in r.columns)
            parts.append(f"SELECT {i} AS rule_no, '{r.gate}' AS gate, 'expect_compound_unique' AS rule, '{','.join(r.columns)}' AS column_name, "
                         f"CASE WHEN sum(c) > 0 THEN 1.0 - coalesce(sum(c) FILTER (WHERE c > 1), 0) / sum(c) ELSE 1.0 END AS observed, "
                         f"CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS unexpected, coalesce(sum(c) FILTER (WHERE c > 1), 0) = 0 AS success "
                         f"FROM (SELECT {keys}, count(*) AS c FROM {table} WHERE NOT ({nn}) GROUP BY {keys})")
    return "\nUNION ALL\n".join(parts)


TX = O.with_(O.TRANSACTIONS)


def _tx(spark, sf):
    return FX.transactions(Tables(spark, sf))


@register("quality_suite", TX + suite_sql(Q.RETAIL_SUITE, "transactions"), ["observed"])
def q_suite(spark, sf):
    """Q8: the full retail suite over the transactions"""
    return Q.run_suite(_tx(spark, sf))


@register("expect_columns", TX + suite_sql([Q.RETAIL_SUITE[0]], "transactions"), ["observed"])
def q_expect_columns(spark, sf):
    """Q1"""
    return Q.run_suite(_tx(spark, sf), [Q.RETAIL_SUITE[0]])


@register("expect_not_null", TX + suite_sql([Q.Rule("G2", "not_null", "Customer ID", mostly=0.7)], "transactions"), ["observed"])
def q_not_null(spark, sf):
    """Q2"""
    return Q.expect_not_null(_tx(spark, sf), "Customer ID", 0.7).withColumn("gate", F.lit("G2"))


@register("expect_between", TX + suite_sql([Q.Rule("G3", "between", "Quantity", 1, 100000, mostly=0.9)], "transactions"), ["observed"])
def q_between(spark, sf):
    """Q3"""
    return Q.expect_between(_tx(spark, sf), "Quantity", 1, 100000, 0.9)


@register("expect_compound_unique", TX + suite_sql([Q.Rule("G4", "compound_unique", columns=("Invoice", "StockCode"))], "transactions"),
          ["observed"])
def q_compound(spark, sf):
    """Q4 (fails legitimately: duplicated lines in the test data)"""
    return Q.compound_unique(_tx(spark, sf), ["Invoice", "StockCode"], "G4", 0)


@register("expect_row_count", TX + suite_sql([Q.Rule("G5", "row_count", min_value=10000, max_value=2000000)], "transactions"),
          ["observed"])
def q_row_count(spark, sf):
    """Q5"""
    return Q.expect_row_count(_tx(spark, sf), 10000, 2000000)


_CAUSAL = Q.Rule("G8", "count_zero", "review_date", predicate=f"`review_date` >= CAST('{SSNAP}' AS TIMESTAMP_NTZ)")


@register("causal_integrity", O.with_(O.REVIEW_SENTIMENT) + suite_sql([_CAUSAL], "review_sentiment"), ["observed"])
def q_causal(spark, sf):
    """Q6 on the raw review sentiment (fails: reviews after the snapshot exist)"""
    return Q.causal_integrity(FX.review_sentiment(Tables(spark, sf)), SSNAP)


_RANGES = [Q.Rule("Q7", "between", "sentiment_score", -1.0, 1.0), Q.Rule("Q7", "between", "aspect_sentiment", -1.0, 1.0)]


@register("score_range", O.with_(O.REVIEW_SENTIMENT, O.ASPECT_SENTIMENT) + """, s AS (
  SELECT r.sentiment_score, a.aspect_sentiment FROM review_sentiment r POSITIONAL JOIN aspect_sentiment a)
""" + suite_sql(_RANGES, "s"), ["observed"])
def q_score_range(spark, sf):
    """Q7 over review and aspect scores"""
    t = Tables(spark, sf)
    e = t.events
    eid = F.col("event_id")
    s = e.select(F.when(eid % 101 == 0, F.lit(None).cast("double")).otherwise(((eid * 7919) % 2001) / F.lit(1000.0) - 1.0).alias("sentiment_score"),
                 (((eid * 104729) % 2001) / F.lit(1000.0) - 1.0).alias("aspect_sentiment"))
    return Q.score_range(s, {"sentiment_score": (-1.0, 1.0), "aspect_sentiment": (-1.0, 1.0)})
