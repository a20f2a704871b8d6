"""Retention queries: cleaning, features, labels (test-table scenario dates)."""

from __future__ import annotations


from storelens.operators import clean as C
from storelens.operators import features as FE
from storelens.operators import labels as L
from storelens.plans import oracle as O
from storelens.plans.registry import register
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables

SNAP = FX.RETENTION_SNAPSHOT
OBS = FX.RETENTION_OBS_START
HZ = 90
REGION = "EUROPE"


def _tx(spark, sf):
    return FX.transactions(Tables(spark, sf))


def _clean(spark, sf, country=None):
    return C.clean_transactions(_tx(spark, sf), country=country)


def _obs(spark, sf):
    return C.observation_window(_clean(spark, sf), OBS, SNAP)


TX_COLS = 'Invoice, StockCode, Description, Quantity, InvoiceDate, Price, "Customer ID", Country'
CLEAN_ALL = O.with_(O.TRANSACTIONS, O.clean(None))
CLEAN_EU = O.with_(O.TRANSACTIONS, O.clean(REGION))
OBS_ALL = O.with_(O.TRANSACTIONS, O.clean(None), O.OBS)


@register("exclude_guests", O.with_(O.TRANSACTIONS) + 'SELECT * FROM transactions WHERE "Customer ID" IS NOT NULL',
          ["Price", "Customer ID"])
def q_exclude_guests(spark, sf):
    """P1"""
    return C.exclude_guests(_tx(spark, sf))


@register("scope_country", O.with_(O.TRANSACTIONS) + f"SELECT * FROM transactions WHERE Country = '{REGION}'",
          ["Price", "Customer ID"])
def q_scope_country(spark, sf):
    """P2"""
    return C.scope_country(_tx(spark, sf), REGION)


@register("normalise_customer_id", O.with_(O.TRANSACTIONS) +
          'SELECT * REPLACE (CAST(CAST("Customer ID" AS BIGINT) AS VARCHAR) AS "Customer ID") FROM transactions',
          ["Price"])
def q_normalise(spark, sf):
    """P3"""
    return C.normalise_customer_id(_tx(spark, sf))


@register("drop_cancellations", O.with_(O.TRANSACTIONS) +
          "SELECT * FROM transactions WHERE NOT coalesce(starts_with(Invoice, 'C'), false)",
          ["Price", "Customer ID"])
def q_drop_cancel(spark, sf):
    """P4"""
    return C.drop_cancellations(_tx(spark, sf))


@register("positive_lines", O.with_(O.TRANSACTIONS) + "SELECT * FROM transactions WHERE Quantity > 0 AND Price > 0",
          ["Price", "Customer ID"])
def q_positive(spark, sf):
    """P5"""
    return C.positive_lines(_tx(spark, sf))


@register("line_total", O.with_(O.TRANSACTIONS) +
          "SELECT *, CAST(Quantity AS DOUBLE) * Price AS LineTotal FROM transactions",
          ["Price", "Customer ID", "LineTotal"])
def q_line_total(spark, sf):
    """P6"""
    return C.line_total(_tx(spark, sf))


@register("clean_transactions", CLEAN_EU + "SELECT * FROM clean", ["Price", "LineTotal"])
def q_clean(spark, sf):
    """P7 (one region in scope)"""
    return _clean(spark, sf, REGION)


@register("cleaning_funnel", O.with_(O.TRANSACTIONS) + f"""
, s AS (SELECT count(*) AS s0,
         count(*) FILTER (WHERE "Customer ID" IS NOT NULL) AS s1,
         count(*) FILTER (WHERE "Customer ID" IS NOT NULL AND Country = '{REGION}') AS s2,
         count(*) FILTER (WHERE "Customer ID" IS NOT NULL AND Country = '{REGION}'
                          AND NOT coalesce(starts_with(Invoice, 'C'), false)) AS s3,
         count(*) FILTER (WHERE "Customer ID" IS NOT NULL AND Country = '{REGION}'
                          AND NOT coalesce(starts_with(Invoice, 'C'), false) AND Quantity > 0 AND Price > 0) AS s4
       FROM transactions)
SELECT CAST(step_no AS INTEGER) AS step_no, step, CAST(cur AS BIGINT) AS rows_remaining,
       CAST(prev - cur AS BIGINT) AS rows_removed,
       CASE WHEN prev > 0 THEN round((prev - cur) * 100.0 / prev, 4) ELSE 0.0 END AS pct_removed
FROM (SELECT 0 AS step_no, 'raw' AS step, s0 AS cur, s0 AS prev FROM s
      UNION ALL SELECT 1, 'exclude_guests', s1, s0 FROM s
      UNION ALL SELECT 2, 'scope_country', s2, s1 FROM s
      UNION ALL SELECT 3, 'drop_cancellations', s3, s2 FROM s
      UNION ALL SELECT 4, 'positive_lines', s4, s3 FROM s)""".replace("\n, s AS", "\n, s AS", 1).replace(
    "transactions AS (", "transactions AS (", 1), ["pct_removed"])
def q_funnel(spark, sf):
    """P8"""
    return C.cleaning_funnel(_tx(spark, sf), REGION)


@register("observation_window", OBS_ALL + "SELECT * FROM obs", ["Price", "LineTotal"])
def q_obs(spark, sf):
    """P9"""
    return _obs(spark, sf)


@register("horizon_window", O.with_(O.TRANSACTIONS, O.clean(None), O.HORIZON) + "SELECT * FROM hz",
          ["Price", "LineTotal"])
def q_horizon(spark, sf):
    """P10"""
    return C.horizon_window(_clean(spark, sf), SNAP, HZ)


@register("rfm_features", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.RFM) + "SELECT * FROM rfm",
          ["monetary_value", "avg_order_value", "recency_days_log"])
def q_rfm(spark, sf):
    """A1"""
    return FE.rfm_features(_obs(spark, sf), SNAP)


@register("recency_tenure_days", OBS_ALL + f"""SELECT "Customer ID" AS CustomerID,
  {O.days('max(InvoiceDate)', O.SNAP)} AS recency_days, {O.days('min(InvoiceDate)', O.SNAP)} AS tenure_days
  FROM obs GROUP BY 1""")
def q_rec(spark, sf):
    """A2"""
    return FE.recency_tenure_days(_obs(spark, sf), SNAP)


@register("order_gaps", OBS_ALL + f"""SELECT "Customer ID" AS CustomerID, Invoice, InvoiceDate,
  {O.days('lag(InvoiceDate) OVER (PARTITION BY "Customer ID" ORDER BY InvoiceDate, Invoice, StockCode)', 'InvoiceDate')} AS gap_days
  FROM obs""")
def q_order_gaps(spark, sf):
    """W1"""
    return FE.order_gaps(_obs(spark, sf))


@register("purchase_gap_cv", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.GAPS) +
          "SELECT CustomerID, purchase_gap_cv FROM gap_cv", ["purchase_gap_cv"])
def q_gap_cv(spark, sf):
    """A3"""
    return FE.purchase_gap_cv(_obs(spark, sf))


@register("category_diversity", OBS_ALL + """SELECT "Customer ID" AS CustomerID,
  CAST(count(DISTINCT StockCode) AS BIGINT) AS category_diversity FROM obs GROUP BY 1""")
def q_div(spark, sf):
    """A4"""
    return FE.category_diversity(_obs(spark, sf))


@register("behaviour_features", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.BEHAVIOUR) +
          "SELECT * FROM behaviour", ["purchase_gap_cv", "return_rate"])
def q_behaviour(spark, sf):
    """A5"""
    return FE.behaviour_features(_obs(spark, sf))


@register("monthly_order_counts", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.MONTHLY) + "SELECT * FROM monthly")
def q_monthly(spark, sf):
    """A6"""
    return FE.monthly_order_counts(_obs(spark, sf), SNAP)


@register("purchase_trend", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.TEMPORAL) +
          "SELECT CustomerID, purchase_trend FROM trend", ["purchase_trend"])
def q_trend(spark, sf):
    """A7"""
    return FE.purchase_trend(FE.monthly_order_counts(_obs(spark, sf), SNAP))


@register("time_decay_weight", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.TEMPORAL) +
          "SELECT * FROM decay", ["time_decay_weight"])
def q_decay(spark, sf):
    """A8"""
    return FE.time_decay_weight(_obs(spark, sf), SNAP)


@register("temporal_features", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.TEMPORAL) +
          "SELECT * FROM temporal", ["purchase_trend", "time_decay_weight"])
def q_temporal(spark, sf):
    """A9"""
    return FE.temporal_features(_obs(spark, sf), SNAP)


@register("churn_labels", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON, O.LABELS) +
          "SELECT * FROM labels", ["total_spend"])
def q_labels(spark, sf):
    """A13 + J2"""
    return L.churn_labels(_clean(spark, sf), SNAP, OBS, HZ)


@register("retained_membership", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON, O.LABELS) +
          "SELECT CustomerID, churned FROM labels")
def q_membership(spark, sf):
    """J2"""
    return L.churn_labels(_clean(spark, sf), SNAP, OBS, HZ).select("CustomerID", "churned")


@register("churned_customers", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON) +
          'SELECT DISTINCT "Customer ID" AS CustomerID FROM obs WHERE "Customer ID" NOT IN (SELECT "Customer ID" FROM hz)')
def q_churned(spark, sf):
    """J3 churned side"""
    return L.churned_customers(_clean(spark, sf), SNAP, OBS, HZ)


@register("retained_customers", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON) +
          'SELECT DISTINCT "Customer ID" AS CustomerID FROM obs WHERE "Customer ID" IN (SELECT "Customer ID" FROM hz)')
def q_retained(spark, sf):
    """J3 retained side"""
    return L.retained_customers(_clean(spark, sf), SNAP, OBS, HZ)


@register("churn_label_validity", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON, O.LABELS) + """
SELECT round(n_churned / n_total, 6) AS churn_rate, n_total, n_churned, n_total - n_churned AS n_retained,
       (n_churned / n_total BETWEEN 0.15 AND 0.80) AS valid,
       CASE WHEN n_churned / n_total < 0.15 THEN 'increase_horizon'
            WHEN n_churned / n_total > 0.80 THEN 'decrease_horizon' ELSE 'ok' END AS advice
FROM (SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(sum(churned) AS BIGINT) AS n_churned FROM labels)""",
          ["churn_rate"])
def q_validity(spark, sf):
    """A14"""
    return L.churn_label_validity(L.churn_labels(_clean(spark, sf), SNAP, OBS, HZ))


@register("horizon_sensitivity", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS) + f""",
cust AS (SELECT DISTINCT "Customer ID" AS CustomerID FROM obs),
nxt AS (SELECT "Customer ID" AS CustomerID, min(InvoiceDate) AS next_purchase FROM clean
        WHERE InvoiceDate >= {O.SNAP} + INTERVAL 1 DAY GROUP BY 1),
j AS (SELECT c.CustomerID, n.next_purchase FROM cust c LEFT JOIN nxt n USING (CustomerID)),
h AS (SELECT unnest([30, 60, 90, 120, 180]) AS horizon_days)
SELECT CAST(h.horizon_days AS INTEGER) AS horizon_days, CAST((SELECT count(*) FROM j) AS BIGINT) AS n_customers,
       CAST(count(j.CustomerID) AS BIGINT) AS n_churned,
       round(count(j.CustomerID) / (SELECT count(*) FROM j), 6) AS churn_rate
FROM h LEFT JOIN j ON j.next_purchase IS NULL OR j.next_purchase > {O.SNAP} + to_days(h.horizon_days)
GROUP BY h.horizon_days""".replace(",\ncust AS", ",\ncust AS"), ["churn_rate"])
def q_sensitivity(spark, sf):
    """A15"""
    return L.horizon_sensitivity(_clean(spark, sf), SNAP, OBS)
