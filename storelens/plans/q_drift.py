"""Drift queries: reference = features one year earlier, current = test snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.operators import drift as D
from storelens.plans.q_features import customer_features, feature_sql
from storelens.plans.registry import register
from storelens.schemas import NUMERIC_FEATURE_COLUMNS as NUM

REF_SNAP, REF_OBS = "1999-08-01", "1998-08-02"
SHIFT_FEATURE = "recency_days"


def _periods(spark, sf):
    """(reference, current) feature tables from ONE pass over the lines
    (multi-period builder), checkpointed once since drift reads both several times."""
    from storelens.operators import clean as C
    from storelens.operators.features import customer_feature_tables
    from storelens.plans.q_features import SSNAP
    from storelens.sources import fixtures as FX
    from storelens.sources.tables import Tables
    t = Tables(spark, sf)
    clean = C.clean_transactions(FX.transactions(t), country=None)
    both = customer_feature_tables(clean, {"ref": (REF_SNAP, REF_OBS), "cur": (FX.RETENTION_SNAPSHOT, FX.RETENTION_OBS_START)},
                                   None, FX.review_sentiment(t), FX.aspect_sentiment(t), SSNAP).checkpoint(eager=True)
    return (both.where(F.col("period") == "ref").drop("period"), both.where(F.col("period") == "cur").drop("period"))


def _with_periods(spark, sf, fn):
    r, c = _periods(spark, sf)
    return fn(r, c)


def _report(spark, sf):
    return _with_periods(spark, sf, lambda r, c: D.drift_report(c, D.reference_distribution(r)))


def _ref(spark, sf):
    return _periods(spark, sf)[0]


def _cur(spark, sf):
    return _periods(spark, sf)[1]


_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)
_COLS = ", ".join(NUM)
def base_sql(shift: str | None = None) -> str:
    cur_sel = f"SELECT {_CASTS} FROM cur_f"
    if shift:
        cur_sel = (f"SELECT * REPLACE ({shift} + 5.0 * (SELECT std FROM ref_dist WHERE feature = '{shift}') AS {shift}) "
                   f"FROM ({cur_sel})")
    return f"""WITH ref_f AS ({feature_sql(REF_SNAP, REF_OBS)}),
cur_f AS ({feature_sql()}),
ref_long AS (UNPIVOT (SELECT {_CASTS} FROM ref_f) ON {_COLS} INTO NAME feature VALUE value),
ref_dist AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.25) AS p25,
   quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95,
   min(value) AS min, max(value) AS max, CAST(count(*) AS BIGINT) AS n FROM ref_long GROUP BY 1),
cur_long AS (UNPIVOT ({cur_sel}) ON {_COLS} INTO NAME feature VALUE value)"""


BASE = base_sql()

SCALER = """,
ref_z AS (UNPIVOT (SELECT {z} FROM ref_f) ON {cols} INTO NAME feature VALUE value),
scaler AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale
           FROM ref_z GROUP BY 1)""".format(z=", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUM), cols=_COLS)


def psi_sql(cur_long: str = "cur_long") -> str:
    return f""",
edges AS (SELECT feature, list_transform(keep, lambda i: vals[i]) AS edges, list_transform(keep, lambda i: qs[i]) AS ranks FROM (
   SELECT feature, vals, qs, list_filter(range(1, 7), lambda i: i = 1 OR vals[i] <> vals[greatest(i - 1, 1)]) AS keep
   FROM (SELECT feature, [min, p25, p50, p75, p95, max] AS vals, [0.0, 25.0, 50.0, 75.0, 95.0, 100.0] AS qs FROM ref_dist))),
binned AS (SELECT c.feature, CASE WHEN len(e.edges) >= 2 AND c.value >= e.edges[1] AND c.value <= e.edges[len(e.edges)]
     THEN least(len(list_filter(e.edges, lambda x: x <= c.value)) - 1, len(e.edges) - 2) END AS b
   FROM {cur_long} c JOIN edges e USING (feature)),
cnt AS (SELECT feature, b, count(*) AS c FROM binned GROUP BY 1, 2),
tot AS (SELECT feature, sum(c) FILTER (WHERE b IS NOT NULL) AS tot, sum(c) AS n_all FROM cnt GROUP BY 1),
refb AS (SELECT feature, b, (ranks[b + 2] - ranks[b + 1]) / 100.0 AS r FROM (
   SELECT feature, ranks, unnest(range(0, len(edges) - 1)) AS b FROM edges)),
terms AS (SELECT r.feature, greatest(coalesce(c.c, 0) / greatest(coalesce(t.tot, 0), 1), 1e-6) AS cs, greatest(r.r, 1e-6) AS rs
   FROM refb r LEFT JOIN (SELECT * FROM cnt WHERE b IS NOT NULL) c ON r.feature = c.feature AND r.b = c.b
   LEFT JOIN tot t ON r.feature = t.feature),
psi AS (SELECT t.feature, coalesce(p.psi, 0.0) AS psi, (t.n_all - coalesce(t.tot, 0)) / t.n_all AS out_of_range
   FROM tot t JOIN edges e USING (feature)
   LEFT JOIN (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM terms GROUP BY 1) p USING (feature))"""


def ks_sql(cur_long: str = "cur_long") -> str:
    def fr(strict: bool) -> str:
        op = "<" if strict else "<="
        idx = f"len(list_filter(vals, lambda x: x {op} value))"
        i1, i2 = f"greatest({idx}, 1)", f"least({idx} + 1, 6)"
        lin = f"(qs[{i1}] + (qs[{i2}] - qs[{i1}]) * (value - vals[{i1}]) / (vals[{i2}] - vals[{i1}])) / 100.0"
        if strict:
            return f"CASE WHEN value <= vals[1] THEN 0.0 WHEN value > vals[6] THEN 1.0 ELSE {lin} END"
        return f"CASE WHEN value < vals[1] THEN 0.0 WHEN value >= vals[6] THEN 1.0 ELSE {lin} END"
    lam = "sqrt(n * 1000.0 / (n + 1000.0)) * ks_stat"
    series = f"list_sum(list_transform(range(1, 101), lambda k: power(-1.0, k - 1) * exp(-2.0 * k * k * ({lam}) * ({lam}))))"
    return f""",
dv AS (SELECT feature, value, count(*) AS cnt FROM {cur_long} GROUP BY 1, 2),
cdf AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum,
               sum(cnt) OVER (PARTITION BY feature) AS n FROM dv),
kj AS (SELECT c.*, [r.min, r.p25, r.p50, r.p75, r.p95, r.max] AS vals, [0.0, 25.0, 50.0, 75.0, 95.0, 100.0] AS qs
       FROM cdf c JOIN ref_dist r USING (feature)),
ks0 AS (SELECT feature, n, max(greatest(abs((cum + cnt) / n - ({fr(False)})), abs(cum / n - ({fr(True)})))) AS ks_stat
        FROM kj GROUP BY 1, 2),
ks AS (SELECT feature, CAST(n AS BIGINT) AS n, ks_stat,
              CASE WHEN {lam} <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * {series})) END AS ks_pvalue FROM ks0)"""


@register("reference_distribution", BASE + "\nSELECT * FROM ref_dist", ["mean", "std", "p25", "p50", "p75", "p95", "min", "max"])
def q_refdist(spark, sf):
    """A17 on the reference-period features"""
    return D.reference_distribution(_ref(spark, sf))


@register("fit_scaler", BASE + SCALER + "\nSELECT * FROM scaler", ["mean", "scale"])
def q_fit_scaler(spark, sf):
    """D1"""
    return D.fit_scaler(_ref(spark, sf))


_SCALED = ", ".join(f"(coalesce(CAST(c.{c} AS DOUBLE), 0.0) - (SELECT mean FROM scaler WHERE feature = '{c}')) / "
                    f"(SELECT scale FROM scaler WHERE feature = '{c}') AS {c}" for c in NUM)


@register("apply_scaler", BASE + SCALER + f"\nSELECT c.CustomerID, {_SCALED}, c.is_single_purchase, c.has_reviews FROM cur_f c", NUM)
def q_apply_scaler(spark, sf):
    """Current features scaled with the reference-period scaler"""
    ref, cur = _periods(spark, sf)
    sc = D.fit_scaler(ref)
    cur = cur.select("CustomerID", *NUM, "is_single_purchase", "has_reviews")
    return D.apply_scaler(cur, sc)


def _round_trip(c: str) -> str:
    """(x - m) / s * s + m gives x back to a few units in the last place; what is compared is what survives that."""
    return f"CASE WHEN abs({c}) < 1000 THEN round({c}, 9) ELSE round({c}, 6) END"


@register("inverse_scaler", BASE + f"\nSELECT CustomerID, {', '.join(f'{_round_trip(f'CAST({c} AS DOUBLE)')} AS {c}' for c in NUM)} FROM cur_f", NUM)
def q_inverse_scaler(spark, sf):
    """D3: scale then inverse-scale returns the raw features"""
    ref, cur = _periods(spark, sf)
    sc = D.fit_scaler(ref)
    cur = cur.select("CustomerID", *NUM)
    back = D.apply_scaler(D.apply_scaler(cur, sc), sc, inverse=True)
    return back.select("CustomerID", *[F.expr(_round_trip(c)).alias(c) for c in NUM])


@register("psi", BASE + psi_sql() + "\nSELECT * FROM psi", ["psi", "out_of_range"])
def q_psi(spark, sf):
    """D4"""
    return _with_periods(spark, sf, lambda r, c: D.psi(c, D.reference_distribution(r)))


@register("ks_two_sample", BASE + ks_sql() + "\nSELECT * FROM ks", ["ks_stat", "ks_pvalue"])
def q_ks(spark, sf):
    """D5 (statistic vs. the piecewise-linear reference curve, asymptotic p)"""
    return _with_periods(spark, sf, lambda r, c: D.ks_statistic(c, D.reference_distribution(r)))


REPORT = BASE + psi_sql() + ks_sql() + """,
report AS (SELECT p.feature, p.psi, k.ks_stat, k.ks_pvalue, p.psi > 0.2 AS drift_detected FROM psi p JOIN ks k USING (feature))"""


@register("drift_report", REPORT + "\nSELECT * FROM report", ["psi", "ks_stat", "ks_pvalue"])
def q_report(spark, sf):
    """D6"""
    return _report(spark, sf)


def _self_test_sql() -> str:
    return base_sql(SHIFT_FEATURE) + psi_sql() + ks_sql() + """,
report AS (SELECT p.feature, p.psi, k.ks_stat, k.ks_pvalue, p.psi > 0.2 AS drift_detected FROM psi p JOIN ks k USING (feature))
SELECT * FROM report"""


@register("drift_self_test", _self_test_sql(), ["psi", "ks_stat", "ks_pvalue"])
def q_self_test(spark, sf):
    """A 5-sigma shift of one feature must be flagged"""
    r, c = _periods(spark, sf)
    ref = D.reference_distribution(r)
    return D.drift_report(D.inject_shift(c, ref, SHIFT_FEATURE), ref)


@register("drift_events_rows", REPORT + """
SELECT 'retention' AS module, feature AS feature_name, 'psi' AS metric, psi AS metric_value, CAST(0.2 AS DOUBLE) AS threshold,
       drift_detected AS alert_triggered, 'v1' AS reference_version FROM report""", ["metric_value", "threshold"])
def q_events(spark, sf):
    """D8"""
    return D.drift_events_rows(_report(spark, sf))


@register("drift_review_items", REPORT + """
SELECT 'drift_retention_' || feature AS request_id, 'retention' AS module, 'drift_alert' AS trigger,
       feature AS payload_feature, psi AS payload_psi, 'pending' AS status FROM report WHERE drift_detected""", ["payload_psi"])
def q_review_items(spark, sf):
    """D9 (payload fields read back from the JSON)"""
    r = D.drift_review_items(_report(spark, sf))
    return r.select("request_id", "module", "trigger",
                    F.get_json_object("payload", "$.feature").alias("payload_feature"),
                    F.get_json_object("payload", "$.psi").cast("double").alias("payload_psi"), "status")


@register("top_drifted", REPORT + "\nSELECT feature, psi FROM report ORDER BY psi DESC, feature LIMIT 5", ["psi"])
def q_top_drifted(spark, sf):
    """O3: five features with the highest PSI"""
    r = _report(spark, sf)
    return r.orderBy(F.col("psi").desc(), "feature").limit(5).select("feature", "psi")


@register("customer_feature_tables", "SELECT * FROM (SELECT 'ref' AS period, * EXCLUDE (churned) FROM (" + feature_sql(REF_SNAP, REF_OBS).replace("WITH ", "WITH ", 1)
          + ") UNION ALL SELECT 'cur' AS period, * EXCLUDE (churned) FROM (" + feature_sql() + "))",
          ["monetary_value", "avg_order_value", "recency_days_log", "purchase_gap_cv", "return_rate", "purchase_trend",
           "time_decay_weight", "avg_sentiment_score", "last_review_sentiment", "avg_battery_sentiment",
           "avg_shipping_sentiment", "avg_price_sentiment"])
def q_feature_tables(spark, sf):
    """J1 for two snapshots in one pass (multi-period builder)"""
    from storelens.operators import clean as C
    from storelens.operators.features import customer_feature_tables
    from storelens.plans.q_features import SSNAP
    from storelens.sources import fixtures as FX
    from storelens.sources.tables import Tables
    t = Tables(spark, sf)
    clean = C.clean_transactions(FX.transactions(t), country=None)
    return customer_feature_tables(clean, {"ref": (REF_SNAP, REF_OBS), "cur": (FX.RETENTION_SNAPSHOT, FX.RETENTION_OBS_START)},
                                   None, FX.review_sentiment(t), FX.aspect_sentiment(t), SSNAP)
