"""Evaluation metric queries (M1–M18) over prediction tables derived from the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.text import length_band
from storelens.operators import metrics as M
from storelens.operators import splits as SP
from storelens.plans import oracle as O
from storelens.plans.q_features import FEATURE_CTES, customer_features
from storelens.plans.q_reviews import REVIEWS, _reviews
from storelens.plans.registry import register
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables


def _bin(spark, sf):
    return FX.binary_predictions(Tables(spark, sf))


def _cls(spark, sf):
    return FX.class_predictions(Tables(spark, sf))


def _rev(spark, sf):
    return FX.review_predictions(_reviews(spark, sf))


CLS = O.with_(O.CLASS_PRED)
BIN = O.with_(O.BINARY_PRED)
REV = O.with_(REVIEWS, O.review_pred())


@register("classification_report", CLS + "SELECT * FROM " + O.report_f1_sql("cp"), ["precision", "recall", "f1"])
def q_report(spark, sf):
    """M1 over nearest-centroid predictions of the embeddings"""
    return M.classification_report(_cls(spark, sf))


@register("macro_weighted_f1", CLS + """SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS n, avg(f1) >= 0.9 AS meets_target FROM """ + O.report_f1_sql("cp"), ["macro_f1", "weighted_f1"])
def q_macro(spark, sf):
    """M2"""
    return M.macro_weighted_f1(M.classification_report(_cls(spark, sf)))


def _topk_sql(k: int) -> str:
    return (f"avg(CASE WHEN list_contains(list_slice(list_transform(list_sort(list_transform(proba, lambda p, i: {{'np': -p, 'idx': i - 1}})), "
            f"lambda s: s.idx), 1, {k}), y_true) THEN 1.0 ELSE 0.0 END)")


@register("topk_accuracy", CLS + f"SELECT CAST(count(*) AS BIGINT) AS n, {_topk_sql(1)} AS top1_accuracy, {_topk_sql(3)} AS top3_accuracy FROM cp",
          ["top1_accuracy", "top3_accuracy"])
def q_topk(spark, sf):
    """M3"""
    return M.topk_accuracy(_cls(spark, sf))


@register("confusion_matrix", CLS + """, grid AS (SELECT CAST(a AS INTEGER) AS true_label, CAST(b AS INTEGER) AS pred_label
  FROM range(10) r1(a), range(10) r2(b))
SELECT g.true_label, g.pred_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM grid g
LEFT JOIN (SELECT y_true, y_pred, count(*) AS n FROM cp GROUP BY 1, 2) c ON g.true_label = c.y_true AND g.pred_label = c.y_pred""")
def q_confusion(spark, sf):
    """M4 (10 classes, zero cells included)"""
    return M.confusion_matrix(_cls(spark, sf), 10)


def _name_sql(x: str) -> str:
    names = ", ".join(f"'{n}'" for n in M.TARGET_CATEGORIES)
    return f"CASE WHEN {x} < {len(M.TARGET_CATEGORIES)} THEN [{names}][{x} + 1] ELSE CAST({x} AS VARCHAR) END"


_HIGH = " OR ".join(f"(true_class = '{a}' AND predicted_class = '{b}')" for a, b in M.HIGH_COST_PAIRS)


@register("top_confusion_pairs", CLS + f"""SELECT true_class, predicted_class, CAST(cnt AS BIGINT) AS count,
  CASE WHEN {_HIGH} THEN '{M.HIGH_IMPACT}' ELSE '{M.MEDIUM_IMPACT}' END AS business_impact
FROM (SELECT {_name_sql('y_true')} AS true_class, {_name_sql('y_pred')} AS predicted_class, count(*) AS cnt
      FROM cp WHERE y_true <> y_pred GROUP BY 1, 2)
ORDER BY cnt DESC, true_class, predicted_class LIMIT 3""")
def q_top_pairs(spark, sf):
    """M5"""
    return M.top_confusion_pairs(_cls(spark, sf))


def _bin_case(v: str, last_closed: bool) -> str:
    parts = []
    for i in range(M.N_BINS):
        lo, hi = M.BIN_EDGES[i], M.BIN_EDGES[i + 1]
        op = "<=" if (last_closed and i == M.N_BINS - 1) else "<"
        parts.append(f"WHEN {v} >= CAST('{lo!r}' AS DOUBLE) AND {v} {op} CAST('{hi!r}' AS DOUBLE) THEN {i}")
    return "CASE " + " ".join(parts) + " END"


def _ece_sql(src: str, conf: str, hit: str, last_closed: bool) -> str:
    return f"""SELECT sum(CASE WHEN b IS NOT NULL THEN c * abs(acc - cf) ELSE 0.0 END) / sum(c) AS ece FROM (
  SELECT {_bin_case('cf0', last_closed)} AS b, count(*) AS c, avg(cf0) AS cf, avg(h0) AS acc
  FROM (SELECT {conf} AS cf0, {hit} AS h0 FROM {src}) GROUP BY 1)"""


@register("ece_multiclass", CLS + _ece_sql("cp", "list_max(proba)",
                                          "CASE WHEN list_position(proba, list_max(proba)) - 1 = y_true THEN 1.0 ELSE 0.0 END", False),
          ["ece"])
def q_ece_multi(spark, sf):
    """M6"""
    return M.ece_multiclass(_cls(spark, sf))


@register("ece_binary", BIN + _ece_sql("pred", "prob", "CAST(y_true AS DOUBLE)", True), ["ece"])
def q_ece_binary(spark, sf):
    """M7"""
    return M.ece_binary(_bin(spark, sf))


_INNER = ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in M.BIN_EDGES[1:-1])


@register("reliability_curve", BIN + f"""SELECT CAST(len(list_filter([{_INNER}], lambda e: e < prob)) AS INTEGER) AS bin,
  avg(prob) AS mean_predicted, avg(CAST(y_true AS DOUBLE)) AS fraction_positive, CAST(count(*) AS BIGINT) AS n
  FROM pred GROUP BY 1""", ["mean_predicted", "fraction_positive"])
def q_reliability(spark, sf):
    """M8"""
    return M.reliability_curve(_bin(spark, sf))


_THR = ", ".join(f"({j}, CAST('{t!r}' AS DOUBLE))" for j, t in enumerate(M.THRESHOLD_SWEEP))
FBETA_SQL = BIN + f""", thr AS (SELECT * FROM (VALUES {_THR}) v(j, threshold)),
cnt AS (SELECT t.threshold,
          CAST(count(*) FILTER (WHERE p.prob >= t.threshold AND p.y_true = 1) AS DOUBLE) AS tp,
          CAST(count(*) FILTER (WHERE p.prob >= t.threshold AND p.y_true = 0) AS DOUBLE) AS fp,
          CAST(count(*) FILTER (WHERE p.prob < t.threshold AND p.y_true = 1) AS DOUBLE) AS fn
        FROM thr t, pred p GROUP BY t.threshold),
sw AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
          CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN 5 * tp / (5 * tp + 4 * fn + fp) ELSE 0.0 END AS fbeta FROM cnt)
"""


@register("fbeta_threshold_sweep", FBETA_SQL + """SELECT *, row_number() OVER (ORDER BY fbeta DESC, threshold) = 1 AS is_best FROM sw""",
          ["threshold", "precision", "recall", "fbeta"])
def q_fbeta(spark, sf):
    """M9 + J7"""
    return M.fbeta_threshold_sweep(_bin(spark, sf))


@register("threshold_cross", FBETA_SQL + """SELECT threshold AS decision_threshold, fbeta, precision AS precision_at_threshold,
  recall AS recall_at_threshold FROM sw ORDER BY fbeta DESC, threshold LIMIT 1""",
          ["decision_threshold", "fbeta", "precision_at_threshold", "recall_at_threshold"])
def q_threshold_cross(spark, sf):
    """The chosen decision threshold (first maximum of F-beta)"""
    s = M.fbeta_threshold_sweep(_bin(spark, sf)).where("is_best")
    return s.select(F.col("threshold").alias("decision_threshold"), "fbeta",
                    F.col("precision").alias("precision_at_threshold"), F.col("recall").alias("recall_at_threshold"))


@register("roc_auc", BIN + "SELECT * FROM " + O.auc_sql("pred"), ["auc"])
def q_auc(spark, sf):
    """M10"""
    return M.roc_auc(_bin(spark, sf))


@register("f1_by_length", REV + """, g AS (SELECT *, CASE WHEN char_length // 4 < 50 THEN 'short' WHEN char_length // 4 < 300 THEN 'medium'
  ELSE 'long' END AS length_band FROM rpred),
sz AS (SELECT length_band, count(*) AS n FROM g GROUP BY 1)
SELECT r.length_band, CAST(sz.n AS BIGINT) AS n, avg(r.f1) AS macro_f1 FROM """ + O.report_f1_sql("g", ["length_band"]) +
          """ r JOIN sz USING (length_band) WHERE sz.n >= 10 GROUP BY r.length_band, sz.n""", ["macro_f1"])
def q_f1_length(spark, sf):
    """M11 by length band"""
    return M.grouped_macro_f1(_rev(spark, sf), length_band(F.col("char_length")), "length_band")


@register("f1_by_rating", REV + """, g AS (SELECT * FROM rpred WHERE rating IN (1, 3, 5)),
sz AS (SELECT rating, count(*) AS n FROM g GROUP BY 1)
SELECT r.rating, CAST(sz.n AS BIGINT) AS n, avg(r.f1) AS macro_f1 FROM """ + O.report_f1_sql("g", ["rating"]) +
          """ r JOIN sz USING (rating) WHERE sz.n >= 10 GROUP BY r.rating, sz.n""", ["macro_f1"])
def q_f1_rating(spark, sf):
    """M11 by star rating 1 / 3 / 5"""
    p = _rev(spark, sf).where(F.col("rating").isin(1, 3, 5))
    return M.grouped_macro_f1(p, F.col("rating"), "rating")


@register("domain_shift", REV + """, sz AS (SELECT source, count(*) AS n FROM rpred GROUP BY 1)
SELECT r.source, CAST(sz.n AS BIGINT) AS n, avg(r.f1) AS macro_f1, avg(r.f1) < 0.78 AS flagged FROM """ +
          O.report_f1_sql("rpred", ["source"]) + """ r JOIN sz USING (source) WHERE sz.n >= 10 GROUP BY r.source, sz.n""",
          ["macro_f1"])
def q_domain_shift(spark, sf):
    """M12 by review source"""
    return M.domain_shift(_rev(spark, sf), "source")


TENURE_SQL = ("CASE WHEN tenure_days <= 90 THEN '0-90' WHEN tenure_days <= 180 THEN '91-180' "
              "WHEN tenure_days <= 365 THEN '181-365' ELSE '365+' END")


@register("retention_subgroups", FEATURE_CTES + ", " + O.CHURN_PRED + f""", b AS (SELECT *, {TENURE_SQL} AS tenure_band FROM churn_pred)
SELECT * FROM """ + O.auc_sql("b", ["tenure_band"]), ["auc"])
def q_subgroups(spark, sf):
    """Churn AUC by tenure band"""
    p = FX.churn_predictions(customer_features(spark, sf))
    t = F.col("tenure_days")
    band = F.when(t <= 90, "0-90").when(t <= 180, "91-180").when(t <= 365, "181-365").otherwise("365+")
    return M.roc_auc(p.withColumn("tenure_band", band), by=["tenure_band"])


FREQ_SQL = ("CASE WHEN frequency <= 1 THEN '1' WHEN frequency <= 5 THEN '2-5' WHEN frequency <= 20 THEN '6-20' ELSE '20+' END")


@register("retention_pr_by_frequency", FEATURE_CTES + ", " + O.CHURN_PRED + f""", b AS (
  SELECT *, {FREQ_SQL} AS frequency_band, CAST(prob >= 0.5 AS INTEGER) AS y_pred FROM churn_pred)
SELECT frequency_band, CAST(count(*) AS BIGINT) AS n,
  CASE WHEN count(*) FILTER (WHERE y_pred = 1) > 0 THEN count(*) FILTER (WHERE y_pred = 1 AND y_true = 1) / count(*) FILTER (WHERE y_pred = 1) ELSE 0.0 END AS precision,
  CASE WHEN count(*) FILTER (WHERE y_true = 1) > 0 THEN count(*) FILTER (WHERE y_pred = 1 AND y_true = 1) / count(*) FILTER (WHERE y_true = 1) ELSE 0.0 END AS recall
FROM b GROUP BY 1""", ["precision", "recall"])
def q_pr_freq(spark, sf):
    """Churn precision / recall by order-frequency band at threshold 0.5"""
    p = FX.churn_predictions(customer_features(spark, sf))
    f = F.col("frequency")
    band = F.when(f <= 1, "1").when(f <= 5, "2-5").when(f <= 20, "6-20").otherwise("20+")
    d = p.withColumn("frequency_band", band).withColumn("y_pred", (F.col("prob") >= 0.5).cast("int"))
    tp = F.count_if((F.col("y_pred") == 1) & (F.col("y_true") == 1))
    pp = F.count_if(F.col("y_pred") == 1)
    ap = F.count_if(F.col("y_true") == 1)
    return d.groupBy("frequency_band").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.when(pp > 0, tp / pp).otherwise(0.0).alias("precision"),
        F.when(ap > 0, tp / ap).otherwise(0.0).alias("recall"))


@register("promotion_gate", BIN + f""", m AS (
  SELECT 'quality_model' AS run_id, 'roc_auc' AS metric, auc AS value FROM {O.auc_sql('pred')}
  UNION ALL SELECT 'quality_model', 'ece', ece FROM ({_ece_sql('pred', 'prob', 'CAST(y_true AS DOUBLE)', True)})
  UNION ALL SELECT 'auc_only_model', 'roc_auc', auc FROM {O.auc_sql('pred')})
SELECT run_id, max(value) FILTER (WHERE metric = 'roc_auc') AS roc_auc, max(value) FILTER (WHERE metric = 'ece') AS ece,
  reason = 'passed' AS promote, reason FROM (
  SELECT run_id, metric, value, NULL AS reason FROM m) q0
JOIN (SELECT run_id, CASE WHEN a IS NULL THEN 'missing roc_auc' WHEN e IS NULL THEN 'missing ece'
                    WHEN a < 0.87 THEN 'roc_auc below gate' WHEN e >= 0.05 THEN 'ece above gate' ELSE 'passed' END AS reason
      FROM (SELECT run_id, max(value) FILTER (WHERE metric = 'roc_auc') AS a, max(value) FILTER (WHERE metric = 'ece') AS e
            FROM m GROUP BY 1)) r USING (run_id)
GROUP BY run_id, reason""".replace("NULL AS reason FROM m) q0", "NULL AS r0 FROM m) q0"), ["roc_auc", "ece"])
def q_gate(spark, sf):
    """Metrics table of two runs (one lacks ECE) → promote / blocked"""
    p = _bin(spark, sf)
    auc = M.roc_auc(p).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    ece = M.ece_binary(p).select(F.lit("ece").alias("metric"), F.col("ece").alias("value"))
    m = (auc.unionByName(ece).withColumn("run_id", F.lit("quality_model"))
         .unionByName(auc.withColumn("run_id", F.lit("auc_only_model"))))
    return M.promotion_gate(m)


@register("fold_auc_summary", BIN + f""", f AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY y_true ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) - 1) % 5 AS INTEGER) AS fold FROM pred),
fa AS (SELECT * FROM {O.auc_sql('f', ['fold'])})
SELECT avg(auc) AS mean_auc, stddev_pop(auc) AS std_auc, CAST(count(*) AS BIGINT) AS n_folds,
       (SELECT auc FROM {O.auc_sql('pred')}) AS oof_auc FROM fa""", ["mean_auc", "std_auc", "oof_auc"])
def q_fold_auc(spark, sf):
    """Fold AUCs (stratified folds) → mean, population std, overall OOF AUC"""
    p = SP.stratified_folds(_bin(spark, sf), "y_true", "id")
    both = (M.roc_auc(p, by=["fold"]).select(F.col("fold").cast("int").alias("fold"), "auc")
            .unionByName(M.roc_auc(p).select(F.lit(None).cast("int").alias("fold"), "auc")))
    per_fold = F.col("fold").isNotNull()
    return both.agg(F.avg(F.when(per_fold, F.col("auc"))).alias("mean_auc"),
                    F.stddev_pop(F.when(per_fold, F.col("auc"))).alias("std_auc"),
                    F.count_if(per_fold).cast("bigint").alias("n_folds"),
                    F.max(F.when(~per_fold, F.col("auc"))).alias("oof_auc"))


RES_SQL = ("CASE WHEN res < 100 THEN '<100' WHEN res <= 300 THEN '100-300' ELSE '>300' END")


@register("accuracy_by_resolution", CLS + f"""SELECT {RES_SQL} AS resolution_band, CAST(count(*) AS BIGINT) AS n,
  avg(CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END) AS top1_accuracy
FROM (SELECT *, 32 + (id * 37) % 480 AS res FROM cp) GROUP BY 1""", ["top1_accuracy"])
def q_acc_res(spark, sf):
    """Top-1 accuracy by image-size band (size derived from the vector id)"""
    p = _cls(spark, sf).withColumn("res", 32 + (F.col("id") * 37) % 480)
    band = F.when(F.col("res") < 100, "<100").when(F.col("res") <= 300, "100-300").otherwise(">300")
    return p.groupBy(band.alias("resolution_band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("top1_accuracy"))
