"""Model-job queries (J8, L1–L17, W9, W13, M17). Most are rows-only checks:
their numbers come from fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.hashing import hashed_uniform
from storelens.operators import calibration as CA
from storelens.operators import clean as C
from storelens.operators import metrics as M
from storelens.operators import modeling as ML
from storelens.operators import ood as OD
from storelens.operators import sentiment_model as SM
from storelens.operators.drift import apply_scaler, fit_scaler, reference_distribution
from storelens.operators.splits import stratified_split
from storelens.plans import oracle as O
from storelens.plans.q_features import FEATURE_CTES, customer_features
from storelens.plans.q_reviews import _reviews
from storelens.plans.registry import register
from storelens.schemas import FEATURE_COLUMNS, NUMERIC_FEATURE_COLUMNS
from storelens.session import scratch_path
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables


def _matrix(spark, sf):
    return C.select_model_matrix(customer_features(spark, sf)).checkpoint(eager=True)


def _filled(c: str) -> str:
    return f"coalesce(CAST({c} AS DOUBLE), 0.0)"


_UNITS = ", ".join(f"CASE WHEN round(stddev_pop({_filled(c)}), 6) = 0 THEN 1.0 ELSE round(stddev_pop({_filled(c)}), 6) END AS u_{c}"
                   for c in NUMERIC_FEATURE_COLUMNS)
_V = "[" + ", ".join(f"{_filled('f.' + c)} / u_{c}" if c in NUMERIC_FEATURE_COLUMNS else _filled("f." + c) for c in FEATURE_COLUMNS) + "]"


@register("minority_knn", FEATURE_CTES + f""", units AS (SELECT {_UNITS} FROM features),
mino AS (SELECT f.CustomerID, {_V} AS v FROM features f, units WHERE f.churned = 0),
pairs AS (SELECT a.CustomerID, b.CustomerID AS nbr_id,
                 sqrt(list_sum(list_transform(range(1, {len(FEATURE_COLUMNS) + 1}), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist
          FROM mino a JOIN mino b ON a.CustomerID <> b.CustomerID)
SELECT CustomerID, nbr_id, dist, CAST(rk AS INTEGER) AS nbr_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY dist, nbr_id) AS rk FROM pairs) WHERE rk <= 5""", ["dist"])
def q_knn(spark, sf):
    """Exact 5 nearest retained customers in all 19 model columns, scaled (pivot join)"""
    f = customer_features(spark, sf).checkpoint(eager=True)
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURE_COLUMNS}
    unit = f.agg(*[F.round(F.stddev_pop(x[c]), 6).alias(c) for c in NUMERIC_FEATURE_COLUMNS]).first().asDict()  # one row
    v = F.array(*[x[c] / F.lit(unit.get(c) or 1.0) for c in FEATURE_COLUMNS])
    return ML.minority_knn(f.where(F.col("churned") == 0).select("CustomerID", v.alias("v")), "CustomerID", "v", 5)


@register("smote_balance", FEATURE_CTES + """SELECT CAST(churned AS INTEGER) AS churned, synthetic, CAST(n AS BIGINT) AS n FROM (
  SELECT churned, false AS synthetic, count(*) AS n FROM features WHERE churned IS NOT NULL GROUP BY 1
  UNION ALL SELECT 0, true, (SELECT count(*) FILTER (WHERE churned = 1) - count(*) FILTER (WHERE churned = 0) FROM features))""")
def q_smote(spark, sf):
    """L1: class counts after balancing the labelled customers to parity"""
    m = _matrix(spark, sf)
    s = ML.smote_balance(m, "CustomerID", "churned", FEATURE_COLUMNS)
    return s.groupBy(F.col("churned").cast("int").alias("churned"), "synthetic").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("oof_predictions")
def q_oof(spark, sf):
    """L2: 5-fold out-of-fold probabilities of both learners (SMOTE inside folds)"""
    return ML.oof_predictions(_matrix(spark, sf))


CHURN_AB = FEATURE_CTES + ", " + O.CHURN_PRED + f""", ab AS (SELECT CustomerID, y_true, prob AS p_a,
  0.5 * {O.uniform('CustomerID', 'learner_b')} + 0.5 * y_true AS p_b FROM churn_pred)"""


def _ab(spark, sf):
    p = FX.churn_predictions(customer_features(spark, sf))
    return p.select("CustomerID", "y_true", F.col("prob").alias("p_a"),
                    (F.lit(0.5) * hashed_uniform(F.col("CustomerID"), "learner_b") + F.lit(0.5) * F.col("y_true")).alias("p_b"))


@register("ensemble_probability", CHURN_AB + "SELECT CustomerID, 0.5 * p_a + 0.5 * p_b AS p_ensemble FROM ab", ["p_ensemble"])
def q_ensemble(spark, sf):
    """L3 (w = 0.5)"""
    return ML.ensemble_probability(_ab(spark, sf)).select("CustomerID", "p_ensemble")


_W = "CAST(('0x' || substr(md5('42|' || CAST(t AS VARCHAR)), 1, 13)) AS BIGINT) / power(16, 13)"


@register("best_so_far", CHURN_AB + f""", trials AS (SELECT t AS trial, {_W} AS w FROM range(0, 20) r(t)),
sc AS (SELECT trial, w * p_a + (1 - w) * p_b AS prob, y_true FROM trials, ab),
auc AS (SELECT * FROM {O.auc_sql('sc', ['trial'])})
SELECT CAST(trial AS BIGINT) AS trial, auc AS objective, max(auc) OVER (ORDER BY trial) AS best_so_far,
  CAST(count(*) OVER (ORDER BY trial) AS BIGINT) AS n_trials, row_number() OVER (ORDER BY auc DESC, trial) = 1 AS is_best FROM auc""",
          ["objective", "best_so_far"])
def q_best_so_far(spark, sf):
    """W13 over an ensemble-weight search: 20 hashed weights, objective = AUC"""
    ab = _ab(spark, sf)
    cells = F.array(*[F.struct(F.lit(j).cast("bigint").alias("trial"), hashed_uniform(F.lit(j), 42).alias("w"))
                      for j in range(20)])
    sc = ab.select("y_true", "p_a", "p_b", F.explode(cells).alias("t")).select(
        "t.trial", (F.col("t.w") * F.col("p_a") + (1 - F.col("t.w")) * F.col("p_b")).alias("prob"), "y_true")
    auc = M.roc_auc(sc, by=["trial"]).select("trial", F.col("auc").alias("objective"))
    return ML.best_so_far(auc)


@register("param_search")
def q_param_search(spark, sf):
    """50 hashed trials, 5-fold CV AUC by rungs of successive halving, appended to a resumable trial table"""
    return ML.param_search(_matrix(spark, sf), scratch_path(spark, "trials"))


@register("final_fit")
def q_final_fit(spark, sf):
    """L4: refit both learners on all labelled rows (balanced once), save, predict"""
    m = _matrix(spark, sf)
    m = apply_scaler(m, fit_scaler(m)).checkpoint(eager=True)
    ma, mb = ML.final_fit(m, scratch_path(spark, "models"))
    return ML.predict_both(ma, mb, m).select("CustomerID", "churned", "p_a", "p_b")


@register("fit_calibrator")
def q_fit_cal(spark, sf):
    """Platt below 1,000 rows else isotonic; ECE before/after on the held-out half"""
    _, rep = CA.fit_calibrator(FX.binary_predictions(Tables(spark, sf)))
    return rep


def _hist_calibrator(spark, sf):
    rc = M.reliability_curve(FX.binary_predictions(Tables(spark, sf))).orderBy("bin").collect()  # ≤ 10 rows
    xs, ys, best = [], [], 0.0
    for r in rc:
        best = max(best, r["fraction_positive"])
        xs.append(r["mean_predicted"])
        ys.append(best)
    return CA.Calibrator("isotonic", xs, ys)


@register("apply_calibrator", O.with_(O.BINARY_PRED) + """, rc AS (SELECT CAST(len(list_filter([""" +
          ", ".join(f"CAST('{e!r}' AS DOUBLE)" for e in M.BIN_EDGES[1:-1]) + """], lambda e: e < prob)) AS INTEGER) AS bin,
     avg(prob) AS mp, avg(CAST(y_true AS DOUBLE)) AS fp FROM pred GROUP BY 1),
cal AS (SELECT list(mp ORDER BY bin) AS xs, list(mx ORDER BY bin) AS ys FROM (SELECT *, max(fp) OVER (ORDER BY bin) AS mx FROM rc)),
j AS (SELECT p.id, p.prob, c.xs, c.ys, len(list_filter(c.xs, lambda b: b <= p.prob)) AS i, len(c.xs) AS n FROM pred p, cal c)
SELECT id, prob, CASE WHEN prob <= xs[1] THEN ys[1] WHEN prob >= xs[n] THEN ys[n]
  WHEN xs[least(i + 1, n)] = xs[greatest(i, 1)] THEN ys[greatest(i, 1)]
  ELSE ys[greatest(i, 1)] + (ys[least(i + 1, n)] - ys[greatest(i, 1)]) * (prob - xs[greatest(i, 1)]) / (xs[least(i + 1, n)] - xs[greatest(i, 1)]) END
  AS calibrated FROM j""", ["prob", "calibrated"])
def q_apply_cal(spark, sf):
    """Monotone binning calibrator (reliability bins + running max) applied by interpolation"""
    cal = _hist_calibrator(spark, sf)
    p = FX.binary_predictions(Tables(spark, sf))
    return cal.onto(p.select("id", "prob"), "prob", "calibrated")


@register("score_customers")
def q_score(spark, sf):
    """The batch scorer end to end on the feature table

    Calibrator and threshold come from out-of-fold scores: no row is judged by a model that saw it.
    """
    f = customer_features(spark, sf).checkpoint(eager=True)
    m, scaler = C.select_model_matrix(f), fit_scaler(f)
    oof, ma, mb = ML.fit_ensemble(apply_scaler(m, scaler).checkpoint(eager=True))
    oof = ML.ensemble_probability(oof).select(
        F.col("CustomerID").alias("id"), F.col("churned").alias("y_true"), F.col("p_ensemble").alias("prob")).checkpoint(eager=True)
    cal, _ = CA.fit_calibrator(oof)
    threshold = CA.decision_threshold(cal.onto(oof, "prob", "_p").drop("prob").withColumnRenamed("_p", "prob"))
    factors = _explain(m).select("CustomerID", F.slice("top_features", 1, 3).alias("top_features"))
    return CA.score_customers(f.drop("churned"), scaler, ma, mb, cal, threshold=threshold, factors=factors)


def _explain(m):
    model = ML.logistic_surrogate(m)
    known = reference_distribution(m, FEATURE_COLUMNS).collect()  # a row a feature
    means = {r["feature"]: r["mean"] for r in known}
    return ML.explain_scores(m, model, means, training={r["feature"]: (r["p25"], r["p95"]) for r in known})


def _explained(spark, sf):
    return _explain(_matrix(spark, sf))


@register("explain_scores")
def q_explain(spark, sf):
    """L9 + W9 + C16/C17: top-10 additive contributions per customer"""
    e = _explained(spark, sf)
    return e.select("CustomerID", F.explode("top_features").alias("t")).select("CustomerID", "t.*")


@register("top_features_surrogate")
def q_top_features_surrogate(spark, sf):
    """W9 on the logistic surrogate's contributions (scoring response form)"""
    e = _explained(spark, sf)
    return e.select("CustomerID", F.slice("top_features", 1, 3).alias("t")).select(
        "CustomerID", F.explode("t").alias("f")).select("CustomerID", "f.feature", "f.direction")


@register("contribution_sum_check")
def q_sum_check(spark, sf):
    """Additivity of the contributions (must pass)"""
    return ML.contribution_sum_check(_explained(spark, sf))


@register("sentiment_classifier")
def q_sent_clf(spark, sf):
    """Train on the train split, per-class report on the test split"""
    r = stratified_split(_reviews(spark, sf), "label", "review_id").checkpoint(eager=True)
    model = SM.sentiment_classifier(r.where(F.col("split") == "train"))
    sc = SM.score_reviews(model, r.where(F.col("split") == "test"))
    y = F.array_position(F.array(*[F.lit(x) for x in SM.LABELS]), F.col("y")) - 1
    ev = sc.join(r.select("review_id", F.col("label").alias("y")), "review_id").select(
        y.alias("y_true"), (F.array_position(F.array(*[F.lit(x) for x in SM.LABELS]), F.col("label")) - 1).alias("y_pred"))
    return M.classification_report(ev)


@register("score_reviews")
def q_score_reviews(spark, sf):
    """Batch review scoring (label, confidence, score, overall, preview)"""
    r = stratified_split(_reviews(spark, sf), "label", "review_id").checkpoint(eager=True)
    model = SM.sentiment_classifier(r.where(F.col("split") == "train"))
    return SM.score_reviews(model, r.select("review_id", "text"))


def _ood(spark, sf):
    emb = Tables(spark, sf).embeddings
    return OD.ood_reference(emb)


@register("ood_reference")
def q_ood_ref(spark, sf):
    """Reference statistics (one row)"""
    ref = _ood(spark, sf)
    return spark.range(1).select(F.lit(int(ref.mean.shape[0])).alias("dims"), F.lit(float(ref.threshold)).alias("p99_distance"),
                                 F.lit(float((ref.mean ** 2).sum() ** 0.5)).alias("mean_norm"))


@register("ood_score")
def q_ood_score(spark, sf):
    """L15"""
    ref = _ood(spark, sf)
    return OD.ood_score(Tables(spark, sf).embeddings, ref).select("vec_id", "ood_score", "ood_flagged")


def _classified(spark, sf):
    t = Tables(spark, sf)
    ref = _ood(spark, sf)
    p = FX.class_predictions(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return OD.classify_products(p, ref, baseline_top1=0.5)


@register("classify_products")
def q_classify(spark, sf):
    """L16"""
    return _classified(spark, sf).select("id", "predicted_category", "confidence", "ood_score", "ood_flagged",
                                         "low_confidence", "baseline_top1", "baseline_delta")


@register("route_for_review")
def q_route(spark, sf):
    """L17"""
    return OD.route_for_review(_classified(spark, sf))


def _z_sql() -> str:
    from storelens.schemas import NUMERIC_FEATURE_COLUMNS as NUM
    z = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in NUM)
    return FEATURE_CTES + f""", z AS (UNPIVOT (SELECT CustomerID, {z} FROM features) ON {', '.join(NUM)} INTO NAME feature VALUE value),
sc AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS scale FROM z GROUP BY 1),
c AS (SELECT z.CustomerID, z.feature, (z.value - sc.mean) / sc.scale AS contribution, z.value FROM z JOIN sc USING (feature))
SELECT CustomerID, CAST(rk AS INTEGER) AS rank, feature, contribution,
  CASE WHEN contribution > 0 THEN 'increases_churn' ELSE 'decreases_churn' END AS direction, value FROM (
  SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY abs(contribution) DESC, feature) AS rk FROM c) WHERE rk <= 3"""


@register("top_features", _z_sql(), ["contribution", "value"])
def q_top_features(spark, sf):
    """Top-3 features per customer by |standardised deviation| (D1 scaler)"""
    from storelens.operators.drift import unpivot_features
    from storelens.schemas import NUMERIC_FEATURE_COLUMNS as NUM
    f = customer_features(spark, sf)
    filled = f.select("CustomerID", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUM])
    sc = fit_scaler(filled, NUM)
    long = unpivot_features(filled, NUM, "CustomerID").join(F.broadcast(sc), "feature")  # one row per feature
    c = long.select("CustomerID", "feature", ((F.col("value") - F.col("mean")) / F.col("scale")).alias("contribution"), "value")
    return ML.top_contributions(c, "CustomerID", 3)
