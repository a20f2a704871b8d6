"""Evaluation metrics (M1–M18) as grouped aggregates over prediction tables.

Predictions are ``(id, y_true, y_pred[, proba array<double>])`` for classes
and ``(id, y_true, prob)`` for binary scores. Every metric reduces to counts per
(group, class) or per (group, bin) — partial aggregation per task, tiny
finals — so no metric needs the rows in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.operators.ranking import exclusive_cumsum

# Reference constants.
N_BINS = 10
BIN_EDGES = [i * 0.1 for i in range(N_BINS)] + [1.0]  # = numpy linspace(0, 1, 11)
THRESHOLD_SWEEP = [round(0.30 + 0.01 * i, 2) for i in range(41)]
FBETA_BETA = 2.0
TARGET_CATEGORIES = ["Electronics", "Fashion", "Home & Kitchen", "Sports", "Furniture", "Beauty", "Books", "Toys"]
HIGH_COST_PAIRS = [("Electronics", "Home & Kitchen"), ("Home & Kitchen", "Electronics"),
                   ("Electronics", "Sports"), ("Sports", "Electronics")]
HIGH_IMPACT = "HIGH — search ranking and catalog integrity risk"
MEDIUM_IMPACT = "MEDIUM — user experience degradation"
MIN_GROUP_N = 10
OOD_F1_FLAG = 0.78
AUC_GATE = 0.87
ECE_GATE = 0.05


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def classification_report(pred: DataFrame, by: list[str] | None = None,
                          y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """M1: precision / recall / F1 / support per class (0 on zero division).

    Classes = labels seen in either column. Counts come from one grouped
    aggregate of (group, y, ŷ); the per-class sums are unions of two tiny
    aggregates.
    """
    by = list(by or [])
    cm = pred.groupBy(*by, F.col(y).alias("_y"), F.col(yhat).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    true_side = cm.groupBy(*by, F.col("_y").alias("label")).agg(
        F.sum("_n").alias("support"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("tp"))
    pred_side = cm.groupBy(*by, F.col("_p").alias("label")).agg(F.sum("_n").alias("predicted"))
    j = true_side.join(pred_side, [*by, "label"], "full")
    tp = F.coalesce(F.col("tp"), F.lit(0)).cast("double")
    sup = F.coalesce(F.col("support"), F.lit(0))
    prd = F.coalesce(F.col("predicted"), F.lit(0))
    p = _safe_div(tp, prd.cast("double"))
    r = _safe_div(tp, sup.cast("double"))
    return j.select(*by, "label", p.alias("precision"), r.alias("recall"),
                    _safe_div(2 * p * r, p + r).alias("f1"), sup.cast("bigint").alias("support"))


def macro_weighted_f1(report: DataFrame, by: list[str] | None = None,
                      macro_target: float = 0.90) -> DataFrame:
    """M2: macro and support-weighted F1 (+ target flag) from an M1 report."""
    by = list(by or [])
    g = report.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        _safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted_f1"),
        F.sum("support").cast("bigint").alias("n"))
    return g.withColumn("meets_target", F.col("macro_f1") >= macro_target)


def topk_order(proba: Column) -> Column:
    """Class indices sorted by probability desc (index asc on ties)."""
    pairs = F.transform(proba, lambda p, i: F.struct((-p).alias("neg_p"), i.alias("idx")))
    return F.transform(F.array_sort(pairs), lambda s: s["idx"])


def topk_accuracy(pred: DataFrame, ks: tuple[int, ...] = (1, 3), y: str = "y_true",
                  proba: str = "proba", by: list[str] | None = None) -> DataFrame:
    """M3: share of rows whose true class is in the top-k of the probabilities."""
    by = list(by or [])
    order = topk_order(F.col(proba))
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in ks:
        aggs.append(F.avg(F.array_contains(F.slice(order, 1, k), F.col(y)).cast("double")).alias(f"top{k}_accuracy"))
    return pred.groupBy(*by).agg(*aggs)


def confusion_matrix(pred: DataFrame, n_classes: int, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """M4: the full K×K matrix, zero cells included.

    The grid is generated from ``range(K²)`` (size fixed by the model's class
    count, not by the data) and left-joined to the grouped counts.
    """
    spark = pred.sparkSession
    grid = spark.range(n_classes * n_classes).select(
        (F.col("id") / n_classes).cast("int").alias("true_label"), (F.col("id") % n_classes).cast("int").alias("pred_label"))
    cm = pred.groupBy(F.col(y).cast("int").alias("true_label"), F.col(yhat).cast("int").alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n"))
    return grid.join(cm, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def class_name(idx: Column, names: list[str] = TARGET_CATEGORIES) -> Column:
    arr = F.array(*[F.lit(n) for n in names])
    return F.when(idx < len(names), F.element_at(arr, (idx + 1).cast("int"))).otherwise(idx.cast("string"))


def top_confusion_pairs(pred: DataFrame, names: list[str] = TARGET_CATEGORIES, top_n: int = 3,
                        y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """M5: most frequent (true, predicted) mistakes with business impact.

    Grouped counts (partial aggregation) then ``orderBy.limit`` → TakeOrdered
    (a per-partition top-n, merged on the driver: n rows, not the table).
    """
    wrong = pred.where(F.col(y) != F.col(yhat))
    g = wrong.groupBy(class_name(F.col(y), names).alias("true_class"),
                      class_name(F.col(yhat), names).alias("predicted_class")).agg(F.count(F.lit(1)).alias("count"))
    high = None
    for a, b in HIGH_COST_PAIRS:
        c = (F.col("true_class") == a) & (F.col("predicted_class") == b)
        high = c if high is None else (high | c)
    top = g.orderBy(F.col("count").desc(), "true_class", "predicted_class").limit(top_n)
    return top.select("true_class", "predicted_class", F.col("count").cast("bigint"),
                      F.when(high, HIGH_IMPACT).otherwise(MEDIUM_IMPACT).alias("business_impact"))


def bin_index(v: Column, last_closed: bool) -> Column:
    """Bin of ``v`` among ``BIN_EDGES``: [e_i, e_{i+1}); the last bin is closed
    when ``last_closed``, otherwise v = 1.0 falls outside (null)."""
    expr = None
    for i in range(N_BINS):
        lo, hi = BIN_EDGES[i], BIN_EDGES[i + 1]
        cond = (v >= F.lit(lo)) & ((v <= F.lit(hi)) if (last_closed and i == N_BINS - 1) else (v < F.lit(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def _ece_from_bins(binned: DataFrame, conf: str, hit: str, by: list[str]) -> DataFrame:
    """Σ_bins (n_bin / N)·|acc − conf|; N counts every row, also those outside
    the bins (grouped with a null bin), so no join with a separate count."""
    b = binned.groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_c"), F.avg(conf).alias("_conf"), F.avg(hit).alias("_acc"))
    part = F.when(F.col("_bin").isNotNull(), F.col("_c") * F.abs(F.col("_acc") - F.col("_conf"))).otherwise(0.0)
    return b.groupBy(*by).agg((F.sum(part) / F.sum("_c")).alias("ece"))


def ece_multiclass(pred: DataFrame, proba: str = "proba", y: str = "y_true",
                   by: list[str] | None = None) -> DataFrame:
    """M6: ECE on max probability, 10 bins, last bin half-open (conf = 1.0 dropped
    from the bins but counted in N)."""
    by = list(by or [])
    conf = F.array_max(F.col(proba))
    hit = (F.array_position(F.col(proba), conf) - 1 == F.col(y)).cast("double")
    d = pred.select(*by, conf.alias("_cf"), hit.alias("_hit"))
    d = d.withColumn("_bin", bin_index(F.col("_cf"), last_closed=False))
    return _ece_from_bins(d, "_cf", "_hit", by)


def ece_binary(pred: DataFrame, prob: str = "prob", y: str = "y_true",
               by: list[str] | None = None) -> DataFrame:
    """M7: ECE of a binary probability vs. label, 10 bins, last bin closed."""
    by = list(by or [])
    d = pred.select(*by, F.col(prob).alias("_cf"), F.col(y).cast("double").alias("_hit"))
    d = d.withColumn("_bin", bin_index(F.col("_cf"), last_closed=True))
    return _ece_from_bins(d, "_cf", "_hit", by)


def reliability_curve(pred: DataFrame, prob: str = "prob", y: str = "y_true", n_bins: int = N_BINS) -> DataFrame:
    """M8: per non-empty bin mean predicted and fraction positive.

    Uniform bins with inner edges assigned like ``searchsorted(edges[1:-1], p)``:
    bin i holds (e_i, e_{i+1}], the first bin also 0.
    """
    inner = BIN_EDGES[1:-1]
    b = F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e < F.col(prob)))
    g = pred.groupBy(b.alias("bin")).agg(F.avg(F.col(prob)).alias("mean_predicted"),
                                          F.avg(F.col(y).cast("double")).alias("fraction_positive"),
                                          F.count(F.lit(1)).alias("n"))
    return g.select(F.col("bin").cast("int"), "mean_predicted", "fraction_positive", F.col("n").cast("bigint"))


def fbeta_threshold_sweep(pred: DataFrame, prob: str = "prob", y: str = "y_true",
                          thresholds: list[float] | None = None, beta: float = FBETA_BETA) -> DataFrame:
    """M9 + J7: P, R, F-β at each threshold; ``is_best`` marks the first maximum.

    Rows are reduced to ``k`` = number of thresholds ≤ score (so predicted
    positive at threshold j ⇔ k > j); counts per k form a table of
    len(thresholds)+1 rows and reverse prefix sums give tp/fp per threshold.
    Never rows × thresholds.
    """
    ts = thresholds or THRESHOLD_SWEEP
    spark = pred.sparkSession
    arr = F.array(*[F.lit(float(t)) for t in ts])
    k = F.size(F.filter(arr, lambda t: t <= F.col(prob)))
    counts = pred.groupBy(k.alias("k")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    thr = spark.createDataFrame([(j, float(t)) for j, t in enumerate(ts)], "j int, threshold double")
    allk = spark.range(len(ts) + 1).select(F.col("id").cast("int").alias("k"))
    full = allk.join(counts, "k", "left").select("k", F.coalesce("pos", F.lit(0)).alias("pos"),
                                                 F.coalesce("cnt", F.lit(0)).alias("cnt"))
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy()
    cum = full.select("k", F.sum("pos").over(w).alias("tp_ge"), F.sum("cnt").over(w).alias("n_ge"),
                      F.sum("pos").over(tot).alias("P"))
    # threshold j predicts positive for k > j, i.e. the reverse sum from k = j + 1
    j = thr.join(cum.withColumn("j", F.col("k") - 1), "j").drop("k")
    tp = F.col("tp_ge").cast("double")
    fp = (F.col("n_ge") - F.col("tp_ge")).cast("double")
    fn = (F.col("P") - F.col("tp_ge")).cast("double")
    b2 = beta * beta
    out = j.select("threshold", _safe_div(tp, tp + fp).alias("precision"), _safe_div(tp, tp + fn).alias("recall"),
                   _safe_div((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp).alias("fbeta"))
    best = Window.orderBy(F.col("fbeta").desc(), F.col("threshold").asc())
    return out.withColumn("is_best", F.row_number().over(best) == 1)


def roc_auc(pred: DataFrame, prob: str = "prob", y: str = "y_true", by: list[str] | None = None,
            buckets: int = 1024) -> DataFrame:
    """Exact ROC AUC (ties count ½) by the Mann–Whitney form.

    Distinct scores with (pos, neg) counts; for each, the number of negatives
    strictly below comes from a bucketed exclusive prefix sum (two-level, no
    single-task window); AUC = Σ pos·(neg_below + ½·neg) / (P·N).
    """
    by = list(by or [])
    s = pred.groupBy(*by, F.col(prob).alias("_s")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    bucket = F.floor(F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0)) * buckets)
    c = exclusive_cumsum(s, "_s", ["neg"], bucket, by)
    g = c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                           F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))).alias("_u"))
    return g.select(*by, F.col("n_pos").cast("bigint"), F.col("n_neg").cast("bigint"),
                    F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                           F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def grouped_macro_f1(pred: DataFrame, group: Column, name: str, min_n: int = MIN_GROUP_N,
                     y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """M11/M12 core: macro F1 per group, groups with fewer than ``min_n`` rows skipped."""
    d = pred.withColumn(name, group)
    sizes = d.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    rep = classification_report(d, [name], y, yhat)
    mf = rep.groupBy(name).agg(F.avg("f1").alias("macro_f1"))
    return mf.join(sizes.where(F.col("n") >= min_n), name).select(name, F.col("n").cast("bigint"), "macro_f1")


def domain_shift(pred: DataFrame, category: str, threshold: float = OOD_F1_FLAG, min_n: int = MIN_GROUP_N,
                 y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Macro F1 per category (n ≥ 10) flagged below 0.78."""
    g = grouped_macro_f1(pred, F.col(category), category, min_n, y, yhat)
    return g.withColumn("flagged", F.col("macro_f1") < threshold)


def promotion_gate(metrics: DataFrame, auc_gate: float = AUC_GATE, ece_gate: float = ECE_GATE) -> DataFrame:
    """Promote iff AUC ≥ 0.87 and ECE < 0.05; missing metrics block with a reason.

    ``metrics`` is a long table (run_id, metric, value).
    """
    g = metrics.groupBy("run_id").agg(
        F.max(F.when(F.col("metric") == "roc_auc", F.col("value"))).alias("roc_auc"),
        F.max(F.when(F.col("metric") == "ece", F.col("value"))).alias("ece"))
    reason = (F.when(F.col("roc_auc").isNull(), "missing roc_auc")
               .when(F.col("ece").isNull(), "missing ece")
               .when(F.col("roc_auc") < auc_gate, "roc_auc below gate")
               .when(F.col("ece") >= ece_gate, "ece above gate").otherwise("passed"))
    return g.select("run_id", "roc_auc", "ece", (reason == "passed").alias("promote"), reason.alias("reason"))
