"""Content-file (image) queries and score post-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import scoring as SC
from storelens.operators import drift as D
from storelens.operators import images as IM
from storelens.operators import metrics as M
from storelens.operators import splits as SP
from storelens.plans import oracle as O
from storelens.plans.q_drift import BASE as DRIFT_BASE
from storelens.plans.q_drift import _periods
from storelens.plans.q_features import FEATURE_CTES, customer_features
from storelens.plans.q_reviews import REVIEWS, _reviews
from storelens.plans.registry import register
from storelens.schemas import NUMERIC_FEATURE_COLUMNS as NUM
from storelens.sources import files as FL
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables


def _files(spark, sf):
    return FX.content_files(Tables(spark, sf))


FILES = O.with_(O.content_files_sql())
EXT = O.ext_sql("path")


def _upload_reason_sql() -> str:
    size = "octet_length(content)"
    return (f"CASE WHEN {size} < 5000 THEN 'File too small: ' || CAST({size} AS VARCHAR) || ' bytes < 5000' "
            f"WHEN {size} > 10485760 THEN 'File too large: ' || CAST({size} AS VARCHAR) || ' bytes > 10485760' "
            f"WHEN {EXT} NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'Invalid extension: ' || {EXT} "
            f"WHEN NOT ({O.magic_sql('content', EXT)}) THEN 'File content does not match declared image type' "
            f"ELSE 'ok' END")


@register("upload_rules", FILES + f"SELECT path, ({_upload_reason_sql()}) = 'ok' AS valid, {_upload_reason_sql()} AS reason FROM files")
def q_upload(spark, sf):
    """C11"""
    return IM.upload_rules(_files(spark, sf))


@register("content_sha256", FILES + "SELECT path, sha256(content) AS sha256, CAST(octet_length(content) AS INTEGER) AS n_bytes FROM files")
def q_sha(spark, sf):
    """C12"""
    f = _files(spark, sf)
    return f.select("path", IM.content_sha256(f).alias("sha256"), F.length("content").alias("n_bytes"))


@register("dataset_fingerprint", FILES + "SELECT path AS file, md5(content) AS md5 FROM files")
def q_fingerprint(spark, sf):
    """MD5 per file"""
    return FL.dataset_fingerprint(_files(spark, sf))


def _image_rules_sql() -> str:
    size = "octet_length(content)"
    return FILES + f""", d AS (SELECT path, content, {O.dims_sql('content')} FROM files),
r AS (SELECT path, width, height,
  CASE WHEN {EXT} NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'invalid extension: ' || {EXT}
       WHEN {size} < 5000 THEN 'file too small: ' || CAST({size} AS VARCHAR) || ' bytes < 5000'
       WHEN {size} > 10000000 THEN 'file too large: ' || CAST({size} AS VARCHAR) || ' bytes > 10000000'
       WHEN width IS NULL THEN 'corrupt or unreadable'
       WHEN width < 64 OR height < 64 THEN 'image too small: ' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || 'px'
       ELSE 'ok' END AS reason FROM d)
SELECT path, width, height, reason = 'ok' AS valid, reason FROM r"""


@register("image_rules", _image_rules_sql())
def q_image_rules(spark, sf):
    """Header dimensions via a pandas UDF over the header bytes"""
    return IM.image_rules(_files(spark, sf)).drop("category", "page_id")


RULED = f"""SELECT path, category, sha256(content) AS sha256,
  CASE WHEN {EXT} NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'corrupt'
       WHEN octet_length(content) < 5000 OR octet_length(content) > 10000000 THEN 'size'
       WHEN width IS NULL THEN 'corrupt' WHEN width < 64 OR height < 64 THEN 'size' ELSE 'ok' END AS r
  FROM (SELECT *, {O.dims_sql('content')} FROM files)"""

DEDUP = FILES + f""", v AS (SELECT path, category, sha256 FROM ({RULED}) WHERE r = 'ok'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY category, path) AS rn FROM v) WHERE rn = 1)"""


@register("first_seen_dedup", DEDUP + "SELECT path, category, sha256 FROM firsts")
def q_dedup(spark, sf):
    """Valid files, first per SHA-256 across categories"""
    v = IM.hashed_files(_files(spark, sf)).where("valid").select("path", "category", "sha256")
    return IM.first_seen_dedup(v)


@register("split_statistics", FILES + f""", d AS (SELECT category, path, r, sha256 AS h FROM ({RULED})),
f AS (SELECT h, arg_min(category, (category, path)) AS fc, arg_min(path, (category, path)) AS fp FROM d WHERE r = 'ok' GROUP BY h),
j AS (SELECT d.*, r = 'ok' AND NOT (f.fc = d.category AND f.fp = d.path) AS dup FROM d LEFT JOIN f USING (h))
SELECT coalesce(category, '__overall__') AS category, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE r = 'ok' AND NOT dup) AS BIGINT) AS valid,
  CAST(count(*) FILTER (WHERE r = 'size') AS BIGINT) AS invalid_size,
  CAST(count(*) FILTER (WHERE r = 'corrupt') AS BIGINT) AS invalid_corrupt,
  CAST(count(*) FILTER (WHERE dup) AS BIGINT) AS duplicates
FROM j GROUP BY ROLLUP (category)""")
def q_split_stats(spark, sf):
    """A21 with an overall row (rollup)"""
    return IM.split_statistics(_files(spark, sf))


@register("image_dev_sample", DEDUP + """, s AS (
  SELECT path, category, CASE WHEN rk < floor(n * 0.7) THEN 'train' WHEN rk < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || path), path) - 1 AS rk,
               count(*) OVER (PARTITION BY category) AS n FROM firsts))
SELECT path, category, split, CAST(rk AS BIGINT) AS _rank FROM (
  SELECT *, row_number() OVER (PARTITION BY split, category ORDER BY md5('42|' || path), path) - 1 AS rk FROM s)
WHERE rk < greatest(1, floor(10 * CASE split WHEN 'train' THEN 0.7 WHEN 'val' THEN 0.15 ELSE 0.15 END))""")
def q_dev_sample(spark, sf):
    """W4 on images (by category after dedup) → W6 dev sample of 10 per class"""
    v = IM.hashed_files(_files(spark, sf)).where("valid").select("path", "category", "sha256")
    s = SP.stratified_split(IM.first_seen_dedup(v).select("path", "category"), "category", "path")
    return SP.split_sample(s, "category", "path", per_class=10)


# ---- score post-processing ------------------------------------------------

REV = O.with_(REVIEWS, O.review_pred())


@register("sentiment_from_probs", REV + """SELECT review_id,
  ['negative', 'neutral', 'positive'][list_position(proba, list_max(proba))] AS label,
  round(list_max(proba), 4) AS confidence, round(least(1.0, greatest(-1.0, proba[3] - proba[1])), 4) AS sentiment_score
FROM rpred""", ["confidence", "sentiment_score"])
def q_from_probs(spark, sf):
    """C6"""
    p = FX.review_predictions(_reviews(spark, sf))
    return p.select("review_id", SC.sentiment_from_probs(F.col("proba")).alias("s")).select("review_id", "s.*")


@register("overall_sentiment", REV + """SELECT review_id, CASE WHEN round(list_max(proba), 4) < 0.65 THEN 'Mixed'
  ELSE ['Negative', 'Neutral', 'Positive'][list_position(proba, list_max(proba))] END AS overall_sentiment FROM rpred""")
def q_overall(spark, sf):
    """C7"""
    p = FX.review_predictions(_reviews(spark, sf))
    s = SC.sentiment_from_probs(F.col("proba"))
    return p.select("review_id", SC.overall_sentiment(s["label"], s["confidence"]).alias("overall_sentiment"))


CHURN = FEATURE_CTES + ", " + O.CHURN_PRED


@register("risk_band", CHURN + """SELECT CustomerID, prob, CASE WHEN prob < 0.3 THEN 'LOW' WHEN prob < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
  CASE WHEN prob >= 0.33 THEN 'RETENTION_OFFER' ELSE 'NONE' END AS recommended_action FROM churn_pred""", ["prob"])
def q_risk_band(spark, sf):
    """C8 + C9 (decision threshold 0.33)"""
    p = FX.churn_predictions(customer_features(spark, sf))
    return p.select("CustomerID", "prob", SC.risk_band(F.col("prob")).alias("risk_band"),
                    SC.recommended_action(F.col("prob"), 0.33).alias("recommended_action"))


ASPECT_LABEL = ("CASE WHEN aspect_sentiment > 0.3 THEN 'Positive' WHEN aspect_sentiment < -0.3 THEN 'Negative' "
                "WHEN aspect_sentiment = 0 THEN 'unknown' ELSE 'Neutral' END")


@register("aspect_label_score", O.with_(O.ASPECT_SENTIMENT) + f"""SELECT CustomerID, review_date, aspect, {ASPECT_LABEL} AS aspect_label,
  CAST(CASE {ASPECT_LABEL} WHEN 'Positive' THEN 1.0 WHEN 'Negative' THEN -1.0 ELSE 0.0 END AS DOUBLE) AS score FROM aspect_sentiment""", ["score"])
def q_aspect_label(spark, sf):
    """C15"""
    a = FX.aspect_sentiment(Tables(spark, sf))
    s = F.col("aspect_sentiment")
    lab = F.when(s > 0.3, "Positive").when(s < -0.3, "Negative").when(s == 0, "unknown").otherwise("Neutral")
    return a.select("CustomerID", "review_date", "aspect", lab.alias("aspect_label"), SC.aspect_label_score(lab).alias("score"))


_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUM)


@register("percentile_in_training", DRIFT_BASE + f""",
cl AS (UNPIVOT (SELECT CustomerID, {_CASTS} FROM cur_f) ON {', '.join(NUM)} INTO NAME feature VALUE value)
SELECT c.CustomerID, c.feature, c.value,
  CASE WHEN r.p25 IS NULL THEN 50.0 ELSE least(100.0, greatest(0.0, (c.value - r.p25) / greatest(r.p95 - r.p25, 1e-9) * 70.0 + 25.0)) END AS percentile
FROM cl c LEFT JOIN ref_dist r USING (feature)""", ["value", "percentile"])
def q_percentile(spark, sf):
    """Each current feature value placed in the reference distribution"""
    r, c = _periods(spark, sf)
    ref = D.reference_distribution(r)
    cur = D.unpivot_features(c, NUM, "CustomerID")
    j = cur.join(F.broadcast(ref.select("feature", "p25", "p95")), "feature", "left")
    return j.select("CustomerID", "feature", "value", SC.percentile_in_training(F.col("value"), F.col("p25"), F.col("p95")).alias("percentile"))


@register("focal_loss", REV + """SELECT avg(-1.0 * power(1 - proba[y_true + 1], 2.0) * ln(proba[y_true + 1])) AS focal_loss,
  CAST(count(*) AS BIGINT) AS n FROM rpred""", ["focal_loss"])
def q_focal(spark, sf):
    """Mean −α(1−p_t)^γ ln p_t, γ = 2, α = 1"""
    p = FX.review_predictions(_reviews(spark, sf))
    pt = F.element_at("proba", (F.col("y_true") + 1).cast("int"))
    return p.agg(F.avg(-1.0 * F.pow(1 - pt, 2.0) * F.log(pt)).alias("focal_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


def _baseline_preds(reviews):
    """A weaker 'baseline' scorer: smaller bonus on the true class."""
    y = F.when(F.col("label") == "negative", 0).when(F.col("label") == "neutral", 1).otherwise(2)
    d = reviews.withColumn("y_true", y.cast("int"))
    from storelens.functions.hashing import hashed_uniform
    s = [hashed_uniform(F.col("review_id"), f"base{k}") + F.when(F.col("y_true") == k, F.lit(0.3)).otherwise(0.0) for k in range(3)]
    tot = s[0] + s[1] + s[2]
    d = d.withColumn("proba", F.array(*[x / tot for x in s]))
    return d.withColumn("y_pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))


def _base_sql() -> str:
    u = [O.uniform("review_id", f"base{k}") for k in range(3)]
    s = [f"({u[k]} + CASE WHEN y_true = {k} THEN 0.3 ELSE 0.0 END)" for k in range(3)]
    tot = f"({s[0]} + {s[1]} + {s[2]})"
    return f"""bp AS (SELECT *, CAST(list_position(pr, list_max(pr)) - 1 AS INTEGER) AS y_pred FROM (
  SELECT *, [{s[0]} / {tot}, {s[1]} / {tot}, {s[2]} / {tot}] AS pr FROM rp0))"""


@register("baseline_delta", REV + ", " + _base_sql() + """,
m1 AS (SELECT label, f1 FROM """ + O.report_f1_sql("rpred") + """),
m0 AS (SELECT label, f1 FROM """ + O.report_f1_sql("bp") + """),
d AS (SELECT 'delta_' || ['negative', 'neutral', 'positive'][m1.label + 1] || '_f1' AS metric, round(m1.f1 - coalesce(m0.f1, 0.0), 4) AS delta
      FROM m1 LEFT JOIN m0 USING (label))
SELECT * FROM d UNION ALL SELECT 'delta_macro_f1', round((SELECT avg(f1) FROM m1) - (SELECT avg(f1) FROM m0), 4)""", ["delta"])
def q_baseline_delta(spark, sf):
    """Per-class and macro F1 of the review scorer vs. a weaker baseline"""
    r = _reviews(spark, sf)
    m1 = M.classification_report(FX.review_predictions(r)).select("label", F.col("f1").alias("f1_a"))
    m0 = M.classification_report(_baseline_preds(r)).select("label", F.col("f1").alias("f1_b"))
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    j = m1.join(m0, "label", "left")
    per = j.select(F.concat(F.lit("delta_"), F.element_at(names, (F.col("label") + 1).cast("int")), F.lit("_f1")).alias("metric"),
                   F.round(F.col("f1_a") - F.coalesce(F.col("f1_b"), F.lit(0.0)), 4).alias("delta"))
    macro = j.agg(F.round(F.avg("f1_a") - F.avg("f1_b"), 4).alias("delta")).select(F.lit("delta_macro_f1").alias("metric"), "delta")
    return per.unionByName(macro)


CLS = O.with_(O.CLASS_PRED)


def _top_sql(k: int) -> str:
    return f"list_transform(list_sort(list_transform(proba, lambda p, i: {{'np': -p, 'idx': i - 1}})), lambda s: s.idx)[{k}]"


@register("top3_predictions", CLS + f""", t AS (SELECT id, proba, {_top_sql(1)} AS c1, {_top_sql(2)} AS c2, {_top_sql(3)} AS c3 FROM cp)
SELECT id, CAST(c1 AS INTEGER) AS top1, round(proba[c1 + 1], 4) AS conf1, CAST(c2 AS INTEGER) AS top2, round(proba[c2 + 1], 4) AS conf2,
       CAST(c3 AS INTEGER) AS top3, round(proba[c3 + 1], 4) AS conf3 FROM t""", ["conf1", "conf2", "conf3"])
def q_top3(spark, sf):
    """Top-3 classes per row from the probability vector (no shuffle)"""
    p = FX.class_predictions(Tables(spark, sf))
    order = M.topk_order(F.col("proba"))
    cols = ["id"]
    out = p.withColumn("_o", order)
    for k in (1, 2, 3):
        idx = F.element_at("_o", k)
        out = out.withColumn(f"top{k}", idx.cast("int")).withColumn(f"conf{k}", F.round(F.element_at("proba", idx + 1), 4))
        cols += [f"top{k}", f"conf{k}"]
    return out.select(*cols)


@register("p95_by_index", O.with_(O.LOGS) + """SELECT module, CAST(list_sort(list(latency_ms))[least(CAST(floor(0.95 * count(*)) AS BIGINT), count(*) - 1) + 1] AS INTEGER) AS p95_latency_ms,
  CAST(count(*) AS BIGINT) AS n FROM logs GROUP BY module""")
def q_p95_index(spark, sf):
    """sorted[min(int(0.95 n), n − 1)] per module via the bucketed global rank"""
    from storelens.operators.ranking import exclusive_cumsum
    lg = FX.prediction_logs(Tables(spark, sf))
    v = lg.groupBy("module", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    c = exclusive_cumsum(v, "latency_ms", ["c"], F.floor(F.col("latency_ms") / 16), ["module"])
    n = c.groupBy("module").agg(F.sum("c").alias("n"))
    j = c.join(n, "module").withColumn("_k", F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1))
    hit = j.where((F.col("cum_c") <= F.col("_k")) & (F.col("_k") < F.col("cum_c") + F.col("c")))
    return hit.select("module", F.col("latency_ms").alias("p95_latency_ms"), F.col("n").cast("bigint"))


@register("recommended_action", CHURN + """SELECT CustomerID, CASE WHEN prob >= 0.5 THEN 'RETENTION_OFFER' ELSE 'NONE' END AS recommended_action
  FROM churn_pred""")
def q_action(spark, sf):
    """C9 (default threshold 0.5)"""
    p = FX.churn_predictions(customer_features(spark, sf))
    return p.select("CustomerID", SC.recommended_action(F.col("prob")).alias("recommended_action"))


@register("contribution_direction", DRIFT_BASE + f""",
cl AS (UNPIVOT (SELECT CustomerID, {_CASTS} FROM cur_f) ON {', '.join(NUM)} INTO NAME feature VALUE value)
SELECT c.CustomerID, c.feature, CASE WHEN c.value - r.mean > 0 THEN 'increases_churn' ELSE 'decreases_churn' END AS direction
FROM cl c JOIN ref_dist r USING (feature)""")
def q_direction(spark, sf):
    """C17 on deviations from the reference mean (value − mean > 0 → increases_churn)"""
    r, c = _periods(spark, sf)
    ref = D.reference_distribution(r)
    cur = D.unpivot_features(c, NUM, "CustomerID")
    j = cur.join(F.broadcast(ref.select("feature", "mean")), "feature")
    return j.select("CustomerID", "feature", SC.contribution_direction(F.col("value") - F.col("mean")).alias("direction"))


@register("table_fingerprint")
def q_table_fp(spark, sf):
    """S11 (table variant): order-free digest of the content-file table"""
    return FL.table_fingerprint(_files(spark, sf).select("path", "category", F.sha2("content", 256).alias("h")))


def write_content_tree(spark, sf) -> str:
    """Materialise the content files as ``root/{category}/{name}`` (S5 input).

    Each task writes its own rows' files (``mapInPandas``). Works where the
    shared checkpoint folder is a mounted file system path.
    """
    import os
    from urllib.parse import urlparse

    from storelens.session import scratch_path
    root = urlparse(scratch_path(spark, "content_tree")).path

    def write(batches):
        import pandas as pd
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                target = os.path.join(root, path.lstrip("/").split("/", 1)[1])
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as fh:
                    fh.write(bytes(content))
                out.append(len(content))
            yield pd.DataFrame({"n": out})
    _files(spark, sf).select("path", "content").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    return root


@register("scan_image_tree", FILES + f"""SELECT category, regexp_extract(path, '([^/]*)$', 1) AS file_name,
  CAST(octet_length(content) AS BIGINT) AS length FROM files WHERE {EXT} IN ('.jpg', '.jpeg', '.png', '.webp')""")
def q_scan_tree(spark, sf):
    """Content files written as an image folder tree, listed and read with binaryFile"""
    root = write_content_tree(spark, sf)
    t = FL.scan_image_tree(spark, root)
    return t.select("category", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), F.col("length").cast("bigint"))
