"""Adapters: canonical retail tables derived from the driver's TPC-H-like tables.

Every rule here is deterministic and has a DuckDB twin in
``storelens.plans.oracle`` so that results can be checked against plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.schemas import NUMERIC_FEATURE_COLUMNS
from storelens.functions.hashing import hashed_uniform
from storelens.sources.tables import Tables

# Default dates of the test-table scenarios.
RETENTION_SNAPSHOT = "2000-08-01"
RETENTION_OBS_START = "1999-08-02"
SENTIMENT_SNAPSHOT = "2024-01-20"
ASPECTS = ["battery", "shipping", "price"]
MODULES = ["product", "sentiment", "retention"]
QUEUE_TRIGGERS = ["low_confidence", "ood_flagged", "drift_alert"]
QUEUE_STATUSES = ["pending", "pending", "resolved", "dismissed"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def transactions(t: Tables) -> DataFrame:
    """orders ⋈ lineitem ⋈ customer ⋈ nation ⋈ region ⟕ part → transactions.

    Catalyst chooses the join strategies: nation/region are fixed-size
    (25/5 rows) and broadcast by the size check; orders⋈lineitem shuffles on
    the order key; part joins by size (broadcast while small, sort-merge
    beyond ``autoBroadcastJoinThreshold``).
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    p = t.part.select("p_partkey", "p_name")
    k = F.col("o_orderkey")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
         .join(p, li.l_partkey == p.p_partkey, "left"))
    qty = F.col("l_quantity").cast("int")
    return j.select(
        F.when((F.col("l_returnflag") == "R") & (k % 10 == 0), F.concat(F.lit("C"), k.cast("string")))
         .otherwise(k.cast("string")).alias("Invoice"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when(k % 50 == 0, -qty).otherwise(qty).alias("Quantity"),
        (F.col("o_orderdate") + F.make_interval(hours=(k % 24).cast("int"))).alias("InvoiceDate"),
        F.when(k % 97 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"),
        F.when(k % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("o_custkey").cast("double")).alias("Customer ID"),
        F.col("r_name").alias("Country"),
    )


def review_sentiment(t: Tables) -> DataFrame:
    """events → (CustomerID, review_date, sentiment_score in [-1, 1])."""
    e = t.events
    eid = F.col("event_id")
    score = ((eid * 7919) % 2001) / F.lit(1000.0) - F.lit(1.0)
    return e.select(
        F.col("user_id").cast("string").alias("CustomerID"),
        F.col("ts").alias("review_date"),
        F.when(eid % 101 == 0, F.lit(None).cast("double")).otherwise(score).alias("sentiment_score"),
    )


def aspect_sentiment(t: Tables) -> DataFrame:
    """events → (CustomerID, review_date, aspect, aspect_sentiment)."""
    eid = F.col("event_id")
    return t.events.select(
        F.col("user_id").cast("string").alias("CustomerID"),
        F.col("ts").alias("review_date"),
        _pick(ASPECTS, eid % 3).alias("aspect"),
        (((eid * 104729) % 2001) / F.lit(1000.0) - F.lit(1.0)).alias("aspect_sentiment"),
    )


def reviews_raw(t: Tables) -> DataFrame:
    """documents → raw review records (rating kept as text, as in the files)."""
    d = t.documents
    did = F.col("doc_id")
    rating = F.when(did % 53 == 0, F.lit(0)).otherwise(did % 5 + 1)
    return d.select(
        rating.cast("double").cast("string").alias("rating"),
        F.lit(None).cast("string").alias("title"),
        F.col("text"),
        F.col("source").alias("asin"),
        F.col("source").alias("parent_asin"),
        did.cast("string").alias("user_id"),
        did.alias("timestamp"),
        F.lit(0).alias("helpful_vote"),
        (did % 2 == 0).alias("verified_purchase"),
        did.alias("doc_id"),
    )


def prediction_logs(t: Tables) -> DataFrame:
    """events → prediction log rows (one per event)."""
    return prediction_logs_from_events(t.events)


def prediction_logs_from_events(events: DataFrame) -> DataFrame:
    """The log rule on any (possibly streaming) events DataFrame."""
    eid = F.col("event_id")
    conf = (eid % 100) / F.lit(100.0)
    band = F.when(conf < 0.3, "LOW").when(conf < 0.6, "MEDIUM").otherwise("HIGH")
    return events.select(
        eid.alias("id"),
        F.concat(F.lit("req_"), eid.cast("string")).alias("request_id"),
        _pick(MODULES, eid % 3).alias("module"),
        F.lit("v1").alias("model_version"),
        F.sha2(eid.cast("string"), 256).alias("input_hash"),
        F.to_json(F.struct(band.alias("risk_band"), conf.alias("confidence"))).alias("prediction"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        F.concat(F.lit("key_"), (F.col("user_id") % 7).cast("string")).alias("api_key_id"),
        ((eid % 3 == 0) & (F.col("value") > 100)).alias("ood_flagged"),
        F.col("ts").alias("created_at"),
    )


def review_queue(t: Tables) -> DataFrame:
    """events with event_id % 10 = 0 → review queue rows."""
    return review_queue_from_events(t.events)


def review_queue_from_events(events: DataFrame) -> DataFrame:
    """The queue rule on any (possibly streaming) events DataFrame."""
    eid = F.col("event_id")
    return events.where(eid % 10 == 0).select(
        eid.alias("id"),
        F.concat(F.lit("req_"), eid.cast("string")).alias("request_id"),
        _pick(MODULES, eid % 3).alias("module"),
        _pick(QUEUE_TRIGGERS, eid % 3).alias("trigger"),
        F.to_json(F.struct(F.col("event_type"), F.col("value"))).alias("payload"),
        _pick(QUEUE_STATUSES, eid % 4).alias("status"),
        F.col("ts").alias("created_at"),
        F.when(eid % 4 >= 2, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("reviewed_at"),
    )


def binary_predictions(t: Tables) -> DataFrame:
    """labels ⋈ documents → (id, y_true, prob); prob mixes a hashed uniform with the label."""
    lab = t.labels.select("doc_id", "quality")
    docs = t.documents.select("doc_id")
    u = hashed_uniform(F.col("doc_id"), "prob")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("y_true"),
        F.round(F.lit(0.6) * u + F.lit(0.4) * F.col("quality"), 6).alias("prob"),
    )


def class_predictions(t: Tables) -> DataFrame:
    """embeddings → (id, y_true, y_pred, proba): softmax of −distance to the
    label centroids (nearest-centroid scorer).

    Centroids are model parameters (K × d, fixed by the label set and the
    embedding width, not by the row count); they are aggregated in Spark and
    attached as a literal so scoring is a narrow map over the rows.
    """
    from storelens.session import spread
    emb = t.embeddings
    cent = (emb.select("label", F.posexplode("embedding").alias("i", "v"))
            .groupBy("label", "i").agg(F.avg("v").alias("c")))
    rows = cent.collect()  # K·d numbers: the fitted model, not the data
    labels = sorted({r["label"] for r in rows})
    dims = max(r["i"] for r in rows) + 1
    mat = {(r["label"], r["i"]): r["c"] for r in rows}
    cen = F.array(*[F.array(*[F.lit(float(mat[(k, i)])) for i in range(dims)]) for k in labels])
    emb = spread(emb)
    x = F.col("embedding")
    dist = F.transform(cen, lambda c: F.sqrt(F.aggregate(
        F.zip_with(x, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)))
    e = F.transform(dist, lambda d: F.exp(-d))
    tot = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    proba = F.transform(e, lambda v: v / tot)
    out = emb.select(F.col("vec_id").alias("id"), F.col("label").alias("y_true"), proba.alias("proba"))
    return out.withColumn("y_pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))


def review_predictions(reviews: DataFrame) -> DataFrame:
    """reviews → 3-class predictions: hashed scores with a bonus on the true class."""
    y = (F.when(F.col("label") == "negative", 0).when(F.col("label") == "neutral", 1).otherwise(2))
    d = reviews.withColumn("y_true", y.cast("int"))
    s = [hashed_uniform(F.col("review_id"), f"cls{k}") + F.when(F.col("y_true") == k, F.lit(0.8)).otherwise(0.0)
         for k in range(3)]
    tot = s[0] + s[1] + s[2]
    d = d.withColumn("proba", F.array(*[x / tot for x in s]))
    return d.withColumn("y_pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))


def churn_predictions(features: DataFrame) -> DataFrame:
    """customer features → (CustomerID, y_true, prob) with a label-correlated hashed score."""
    u = hashed_uniform(F.col("CustomerID"), "churn")
    return features.where(F.col("churned").isNotNull()).select(
        "*", F.col("churned").alias("y_true"),
        F.round(F.lit(0.55) * u + F.lit(0.45) * F.col("churned"), 6).alias("prob"))


DRIFT_FEATURES = NUMERIC_FEATURE_COLUMNS


def drift_events_log(t: Tables) -> DataFrame:
    """'view' events → a drift-event log (module, feature, psi value, alert)."""
    eid = F.col("event_id")
    v = F.col("value") / F.lit(100.0)
    return t.events.where(F.col("event_type") == "view").select(
        eid.alias("id"), _pick(MODULES, eid % 3).alias("module"),
        _pick(DRIFT_FEATURES, eid % len(DRIFT_FEATURES)).alias("feature_name"),
        F.lit("psi").alias("metric"), v.alias("metric_value"), F.lit(0.2).alias("threshold"),
        (v > 0.2).alias("alert_triggered"), F.lit("v1").alias("reference_version"), F.col("ts").alias("created_at"))


def image_storage(t: Tables) -> DataFrame:
    """'purchase' events → stored files with a TTL (gradcam 1 h, upload 24 h)."""
    eid = F.col("event_id")
    ftype = F.when(eid % 2 == 0, "upload").otherwise("gradcam")
    ttl_h = F.when(eid % 2 == 0, 24).otherwise(1)
    return t.events.where(F.col("event_type") == "purchase").select(
        eid.alias("id"), F.concat(F.lit("req_"), eid.cast("string")).alias("request_id"), ftype.alias("file_type"),
        F.concat(F.lit("/store/"), ftype, F.lit("/"), eid.cast("string"), F.lit(".png")).alias("file_path"),
        (F.col("ts") + F.make_interval(hours=ttl_h)).alias("expires_at"), F.col("ts").alias("created_at"),
        F.floor(F.col("value") * 1024 * 10).cast("bigint").alias("size_bytes"))


def queue_resolutions(t: Tables) -> DataFrame:
    """Append-only resolution log for the review queue: the final decision of
    resolved/dismissed rows, an older superseded decision for every 20th row,
    and decisions for ids that are not in the queue (event_id % 10 = 5)."""
    q = review_queue(t)
    final = q.where(F.col("status") != "pending").select(
        F.col("id").alias("queue_id"), "status", F.col("reviewed_at").alias("resolved_at"))
    older = q.where(F.col("id") % 20 == 0).select(
        F.col("id").alias("queue_id"), F.lit("dismissed").alias("status"),
        (F.col("created_at") + F.expr("INTERVAL 30 MINUTES")).alias("resolved_at"))
    eid = F.col("event_id")
    unknown = t.events.where(eid % 10 == 5).select(eid.alias("queue_id"), F.lit("resolved").alias("status"),
                                                   F.col("ts").alias("resolved_at"))
    return final.unionByName(older).unionByName(unknown)


FILE_EXTENSIONS = [".jpg", ".png", ".webp", ".gif", ".JPEG"]


def _hex(v, nbytes: int, little: bool = False):
    """Fixed-width hex of a non-negative integer column (big- or little-endian)."""
    if not little:
        return F.lpad(F.hex(v.cast("bigint")), 2 * nbytes, "0")
    parts = [F.lpad(F.hex((v / F.lit(256 ** i)).cast("bigint") % 256), 2, "0") for i in range(nbytes)]
    return F.concat(*parts)


def content_files(t: Tables) -> DataFrame:
    """pages → content files: an image header (PNG IHDR / JPEG SOF0 / WebP VP8X,
    dimensions from the page id) followed by the UTF-8 html; every 4th page has
    no header. Path from the URL, category = one of 8 names by a hash of the page
    id. Every 9th page carries one of four shared bodies (exact copies across
    categories)."""
    from storelens.operators.metrics import TARGET_CATEGORIES
    from storelens.session import spread
    p = spread(t.pages)
    pid = F.col("page_id")
    kind = pid % 4
    w = F.when(pid % 9 == 0, F.lit(128)).otherwise(32 + (pid * 7) % 300)
    h = F.when(pid % 9 == 0, F.lit(128)).otherwise(32 + (pid * 13) % 300)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 4), _hex(h, 4), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFC0001108"), _hex(h, 2), _hex(w, 2), F.lit("03012200021101031101"))
    webp = F.concat(F.lit("52494646"), F.lit("00000000"), F.lit("57454250"), F.lit("56503858"), F.lit("0A000000"),
                    F.lit("00000000"), _hex(w - 1, 3, True), _hex(h - 1, 3, True))
    header = (F.when(pid % 9 == 0, png).when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, webp)
               .otherwise(F.lit("")))
    body = F.when(pid % 9 == 0, F.concat(F.repeat(F.lit("dup "), 2000), (pid % 4).cast("string"))).otherwise(F.col("html"))
    content = F.concat(F.unhex(header), F.encode(body, "UTF-8"))
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTENSIONS]), (pid % 5 + 1).cast("int"))
    ext = F.when(pid % 9 == 0, F.lit(".png")).otherwise(ext)
    cat_idx = F.conv(F.substring(F.md5(pid.cast("string")), 1, 8), 16, 10).cast("bigint") % 8
    cat = F.element_at(F.array(*[F.lit(c) for c in TARGET_CATEGORIES]), (cat_idx + 1).cast("int"))
    return p.select(pid.alias("page_id"),
                    F.concat(F.lit("/images/"), cat, F.lit("/"), F.regexp_replace(F.col("url"), r"[^A-Za-z0-9]+", "_"), ext).alias("path"),
                    cat.alias("category"), content.alias("content"))
