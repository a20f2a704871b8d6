"""Prediction log, review queue and storage operators.

Log tables are append-only Parquet (partitioned by module and date in
production); "updates" of the reference's PostgreSQL become append-only event
logs plus a latest-state view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# API limits and TTLs of the reference.
MAX_QUEUE_PAGE = 200
MAX_DRIFT_EVENTS = 500
TTL_HOURS = {"gradcam": 1, "upload": 24}


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` — a ``min_by`` aggregate (partial
    aggregation per task), not a window that gathers a hot key in one task."""
    cols = [c for c in df.columns]
    packed = F.struct(*[F.col(c) for c in cols])
    g = df.groupBy(key).agg(F.min_by(packed, F.struct(*[F.col(c) for c in order])).alias("_r"))
    return g.select("_r.*")


def append_prediction_log(target: DataFrame, batch: DataFrame, key: str = "request_id",
                          order: tuple = ("created_at", "id")) -> DataFrame:
    """INSERT … ON CONFLICT (key) DO NOTHING as DataFrames: dedup the batch
    on the key (first arrival wins), drop keys already in the target
    (left anti join), return the rows to append."""
    b = dedup_first(batch, key, list(order))
    return b.join(target.select(key), key, "left_anti").select(*target.columns)


def append_new(batch: DataFrame, path: str, key: str = "request_id", order: tuple = ("created_at", "id"),
               partition_by: list[str] | None = None) -> None:
    """S10 as a sink: the rows of ``batch`` whose key the log at ``path`` lacks are appended to it.

    What to append is materialised before the log changes, so a retried batch adds nothing.
    """
    target = batch.sparkSession.read.schema(batch.schema).parquet(path)
    write_append(append_prediction_log(target, batch, key, order).checkpoint(), path, partition_by)


def write_append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Sink for S10 / T5: append to the log table."""
    w = rows.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def latest_queue_state(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Queue rows with their newest resolution (status, reviewed_at);
    pending rows keep their own status."""
    latest = resolutions.groupBy("queue_id").agg(
        F.max_by(F.struct("status", "resolved_at"), F.struct("resolved_at", "status")).alias("_l"))
    j = queue.join(latest, queue.id == latest.queue_id, "left")
    return j.select("id", "request_id", "module", "trigger",
                    F.coalesce(F.col("_l.status"), F.col("status")).alias("status"),
                    "created_at", F.coalesce(F.col("_l.resolved_at"), F.col("reviewed_at")).alias("reviewed_at"))


def unknown_resolutions(queue: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Resolutions for ids that do not exist (the API's 404 case)."""
    return resolutions.join(queue.select(F.col("id").alias("queue_id")), "queue_id", "left_anti")


def _within(limit: int, most: int) -> None:
    if not 1 <= int(limit) <= most:
        raise ValueError(f"limit must be between 1 and {most}")


def review_queue_page(queue: DataFrame, module: str | None = None, status: str | None = None,
                      limit: int = 50, offset: int = 0) -> DataFrame:
    """O1: optional filters, newest first, LIMIT ≤ 200 OFFSET n (a page is the feature)."""
    _within(limit, MAX_QUEUE_PAGE)
    q = queue
    if module:
        q = q.where(F.col("module") == module)
    if status:
        q = q.where(F.col("status") == status)
    return q.orderBy(F.col("created_at").desc(), F.col("id")).offset(int(offset)).limit(limit)


def queue_depth(queue: DataFrame, module: str | None = None, status: str | None = None) -> DataFrame:
    """Pending depth (independent of filters) and filtered total in one aggregate."""
    cond = F.lit(True)
    if module:
        cond = cond & (F.col("module") == module)
    if status:
        cond = cond & (F.col("status") == status)
    return queue.agg(F.count_if(F.col("status") == "pending").cast("bigint").alias("pending_depth"),
                     F.count_if(cond).cast("bigint").alias("filtered_total"))


def drift_event_list(events: DataFrame, module: str | None = None, limit: int = 100) -> DataFrame:
    """O2: newest drift events first, LIMIT ≤ 500 (TakeOrdered: top-n per task)."""
    _within(limit, MAX_DRIFT_EVENTS)
    e = events if module is None else events.where(F.col("module") == module)
    return e.orderBy(F.col("created_at").desc(), F.col("id")).limit(limit)


def latest_drift_per_feature(events: DataFrame) -> DataFrame:
    """DISTINCT ON (feature) … ORDER BY created_at DESC as a ``max_by`` aggregate."""
    cols = [c for c in events.columns if c != "feature_name"]
    g = events.groupBy("feature_name").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("_r"))
    return g.select("feature_name", "_r.*")


def module_volume(logs: DataFrame) -> DataFrame:
    """Predictions and mean latency per module (null mean → 0) and the total."""
    g = logs.groupBy("module").agg(F.count(F.lit(1)).alias("count"), F.avg("latency_ms").alias("avg_latency_ms"))
    return g.select("module", F.col("count").cast("bigint"),
                    F.coalesce(F.col("avg_latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
                    F.sum("count").over(Window.partitionBy()).cast("bigint").alias("total_predictions"))


def risk_band_distribution(logs: DataFrame) -> DataFrame:
    """Retention predictions counted by the JSON field ``risk_band``."""
    r = logs.where(F.col("module") == "retention")
    return r.groupBy(F.get_json_object("prediction", "$.risk_band").alias("risk_band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))


def storage_stats(files: DataFrame, now: str) -> DataFrame:
    """A22 + T8: files and MB per type, and how many are past their TTL at ``now``."""
    expired = F.col("expires_at") <= F.lit(now).cast("timestamp_ntz")
    return files.groupBy("file_type").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.round(F.sum("size_bytes") / (1024.0 * 1024.0), 4).alias("total_mb"),
        F.count_if(expired).cast("bigint").alias("removed"),
        F.count_if(~expired).cast("bigint").alias("remaining"))


def ttl_expiry(files: DataFrame, now: str) -> DataFrame:
    """The rows past their TTL at ``now`` (to delete)."""
    return files.where(F.col("expires_at") <= F.lit(now).cast("timestamp_ntz"))
