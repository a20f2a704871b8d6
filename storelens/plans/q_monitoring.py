"""Prediction-log, review-queue, alert and business-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators import business as B
from storelens.operators import drift_state as DS
from storelens.operators import logs as LG
from storelens.plans import oracle as O
from storelens.plans.registry import register
from storelens.session import scratch_path
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables
from storelens.streaming import monitors as MN
from storelens.streaming.runner import append_file, replay_as_files, run_available_now

NOW = "2024-01-15 00:00:00"


def _logs(spark, sf):
    return FX.prediction_logs(Tables(spark, sf))


def _queue(spark, sf):
    return FX.review_queue(Tables(spark, sf))


LOGS = O.with_(O.LOGS)
QUEUE = O.with_(O.QUEUE)


@register("module_volume", LOGS + """SELECT module, CAST(count(*) AS BIGINT) AS count, coalesce(avg(latency_ms), 0.0) AS avg_latency_ms,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_predictions FROM logs GROUP BY module""", ["avg_latency_ms"])
def q_module_volume(spark, sf):
    """A18"""
    return LG.module_volume(_logs(spark, sf))


@register("risk_band_distribution", LOGS + """SELECT risk_band, CAST(count(*) AS BIGINT) AS count FROM logs
  WHERE module = 'retention' GROUP BY 1""")
def q_risk_bands(spark, sf):
    """A19 (band read from the JSON payload)"""
    return LG.risk_band_distribution(_logs(spark, sf))


@register("json_field_extract", LOGS + "SELECT id, risk_band, confidence FROM logs", ["confidence"])
def q_json(spark, sf):
    """C13"""
    lg = _logs(spark, sf)
    return lg.select("id", F.get_json_object("prediction", "$.risk_band").alias("risk_band"),
                     F.get_json_object("prediction", "$.confidence").cast("double").alias("confidence"))


@register("queue_depth", QUEUE + """SELECT CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending_depth,
  CAST(count(*) FILTER (WHERE module = 'product') AS BIGINT) AS filtered_total FROM queue""")
def q_queue_depth(spark, sf):
    """A20 (filter: module = product)"""
    return LG.queue_depth(_queue(spark, sf), module="product")


_QCOLS = "id, request_id, module, trigger, status, created_at, reviewed_at"


@register("review_queue_page", QUEUE + f"""SELECT {_QCOLS} FROM queue WHERE module = 'retention' AND status = 'pending'
  ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""")
def q_queue_page(spark, sf):
    """O1: third page of pending retention items"""
    return LG.review_queue_page(_queue(spark, sf), "retention", "pending", 50, 20).select(*_QCOLS.split(", "))


@register("latest_queue_state", O.with_(O.QUEUE, O.RESOLUTIONS) + """SELECT q.id, q.request_id, q.module, q.trigger,
  coalesce(l.status, q.status) AS status, q.created_at, coalesce(l.resolved_at, q.reviewed_at) AS reviewed_at
FROM queue q LEFT JOIN (SELECT queue_id, arg_max(status, resolved_at) AS status, max(resolved_at) AS resolved_at
                        FROM res GROUP BY 1) l ON q.id = l.queue_id""")
def q_latest_state(spark, sf):
    """Newest resolution per queue row"""
    t = Tables(spark, sf)
    return LG.latest_queue_state(FX.review_queue(t), FX.queue_resolutions(t))


@register("unknown_resolutions", O.with_(O.QUEUE, O.RESOLUTIONS) + """SELECT * FROM res
  WHERE queue_id NOT IN (SELECT id FROM queue)""")
def q_unknown(spark, sf):
    """Resolutions of ids not in the queue (404 rows)"""
    t = Tables(spark, sf)
    return LG.unknown_resolutions(FX.review_queue(t), FX.queue_resolutions(t))


_LCOLS = "id, request_id, module, latency_ms, status_code, created_at"


@register("append_prediction_log", LOGS + f"SELECT {_LCOLS} FROM logs WHERE created_at >= TIMESTAMP '{NOW}'")
def q_append_log(spark, sf):
    """target = logs before NOW; batch = all logs plus repeats; rows to append"""
    lg = _logs(spark, sf).select(*_LCOLS.split(", "))
    target = lg.where(F.col("created_at") < F.lit(NOW).cast("timestamp_ntz"))
    batch = lg.unionByName(lg.where(F.col("id") % 7 == 0))
    return LG.append_prediction_log(target, batch)


_DCOLS = "id, module, feature_name, metric, metric_value, threshold, alert_triggered, reference_version, created_at"


@register("drift_event_list", O.with_(O.drift_log()) + f"""SELECT {_DCOLS} FROM dlog WHERE module = 'retention'
  ORDER BY created_at DESC, id LIMIT 500""", ["metric_value", "threshold"])
def q_drift_list(spark, sf):
    """O2"""
    return LG.drift_event_list(FX.drift_events_log(Tables(spark, sf)), "retention", 500)


@register("latest_drift_per_feature", O.with_(O.drift_log()) + f"""SELECT feature_name, id, module, metric, metric_value, threshold,
  alert_triggered, reference_version, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_name ORDER BY created_at DESC, id DESC) AS rn FROM dlog) WHERE rn = 1""",
          ["metric_value", "threshold"])
def q_latest_drift(spark, sf):
    """W3"""
    return LG.latest_drift_per_feature(FX.drift_events_log(Tables(spark, sf)))


@register("storage_stats", O.with_(O.STORAGE) + f"""SELECT file_type, CAST(count(*) AS BIGINT) AS n_files,
  round(sum(size_bytes) / (1024.0 * 1024.0), 4) AS total_mb,
  CAST(count(*) FILTER (WHERE expires_at <= TIMESTAMP '{NOW}') AS BIGINT) AS removed,
  CAST(count(*) FILTER (WHERE expires_at > TIMESTAMP '{NOW}') AS BIGINT) AS remaining FROM files GROUP BY 1""", ["total_mb"])
def q_storage(spark, sf):
    """A22 + T8 counts"""
    return LG.storage_stats(FX.image_storage(Tables(spark, sf)), NOW)


@register("ttl_expiry", O.with_(O.STORAGE) + f"SELECT * FROM files WHERE expires_at <= TIMESTAMP '{NOW}'")
def q_ttl(spark, sf):
    """Rows past TTL"""
    return LG.ttl_expiry(FX.image_storage(Tables(spark, sf)), NOW)


def _hist_sql(value: str, buckets: list[float], src: str) -> str:
    les = [repr(float(b)) for b in buckets]
    parts = [f"SELECT module, '{le}' AS le, CAST(count(*) FILTER (WHERE {value} <= {le}) AS BIGINT) AS count FROM {src} GROUP BY 1"
             for le in les]
    parts.append(f"SELECT module, '+Inf', CAST(count(*) AS BIGINT) FROM {src} GROUP BY 1")
    return "\nUNION ALL ".join(parts)


@register("latency_histogram", LOGS + _hist_sql("latency_ms / 1000.0", MN.LATENCY_BUCKETS_S, "logs"))
def q_lat_hist(spark, sf):
    """T1"""
    return MN.latency_histogram(_logs(spark, sf))


@register("confidence_histogram", LOGS + _hist_sql("confidence", MN.CONFIDENCE_BUCKETS, "logs"))
def q_conf_hist(spark, sf):
    """T4"""
    return MN.confidence_histogram(_logs(spark, sf))


_LES = "[" + ", ".join(f"CAST('{b!r}' AS DOUBLE)" for b in MN.LATENCY_BUCKETS_S) + "]"
_CUM = "[" + ", ".join(f"count(*) FILTER (WHERE latency_ms / CAST(1000 AS DOUBLE) <= CAST('{b!r}' AS DOUBLE))"
                       for b in MN.LATENCY_BUCKETS_S) + ", count(*)]"
P95 = LOGS + f""", win AS (SELECT time_bucket(INTERVAL 1 MINUTE, created_at) - to_minutes(CAST(k AS INTEGER)) AS window_start, module, latency_ms
  FROM logs, range(0, 5) r(k)),
cum AS (SELECT window_start, module, count(*) AS n, {_CUM} AS cum FROM win GROUP BY 1, 2),
p0 AS (SELECT *, CAST(0.95 AS DOUBLE) * n AS rank, len(list_filter(cum, lambda c: c < CAST(0.95 AS DOUBLE) * n)) AS b FROM cum),
p95 AS (SELECT window_start, module, CAST(n AS BIGINT) AS n,
  CASE WHEN n = 0 THEN NULL WHEN b >= 11 THEN CAST(5.0 AS DOUBLE)
       ELSE (CASE WHEN b = 0 THEN 0.0 ELSE {_LES}[b] END)
            + ({_LES}[least(b + 1, 11)] - CASE WHEN b = 0 THEN 0.0 ELSE {_LES}[b] END)
              * ((rank - CASE WHEN b = 0 THEN 0 ELSE cum[b] END) / (cum[b + 1] - CASE WHEN b = 0 THEN 0 ELSE cum[b] END)) END AS p95_s
  FROM p0)"""


@register("latency_p95", P95 + "\nSELECT * FROM p95", ["p95_s"])
def q_p95(spark, sf):
    """T2 core: histogram_quantile(0.95) over 5-minute windows sliding by 1 minute"""
    return MN.latency_p95(_logs(spark, sf))


def _streak_sql(src: str, series: str, t: str, for_min: int) -> str:
    return f"""SELECT {series}, min({t}) AS streak_start, max({t}) AS streak_end, CAST(count(*) AS BIGINT) AS n_steps,
  (epoch_us(max({t})) - epoch_us(min({t}))) / 60000000 >= {for_min} AS firing FROM (
  SELECT *, CAST(epoch_us({t}) / 60000000 AS BIGINT) - row_number() OVER (PARTITION BY {series} ORDER BY {t}) AS g FROM {src})
  GROUP BY {series}, g"""


_LIM = " ".join(f"WHEN module = '{k}' THEN CAST('{v!r}' AS DOUBLE)" for k, v in MN.LATENCY_P95_LIMITS_S.items())


@register("latency_p95_alert", P95 + f""", over AS (SELECT module, window_start FROM p95 WHERE p95_s > CASE {_LIM} END)
""" + _streak_sql("over", "module", "window_start", 5))
def q_p95_alert(spark, sf):
    """T2 + W12: p95 above the module limit for 5 minutes"""
    return MN.latency_p95_alert(_logs(spark, sf))


ERR = LOGS + """, ew AS (SELECT time_bucket(INTERVAL 1 MINUTE, created_at) - to_minutes(CAST(k AS INTEGER)) AS window_start, status_code
  FROM logs, range(0, 2) r(k)),
er AS (SELECT window_start, CAST(count(*) FILTER (WHERE status_code >= 500) AS BIGINT) AS errors, CAST(count(*) AS BIGINT) AS n,
  count(*) FILTER (WHERE status_code >= 500) / count(*) AS error_rate FROM ew GROUP BY 1)"""


@register("error_rate", ERR + "\nSELECT * FROM er", ["error_rate"])
def q_error_rate(spark, sf):
    """T3 core"""
    return MN.error_rate(_logs(spark, sf))


@register("error_rate_alert", ERR + ", over AS (SELECT 'api' AS series, window_start FROM er WHERE error_rate > 0.05)\n"
          + _streak_sql("over", "series", "window_start", 2))
def q_error_alert(spark, sf):
    """T3 + W12: error share > 5 % for 2 minutes"""
    return MN.error_rate_alert(_logs(spark, sf))


@register("drift_alerts", O.with_(O.drift_log()) + """SELECT feature_name, CAST(count(*) AS BIGINT) AS drift_count,
  min(created_at) AS first_alert_at FROM dlog WHERE alert_triggered GROUP BY 1""")
def q_drift_alerts(spark, sf):
    """T6"""
    return MN.drift_alerts(FX.drift_events_log(Tables(spark, sf)))


@register("ood_flag_rate", LOGS + """SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start,
  CAST(count(*) FILTER (WHERE ood_flagged) AS BIGINT) AS ood_flags, CAST(count(*) AS BIGINT) AS n,
  count(*) FILTER (WHERE ood_flagged) / count(*) AS ood_rate FROM logs GROUP BY 1""", ["ood_rate"])
def q_ood_rate(spark, sf):
    """T10"""
    return MN.ood_flag_rate(_logs(spark, sf))


DEPTH = QUEUE + """, ev AS (SELECT module, created_at AS ts, 1 AS delta FROM queue
  UNION ALL SELECT module, reviewed_at, -1 FROM queue WHERE reviewed_at IS NOT NULL),
per AS (SELECT module, date_trunc('minute', ts) AS t, sum(delta) AS delta FROM ev GROUP BY 1, 2),
depth AS (SELECT module, t, CAST(sum(delta) OVER (PARTITION BY module ORDER BY t) AS BIGINT) AS depth FROM per)"""


def _gauge_sql(src: str, series: str, limit: float, for_min: int) -> str:
    src = f"(SELECT {series}, date_trunc('minute', t) AS t, max(value) AS value FROM {src} GROUP BY ALL)"
    return f"""SELECT {series}, min(t) AS streak_start, coalesce(arg_max(next_t, t), max(t)) AS streak_end,
  CAST(count(*) AS BIGINT) AS n_samples,
  (epoch_us(coalesce(arg_max(next_t, t), max(t))) - epoch_us(min(t))) / 60000000 >= {for_min} AS firing
FROM (SELECT *, row_number() OVER (PARTITION BY {series} ORDER BY t)
              - row_number() OVER (PARTITION BY {series}, value > {limit} ORDER BY t) AS g,
             lead(t) OVER (PARTITION BY {series} ORDER BY t) AS next_t FROM {src})
WHERE value > {limit} GROUP BY {series}, g"""


@register("queue_depth_series", DEPTH + "\nSELECT * FROM depth")
def q_depth_series(spark, sf):
    """T7 core: pending depth per module and minute"""
    return MN.queue_depth_series(_queue(spark, sf))


@register("queue_backlog_alert", DEPTH + ", ds AS (SELECT module, t, CAST(depth AS DOUBLE) AS value FROM depth)\n"
          + _gauge_sql("ds", "module", 50.0, 5))
def q_backlog(spark, sf):
    """Depth > 50 for 5 minutes"""
    return MN.queue_backlog_alert(_queue(spark, sf))


GAUGES = DEPTH + """, gs AS (
  SELECT 'review_queue_depth' AS metric, t, CAST(sum(depth) AS DOUBLE) AS value FROM depth GROUP BY t
  UNION ALL SELECT 'model_warmup_seconds', ts, value * 2 FROM events WHERE event_type = 'signup'
  UNION ALL SELECT 'celery_queue_length', date_trunc('minute', ts), CAST(count(*) AS DOUBLE) FROM events GROUP BY 2)"""


def _gauges(spark, sf):
    t = Tables(spark, sf)
    d = MN.queue_depth_series(FX.review_queue(t))
    q = d.groupBy("t").agg(F.sum("depth").cast("double").alias("value")).select(F.lit("review_queue_depth").alias("metric"), "t", "value")
    e = t.events
    w = e.where(F.col("event_type") == "signup").select(F.lit("model_warmup_seconds").alias("metric"), F.col("ts").alias("t"),
                                                       (F.col("value") * 2).alias("value"))
    c = e.groupBy(F.date_trunc("minute", "ts").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value")) \
         .select(F.lit("celery_queue_length").alias("metric"), "t", "value")
    return q.unionByName(w).unionByName(c)


@register("gauge_threshold_alert", GAUGES + "\n" + "\nUNION ALL\n".join(
    f"SELECT *, '{name}' AS rule FROM ({_gauge_sql(f'(SELECT * FROM gs WHERE metric = {chr(39)}{metric}{chr(39)})', 'metric', lim, mins)})"
    for name, metric, lim, mins in MN.GAUGE_RULES))
def q_gauges(spark, sf):
    """Queue depth > 50 for 5 min, celery length > 200 for 5 min, warm-up > 90 s at once"""
    return MN.gauge_threshold_alert(_gauges(spark, sf))


SESSIONS = """sess AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
  CAST(count(*) AS BIGINT) AS n_events, sum(value) AS total_value FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
  GROUP BY user_id, sid)"""


@register("customer_sessions", O.with_(SESSIONS) + "SELECT * FROM sess", ["total_value"])
def q_sessions(spark, sf):
    """30-minute activity sessions per user (batch, two-level form)"""
    return MN.customer_sessions_batch(Tables(spark, sf).events)


@register("customer_sessions_window", O.with_(SESSIONS) + "SELECT * FROM sess", ["total_value"])
def q_sessions_window(spark, sf):
    """The same sessions with the built-in ``session_window`` aggregate"""
    return MN.customer_sessions(Tables(spark, sf).events)


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _event_files(spark, sf, name: str, closing_event: bool, repeat_every: int | None = None) -> str:
    e = Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    if repeat_every:  # some events arrive twice, close together
        e = e.unionByName(e.where(F.col("event_id") % repeat_every == 0))
    root = replay_as_files(e, "ts", 6, "2024-01-01", "2024-01-31", name)
    if closing_event:  # one event far in the future closes every open window / session
        closer = spark.range(1).select(F.lit(9_000_000_000).cast("long").alias("event_id"),
                                       F.lit("2030-01-01 00:00:00").cast("timestamp").alias("ts"),
                                       F.lit(-1).cast("long").alias("user_id"), F.lit("close").alias("event_type"),
                                       F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
        append_file(closer, root, 9999)
    return root


@register("customer_sessions_stream", O.with_(SESSIONS) + "SELECT * FROM sess", ["total_value"])
def q_sessions_stream(spark, sf):
    """T11 as Structured Streaming: file source, watermark, session windows, append"""
    root = _event_files(spark, sf, "events-sessions", closing_event=True)

    def tf(s):
        return MN.customer_sessions(s.withWatermark("ts", "10 minutes"))
    out = run_available_now(spark, root, T.StructType([*EVENT_SCHEMA.fields, T.StructField("chunk", T.IntegerType())]), tf, "sessions")
    return out.where(F.col("user_id") >= 0).select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events", "total_value")


@register("dedup_prediction_stream", LOGS + "SELECT request_id, module, latency_ms, created_at FROM logs")
def q_dedup_stream(spark, sf):
    """T5: streamed logs with repeated request ids, inside the 10 minutes of the watermark → one row per id"""
    root = _event_files(spark, sf, "events-dedup", closing_event=False, repeat_every=7)

    def tf(s):
        lg = s.select(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("request_id"),
                      F.element_at(F.array(*[F.lit(m) for m in FX.MODULES]), (F.col("event_id") % 3 + 1).cast("int")).alias("module"),
                      F.floor("value").cast("int").alias("latency_ms"), F.col("ts").alias("created_at"))
        return MN.dedup_prediction_stream(lg, "10 minutes")
    out = run_available_now(spark, root, T.StructType([*EVENT_SCHEMA.fields, T.StructField("chunk", T.IntegerType())]), tf, "dedup")
    return out.select("request_id", "module", "latency_ms", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@register("retention_roi", LOGS + """, n AS (SELECT CAST(count(*) FILTER (WHERE risk_band = 'HIGH') AS DOUBLE) AS n FROM logs WHERE module = 'retention')
SELECT CAST(n AS BIGINT) AS n_high_risk, n * 0.6 AS n_targeted, n * 0.6 * 0.25 AS n_saved, n * 0.6 * 0.25 * 480.0 AS revenue_saved,
  n * 0.6 * 15.0 AS campaign_cost, n * 0.6 * 0.25 * 480.0 - n * 0.6 * 15.0 AS net_roi,
  CASE WHEN n * 0.6 * 15.0 > 0 THEN (n * 0.6 * 0.25 * 480.0) / (n * 0.6 * 15.0) ELSE 0.0 END AS roi_multiple FROM n""",
          ["n_targeted", "n_saved", "revenue_saved", "campaign_cost", "net_roi", "roi_multiple"])
def q_roi(spark, sf):
    """B1 over the retention risk bands"""
    return B.retention_roi(LG.risk_band_distribution(_logs(spark, sf)))


@register("roi_sensitivity", LOGS + """, n AS (SELECT CAST(count(*) FILTER (WHERE risk_band = 'HIGH') AS DOUBLE) AS n FROM logs WHERE module = 'retention')
SELECT c AS conversion_rate, l AS avg_ltv, n * 0.6 * c * l - n * 0.6 * 15.0 AS net_roi
FROM n, (SELECT unnest([0.10, 0.25, 0.45]::DOUBLE[]) AS c), (SELECT unnest([200.0, 480.0, 800.0]::DOUBLE[]) AS l)""",
          ["conversion_rate", "avg_ltv", "net_roi"])
def q_roi_grid(spark, sf):
    """B2 + J9: 3 × 3 net ROI grid"""
    return B.roi_sensitivity(LG.risk_band_distribution(_logs(spark, sf)))


@register("overview_kpis", LOGS + """SELECT CAST(count(*) AS BIGINT) AS total_predictions, CAST(count(DISTINCT module) AS BIGINT) AS active_modules,
  coalesce(avg(latency_ms) FILTER (WHERE module = 'retention'), 0.0) AS retention_avg_latency_ms,
  CAST(min(model_version) AS VARCHAR) AS versions_any FROM logs""", ["retention_avg_latency_ms"])
def q_overview(spark, sf):
    """B3 (the versions map is checked through one of its values)"""
    k = B.overview_kpis(_logs(spark, sf))
    return k.select("total_predictions", "active_modules", "retention_avg_latency_ms",
                    F.element_at("model_versions", "retention").alias("versions_any"))


@register("band_share", LOGS + """SELECT risk_band, CAST(count(*) AS BIGINT) AS count, count(*) / max(count(*)) OVER () AS share_of_max
  FROM logs WHERE module = 'retention' GROUP BY 1""", ["share_of_max"])
def q_band_share(spark, sf):
    """B4"""
    return B.band_share(LG.risk_band_distribution(_logs(spark, sf)))


DAILY = LOGS + """, rlogs AS (SELECT * FROM logs WHERE module = 'retention'),
ref_v AS (SELECT CAST(latency_ms AS DOUBLE) AS value FROM rlogs
  WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-08'),
ref_dist AS (SELECT strftime(d, '%Y-%m-%d') AS feature, r.* FROM (SELECT DISTINCT CAST(created_at AS DATE) AS d FROM rlogs) dd,
  (SELECT quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
          quantile_cont(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM ref_v) r),
cur_long AS (SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS feature, CAST(latency_ms AS DOUBLE) AS value FROM rlogs)"""


def _daily_sql() -> str:
    from storelens.plans.q_drift import psi_sql
    return DAILY + psi_sql() + """
SELECT feature AS day, 'retention' AS module, 'latency_ms' AS feature_name, 'psi' AS metric, psi AS metric_value,
  CAST(0.2 AS DOUBLE) AS threshold, psi > 0.2 AS alert_triggered FROM psi"""


@register("daily_drift_job", _daily_sql(), ["metric_value", "threshold"])
def q_daily_drift(spark, sf):
    """T9 (batch): per-day PSI of retention latency against the first week"""
    from storelens.operators.drift import daily_drift
    lg = _logs(spark, sf).where(F.col("module") == "retention")
    return daily_drift(lg, "latency_ms", "2024-01-01", "2024-01-08")


# The monitored values of a prediction log row and the reference week.
DRIFT_VALUES = ["latency_ms", "confidence", "status_code"]
REF_WEEK = ("2024-01-01", "2024-01-08")


def _drift_long(logs):
    """(day, feature, value) rows of a prediction log."""
    conf = F.get_json_object("prediction", "$.confidence")
    values = {"latency_ms": F.col("latency_ms"), "confidence": conf, "status_code": F.col("status_code")}
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), values[k].cast("double").alias("value")) for k in DRIFT_VALUES])
    return logs.select("created_at", F.date_format(F.to_date("created_at"), "yyyy-MM-dd").alias("day"), F.explode(cells).alias("c")).select("created_at", "day", "c.*")


def _drift_reference(long):
    """Quantiles of the reference week, a row a feature."""
    from storelens.operators.drift import reference_distribution
    lo, hi = [F.lit(d).cast("timestamp_ntz") for d in REF_WEEK]
    week = long.where((F.col("created_at") >= lo) & (F.col("created_at") < hi))
    wide = week.select(*[F.when(F.col("feature") == f, F.col("value")).alias(f) for f in DRIFT_VALUES])
    return reference_distribution(wide, DRIFT_VALUES)


def _retention_logs(spark, sf):
    return _logs(spark, sf).where(F.col("module") == "retention")


_LONG = ", ".join(f"{{'feature': '{f}', 'value': CAST({'(id % 100) / 100.0' if f == 'confidence' else f} AS DOUBLE)}}" for f in DRIFT_VALUES)
_ALL_DRIFT = LOGS + f""", long AS (SELECT created_at, day, c.feature AS feature, c.value AS value FROM (
  SELECT created_at, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, unnest([{_LONG}]) AS c FROM logs WHERE module = 'retention')),
refs AS (SELECT feature, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
  quantile_cont(value, 0.95) AS p95, min(value) AS min, max(value) AS max FROM long
  WHERE created_at >= TIMESTAMP '{REF_WEEK[0]}' AND created_at < TIMESTAMP '{REF_WEEK[1]}' GROUP BY 1),
""" + DS.drift_sql("long", "refs") + """
SELECT day, feature, n, psi, out_of_range, ks_stat, ks_pvalue, psi > 0.2 AS drift_detected FROM drift"""
_ALL_FLOATS = ["psi", "out_of_range", "ks_stat", "ks_pvalue"]


@register("daily_drift_report", _ALL_DRIFT, _ALL_FLOATS)
def q_daily_drift_report(spark, sf):
    """T9 (batch): per day PSI and KS of every monitored value against the first week"""
    long = _drift_long(_retention_logs(spark, sf))
    ref = _drift_reference(long).checkpoint(eager=True)
    return DS.drift_of(DS.histograms(long, ref), ref)


def _drift_stream(spark, sf):
    """Each availableNow micro-batch of log files merges its histograms into the state and appends its days' events."""
    from storelens.operators.drift import drift_events_rows, drift_review_items
    e = Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    root = replay_as_files(e, "ts", 6, "2024-01-01", "2024-01-31", "events-daily")
    sink = scratch_path(spark, "drift-events")
    state = DS.DailyDrift(spark, scratch_path(spark, "drift-state"), _drift_reference(_drift_long(_retention_logs(spark, sf))))

    def per_batch(batch, epoch_id):
        logs = FX.prediction_logs_from_events(batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).where(F.col("module") == "retention")
        days = state.add(_drift_long(logs).drop("created_at"), epoch_id)
        report = state.report(days).checkpoint(eager=True)
        report.write.mode("overwrite").parquet(f"{sink}/report/epoch={epoch_id}")
        drift_events_rows(report, keep=("day",)).write.mode("overwrite").parquet(f"{sink}/events/epoch={epoch_id}")
        drift_review_items(report, keep=("day",)).write.mode("overwrite").parquet(f"{sink}/items/epoch={epoch_id}")

    stream = spark.readStream.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("chunk", T.IntegerType())])) \
        .option("maxFilesPerTrigger", 1).parquet(root)
    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", sink + "-checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{sink}/report")
    # a day cut across two files is reported by both batches: the last one holds the sum
    latest = out.groupBy("day", "feature").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("day", "feature", "epoch")]), "epoch").alias("r"))
    return latest.select("day", "feature", "r.*")


@register("daily_drift_report_stream", _ALL_DRIFT, _ALL_FLOATS)
def q_daily_drift_report_stream(spark, sf):
    """T9 (stream): the same figures from mergeable histograms; no batch reads the log again"""
    return _drift_stream(spark, sf)


@register("ks_two_tables", LOGS + f""", long AS (SELECT created_at, day, c.feature AS feature, c.value AS value FROM (
  SELECT created_at, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, unnest([{_LONG}]) AS c FROM logs WHERE module = 'retention')),
sides AS (SELECT feature, value, CASE WHEN created_at >= TIMESTAMP '{REF_WEEK[0]}' AND created_at < TIMESTAMP '{REF_WEEK[1]}' THEN 1 ELSE 0 END AS a FROM long),
g AS (SELECT feature, value, sum(a) AS a, sum(1 - a) AS b FROM sides WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM g
  WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
d AS (SELECT feature, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, max(abs(ca / na - cb / nb)) AS ks_stat FROM f WHERE na > 0 AND nb > 0 GROUP BY 1),
l AS (SELECT *, sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) * ks_stat AS l FROM d)
SELECT feature, n_a, n_b, ks_stat, CASE WHEN l <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
  lambda j: power(-1, j - 1) * exp(-2.0 * j * j * l * l))))) END AS ks_pvalue FROM l""", ["ks_stat", "ks_pvalue"])
def q_ks_two_tables(spark, sf):
    """D5 (two tables): the first week's values against the later ones"""
    from storelens.operators.drift import ks_two_sample
    long = _drift_long(_retention_logs(spark, sf))
    lo, hi = [F.lit(d).cast("timestamp_ntz") for d in REF_WEEK]
    first = (F.col("created_at") >= lo) & (F.col("created_at") < hi)
    return ks_two_sample(long.where(first), long.where(~first), exact_cells=0)  # SQL has the asymptotic p-value


@register("daily_drift_stream", _daily_sql(), ["metric_value", "threshold"])
def q_daily_drift_stream(spark, sf):
    """T9 (stream): the drift events of latency, from the mergeable state"""
    r = _drift_stream(spark, sf).where(F.col("feature") == "latency_ms")
    return r.select("day", F.lit("retention").alias("module"), F.col("feature").alias("feature_name"), F.lit("psi").alias("metric"),
                    F.col("psi").alias("metric_value"), F.lit(0.2).alias("threshold"), F.col("drift_detected").alias("alert_triggered"))


@register("roi_grid_cross", LOGS + """, n AS (SELECT CAST(count(*) FILTER (WHERE risk_band = 'HIGH') AS DOUBLE) AS n FROM logs WHERE module = 'retention')
SELECT c AS conversion_rate, l AS avg_ltv, n * 0.6 * c * l - n * 0.6 * 15.0 AS net_roi
FROM n, (SELECT unnest([0.10, 0.25, 0.45]::DOUBLE[]) AS c), (SELECT unnest([200.0, 480.0, 800.0]::DOUBLE[]) AS l)""",
          ["conversion_rate", "avg_ltv", "net_roi"])
def q_roi_grid_cross(spark, sf):
    """Conversion levels × LTV levels on the HIGH-risk count (constants exploded, no join)"""
    return B.roi_sensitivity(LG.risk_band_distribution(_logs(spark, sf)))


@register("alert_streaks", ERR + """, over AS (SELECT 'api' AS series, window_start FROM er WHERE error_rate > 0.1)
""" + _streak_sql("over", "series", "window_start", 3))
def q_alert_streaks(spark, sf):
    """Islands of consecutive minutes with error share > 10 %, firing after 3 minutes"""
    e = MN.error_rate(_logs(spark, sf)).where(F.col("error_rate") > 0.1).withColumn("series", F.lit("api"))
    return MN.alert_streaks(e.select("series", "window_start"), ["series"], "window_start", 1, 3)


_HIST_UNION = "\nUNION ALL ".join(
    [f"SELECT created_at, module, '{b!r}' AS le, latency_ms / 1000.0 <= {b!r} AS hit FROM logs" for b in MN.LATENCY_BUCKETS_S]
    + ["SELECT created_at, module, '+Inf' AS le, true AS hit FROM logs"])


@register("latency_histogram_stream", LOGS + f"""SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS window_start, le,
  CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS count, module FROM ({_HIST_UNION}) GROUP BY 1, 2, 4""")
def q_hist_stream(spark, sf):
    """T1 as a stream: hourly cumulative latency buckets per module (watermark, append)"""
    root = _event_files(spark, sf, "events-hist", closing_event=True)

    def tf(s):
        eid = F.col("event_id")
        # no filter before the aggregate: a filter would be pushed below the
        # watermark and the closing event would never advance it
        lg = s.withWatermark("ts", "10 minutes").select(
            F.element_at(F.array(*[F.lit(m) for m in FX.MODULES]), (eid % 3 + 1).cast("int")).alias("module"),
            F.floor("value").cast("int").alias("latency_ms"), F.col("ts").alias("created_at"))
        return MN.latency_histogram(lg, by_window="1 hour")
    out = run_available_now(spark, root, T.StructType([*EVENT_SCHEMA.fields, T.StructField("chunk", T.IntegerType())]), tf, "hist")
    out = out.where(F.col("window.start") < F.lit("2030-01-01").cast("timestamp"))  # drop the closer's own window
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "le", "count", "module")


@register("queue_depth_stream", DEPTH + "\nSELECT * FROM depth")
def q_depth_stream(spark, sf):
    """T7 as a stateful stream (applyInPandasWithState keyed by module)"""
    root = _event_files(spark, sf, "events-queue", closing_event=True)

    def tf(s):
        return MN.queue_depth_stream(FX.review_queue_from_events(s))
    out = run_available_now(spark, root, T.StructType([*EVENT_SCHEMA.fields, T.StructField("chunk", T.IntegerType())]), tf, "depth")
    out = out.where(F.col("t") < F.lit("2030-01-01").cast("timestamp"))  # the closing event's own minute
    return out.select("module", F.col("t").cast("timestamp_ntz").alias("t"), F.col("depth").cast("bigint"))
