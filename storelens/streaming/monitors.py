"""Alert rules and histograms as windowed aggregations.

Every function takes a DataFrame that may be static or streaming: the same
``groupBy(window(...))`` plan runs as a batch job or, with a watermark, as an
incremental stream (see ``storelens.streaming.runner``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.operators.ranking import exclusive_cumsum

# Histogram buckets and alert limits of the reference.
LATENCY_BUCKETS_S = [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.5, 5.0]
CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.8, 0.9, 0.95, 1.0]
LATENCY_P95_LIMITS_S = {"retention": 0.018, "product": 0.18, "sentiment": 0.075}
ERROR_RATE_LIMIT = 0.05
QUEUE_BACKLOG_LIMIT = 50
GAUGE_RULES = [  # (rule, metric, limit, for_minutes)
    ("ReviewQueueBacklog", "review_queue_depth", 50.0, 5),
    ("CeleryQueueBacklog", "celery_queue_length", 200.0, 5),
    ("SlowModelWarmup", "model_warmup_seconds", 90.0, 0),
]


def cumulative_histogram(df: DataFrame, value: Column, buckets: list[float], keys: list) -> DataFrame:
    """Prometheus-style cumulative bucket counts ``(keys…, le, count)`` incl. +Inf.

    One aggregate with a conditional count per bound (map-side partial
    aggregation), stacked to long form.
    """
    aggs = [F.count_if(value <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(F.lit(1)).alias(f"b{len(buckets)}"))
    g = df.groupBy(*keys).agg(*aggs)
    les = [repr(float(b)) for b in buckets] + ["+Inf"]
    pairs = ", ".join(f"'{le}', b{i}" for i, le in enumerate(les))
    key_cols = [c for c in g.columns if not re.fullmatch(r"b\d+", c)]
    return g.selectExpr(*[f"`{c}`" for c in key_cols], f"stack({len(les)}, {pairs}) AS (le, count)") \
            .withColumn("count", F.col("count").cast("bigint"))


def latency_histogram(logs: DataFrame, by_window: str | None = None) -> DataFrame:
    """Cumulative latency buckets (seconds) per module [per window]."""
    keys = ["module"] if by_window is None else [F.window("created_at", by_window).alias("window"), "module"]
    return cumulative_histogram(logs, F.col("latency_ms") / 1000.0, LATENCY_BUCKETS_S, keys)


def confidence_histogram(logs: DataFrame) -> DataFrame:
    """T4: cumulative confidence buckets per module (confidence read from the JSON)."""
    conf = F.get_json_object("prediction", "$.confidence").cast("double")
    return cumulative_histogram(logs, conf, CONFIDENCE_BUCKETS, ["module"])


def histogram_quantile(q: float, les: list[float], cum: Column) -> Column:
    """``histogram_quantile`` of Prometheus over a cumulative count array (last = +Inf)."""
    n = len(les)
    total = F.element_at(cum, n + 1)
    rank = F.lit(q) * total
    b = F.size(F.filter(cum, lambda c: c < rank))  # 0-based index of first bucket with cum >= rank
    les_arr = F.array(*[F.lit(x) for x in les])
    start = F.when(b == 0, F.lit(0.0)).otherwise(F.element_at(les_arr, F.greatest(b, F.lit(1))))
    end = F.element_at(les_arr, F.least(b + 1, F.lit(n)))
    prev = F.when(b == 0, F.lit(0)).otherwise(F.element_at(cum, F.greatest(b, F.lit(1))))
    cnt = F.element_at(cum, b + 1) - prev
    interp = start + (end - start) * ((rank - prev) / cnt)
    return (F.when(total == 0, F.lit(None).cast("double"))
             .when(b >= n, F.lit(les[-1]))
             .otherwise(interp))


def latency_p95(logs: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """T2 core: p95 latency per (sliding window, module) via ``histogram_quantile``."""
    v = F.col("latency_ms") / 1000.0
    aggs = [F.count_if(v <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(LATENCY_BUCKETS_S)]
    aggs.append(F.count(F.lit(1)).alias("n"))
    g = logs.groupBy(F.window("created_at", window, slide).alias("w"), "module").agg(*aggs)
    cum = F.array(*[F.col(f"b{i}") for i in range(len(LATENCY_BUCKETS_S))], F.col("n"))
    return g.select(F.col("w.start").alias("window_start"), "module", F.col("n").cast("bigint"),
                    histogram_quantile(0.95, LATENCY_BUCKETS_S, cum).alias("p95_s"))


def alert_streaks(conditions: DataFrame, series: list[str], t: str, step_minutes: int,
                  for_minutes: int) -> DataFrame:
    """Islands of consecutive evaluation steps where a condition holds.

    Input: one row per (series, t) where the condition is TRUE, t aligned to
    the step. Island key = t − row_number·step (gaps-and-islands); an island
    fires when it lasts ≥ ``for_minutes``. The window per series holds one row
    per evaluation step (bounded by the time span, not by the event volume).
    """
    w = Window.partitionBy(*series).orderBy(t)
    mins = (F.unix_micros(F.col(t).cast("timestamp")) / F.lit(60_000_000)).cast("bigint")
    d = conditions.withColumn("_m", mins).withColumn("_g", F.col("_m") - F.row_number().over(w) * step_minutes)
    g = d.groupBy(*series, "_g").agg(F.min(t).alias("streak_start"), F.max(t).alias("streak_end"),
                                     F.count(F.lit(1)).alias("n_steps"))
    dur = (F.unix_micros(F.col("streak_end").cast("timestamp")) - F.unix_micros(F.col("streak_start").cast("timestamp"))) / 60_000_000
    return g.select(*series, "streak_start", "streak_end", F.col("n_steps").cast("bigint"),
                    (dur >= for_minutes).alias("firing"))


def latency_p95_alert(logs: DataFrame, limits: dict[str, float] | None = None, for_minutes: int = 5) -> DataFrame:
    """p95 over 5-min windows (1-min steps) above the module limit for 5 min."""
    lim = limits or LATENCY_P95_LIMITS_S
    m = F.create_map(*[x for k, v in lim.items() for x in (F.lit(k), F.lit(v))])
    p = latency_p95(logs)
    over = p.where(F.col("p95_s") > F.element_at(m, F.col("module")))
    return alert_streaks(over.select("module", "window_start"), ["module"], "window_start", 1, for_minutes)


def error_rate(logs: DataFrame, window: str = "2 minutes", slide: str = "1 minute") -> DataFrame:
    """T3 core: 5xx share per sliding window."""
    g = logs.groupBy(F.window("created_at", window, slide).alias("w")).agg(
        F.count_if(F.col("status_code") >= 500).alias("errors"), F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("errors").cast("bigint"), F.col("n").cast("bigint"),
                    (F.col("errors") / F.col("n")).alias("error_rate"))


def error_rate_alert(logs: DataFrame, limit: float = ERROR_RATE_LIMIT, for_minutes: int = 2) -> DataFrame:
    """Error share > 5 % for 2 minutes."""
    e = error_rate(logs).where(F.col("error_rate") > limit).withColumn("series", F.lit("api"))
    return alert_streaks(e.select("series", "window_start"), ["series"], "window_start", 1, for_minutes)


def drift_alerts(drift_events: DataFrame) -> DataFrame:
    """Drift counter per feature (> 0 fires at once) and first alert time."""
    a = drift_events.where(F.col("alert_triggered"))
    return a.groupBy("feature_name").agg(F.count(F.lit(1)).cast("bigint").alias("drift_count"),
                                         F.min("created_at").alias("first_alert_at"))


def ood_flag_rate(logs: DataFrame, window: str = "1 hour") -> DataFrame:
    """OOD flags counted per tumbling window."""
    g = logs.groupBy(F.window("created_at", window).alias("w")).agg(
        F.count_if(F.col("ood_flagged")).cast("bigint").alias("ood_flags"), F.count(F.lit(1)).cast("bigint").alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "ood_flags", "n", (F.col("ood_flags") / F.col("n")).alias("ood_rate"))


def queue_depth_series(queue: DataFrame, step: str = "1 minute") -> DataFrame:
    """T7 core: pending depth per module at the end of every step with activity.

    +1 when a row is created, −1 when it is reviewed; the running sum is an
    exclusive prefix sum bucketed by hour (no single-task window over a module).
    """
    plus = queue.select("module", F.col("created_at").alias("ts"), F.lit(1).alias("delta"))
    minus = queue.where(F.col("reviewed_at").isNotNull()).select("module", F.col("reviewed_at").alias("ts"), F.lit(-1).alias("delta"))
    ev = plus.unionByName(minus)
    per = ev.groupBy("module", F.date_trunc("minute", "ts").alias("t")).agg(F.sum("delta").alias("delta"))
    c = exclusive_cumsum(per, "t", ["delta"], F.date_trunc("hour", "t"), ["module"])
    return c.select("module", "t", (F.col("cum_delta") + F.col("delta")).cast("bigint").alias("depth"))


def gauge_over_limit(samples: DataFrame, series: list[str], limit: float, for_minutes: int, per_minute: str = "max") -> DataFrame:
    """A gauge (last sample holds until the next) above ``limit`` for a duration.

    Change points: consecutive samples with the condition true form an island
    that lasts until the next sample where it is false (or the last sample).
    ``per_minute`` says what a minute's sample is: its highest value, or the last
    one, as a scraper that looks once a minute would see it.
    """
    # one sample per series and minute (the scrape): bounds the window by time span
    one = {"max": F.max("value"), "last": F.max_by("value", F.struct("t", "value"))}[per_minute]
    samples = samples.groupBy(*series, F.date_trunc("minute", "t").alias("t")).agg(one.alias("value"))
    w = Window.partitionBy(*series).orderBy("t")
    cond = F.col("value") > limit
    d = samples.withColumn("_c", cond).withColumn("_rn", F.row_number().over(w)) \
        .withColumn("_next_t", F.lead("t").over(w))
    d = d.withColumn("_g", F.col("_rn") - F.row_number().over(Window.partitionBy(*series, "_c").orderBy("t")))
    isl = d.where("_c").groupBy(*series, "_g").agg(
        F.min("t").alias("streak_start"), F.max("t").alias("_last"), F.max_by("_next_t", "t").alias("_end"),
        F.count(F.lit(1)).cast("bigint").alias("n_samples"))
    end = F.coalesce(F.col("_end"), F.col("_last"))
    dur = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("streak_start").cast("timestamp"))) / 60_000_000
    return isl.select(*series, "streak_start", end.alias("streak_end"), "n_samples",
                      (dur >= for_minutes).alias("firing"))


def queue_backlog_alert(queue: DataFrame, limit: int = QUEUE_BACKLOG_LIMIT, for_minutes: int = 5) -> DataFrame:
    """Pending depth > 50 for 5 minutes, per module."""
    s = queue_depth_series(queue).withColumn("value", F.col("depth").cast("double"))
    return gauge_over_limit(s, ["module"], float(limit), for_minutes)


def gauge_threshold_alert(samples: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Gauge rules (metric, limit, duration) from a rule table, one pass per rule."""
    out = None
    for name, metric, limit, mins in (rules or GAUGE_RULES):
        s = samples.where(F.col("metric") == metric)
        r = gauge_over_limit(s, ["metric"], float(limit), mins).withColumn("rule", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def customer_sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """Activity sessions per user — ``session_window`` (streaming form, with a
    watermark the state per user is bounded by the gap)."""
    g = events.groupBy("user_id", F.session_window(ts, gap).alias("s")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_events"), F.sum("value").alias("total_value"))
    return g.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events", "total_value")


def customer_sessions_batch(events: DataFrame, gap_minutes: int = 30, ts: str = "ts",
                            bucket: str = "hour") -> DataFrame:
    """T11 (batch, skew-safe): same sessions as ``session_window`` without sorting a
    user's whole history in one task.

    1. window per (user, hour): local sessions split where the gap > 30 min (``session_window`` joins events exactly one gap apart);
    2. a per-(user, hour) summary (first / last event time, number of local
       sessions) — one row per active hour — decides whether a bucket's first
       local session continues the previous bucket's last one;
    3. global session ids from prefix sums over that small summary, then a
       partial/final aggregate per (user, session).
    A user with a third of all events still spreads over its active hours.
    """
    gap_us = gap_minutes * 60_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.select("user_id", F.col(ts).alias("_t"), us.alias("_u"), F.col("value"),
                      F.date_trunc(bucket, F.col(ts)).alias("_b"), F.col("event_id") if "event_id" in events.columns
                      else F.lit(0).alias("event_id"))
    w = Window.partitionBy("user_id", "_b").orderBy("_u", "event_id")
    e = e.withColumn("_new", F.when(F.lag("_u").over(w).isNull() | (F.col("_u") - F.lag("_u").over(w) > gap_us), 1).otherwise(0))
    e = e.withColumn("_ls", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = e.groupBy("user_id", "_b", "_ls").agg(F.min("_u").alias("_s"), F.max("_u").alias("_l"),
                                                   F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))
    summ = local.groupBy("user_id", "_b").agg(F.min("_s").alias("_first"), F.max("_l").alias("_last"),
                                              F.max("_ls").alias("_k"))
    wb = Window.partitionBy("user_id").orderBy("_b")
    summ = summ.withColumn("_cont", (F.lag("_last").over(wb).isNotNull() &
                                     (F.col("_first") - F.lag("_last").over(wb) <= gap_us)).cast("int"))
    summ = summ.withColumn("_new_here", F.col("_k") - F.col("_cont"))
    summ = summ.withColumn("_off", F.coalesce(F.sum("_new_here").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = local.join(summ.select("user_id", "_b", "_cont", "_off"), ["user_id", "_b"])
    gid = F.col("_off") + F.col("_ls") - F.col("_cont")
    g = j.groupBy("user_id", gid.alias("_g")).agg(F.min("_s").alias("_s"), F.max("_l").alias("_l"),
                                                   F.sum("_n").cast("bigint").alias("n_events"), F.sum("_v").alias("total_value"))
    to_ts = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return g.select("user_id", to_ts(F.col("_s")).alias("session_start"),
                    to_ts(F.col("_l") + F.lit(gap_us)).alias("session_end"), "n_events", "total_value")


def dedup_prediction_stream(logs: DataFrame, watermark: str = "10 minutes", key: str = "request_id",
                            ts: str = "created_at") -> DataFrame:
    """T5: one row per request id within the watermark (streaming form of S10)."""
    return logs.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


DEPTH_STATE = "depth long, pend_ts array<long>, pend_delta array<long>"
DEPTH_OUT = "module string, t timestamp, depth long"


def _depth_update(key, batches, state):
    """applyInPandasWithState body: running pending depth per module.

    Deltas (+1 at creation, −1 at review) are buffered in state until the
    watermark passes their minute; then the closed minutes are emitted in time
    order with the running depth. An event-time timeout at the next pending
    minute flushes modules that receive no new rows.
    """
    import numpy as np
    import pandas as pd
    (module,) = key
    depth, ts, dl = 0, [], []
    if state.exists:
        depth, ts, dl = state.get[0], list(state.get[1]), list(state.get[2])
    if not state.hasTimedOut:
        for pdf in batches:
            c = pdf["created_at"].astype("int64") // 1000          # µs
            ts += list(c)
            dl += [1] * len(c)
            r = pdf["reviewed_at"].dropna().astype("int64") // 1000
            ts += list(r)
            dl += [-1] * len(r)
    wm_us = state.getCurrentWatermarkMs() * 1000
    minute = 60_000_000
    closed_before = (wm_us // minute) * minute                   # minutes fully behind the watermark
    a_ts, a_dl = np.asarray(ts, dtype="int64"), np.asarray(dl, dtype="int64")
    done = a_ts < closed_before
    out = pd.DataFrame(columns=["module", "t", "depth"])
    if done.any():
        m = (a_ts[done] // minute) * minute
        per = pd.Series(a_dl[done]).groupby(m).sum().sort_index()
        cum = per.cumsum() + depth
        depth = int(cum.iloc[-1])
        out = pd.DataFrame({"module": module, "t": pd.to_datetime(per.index.to_numpy(), unit="us"), "depth": cum.to_numpy()})
    rest_ts, rest_dl = a_ts[~done].tolist(), a_dl[~done].tolist()
    state.update((depth, rest_ts, rest_dl))
    if rest_ts:
        state.setTimeoutTimestamp(int(((min(rest_ts) // minute) + 1) * minute // 1000) + 1)
    yield out


def queue_depth_stream(queue: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """T7 (stream): the depth series of ``queue_depth_series`` from a queue stream,
    with per-module state (``applyInPandasWithState``, event-time timeout)."""
    q = queue.select("module", F.col("created_at").cast("timestamp").alias("created_at"),
                     F.col("reviewed_at").cast("timestamp").alias("reviewed_at")).withWatermark("created_at", watermark)
    return q.groupBy("module").applyInPandasWithState(_depth_update, DEPTH_OUT, DEPTH_STATE, "append", "EventTimeTimeout")
