"""Customer features (A1–A12) and their assembly.

All per-customer "UDAFs" of the reference become native aggregates. Each
family aggregates by ``CustomerID`` so that the final left joins are
co-partitioned (hash on the same key) and add no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.timeutil import elapsed_days, ts_lit
from storelens.operators.clean import DEFAULT_SNAPSHOT

# Reference constants.
TIME_DECAY_LAMBDA = 0.1
SINGLE_ORDER_SENTINEL = -1.0
NEGATIVE_SENTIMENT_THRESHOLD = -0.3
TREND_MONTHS = 6
ASPECT_COLUMNS = {
    "battery": "avg_battery_sentiment",
    "shipping": "avg_shipping_sentiment",
    "price": "avg_price_sentiment",
}
SENTIMENT_DEFAULTS = {
    "avg_sentiment_score": 0.0,
    "last_review_sentiment": 0.0,
    "negative_review_count": 0,
    "has_reviews": 0,
    "avg_battery_sentiment": 0.0,
    "avg_shipping_sentiment": 0.0,
    "avg_price_sentiment": 0.0,
}
ASSEMBLY_DEFAULTS = {
    "purchase_gap_cv": SINGLE_ORDER_SENTINEL,
    "purchase_trend": 0.0,
    "time_decay_weight": 0.0,
    **SENTIMENT_DEFAULTS,
}

CUST_IN = "`Customer ID`"


def _cust(df: DataFrame):
    """Cleaned lines carry ``Customer ID``; feature tables carry ``CustomerID``."""
    return F.col(CUST_IN) if "Customer ID" in df.columns else F.col("CustomerID")


def rfm_features(obs: DataFrame, snapshot: str = DEFAULT_SNAPSHOT) -> DataFrame:
    """A1 + A2: one grouped aggregate per customer.

    ``avg_order_value`` uses the unclipped sum; ``monetary_value`` is clipped
    at 0 afterwards (reference order). Days are elapsed-time floors.
    """
    s = ts_lit(snapshot)
    g = obs.groupBy(_cust(obs).alias("CustomerID")).agg(
        F.max("InvoiceDate").alias("last_order_date"),
        F.min("InvoiceDate").alias("first_order_date"),
        F.countDistinct("Invoice").alias("frequency"),
        F.sum("LineTotal").alias("_spend"),
    )
    rec = elapsed_days(F.col("last_order_date"), s)
    return g.select(
        "CustomerID", "last_order_date", "first_order_date",
        F.col("frequency").cast("bigint").alias("frequency"),
        F.greatest(F.col("_spend"), F.lit(0.0)).alias("monetary_value"),
        rec.alias("recency_days"),
        elapsed_days(F.col("first_order_date"), s).alias("tenure_days"),
        (F.col("_spend") / F.col("frequency")).alias("avg_order_value"),
        F.log1p(rec.cast("double")).alias("recency_days_log"),
    )


def recency_tenure_days(obs: DataFrame, snapshot: str = DEFAULT_SNAPSHOT) -> DataFrame:
    """A2 on its own: whole elapsed days since last and first order."""
    s = ts_lit(snapshot)
    g = obs.groupBy(_cust(obs).alias("CustomerID")).agg(
        F.max("InvoiceDate").alias("last_order_date"), F.min("InvoiceDate").alias("first_order_date"))
    return g.select("CustomerID",
                    elapsed_days(F.col("last_order_date"), s).alias("recency_days"),
                    elapsed_days(F.col("first_order_date"), s).alias("tenure_days"))


def purchase_gap_stats(obs: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """A3 building block: per customer (n lines, Σgap, Σgap²) over sorted line times.

    Skew-safe two-level form instead of one window over all lines of a
    customer: two timestamps on the same calendar day are < 24 h apart, so
    their floored gap is 0. Hence only gaps between consecutive *active days*
    can be non-zero: (1) a partial+final aggregate to (customer, day) rows with
    line count and min/max time (map-side combine, shuffle spread over days),
    (2) a window over the small per-customer day list for the boundary gaps,
    (3) sums. The zero gaps are counted through the line total (n − 1 gaps).
    A customer with a third of all lines still spreads over its active days
    in step 1 and has at most one row per day in step 2.
    """
    day = F.to_date(F.col(ts))
    per_day = obs.groupBy(_cust(obs).alias("CustomerID"), day.alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    w = Window.partitionBy("CustomerID").orderBy("_day")
    gaps = per_day.withColumn("_gap", elapsed_days(F.lag("_t1").over(w), F.col("_t0")))
    return gaps.groupBy("CustomerID").agg(
        F.sum("_n").cast("bigint").alias("n_lines"),
        F.coalesce(F.sum("_gap"), F.lit(0)).cast("bigint").alias("gap_sum"),
        F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0)).cast("bigint").alias("gap_sumsq"),
    )


def _gap_cv(n, s1, s2):
    """std_pop / mean of the G = n − 1 integer gaps from Σg and Σg²:
    cv = √(G·Σg² − (Σg)²) / Σg — integer arithmetic under the root, so the
    result does not depend on summation order."""
    g = (n - 1).cast("decimal(38,0)")
    a, b = s1.cast("decimal(38,0)"), s2.cast("decimal(38,0)")
    inner = (g * b - a * a).cast("double")
    return (F.when(n < 2, F.lit(SINGLE_ORDER_SENTINEL))
             .when(s1 == 0, F.lit(0.0))
             .otherwise(F.sqrt(F.greatest(inner, F.lit(0.0))) / s1.cast("double")))


def purchase_gap_cv(obs: DataFrame) -> DataFrame:
    """A3: CV (population std / mean) of whole-day gaps between sorted line
    timestamps; fewer than 2 lines → −1; mean 0 → 0."""
    st = purchase_gap_stats(obs)
    return st.select("CustomerID", _gap_cv(F.col("n_lines"), F.col("gap_sum"), F.col("gap_sumsq")).alias("purchase_gap_cv"))


def order_gaps(obs: DataFrame) -> DataFrame:
    """Whole-day gap between consecutive purchases of a customer (row per line).

    Two-level: ``lag`` inside (customer, day) windows; the first line of a day
    takes its predecessor from a per-(customer, day) summary (last time of the
    previous active day), whose window is bounded by the number of active days.
    """
    key = [F.col(CUST_IN).alias("CustomerID") if "Customer ID" in obs.columns else F.col("CustomerID")]
    d = obs.select(*key, "Invoice", "StockCode", "InvoiceDate", F.to_date("InvoiceDate").alias("_day"))
    w = Window.partitionBy("CustomerID", "_day").orderBy("InvoiceDate", "Invoice", "StockCode")
    d = d.withColumn("_prev", F.lag("InvoiceDate").over(w))
    last = d.groupBy("CustomerID", "_day").agg(F.max("InvoiceDate").alias("_last"))
    last = last.withColumn("_prev_day_last", F.lag("_last").over(Window.partitionBy("CustomerID").orderBy("_day")))
    j = d.join(last.select("CustomerID", "_day", "_prev_day_last"), ["CustomerID", "_day"])
    prev = F.coalesce(F.col("_prev"), F.col("_prev_day_last"))
    return j.select("CustomerID", "Invoice", "InvoiceDate", elapsed_days(prev, F.col("InvoiceDate")).alias("gap_days"))


def category_diversity(obs: DataFrame) -> DataFrame:
    """A4: distinct StockCode per customer (exact; ``approx=True`` for HLL++)."""
    return obs.groupBy(_cust(obs).alias("CustomerID")).agg(
        F.countDistinct("StockCode").cast("bigint").alias("category_diversity"))


def behaviour_features(obs: DataFrame) -> DataFrame:
    """A5: gap CV + diversity + single-purchase flag + constant return rate."""
    gaps = purchase_gap_stats(obs)
    div = category_diversity(obs)
    cv = _gap_cv(F.col("n_lines"), F.col("gap_sum"), F.col("gap_sumsq"))
    out = gaps.join(div, "CustomerID", "left")
    return out.select(
        "CustomerID", cv.alias("purchase_gap_cv"),
        F.col("category_diversity"),
        (F.col("n_lines") < 2).cast("int").alias("is_single_purchase"),
        F.lit(0.0).alias("return_rate"),
    )


def monthly_order_counts(obs: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                         months: int = TREND_MONTHS) -> DataFrame:
    """Distinct invoices per (customer, month) since ``snapshot − months``."""
    start = F.add_months(F.to_date(ts_lit(snapshot)), -months).cast("timestamp_ntz")
    recent = obs.where(F.col("InvoiceDate") >= start)
    return recent.groupBy(
        _cust(recent).alias("CustomerID"),
        F.trunc(F.to_date("InvoiceDate"), "MM").alias("year_month"),
    ).agg(F.countDistinct("Invoice").cast("bigint").alias("n_orders"))


def _ols_slope_aggs(y, x) -> list:
    """Integer sums for an exact OLS slope (x and y are integers)."""
    y, x = y.cast("decimal(38,0)"), x.cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("_m"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"),
            F.sum(x * y).alias("_sxy"), F.sum(x * x).alias("_sxx")]


def _ols_slope():
    """(n Σxy − Σx Σy) / (n Σx² − (Σx)²): exact integers, one rounded division,
    so every engine and every partitioning returns the same double (an online
    float accumulation does not, and PSI edges then split equal slopes)."""
    num = F.col("_m") * F.col("_sxy") - F.col("_sx") * F.col("_sy")
    den = F.col("_m") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    return F.when(F.col("_m") < 2, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def purchase_trend(monthly: DataFrame) -> DataFrame:
    """OLS slope of monthly counts on x = 0..n−1 over the months present
    (gaps compressed); fewer than 2 months → 0. Native ``regr_slope``."""
    w = Window.partitionBy("CustomerID").orderBy("year_month")
    x = F.row_number().over(w) - 1
    return (monthly.withColumn("_x", x)
            .groupBy("CustomerID").agg(*_ols_slope_aggs(F.col("n_orders"), F.col("_x")))
            .select("CustomerID", _ols_slope().alias("purchase_trend")))


def time_decay_weight(obs: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                      lam: float = TIME_DECAY_LAMBDA) -> DataFrame:
    """``exp(−λ · recency_days)`` per customer."""
    r = recency_tenure_days(obs, snapshot)
    return r.select("CustomerID", F.exp(F.lit(-float(lam)) * F.col("recency_days")).alias("time_decay_weight"))


def temporal_features(obs: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                      lam: float = TIME_DECAY_LAMBDA) -> DataFrame:
    """Trend (left side) ⟕ decay weight. Customers without an order in
    the last 6 months are absent here and get 0.0 for both in J1."""
    trend = purchase_trend(monthly_order_counts(obs, snapshot))
    decay = time_decay_weight(obs, snapshot, lam)
    return (trend.join(decay, "CustomerID", "left")
            .select("CustomerID", "purchase_trend",
                    F.coalesce(F.col("time_decay_weight"), F.lit(0.0)).alias("time_decay_weight")))


def exact_mean(score: Column) -> Column:
    """Mean of scores with at most nine decimals from an exact decimal sum and one division,
    so it doesn't depend on the order in which partial sums meet."""
    return F.sum(score.cast("decimal(18,9)")).cast("double") / F.count(score)


def doc_sentiment_agg(reviews: DataFrame, snapshot: str) -> DataFrame:
    """A10 + W2: per customer mean score, count of scores < −0.3, last non-null
    score by date, has_reviews = 1; only reviews strictly before the snapshot.

    The last score is ``max_by`` over (date, score) restricted to non-null
    scores: a declarative aggregate with partial aggregation, so one heavy
    customer does not land in a single window task.
    """
    r = reviews.where(F.col("review_date") < ts_lit(snapshot))
    s = F.col("sentiment_score")
    return r.groupBy("CustomerID").agg(
        exact_mean(s).alias("avg_sentiment_score"),
        F.count_if(s < NEGATIVE_SENTIMENT_THRESHOLD).cast("bigint").alias("negative_review_count"),
        F.max_by(F.when(s.isNotNull(), s), F.when(s.isNotNull(), F.struct("review_date", s))).alias("last_review_sentiment"),
        F.lit(1).alias("has_reviews"),
    )


def aspect_sentiment_pivot(aspects: DataFrame, snapshot: str) -> DataFrame:
    """Mean aspect score per customer for battery / shipping / price.

    Written as conditional averages in ONE aggregate (what a pivot with
    explicit values compiles to, without the extra distinct-values job).
    """
    a = aspects.where(F.col("review_date") < ts_lit(snapshot))
    return a.groupBy("CustomerID").agg(*[
        exact_mean(F.when(F.col("aspect") == k, F.col("aspect_sentiment"))).alias(v)
        for k, v in ASPECT_COLUMNS.items()
    ])


def sentiment_placeholders(customers: DataFrame) -> DataFrame:
    """Neutral-prior sentiment columns when no sentiment input exists."""
    return customers.select(
        "CustomerID",
        *[F.lit(v).alias(k) if isinstance(v, float) else F.lit(v).cast("bigint" if k == "negative_review_count" else "int").alias(k)
          for k, v in SENTIMENT_DEFAULTS.items()])


def _fill(df: DataFrame, defaults: dict) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in defaults:
            v = defaults[c]
            cols.append(F.coalesce(F.col(c), F.lit(v)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def merge_sentiment(customers: DataFrame, reviews: DataFrame, aspects: DataFrame,
                    snapshot: str) -> DataFrame:
    """Customers ⟕ doc-level aggregate ⟕ aspect pivot; nulls → defaults."""
    doc = doc_sentiment_agg(reviews, snapshot)
    asp = aspect_sentiment_pivot(aspects, snapshot)
    out = customers.select("CustomerID").join(doc, "CustomerID", "left").join(asp, "CustomerID", "left")
    out = out.select("CustomerID", *SENTIMENT_DEFAULTS.keys())
    out = _fill(out, SENTIMENT_DEFAULTS)
    return out.withColumn("negative_review_count", F.col("negative_review_count").cast("bigint")) \
              .withColumn("has_reviews", F.col("has_reviews").cast("int"))


def assemble_features(rfm: DataFrame, behaviour: DataFrame, temporal: DataFrame,
                      sentiment: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """RFM ⟕ behaviour ⟕ temporal ⟕ sentiment (⟕ labels) on CustomerID.

    All inputs are aggregates keyed by CustomerID, i.e. already hash
    partitioned on the join key, so the sort-merge joins reuse that
    partitioning instead of shuffling again.
    """
    out = (rfm.join(behaviour, "CustomerID", "left")
           .join(temporal, "CustomerID", "left")
           .join(sentiment, "CustomerID", "left"))
    if labels is not None:
        out = out.join(labels.select("CustomerID", "churned"), "CustomerID", "left")
    out = _fill(out, ASSEMBLY_DEFAULTS)
    return (out.withColumn("negative_review_count", F.col("negative_review_count").cast("bigint"))
               .withColumn("has_reviews", F.col("has_reviews").cast("int")))


def customer_feature_table(clean: DataFrame, snapshot: str, obs_start: str, horizon_days: int | None,
                           reviews: DataFrame | None, aspects: DataFrame | None, sentiment_snapshot: str | None = None,
                           lam: float = TIME_DECAY_LAMBDA) -> DataFrame:
    """J1, fused: the whole feature table from three passes over the window lines.

    * one per-customer aggregate for RFM, diversity, decay and the label summary
      (they share max/min/distinct-invoice/spend; two distinct counts → one Expand),
    * one (customer, day) aggregate for the gap CV (skew-safe, see A3),
    * one (customer, month) aggregate for the trend,
    plus the distinct horizon ids for the label. Every side is keyed by
    CustomerID, so the final left joins are co-partitioned.
    """
    from storelens.operators.clean import horizon_window, observation_window
    obs = observation_window(clean, obs_start, snapshot)
    s = ts_lit(snapshot)
    core = obs.groupBy(F.col(CUST_IN).alias("CustomerID")).agg(
        F.max("InvoiceDate").alias("last_order_date"), F.min("InvoiceDate").alias("first_order_date"),
        F.countDistinct("Invoice").alias("frequency"), F.sum("LineTotal").alias("_spend"),
        F.countDistinct("StockCode").alias("category_diversity"))
    rec = elapsed_days(F.col("last_order_date"), s)
    core = core.select(
        "CustomerID", "last_order_date", "first_order_date", F.col("frequency").cast("bigint").alias("frequency"),
        F.greatest(F.col("_spend"), F.lit(0.0)).alias("monetary_value"), rec.alias("recency_days"),
        elapsed_days(F.col("first_order_date"), s).alias("tenure_days"),
        (F.col("_spend") / F.col("frequency")).alias("avg_order_value"),
        F.log1p(rec.cast("double")).alias("recency_days_log"),
        F.col("category_diversity").cast("bigint").alias("category_diversity"))
    gaps = purchase_gap_stats(obs)
    trend = purchase_trend(monthly_order_counts(obs, snapshot)).withColumn("_recent", F.lit(True))
    out = core.join(gaps, "CustomerID", "left").join(trend, "CustomerID", "left")
    if reviews is not None and aspects is not None:
        ss = sentiment_snapshot or snapshot
        out = (out.join(doc_sentiment_agg(reviews, ss), "CustomerID", "left")
                  .join(aspect_sentiment_pivot(aspects, ss), "CustomerID", "left"))
    else:
        out = out.select("*", *[F.lit(None).alias(k) for k in SENTIMENT_DEFAULTS])
    if horizon_days is not None:
        hz = (horizon_window(clean, snapshot, horizon_days).select(F.col(CUST_IN).alias("CustomerID")).distinct()
              .withColumn("_ret", F.lit(1)))
        out = out.join(hz, "CustomerID", "left")
    cv = _gap_cv(F.col("n_lines"), F.col("gap_sum"), F.col("gap_sumsq"))
    cols = [
        "CustomerID", "last_order_date", "first_order_date", "frequency", "monetary_value", "recency_days",
        "tenure_days", "avg_order_value", "recency_days_log",
        F.coalesce(cv, F.lit(SINGLE_ORDER_SENTINEL)).alias("purchase_gap_cv"), "category_diversity",
        (F.col("n_lines") < 2).cast("int").alias("is_single_purchase"), F.lit(0.0).alias("return_rate"),
        F.coalesce(F.col("purchase_trend"), F.lit(0.0)).alias("purchase_trend"),
        F.when(F.col("_recent"), F.exp(F.lit(-float(lam)) * F.col("recency_days"))).otherwise(F.lit(0.0)).alias("time_decay_weight"),
        *[F.coalesce(F.col(k), F.lit(v)).cast("bigint" if k == "negative_review_count" else
                                              ("int" if k == "has_reviews" else "double")).alias(k)
          for k, v in SENTIMENT_DEFAULTS.items()],
    ]
    if horizon_days is not None:
        cols.append(F.col("_ret").isNull().cast("int").alias("churned"))
    return out.select(*cols)


def customer_feature_tables(clean: DataFrame, periods: dict[str, tuple[str, str]], horizon_days: int | None,
                            reviews: DataFrame | None, aspects: DataFrame | None,
                            sentiment_snapshot: str | None = None, lam: float = TIME_DECAY_LAMBDA) -> DataFrame:
    """J1 for several snapshots in the same three aggregates over the lines: ``periods`` maps a name
    to (snapshot, observation start). Each line is tagged with the periods whose
    window contains it (explode over the bounded period list), and every
    aggregate groups by (period, customer). Output has a ``period`` column and
    the same columns as ``customer_feature_table``.
    """
    spec = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(s).cast("timestamp_ntz").alias("snap"),
                              F.lit(o).cast("timestamp_ntz").alias("start")) for k, (s, o) in periods.items()])
    ts = F.col("InvoiceDate")
    tagged = clean.select("*", F.explode(F.filter(spec, lambda x: ts.between(x["start"], x["snap"]))).alias("_p")) \
                  .select("*", F.col("_p.p").alias("period"), F.col("_p.snap").alias("_snap")).drop("_p")
    cust = F.col(CUST_IN).alias("CustomerID")
    keys = ["period", "_snap"]
    core = tagged.groupBy(*keys, cust).agg(
        F.max("InvoiceDate").alias("last_order_date"), F.min("InvoiceDate").alias("first_order_date"),
        F.countDistinct("Invoice").alias("frequency"), F.sum("LineTotal").alias("_spend"),
        F.countDistinct("StockCode").alias("category_diversity"))
    rec = elapsed_days(F.col("last_order_date"), F.col("_snap"))
    core = core.select(
        *keys, "CustomerID", "last_order_date", "first_order_date", F.col("frequency").cast("bigint").alias("frequency"),
        F.greatest(F.col("_spend"), F.lit(0.0)).alias("monetary_value"), rec.alias("recency_days"),
        elapsed_days(F.col("first_order_date"), F.col("_snap")).alias("tenure_days"),
        (F.col("_spend") / F.col("frequency")).alias("avg_order_value"),
        F.log1p(rec.cast("double")).alias("recency_days_log"),
        F.col("category_diversity").cast("bigint").alias("category_diversity"))
    # gap CV: (period, customer, day) partials, then boundary gaps per (period, customer)
    day = F.to_date("InvoiceDate")
    per_day = tagged.groupBy("period", cust, day.alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("InvoiceDate").alias("_t0"), F.max("InvoiceDate").alias("_t1"))
    w = Window.partitionBy("period", "CustomerID").orderBy("_day")
    gaps = (per_day.withColumn("_gap", elapsed_days(F.lag("_t1").over(w), F.col("_t0")))
            .groupBy("period", "CustomerID").agg(
                F.sum("_n").cast("bigint").alias("n_lines"), F.coalesce(F.sum("_gap"), F.lit(0)).cast("bigint").alias("gap_sum"),
                F.coalesce(F.sum(F.col("_gap") * F.col("_gap")), F.lit(0)).cast("bigint").alias("gap_sumsq")))
    # trend: distinct invoices per (period, customer, month) within the last 6 months of the period
    recent = tagged.where(F.col("InvoiceDate") >= F.add_months(F.to_date("_snap"), -TREND_MONTHS).cast("timestamp_ntz"))
    monthly = recent.groupBy("period", cust, F.trunc(F.to_date("InvoiceDate"), "MM").alias("year_month")).agg(
        F.countDistinct("Invoice").cast("bigint").alias("n_orders"))
    wm = Window.partitionBy("period", "CustomerID").orderBy("year_month")
    trend = (monthly.withColumn("_x", F.row_number().over(wm) - 1)
             .groupBy("period", "CustomerID").agg(*_ols_slope_aggs(F.col("n_orders"), F.col("_x")))
             .select("period", "CustomerID", _ols_slope().alias("purchase_trend"), F.lit(True).alias("_recent")))
    out = core.join(gaps, ["period", "CustomerID"], "left").join(trend, ["period", "CustomerID"], "left")
    if reviews is not None and aspects is not None:
        ss = sentiment_snapshot
        out = (out.join(doc_sentiment_agg(reviews, ss), "CustomerID", "left")
                  .join(aspect_sentiment_pivot(aspects, ss), "CustomerID", "left"))
    else:
        out = out.select("*", *[F.lit(None).alias(k) for k in SENTIMENT_DEFAULTS])
    if horizon_days is not None:
        hspec = F.array(*[F.struct(F.lit(k).alias("p"),
                                   (F.lit(s).cast("timestamp_ntz") + F.make_interval(days=F.lit(1))).alias("a"),
                                   (F.lit(s).cast("timestamp_ntz") + F.make_interval(days=F.lit(horizon_days))).alias("b"))
                          for k, (s, _) in periods.items()])
        hz = (clean.select(cust, F.explode(F.filter(hspec, lambda x: ts.between(x["a"], x["b"]))).alias("_h"))
              .select(F.col("_h.p").alias("period"), "CustomerID").distinct().withColumn("_ret", F.lit(1)))
        out = out.join(hz, ["period", "CustomerID"], "left")
    cv = _gap_cv(F.col("n_lines"), F.col("gap_sum"), F.col("gap_sumsq"))
    cols = [
        "period", "CustomerID", "last_order_date", "first_order_date", "frequency", "monetary_value", "recency_days",
        "tenure_days", "avg_order_value", "recency_days_log",
        F.coalesce(cv, F.lit(SINGLE_ORDER_SENTINEL)).alias("purchase_gap_cv"), "category_diversity",
        (F.col("n_lines") < 2).cast("int").alias("is_single_purchase"), F.lit(0.0).alias("return_rate"),
        F.coalesce(F.col("purchase_trend"), F.lit(0.0)).alias("purchase_trend"),
        F.when(F.col("_recent"), F.exp(F.lit(-float(lam)) * F.col("recency_days"))).otherwise(F.lit(0.0)).alias("time_decay_weight"),
        *[F.coalesce(F.col(k), F.lit(v)).cast("bigint" if k == "negative_review_count" else
                                              ("int" if k == "has_reviews" else "double")).alias(k)
          for k, v in SENTIMENT_DEFAULTS.items()],
    ]
    if horizon_days is not None:
        cols.append(F.col("_ret").isNull().cast("int").alias("churned"))
    return out.select(*cols)
