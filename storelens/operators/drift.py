"""Reference distributions, scaler and drift.

Wide feature tables are unpivoted once to ``(feature, value)`` and reduced with
one grouped aggregate per feature. Per-feature parameters (scaler, reference
edges) are tiny tables — one row per feature — and are broadcast or attached
as literals; their size is fixed by the feature list, not by the row count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.schemas import NUMERIC_FEATURE_COLUMNS

# Reference constants.
PSI_THRESHOLD = 0.2
QUANTILE_POINTS = [0.0, 25.0, 50.0, 75.0, 95.0, 100.0]
KS_REFERENCE_DRAWS = 1000
EXACT_CELLS = 250_000
PSI_FLOOR = 1e-6


def unpivot_features(df: DataFrame, cols: list[str], id_col: str | None = None) -> DataFrame:
    """Wide → long ``(feature, value)`` (doubles), nulls dropped."""
    ids = [id_col] if id_col else []
    d = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    long = d.unpivot(ids, cols, "feature", "value")
    return long.where(F.col("value").isNotNull())


def cumulative_counts(long: DataFrame, buckets: int = 128) -> DataFrame:
    """(feature, value, cnt, cum_cnt, n): per distinct value its count, the rows below it, the feature's rows.

    Values are dealt into buckets whose edges are approximate quantiles of the
    distinct values, so a bucket holds a small share of them whatever the
    feature's range; prefix sums run over bucket totals and inside a bucket.
    """
    from storelens.operators.ranking import exclusive_cumsum
    dv = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    edges = dv.groupBy("feature").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10_000).alias("_edges"),
                                      F.sum("cnt").alias("n"))
    d = dv.join(F.broadcast(edges), "feature")  # a row a feature
    bucket = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    return exclusive_cumsum(d, "value", ["cnt"], bucket, ["feature"]).drop("_edges")


def reference_distribution(features: DataFrame, cols: list[str] | None = None, exact: bool = True,
                           accuracy: int = 100000) -> DataFrame:
    """Per feature mean, std (ddof 1), p25/p50/p75/p95 (linear), min, max, n.

    ``exact`` finds the two order statistics around each position by their
    ranks among the distinct values; no buffer holds a feature's values.
    ``exact=False`` uses the ``percentile_approx`` sketch in the same pass.
    """
    cols = [c for c in (cols or NUMERIC_FEATURE_COLUMNS) if c in features.columns]
    long = unpivot_features(features, cols)
    qs = [0.25, 0.5, 0.75, 0.95]
    names = [f"p{int(q * 100)}" for q in qs]
    sketch = [] if exact else [F.percentile_approx(F.col("value"), qs, accuracy).alias("_q")]
    g = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), *sketch,
        F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))
    if exact:
        at = lambda rank: F.max(F.when((F.col("cum_cnt") <= rank) & (rank < F.col("cum_cnt") + F.col("cnt")), F.col("value")))
        place = lambda q: (F.col("n") - 1) * F.lit(q)
        c = cumulative_counts(long)
        o = c.groupBy("feature").agg(*[x for q, p in zip(qs, names) for x in (
            at(F.floor(place(q))).alias(f"_lo_{p}"), at(F.ceil(place(q))).alias(f"_hi_{p}"), F.max(place(q) - F.floor(place(q))).alias(f"_f_{p}"))])
        g = g.join(o, "feature", "left")
        pct = [(F.col(f"_lo_{p}") + (F.col(f"_hi_{p}") - F.col(f"_lo_{p}")) * F.col(f"_f_{p}")).alias(p) for p in names]
    else:
        pct = [F.col("_q")[i].alias(p) for i, p in enumerate(names)]
    return g.select("feature", "mean", "std", *pct, "min", "max", F.col("n").cast("bigint"))


def fit_scaler(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column mean and POPULATION std over null → 0; zero std → scale 1."""
    cols = [c for c in (cols or NUMERIC_FEATURE_COLUMNS) if c in features.columns]
    d = features.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    long = d.unpivot([], cols, "feature", "value")
    g = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return g.select("feature", "mean", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std")).alias("scale"))


def _scaler_params(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    # one row per feature: model parameters, not data
    return {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, scaler: DataFrame | dict, inverse: bool = False) -> DataFrame:
    """(x − mean) / scale on the scaled columns only (flags untouched);
    ``inverse`` maps back. Never refits."""
    params = scaler if isinstance(scaler, dict) else _scaler_params(scaler)
    out = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            x = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if not inverse else F.col(c).cast("double")
            out.append(((x * F.lit(s) + F.lit(m)) if inverse else ((x - F.lit(m)) / F.lit(s))).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def _edges(ref: DataFrame) -> DataFrame:
    """Per feature: distinct edges and the FIRST quantile rank of each."""
    vals = F.array("min", "p25", "p50", "p75", "p95", "max")
    pts = F.array(*[F.lit(p) for p in QUANTILE_POINTS])
    keep = F.filter(F.arrays_zip(vals.alias("v"), pts.alias("q")),
                    lambda s, i: F.when(i == 0, F.lit(True)).otherwise(s["v"] != F.element_at(vals, F.greatest(i, F.lit(1)))))
    return ref.select("feature", F.transform(keep, lambda s: s["v"]).alias("edges"),
                      F.transform(keep, lambda s: s["q"]).alias("ranks"))


def psi(current: DataFrame, reference: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Population stability index of current values against reference percentile buckets.

    Buckets are [e_i, e_{i+1}) with the last closed; values outside the edges
    are ignored (reported as ``out_of_range`` share); shares are over the in-range
    count and floored at 1e-6; fewer than 2 edges → 0.
    """
    cols = cols or [r for r in NUMERIC_FEATURE_COLUMNS if r in current.columns]
    return psi_long(unpivot_features(current, cols), reference)


def psi_long(long: DataFrame, reference: DataFrame) -> DataFrame:
    """D4 on a long ``(feature, value)`` table (``feature`` may be any series key,
    e.g. a day, as long as the reference has a row for it)."""
    e = _edges(reference)
    j = long.join(F.broadcast(e), "feature")
    m = F.size("edges")
    v = F.col("value")
    inside = (m >= 2) & (v >= F.element_at("edges", 1)) & (v <= F.element_at("edges", -1))
    b = F.least(F.size(F.filter("edges", lambda x: x <= v)) - 1, m - 2)
    cnt = (j.select("feature", F.when(inside, b).alias("b"))
           .groupBy("feature", "b").agg(F.count(F.lit(1)).alias("c")))
    in_range = cnt.where(F.col("b").isNotNull())
    totals = cnt.groupBy("feature").agg(F.sum(F.when(F.col("b").isNotNull(), F.col("c")).otherwise(0)).alias("tot"),
                                        F.sum("c").alias("n_all"))
    ref_b = e.select("feature", F.posexplode(F.slice("ranks", 2, 5)).alias("b", "hi"), "ranks") \
             .select("feature", "b", ((F.col("hi") - F.element_at("ranks", F.col("b") + 1)) / 100.0).alias("r"))
    t = ref_b.join(in_range, ["feature", "b"], "left").join(totals, "feature", "left")
    c = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.greatest(F.coalesce(F.col("tot"), F.lit(0)), F.lit(1)), F.lit(PSI_FLOOR))
    r = F.greatest(F.col("r"), F.lit(PSI_FLOOR))
    per = t.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))
    feats = e.join(totals, "feature", "inner")  # features present in both, with data
    return feats.join(per, "feature", "left").select(
        "feature", F.coalesce(F.col("psi"), F.lit(0.0)).alias("psi"),
        ((F.col("n_all") - F.col("tot")) / F.col("n_all")).alias("out_of_range"))


def daily_drift(logs: DataFrame, value: str, ref_start: str, ref_end: str, ts: str = "created_at",
                module: str = "retention", threshold: float = PSI_THRESHOLD) -> DataFrame:
    """T9 (batch form): PSI of one monitored value per day against a reference
    window, as drift-event rows. The reference is one row; it is repeated for
    each day present (a table of days, not of rows)."""
    lo, hi = F.lit(ref_start).cast("timestamp_ntz"), F.lit(ref_end).cast("timestamp_ntz")
    ref_rows = logs.where((F.col(ts) >= lo) & (F.col(ts) < hi)).select(F.col(value).cast("double").alias(value))
    ref = reference_distribution(ref_rows, [value]).first()  # one row of stored statistics
    days = logs.select(F.date_format(F.to_date(ts), "yyyy-MM-dd").alias("feature")).distinct()
    stats = ["min", "p25", "p50", "p75", "p95", "max"]
    ref_days = days.select("feature", *[F.lit(float(ref[c])).alias(c) for c in stats])
    long = logs.select(F.date_format(F.to_date(ts), "yyyy-MM-dd").alias("feature"), F.col(value).cast("double").alias("value"))
    p = psi_long(long.where(F.col("value").isNotNull()), ref_days)
    return p.select(F.col("feature").alias("day"), F.lit(module).alias("module"), F.lit(value).alias("feature_name"),
                    F.lit("psi").alias("metric"), F.col("psi").alias("metric_value"), F.lit(threshold).alias("threshold"),
                    (F.col("psi") > threshold).alias("alert_triggered"))


def _ref_cdf(v: Column, strict: bool) -> Column:
    """Reference CDF: piecewise linear through (value_i, rank_i/100) of the six
    stored points. ``strict=False`` gives F(v) (right-continuous: the last rank
    of a repeated value), ``strict=True`` the left limit F(v−) (first rank)."""
    vals, qs = F.col("_vals"), F.col("_qs")
    idx = F.size(F.filter(vals, (lambda x: x < v) if strict else (lambda x: x <= v)))
    i1 = F.greatest(idx, F.lit(1))
    i2 = F.least(idx + 1, F.lit(len(QUANTILE_POINTS)))
    x0, x1 = F.element_at(vals, i1), F.element_at(vals, i2)
    q0, q1 = F.element_at(qs, i1), F.element_at(qs, i2)
    lin = (q0 + (q1 - q0) * (v - x0) / (x1 - x0)) / 100.0
    lo, hi = F.element_at(vals, 1), F.element_at(vals, -1)
    if strict:
        return F.when(v <= lo, F.lit(0.0)).when(v > hi, F.lit(1.0)).otherwise(lin)
    return F.when(v < lo, F.lit(0.0)).when(v >= hi, F.lit(1.0)).otherwise(lin)


def kolmogorov_pvalue(lam: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov survival Q(λ) = 2 Σ (−1)^{k−1} exp(−2 k² λ²), clipped to [0, 1]."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    s = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * s)))


def ks_statistic(current: DataFrame, reference: DataFrame, cols: list[str] | None = None,
                 m: int = KS_REFERENCE_DRAWS) -> DataFrame:
    """Sup |F_n − F_ref| per feature and its asymptotic p-value.

    F_ref is the piecewise-linear curve through the stored percentiles
    (deterministic stand-in for the reference's 1,000 random draws: the
    effective size n·m/(n+m) keeps the two-sample scale). F_n comes from
    distinct values with counts and a bucketed prefix sum (no single-task
    window). The supremum is attained at sample points (F_n steps there and
    F_ref is monotone in between).
    """
    cols = cols or [r for r in NUMERIC_FEATURE_COLUMNS if r in current.columns]
    e = reference.select("feature", F.array("min", "p25", "p50", "p75", "p95", "max").alias("_vals"),
                         F.array(*[F.lit(p) for p in QUANTILE_POINTS]).alias("_qs"))
    long = unpivot_features(current, cols)
    j = cumulative_counts(long).join(F.broadcast(e), "feature")
    v = F.col("value")
    below = F.col("cum_cnt") / F.col("n")
    upto = (F.col("cum_cnt") + F.col("cnt")) / F.col("n")
    gap = F.greatest(F.abs(upto - _ref_cdf(v, strict=False)), F.abs(below - _ref_cdf(v, strict=True)))
    d = j.groupBy("feature", "n").agg(F.max(gap).alias("ks_stat"))
    neff = F.col("n") * F.lit(float(m)) / (F.col("n") + F.lit(float(m)))
    return d.select("feature", F.col("n").cast("bigint"), "ks_stat",
                    kolmogorov_pvalue(F.sqrt(neff) * F.col("ks_stat")).alias("ks_pvalue"))


def lattice_pvalue(n: int, m: int, d: float) -> float:
    """P(D ≥ d) for two samples of n and m without ties: 1 − the share of lattice paths that stay closer than d."""
    import numpy as np

    limit = round(d * n * m) - 0.5  # |i / n − j / m| < d over whole numbers
    j = np.arange(m + 1)
    inside = j * n < limit
    share = np.where(np.logical_and.accumulate(inside), 1.0, 0.0)
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < limit
        # of the paths to (i, j) the share i / (i + j) comes from the left, the others from below
        row, before = np.zeros(m + 1), 0.0
        for k in range(m + 1):
            before = (share[k] * i + before * k) / (i + k) if inside[k] else 0.0
            row[k] = before
        share = row
    return float(min(1.0, max(0.0, 1.0 - share[m])))


def ks_two_sample(a: DataFrame, b: DataFrame, exact_cells: int = EXACT_CELLS) -> DataFrame:
    """D5, two tables: sup |F_a − F_b| per feature of two (feature, value) tables, and its p-value.

    Both tables' values are ranked together: counts of both sides by distinct value, and one bucketed prefix sum
    of both. The p-value is exact (lattice paths) while n_a · n_b ≤ ``exact_cells``, else asymptotic; with ties
    the exact one is an upper bound. Null values are left out; a feature that one table lacks has no row.
    """
    from storelens.operators.ranking import exclusive_cumsum

    one = lambda t, x, y: t.where(F.col("value").isNotNull()).select("feature", F.col("value").cast("double").alias("value"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    points = [i / 128 for i in range(1, 128)]
    edges = both.groupBy("feature").agg(F.percentile_approx("value", points, 10_000).alias("_edges"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    d = both.join(F.broadcast(edges), "feature").where((F.col("n_a") > 0) & (F.col("n_b") > 0))  # a row a feature
    c = exclusive_cumsum(d, "value", ["a", "b"], F.size(F.filter("_edges", lambda e: e < F.col("value"))), ["feature"])
    gap = F.abs((F.col("cum_a") + F.col("a")) / F.col("n_a") - (F.col("cum_b") + F.col("b")) / F.col("n_b"))
    out = c.groupBy("feature", "n_a", "n_b").agg(F.max(gap).alias("ks_stat"))

    @F.pandas_udf("double")
    def exact(n: pd.Series, m: pd.Series, stat: pd.Series) -> pd.Series:
        return pd.Series([lattice_pvalue(int(x), int(y), z) if x * y <= exact_cells else None for x, y, z in zip(n, m, stat)], dtype="float64")

    neff = F.col("n_a").cast("double") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    asymptotic = kolmogorov_pvalue(F.sqrt(neff) * F.col("ks_stat"))
    small = F.col("n_a") * F.col("n_b") <= exact_cells
    return out.select("feature", F.col("n_a").cast("bigint"), F.col("n_b").cast("bigint"), "ks_stat",
                      F.when(small, exact("n_a", "n_b", "ks_stat")).otherwise(asymptotic).alias("ks_pvalue"))


def drift_report(current: DataFrame, reference: DataFrame, cols: list[str] | None = None,
                 threshold: float = PSI_THRESHOLD) -> DataFrame:
    """PSI ⟕ KS per feature; flag on PSI only. Features missing from the
    reference or without current values are skipped."""
    p = psi(current, reference, cols)
    k = ks_statistic(current, reference, cols)
    return p.join(k, "feature").select("feature", "psi", "ks_stat", "ks_pvalue",
                                       (F.col("psi") > threshold).alias("drift_detected"))


def inject_shift(current: DataFrame, reference: DataFrame, feature: str, sigmas: float = 5.0) -> DataFrame:
    """Shift one feature by ``sigmas`` reference standard deviations."""
    std = reference.where(F.col("feature") == feature).select("std").first()["std"]  # one stored number
    return current.withColumn(feature, F.col(feature) + F.lit(float(sigmas) * float(std)))


def drift_events_rows(report: DataFrame, module: str = "retention", reference_version: str = "v1",
                      threshold: float = PSI_THRESHOLD, keep: tuple = ()) -> DataFrame:
    """One event row per feature (metric 'psi'), with the report's columns ``keep`` before it."""
    return report.select(*keep, F.lit(module).alias("module"), F.col("feature").alias("feature_name"),
                         F.lit("psi").alias("metric"), F.col("psi").alias("metric_value"),
                         F.lit(threshold).alias("threshold"), F.col("drift_detected").alias("alert_triggered"),
                         F.lit(reference_version).alias("reference_version"))


def drift_review_items(report: DataFrame, module: str = "retention", keep: tuple = ()) -> DataFrame:
    """Drifted features → review-queue rows with a JSON payload, with the report's columns ``keep`` before it."""
    d = report.where("drift_detected")
    payload = F.to_json(F.struct(F.col("feature"), F.col("psi"), F.col("ks_pvalue"), F.col("drift_detected")))
    return d.select(*keep, F.concat(F.lit(f"drift_{module}_"), F.col("feature")).alias("request_id"),
                    F.lit(module).alias("module"), F.lit("drift_alert").alias("trigger"),
                    payload.alias("payload"), F.lit("pending").alias("status"))

