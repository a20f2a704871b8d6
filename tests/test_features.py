import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens.functions.timeutil import elapsed_days, ts_lit
from storelens.operators import features as FE


def obs(spark, rows):
    return spark.createDataFrame(rows, "`Customer ID` string, Invoice string, InvoiceDate timestamp_ntz, StockCode string, LineTotal double")


def d(y, m, dd, h=10):
    return dt.datetime(y, m, dd, h)


def test_gap_cv_sentinel_real_and_mixed(spark):
    rows = [("1", "i1", d(2010, 1, 1), "A1", 1.0),
            ("2", "i2", d(2010, 1, 1), "A1", 1.0), ("2", "i3", d(2010, 1, 15), "A2", 1.0), ("2", "i4", d(2010, 2, 1), "A1", 1.0)]
    b = {r["CustomerID"]: r for r in FE.behaviour_features(obs(spark, rows)).collect()}
    assert b["1"]["purchase_gap_cv"] == -1.0 and b["1"]["is_single_purchase"] == 1
    assert b["2"]["purchase_gap_cv"] >= 0 and b["2"]["is_single_purchase"] == 0
    assert b["2"]["category_diversity"] == 2
    # gaps 14, 17 → pop std 1.5, mean 15.5
    assert abs(b["2"]["purchase_gap_cv"] - 1.5 / 15.5) < 1e-12


def test_one_invoice_many_lines_is_not_single(spark):
    rows = [("9", "i1", d(2010, 1, 1), "A", 1.0), ("9", "i1", d(2010, 1, 1), "B", 1.0)]
    b = FE.behaviour_features(obs(spark, rows)).first()
    assert b["purchase_gap_cv"] == 0.0 and b["is_single_purchase"] == 0


def test_elapsed_days_is_floor_not_calendar(spark):
    r = spark.range(1).select(elapsed_days(ts_lit("2010-01-01 20:00:00"), ts_lit("2010-01-03 06:00:00")).alias("e"),
                              F.datediff(F.lit("2010-01-03"), F.lit("2010-01-01")).alias("cal")).first()
    assert r["e"] == 1 and r["cal"] == 2


def test_decay_zero_when_idle_six_months(spark):
    rows = [("1", "i1", d(2010, 1, 5), "A", 1.0), ("2", "i2", d(2010, 11, 1), "A", 1.0)]
    t = {r["CustomerID"]: r for r in FE.temporal_features(obs(spark, rows), "2010-11-30").collect()}
    assert "1" not in t and t["2"]["time_decay_weight"] > 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 24 * 60)), min_size=1, max_size=40))
def test_two_level_gap_stats_equal_naive_window(spark, events):
    base = dt.datetime(2010, 1, 1)
    rows = [(str(c), f"i{k}", base + dt.timedelta(hours=h), "A", 1.0) for k, (c, h) in enumerate(events)]
    o = obs(spark, rows)
    got = {r["CustomerID"]: r["purchase_gap_cv"] for r in FE.purchase_gap_cv(o).collect()}
    w = Window.partitionBy("Customer ID").orderBy("InvoiceDate")
    g = o.select(F.col("`Customer ID`").alias("c"), elapsed_days(F.lag("InvoiceDate").over(w), F.col("InvoiceDate")).alias("g"))
    naive = g.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("g").alias("sd"), F.avg("g").alias("m")).collect()
    for r in naive:
        exp = -1.0 if r["n"] < 2 else (0.0 if r["m"] == 0 else r["sd"] / r["m"])
        assert abs(got[r["c"]] - exp) < 1e-9


def test_negative_sentiment_threshold_strict_and_snapshot_excluded(spark):
    rev = spark.createDataFrame([("1", d(2024, 1, 1), -0.3), ("1", d(2024, 1, 2), -0.31), ("1", d(2024, 1, 20, 0), -0.9),
                                 ("1", d(2024, 1, 3), None)], "CustomerID string, review_date timestamp_ntz, sentiment_score double")
    r = FE.doc_sentiment_agg(rev, "2024-01-20").first()
    assert r["negative_review_count"] == 1
    assert r["last_review_sentiment"] == -0.31      # last NON-null before the snapshot
    assert abs(r["avg_sentiment_score"] - (-0.305)) < 1e-12


def test_multi_period_equals_single_period(spark):
    from storelens.operators import clean as C
    from storelens.sources import fixtures as FX
    from storelens.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    clean = C.clean_transactions(FX.transactions(t), country=None).cache()
    periods = {"a": ("1999-08-01", "1998-08-02"), "b": ("2000-08-01", "1999-08-02")}
    multi = FE.customer_feature_tables(clean, periods, 90, None, None)
    for name, (snap, start) in periods.items():
        single = FE.customer_feature_table(clean, snap, start, 90, None, None)
        m = multi.where(F.col("period") == name).drop("period")
        cols = sorted(single.columns)
        a = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in single.select(*cols).collect())
        b = sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in m.select(*cols).collect())
        assert a == b


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=6), min_size=1, max_size=5))
def test_exact_trend_slope_equals_least_squares(spark, series):
    import numpy as np
    rows = [(str(c), dt.date(2010, m + 1, 1), y) for c, ys in enumerate(series) for m, y in enumerate(ys)]
    monthly = spark.createDataFrame(rows, "CustomerID string, year_month date, n_orders long")
    got = {r["CustomerID"]: r["purchase_trend"] for r in FE.purchase_trend(monthly).collect()}
    for c, ys in enumerate(series):
        exp = 0.0 if len(ys) < 2 else float(np.polyfit(np.arange(len(ys), dtype=float), np.asarray(ys, dtype=float), 1)[0])
        assert abs(got[str(c)] - exp) < 1e-9
