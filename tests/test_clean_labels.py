"""Behaviours of the reference's churn-label unit tests, on tiny frames."""

import datetime as dt

from pyspark.sql import functions as F

from storelens import schemas as S
from storelens.operators import clean as C
from storelens.operators import labels as L

SNAP, OBS = "2010-11-30", "2009-12-01"


def tx(spark, rows):
    return spark.createDataFrame(rows, S.TRANSACTIONS)


def t(y, m, d, h=12):
    return dt.datetime(y, m, d, h)


def base_rows():
    return [
        ("1", "A", "x", 2, t(2010, 1, 10), 1.5, 100.0, "United Kingdom"),     # retained (buys in horizon)
        ("2", "A", "x", 1, t(2010, 12, 15), 1.5, 100.0, "United Kingdom"),
        ("3", "B", "x", 1, t(2010, 2, 1), 2.0, 200.0, "United Kingdom"),      # churned
        ("4", "B", "x", 1, t(2011, 3, 30), 2.0, 200.0, "United Kingdom"),     # too late (> 90 d)
        ("5", "C", "x", 1, t(2010, 3, 1), 2.0, None, "United Kingdom"),       # guest
        ("6", "C", "x", 1, t(2010, 3, 1), 2.0, 300.0, "France"),              # other country
        ("C7", "C", "x", 1, t(2010, 3, 1), 2.0, 400.0, "United Kingdom"),     # cancellation
        ("8", "C", "x", -1, t(2010, 3, 1), 2.0, 500.0, "United Kingdom"),     # non-positive qty
        ("9", "C", "x", 1, t(2010, 3, 1), 0.0, 600.0, "United Kingdom"),      # zero price
    ]


def test_cleaning_filters_and_id_format(spark):
    c = C.clean_transactions(tx(spark, base_rows()))
    ids = sorted({r["Customer ID"] for r in c.collect()})
    assert ids == ["100", "200"]
    assert all(r["LineTotal"] == r["Quantity"] * r["Price"] for r in c.collect())


def test_funnel_counts(spark):
    f = {r["step"]: (r["rows_remaining"], r["rows_removed"]) for r in C.cleaning_funnel(tx(spark, base_rows())).collect()}
    assert f["raw"] == (9, 0)
    assert f["exclude_guests"] == (8, 1)
    assert f["scope_country"] == (7, 1)
    assert f["drop_cancellations"] == (6, 1)
    assert f["positive_lines"] == (4, 2)


def test_churn_labels(spark):
    lab = {r["CustomerID"]: r["churned"] for r in L.churn_labels(C.clean_transactions(tx(spark, base_rows())), SNAP, OBS, 90).collect()}
    assert lab == {"100": 0, "200": 1}


def test_snapshot_day_hole_and_horizon_bounds(spark):
    rows = [("1", "A", "x", 1, t(2010, 6, 1), 1.0, 1.0, "United Kingdom"),
            ("2", "A", "x", 1, t(2010, 11, 30, 10), 1.0, 1.0, "United Kingdom"),   # snapshot day after 00:00: neither window
            ("3", "A", "x", 1, t(2010, 6, 1), 1.0, 2.0, "United Kingdom"),
            ("4", "A", "x", 1, dt.datetime(2011, 2, 28, 0, 0), 1.0, 2.0, "United Kingdom")]  # exactly snapshot + 90 d
    lab = {r["CustomerID"]: r["churned"] for r in L.churn_labels(C.clean_transactions(tx(spark, rows)), SNAP, OBS, 90).collect()}
    assert lab == {"1": 1, "2": 0}


def test_validity_band(spark):
    def lab(n, churned):
        return spark.createDataFrame([(str(i), 1 if i < churned else 0) for i in range(n)], "CustomerID string, churned int")
    assert not L.churn_label_validity(lab(5, 5)).first()["valid"]
    r = L.churn_label_validity(lab(10, 5)).first()
    assert r["valid"] and r["churn_rate"] == 0.5 and r["advice"] == "ok"


def test_horizon_sensitivity_monotone(spark):
    hs = L.horizon_sensitivity(C.clean_transactions(tx(spark, base_rows())), SNAP, OBS).orderBy("horizon_days").collect()
    rates = [r["churn_rate"] for r in hs]
    assert rates == sorted(rates, reverse=True)


def test_country_pushed_to_scan(spark, tmp_path):
    p = str(tmp_path / "tx")
    tx(spark, base_rows()).write.parquet(p)
    plan = C.scope_country(spark.read.parquet(p), "France")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "France" in plan
