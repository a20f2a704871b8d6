"""Behaviours that an earlier review found missing."""

import struct

import pytest
from pyspark.sql import functions as F

from storelens.operators import features, images, logs, reviews
from storelens.operators.sentiment_model import sentiment_classifier
from storelens.streaming import monitors


def jpeg(width, height, metadata):
    """A JPEG header whose size stands behind ``metadata`` bytes of application segments."""
    out = b"\xff\xd8"
    while metadata > 0:
        n = min(metadata, 65_000)
        out += b"\xff\xe1" + struct.pack(">H", n + 2) + b"\0" * n
        metadata -= n
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 6000


def test_jpeg_with_much_metadata_is_valid(spark):
    files = spark.createDataFrame([("a/x.jpg", "a", jpeg(300, 200, 200_000)), ("a/y.jpg", "a", jpeg(300, 20, 10))],
                                  "path string, category string, content binary")
    got = {r.path: r for r in images.image_rules(files).collect()}
    assert (got["a/x.jpg"].valid, got["a/x.jpg"].width, got["a/x.jpg"].height) == (True, 300, 200)
    assert got["a/y.jpg"].reason == "image too small: 300x20px"
    total = images.split_statistics(files).where("category = '__overall__'").first()
    assert (total.valid, total.invalid_size, total.invalid_corrupt) == (1, 1, 0)


@pytest.mark.parametrize("rating", ["NaN", "1e20", "inf", "-inf", "five", None])
def test_ratings_that_are_no_whole_number_are_skipped(spark, rating):
    raw = spark.createDataFrame([("u", "asin", 1, rating, "a perfectly good review", True)],
                                "user_id string, asin string, timestamp bigint, rating string, text string, verified_purchase boolean")
    assert reviews.review_records(raw).count() == 0
    assert reviews.validate_reviews(raw).first().reason.startswith("invalid rating")


def test_limits_beyond_the_page_are_refused(spark):
    rows = spark.createDataFrame([(1, "m", "pending")], "id int, module string, status string").withColumn("created_at", F.current_timestamp())
    for page, most in ((logs.review_queue_page, 200), (logs.drift_event_list, 500)):
        assert page(rows, limit=most).count() == 1
        for bad in (0, most + 1):
            with pytest.raises(ValueError):
                page(rows, limit=bad)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    scores = [((i * 7919) % 2001) / 1000 - 1 for i in range(400)]
    def mean(order, parts):
        df = spark.createDataFrame([(1, scores[i]) for i in order], "k int, s double").repartition(parts)
        return df.groupBy("k").agg(features.exact_mean(F.col("s")).alias("m")).first().m
    assert len({mean(o, n) for o, n in ((range(400), 1), (range(399, -1, -1), 7), (sorted(range(400), key=lambda i: i * 37 % 400), 3))}) == 1


def test_gauge_sample_of_a_minute_is_a_choice(spark):
    rows = [("s", f"2024-01-01 00:{m:02d}:{sec}", v) for m in range(10) for sec, v in (("10", 99.0), ("50", 1.0))]
    samples = spark.createDataFrame(rows, "series string, t string, value double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert monitors.gauge_over_limit(samples, ["series"], 50, 5).where("firing").count() == 1
    assert monitors.gauge_over_limit(samples, ["series"], 50, 5, per_minute="last").count() == 0


def test_classifier_weighs_classes_without_gathering_the_texts(spark, monkeypatch):
    seen = []
    from pyspark.ml import Pipeline
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d: (seen.append(d), fit(self, d))[1])
    train = spark.createDataFrame([(f"word{i % 5} common", ["negative", "neutral", "positive"][i % 3 if i % 4 else 0]) for i in range(60)], "text string, label string")
    sentiment_classifier(train, num_features=64)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    by = {r.label: r.w for r in seen[0].select("label", "w").distinct().collect()}
    n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    assert all(abs(by[k] - 60 / (3 * n[k])) < 1e-12 for k in n)


def test_exact_percentiles_equal_interpolated_order_statistics(spark):
    import numpy as np

    from storelens.operators import drift
    rng = np.random.default_rng(5)
    for values in (rng.lognormal(8, 3, 701).round(2), np.array([3.0]), np.repeat([1.0, 2.0], [5, 6])):
        f = spark.createDataFrame([(float(v),) for v in values], "monetary_value double")
        got = drift.reference_distribution(f, ["monetary_value"]).first()
        for q in (25, 50, 75, 95):
            assert got[f"p{q}"] == pytest.approx(np.percentile(values, q), rel=1e-12)


def test_no_bucket_of_the_prefix_sum_is_large(spark):
    from storelens.operators import drift, ranking
    seen = []
    f = spark.range(5000).select((F.pow("id", F.lit(2)) + 1000).alias("monetary_value"))
    original = ranking.exclusive_cumsum
    def spy(df, order, values, bucket, partition=None, prefix="cum_"):
        seen.append(df.withColumn("_b", bucket).groupBy("_b").count().agg(F.max("count")).first()[0])
        return original(df, order, values, bucket, partition, prefix)
    ranking.exclusive_cumsum = spy
    try:
        drift.cumulative_counts(drift.unpivot_features(f, ["monetary_value"])).count()
    finally:
        ranking.exclusive_cumsum = original
    assert seen[0] < 0.03 * 5000


def test_review_files_give_at_most_so_many_valid_rows(spark, tmp_path):
    import json

    from storelens.sources.files import scan_reviews_jsonl
    for name in ("a", "b"):
        rows = [{"user_id": f"u{i}", "asin": "x", "timestamp": i, "rating": 5 if i % 2 else "NaN", "text": f"a good enough review {i}"} for i in range(20)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert scan_reviews_jsonl(spark, str(tmp_path)).count() == 20
    got = scan_reviews_jsonl(spark, str(tmp_path), max_valid_per_file=3).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"a": 3, "b": 3}


def test_appending_sinks_are_repeatable(spark, tmp_path):
    from storelens.sources.files import append_perf_snapshot
    log = str(tmp_path / "log")
    rows = lambda ids: spark.createDataFrame([(i, f"r{i % 5}") for i in ids], "id int, request_id string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows([0, 1]).write.parquet(log)
    for _ in range(2):
        logs.append_new(rows([1, 2, 7]), log)
        assert sorted(r.id for r in spark.read.parquet(log).collect()) == [0, 1, 2]
    metrics = spark.createDataFrame([("p50", "1.5"), ("version", "v1")], "metric string, value string")
    for _ in range(2):
        append_perf_snapshot(metrics, "2024-01-29", str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).count() == 1
