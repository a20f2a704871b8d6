"""Product classification post-processing and out-of-distribution scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.operators.drift import cumulative_counts
from storelens.operators.metrics import class_name, topk_order

LOW_CONFIDENCE = 0.65  # fixed value: below → human review
OOD_CAP = 2.0
REG = 1e-6


class OodReference:
    """Mean vector, inverse covariance and the p99 distance threshold."""

    def __init__(self, mean: np.ndarray, inv_cov: np.ndarray, threshold: float):
        self.mean, self.inv_cov, self.threshold = mean, inv_cov, threshold


FAN_IN = 32
MOMENTS = "part int, n bigint, mean binary, scatter binary"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of width ``dim`` as rows, and where they stand."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    flat = column.filter(ok).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim), ok.to_numpy(zero_copy_only=False)


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and scatter (sum of outer products about the mean) of parts taken together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    scatter = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
    return n, mean, scatter


def _moments(dim: int):
    """One row a task: blocked Gram matrices of its batches, merged."""
    def run(batches):
        total = None
        for b in batches:
            x, _ = _matrix(b.column(0), dim)
            if len(x):
                d = x - x.mean(0)
                part = (len(x), x.mean(0), d.T @ d)
                total, at = _merge([total, part]) if total else part, b.column(1)[0].as_py()
        if total:
            n, mean, scatter = total
            yield pa.RecordBatch.from_pylist([{"part": at, "n": n, "mean": mean.tobytes(), "scatter": scatter.tobytes()}],
                                             pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())]))
    return run


def _merge_rows(dim: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("n").to_pylist()
        n, mean, scatter = _merge([(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(dim, dim)) for r in rows])
        return pa.Table.from_pylist([{"part": rows[0]["part"], "n": n, "mean": mean.tobytes(), "scatter": scatter.tobytes()}], table.schema)
    return run


def moments(emb: DataFrame, col: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n − 1) of the vectors; those of another width than the first are left out.

    Each task merges the Gram matrices of its Arrow batches; the tasks' d×d results are merged up a tree,
    ``FAN_IN`` at a time, and the last one reaches the driver.
    """
    some = emb.where(F.col(col).isNotNull()).select(F.size(col).alias("d")).first()
    if some is None:
        raise ValueError("no embedding to learn from")
    dim = some["d"]
    rows = emb.select(col, F.spark_partition_id().alias("part")).mapInArrow(_moments(dim), MOMENTS).checkpoint(eager=True)
    left = rows.count()
    while left > 1:
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        rows = rows.groupBy("part").applyInArrow(_merge_rows(dim), MOMENTS).checkpoint(eager=True)
        left = rows.count()
    r = rows.first()
    scatter = np.frombuffer(r["scatter"]).reshape(dim, dim)
    return r["n"], np.frombuffer(r["mean"]), scatter / max(1, r["n"] - 1)


def exact_percentile(values: DataFrame, col: str, q: float) -> float:
    """The linearly interpolated percentile from ranks among the distinct values; no buffer holds them all."""
    c = cumulative_counts(values.select(F.lit(col).alias("feature"), F.col(col).alias("value")))
    place = (F.col("n") - 1) * F.lit(q)
    at = lambda rank: F.max(F.when((F.col("cum_cnt") <= rank) & (rank < F.col("cum_cnt") + F.col("cnt")), F.col("value")))
    r = c.agg(at(F.floor(place)).alias("lo"), at(F.ceil(place)).alias("hi"), F.max(place - F.floor(place)).alias("f")).first()
    return float(r["lo"] + (r["hi"] - r["lo"]) * r["f"])


def ood_reference(emb: DataFrame, col: str = "embedding", percentile: float = 0.99) -> OodReference:
    """Mean, covariance (ddof 1) + 1e-6·I, inverse, p99 of training distances.

    Only the d×d result reaches the driver for the inverse (d = embedding width). Distances are scored in Spark.
    """
    _, mean, cov = moments(emb, col)
    ref = OodReference(mean, np.linalg.inv(cov + REG * np.eye(len(mean))), 1.0)
    d = emb.select(mahalanobis(ref)(F.col(col)).alias("d")).checkpoint(eager=True)
    return OodReference(ref.mean, ref.inv_cov, exact_percentile(d, "d", percentile))


def mahalanobis(ref: OodReference):
    """√(δᵀ Σ⁻¹ δ) over Arrow batches; wrong dimension → 0."""
    mean, inv = ref.mean, ref.inv_cov

    @F.arrow_udf(T.DoubleType())
    def distance(v: pa.Array) -> pa.Array:
        x, ok = _matrix(v, len(mean))
        out, d = np.zeros(len(v)), x - mean
        out[ok] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inv, d), 0.0))
        return pa.array(out)
    return distance


def ood_score(df: DataFrame, ref: OodReference, col: str = "embedding") -> DataFrame:
    """Distance / max(threshold, 1e-8), capped at 2, rounded 4; flagged if > 1."""
    s = F.least(mahalanobis(ref)(F.col(col)) / F.lit(max(ref.threshold, 1e-8)), F.lit(OOD_CAP))
    return df.withColumn("ood_score", F.round(s, 4)).withColumn("ood_flagged", F.col("ood_score") > 1.0)


def classify_products(pred: DataFrame, ref: OodReference, baseline_top1: float | None = None,
                      proba: str = "proba", col: str = "embedding") -> DataFrame:
    """Top-3 (class, confidence), OOD score, low-confidence flag, the baseline's top-1 accuracy (three
    decimals) and the confidence's signed difference from it (three decimals, as text)."""
    order = topk_order(F.col(proba))
    top3 = F.transform(F.slice(order, 1, 3), lambda i: F.struct(
        class_name(i).alias("category"), F.round(F.element_at(proba, i + 1), 4).alias("confidence")))
    out = ood_score(pred, ref, col).withColumn("top_3_predictions", top3)
    conf = F.col("top_3_predictions")[0]["confidence"]
    top1 = F.lit(baseline_top1).cast("double")
    delta = F.element_at(proba, F.element_at(order, 1) + 1) - top1
    return out.select("id", F.col("top_3_predictions")[0]["category"].alias("predicted_category"), conf.alias("confidence"),
                      "top_3_predictions", "ood_score", "ood_flagged", (conf < LOW_CONFIDENCE).alias("low_confidence"),
                      F.round(top1, 3).alias("baseline_top1"), F.when(delta.isNotNull(), F.format_string("%+.3f", delta)).alias("baseline_delta"))


def route_for_review(classified: DataFrame, module: str = "product") -> DataFrame:
    """Low confidence OR OOD → a review-queue row; low_confidence wins as trigger."""
    r = classified.where(F.col("low_confidence") | F.col("ood_flagged"))
    trig = F.when(F.col("low_confidence"), "low_confidence").otherwise("ood_flagged")
    return r.select(F.concat(F.lit("prod_"), F.col("id").cast("string")).alias("request_id"), F.lit(module).alias("module"),
                    trig.alias("trigger"),
                    F.to_json(F.struct("predicted_category", "confidence", "ood_score")).alias("payload"),
                    F.lit("pending").alias("status"))
