"""T9 as mergeable state: one histogram per (day, feature), never the log again.

A value's cell is its place on the reference's quantile curve, in ``GRID`` equal steps of rank (−1 and ``GRID``: below
and above all reference values). The quantile points of the PSI buckets are borders of cells, so PSI is exact; the KS
statistic is the largest gap at a border, at most 1 / ``GRID`` below the exact one. Histograms of any rows add
up, so a batch only writes its own, under its number; a batch that is repeated replaces what it wrote. A day's
figures are sums over the batches that touched it, read by the days' partitions alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.operators.drift import KS_REFERENCE_DRAWS, PSI_FLOOR, PSI_THRESHOLD, QUANTILE_POINTS, kolmogorov_pvalue

GRID = 200
STATE = "day string, feature string, cell int, n bigint, epoch bigint"
POINTS = ["min", "p25", "p50", "p75", "p95", "max"]


def _cell(v: Column) -> Column:
    vals, qs = F.array(*POINTS), F.array(*[F.lit(p) for p in QUANTILE_POINTS])
    i = F.size(F.filter(vals, lambda x: x <= v))
    x0, x1, q0, q1 = F.get(vals, i - 1), F.get(vals, i), F.get(qs, i - 1), F.get(qs, i)
    rank = (q0 + (q1 - q0) * (v - x0) / (x1 - x0)) / 100.0
    inner = F.least(F.floor(rank * GRID), F.lit(GRID - 1)).cast("int")
    return F.when(v < F.col("min"), -1).when(v > F.col("max"), GRID).when(v == F.col("max"), GRID - 1).otherwise(inner)


def histograms(long: DataFrame, reference: DataFrame) -> DataFrame:
    """(day, feature, cell, n) of (day, feature, value) rows; ``reference``: a row a feature (``reference_distribution``)."""
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(reference.select("feature", *POINTS)), "feature")  # a row a feature
    return j.select("day", "feature", _cell(F.col("value")).alias("cell")).groupBy("day", "feature", "cell").agg(F.count(F.lit(1)).alias("n"))


def drift_of(hist: DataFrame, reference: DataFrame, m: int = KS_REFERENCE_DRAWS, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """(day, feature, n, psi, out_of_range, ks_stat, ks_pvalue, drift_detected) of summed histograms."""
    keys = ["day", "feature"]
    h = hist.groupBy(*keys, "cell").agg(F.sum("n").cast("bigint").alias("n"))  # at most GRID + 2 rows a key
    up = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.greatest(F.col("cell"), F.lit(0)) / F.lit(float(GRID)), F.least(F.col("cell") + 1, F.lit(GRID)) / F.lit(float(GRID))
    gap = F.greatest(F.abs((F.col("upto") - F.col("n")) / F.col("all") - low), F.abs(F.col("upto") / F.col("all") - high))
    vals, qs = F.array(*POINTS), F.array(*[F.lit(p) for p in QUANTILE_POINTS])
    first = F.filter(F.transform(vals, lambda x, i: F.when((i == 0) | (x != F.get(vals, i - 1)), F.get(qs, i))), lambda q: q.isNotNull())
    ranks = reference.select("feature", first.alias("ranks"))
    inside = F.col("cell").between(0, GRID - 1)
    parts = [F.struct(F.sum(F.when(inside & (F.col("cell") >= lo) & (F.col("cell") < hi), F.col("n")).otherwise(0)).alias("c"), F.lit(lo).alias("lo"))
             for lo, hi in zip(_borders(), _borders()[1:])]
    a = h.groupBy(*keys).agg(F.max("all").alias("n"), F.max(gap).alias("ks_stat"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("tot"),
                             F.array(*parts).alias("parts")).join(F.broadcast(ranks), "feature")
    # a bucket runs from one distinct quantile point to the next: it takes in the steps between repeated ones; the last is closed

    def term(i: Column) -> Column:
        lo, hi = F.get("ranks", i), F.get("ranks", i + 1)
        taken = F.filter("parts", lambda p: (p["lo"] >= lo * (GRID / 100.0)) & ((p["lo"] < hi * (GRID / 100.0)) | (i == F.size("ranks") - 2)))
        count = F.aggregate(taken, F.lit(0).cast("bigint"), lambda s, p: s + p["c"])
        c = F.greatest(count / F.greatest(F.col("tot"), F.lit(1)), F.lit(PSI_FLOOR))
        r = F.greatest((hi - lo) / 100.0, F.lit(PSI_FLOOR))
        return (c - r) * F.log(c / r)

    buckets = F.sequence(F.lit(0), F.size("ranks") - 2)
    psi = F.when(F.size("ranks") < 2, F.lit(0.0)).otherwise(F.aggregate(F.transform(buckets, term), F.lit(0.0), lambda s, x: s + x))
    neff = F.col("n") * F.lit(float(m)) / (F.col("n") + F.lit(float(m)))
    out = a.withColumn("psi", psi).withColumn("ks_pvalue", kolmogorov_pvalue(F.sqrt(neff) * F.col("ks_stat")))
    return out.select("day", "feature", "n", "psi", F.when(F.size("ranks") < 2, F.lit(1.0)).otherwise((F.col("n") - F.col("tot")) / F.col("n")).alias("out_of_range"), "ks_stat", "ks_pvalue",
                      (F.col("psi") > threshold).alias("drift_detected"))


def _borders() -> list[int]:
    return [round(q * GRID / 100) for q in QUANTILE_POINTS]


class DailyDrift:
    """The state table under ``path`` and the reference's quantiles; batches add to it and are reported by day."""

    def __init__(self, spark: SparkSession, path: str, reference: DataFrame):
        self.spark, self.path = spark, path
        reference.select("feature", *POINTS).write.mode("overwrite").parquet(f"{path}/reference")
        self.reference = spark.read.parquet(f"{path}/reference")

    def add(self, long: DataFrame, epoch: int) -> list[str]:
        """Take in (day, feature, value) rows of batch ``epoch``; the days it touched (a row a day)."""
        at = f"{self.path}/state/epoch={epoch}"
        histograms(long, self.reference).repartition("day").write.mode("overwrite").partitionBy("day").parquet(at)
        try:
            return sorted(r["day"] for r in self.spark.read.schema("feature string, cell int, n bigint, day string").parquet(at).select("day").distinct().collect())
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []

    def report(self, days: list[str] | None = None) -> DataFrame:
        """The figures of the given days, or of all, from the state alone."""
        state = self.spark.read.schema(STATE).parquet(f"{self.path}/state")
        return drift_of(state if days is None else state.where(F.col("day").isin(days)), self.reference)


# ---------------------------------------------------------------------------- the same in SQL, for checks


def drift_sql(long: str, ref: str) -> str:
    """CTE ``drift`` over ``long`` (day, feature, value) and ``ref`` (feature, min, p25, ..., max)."""
    i = "len(list_filter(vals, lambda x: x <= value))"
    rank = f"((qs[{i}] + (qs[{i} + 1] - qs[{i}]) * (value - vals[{i}]) / (vals[{i} + 1] - vals[{i}])) / 100.0)"
    step = GRID / 100.0
    return f"""points AS (SELECT feature, [min, p25, p50, p75, p95, max] AS vals, {[float(q) for q in QUANTILE_POINTS]} AS qs FROM {ref}),
ranks AS (SELECT feature, list_transform(list_filter(range(1, 7), lambda i: i = 1 OR vals[i] <> vals[greatest(i - 1, 1)]), lambda i: qs[i]) AS ranks FROM points),
celled AS (SELECT day, feature, CAST(CASE WHEN value < vals[1] THEN -1 WHEN value > vals[6] THEN {GRID} WHEN value = vals[6] THEN {GRID - 1}
   ELSE least(floor({rank} * {GRID}), {GRID - 1}) END AS INTEGER) AS cell FROM {long} JOIN points USING (feature) WHERE value IS NOT NULL),
h AS (SELECT day, feature, cell, count(*) AS n FROM celled GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY day, feature ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY day, feature) AS total FROM h),
ks AS (SELECT day, feature, CAST(max(total) AS BIGINT) AS n, sum(CASE WHEN cell BETWEEN 0 AND {GRID - 1} THEN n ELSE 0 END) AS tot,
   max(greatest(abs((upto - n) / total - greatest(cell, 0) / {float(GRID)}), abs(upto / total - least(cell + 1, {GRID}) / {float(GRID)}))) AS ks_stat FROM cum GROUP BY ALL),
buckets AS (SELECT feature, ranks[b] AS lo, ranks[b + 1] AS hi, b = len(ranks) - 1 AS last FROM (SELECT feature, ranks, unnest(range(1, len(ranks))) AS b FROM ranks)),
terms AS (SELECT k.day, k.feature, greatest(coalesce((SELECT sum(h.n) FROM h WHERE h.day = k.day AND h.feature = k.feature AND h.cell BETWEEN 0 AND {GRID - 1}
     AND h.cell >= b.lo * {step} AND (h.cell < b.hi * {step} OR b.last)), 0) / greatest(k.tot, 1), {PSI_FLOOR}) AS c, greatest((b.hi - b.lo) / 100.0, {PSI_FLOOR}) AS r
   FROM ks k JOIN buckets b USING (feature)),
lam AS (SELECT *, sqrt(n * {float(KS_REFERENCE_DRAWS)} / (n + {float(KS_REFERENCE_DRAWS)})) * ks_stat AS l FROM ks),
drift AS (SELECT k.day, k.feature, k.n, coalesce(p.psi, 0.0) AS psi, CASE WHEN len(ranks) < 2 THEN 1.0 ELSE (k.n - k.tot) / k.n END AS out_of_range, k.ks_stat,
   CASE WHEN l <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: power(-1, j - 1) * exp(-2.0 * j * j * l * l))))) END AS ks_pvalue
   FROM lam k JOIN ranks USING (feature) LEFT JOIN (SELECT day, feature, sum((c - r) * ln(c / r)) AS psi FROM terms GROUP BY 1, 2) p USING (day, feature))"""
