import math
import random

from storelens.operators import drift as D
from storelens.operators import drift_state as DS

POINTS = [(0.0, "min"), (25.0, "p25"), (50.0, "p50"), (75.0, "p75"), (95.0, "p95"), (100.0, "max")]


def sample():
    """Smooth, repeated and constant reference values; current values on, between and outside the quantile points."""
    rng = random.Random(8)
    ref = {"smooth": [float(rng.randrange(1000)) for _ in range(400)], "steps": [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(300)], "flat": [3.0] * 50}
    cur = [(f"d{d}", f, v + shift) for d, shift in ((1, 0.0), (2, 40.0), (3, -7.0)) for f, vs in ref.items() for v in rng.sample(vs, 50)]
    cur += [("d1", "smooth", x) for x in (ref["smooth"][0], min(ref["smooth"]), max(ref["smooth"]), -5.0, 2000.0)] + [("d2", "smooth", None)]
    return ref, cur


def reference(spark, ref):
    wide = spark.createDataFrame([tuple(vs[i] if i < len(vs) else None for vs in ref.values()) for i in range(400)], ", ".join(f"{f} double" for f in ref))
    return D.reference_distribution(wide, list(ref))


def gaps(points, values):
    """The exact KS statistic against the curve through the points."""
    def curve(v, strict):
        if (v <= points[0][1]) if strict else (v < points[0][1]):
            return 0.0
        if (v > points[-1][1]) if strict else (v >= points[-1][1]):
            return 1.0
        below = [(q, x) for q, x in points if (x < v if strict else x <= v)]
        (q0, x0), (q1, x1) = below[-1], points[len(below)]
        return (q0 + (q1 - q0) * (v - x0) / (x1 - x0)) / 100
    n = len(values)
    return max(max(abs(sum(x <= v for x in values) / n - curve(v, False)), abs(sum(x < v for x in values) / n - curve(v, True))) for v in values)


def test_equals_the_direct_figures(spark):
    ref, cur = sample()
    r = reference(spark, ref).checkpoint()
    at = {x["feature"]: [(q, x[c]) for q, c in POINTS] for x in r.collect()}
    long = spark.createDataFrame(cur, "day string, feature string, value double")
    got = {(x["day"], x["feature"]): x for x in DS.drift_of(DS.histograms(long, r), r).collect()}
    assert len(got) == 9
    for day in ("d1", "d2", "d3"):
        want = {x["feature"]: x for x in D.psi_long(long.where(f"day = '{day}' AND value IS NOT NULL").drop("day"), r).collect()}
        for f in ref:
            x, values = got[day, f], [v for d, g, v in cur if d == day and g == f and v is not None]
            assert x["n"] == len(values)
            assert math.isclose(x["psi"], want[f]["psi"], abs_tol=1e-12) and math.isclose(x["out_of_range"], want[f]["out_of_range"], abs_tol=1e-12)
            exact = gaps(at[f], values)
            assert exact - 1 / DS.GRID - 1e-9 <= x["ks_stat"] <= exact + 1e-9 or f != "smooth"


def test_batches_merge_and_repeat(spark, tmp_path):
    ref, cur = sample()
    long = spark.createDataFrame(cur, "day string, feature string, value double")
    state = DS.DailyDrift(spark, str(tmp_path), reference(spark, ref))
    whole = sorted(map(str, DS.drift_of(DS.histograms(long, state.reference), state.reference).collect()))
    parts = [spark.createDataFrame(cur[i::3], long.schema) for i in range(3)]
    for epoch, part in enumerate(parts):
        assert state.add(part, epoch) == ["d1", "d2", "d3"]
    assert sorted(map(str, state.report().collect())) == whole
    state.add(parts[1], 1)  # the same batch once more
    assert sorted(map(str, state.report().collect())) == whole
    assert sorted(map(str, state.report(["d2"]).collect())) == [x for x in whole if "d2" in x]
    assert state.add(long.where("false"), 9) == [] and sorted(map(str, state.report().collect())) == whole
    # what a batch reads is the state's partitions of its days
    plan = state.report(["d2"])._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in x and "day#" in x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines())
