import numpy as np
from pyspark.sql import functions as F

from storelens.operators import ood as OD


def embeddings(spark, n=500, d=6):
    rng = np.random.default_rng(4)
    x = rng.normal(50, 3, (n, d)) @ rng.normal(0, 1, (d, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows + [(n, None), (n + 1, [1.0])], "vec_id bigint, embedding array<double>")


def test_reference_equals_numpy(spark):
    x, df = embeddings(spark)
    cov = np.cov(x, rowvar=False) + 1e-6 * np.eye(6)
    inv = np.linalg.inv(cov)
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0)))
    for parts in (1, 3, 40):  # 40 tasks: two levels of the tree
        ref = OD.ood_reference(df.repartition(parts))
        assert np.allclose(ref.mean, x.mean(0)) and np.allclose(ref.inv_cov, inv, rtol=1e-6)
        assert np.isclose(ref.threshold, np.quantile(np.concatenate([d, [0.0, 0.0]]), 0.99), rtol=1e-6)


def test_scores_and_baseline(spark):
    x, df = embeddings(spark)
    ref = OD.ood_reference(df)
    got = {r["vec_id"]: r for r in OD.ood_score(df, ref).collect()}
    assert got[500]["ood_score"] == got[501]["ood_score"] == 0.0 and not got[500]["ood_flagged"]
    far = spark.createDataFrame([(1, [1e6] * 6)], "vec_id bigint, embedding array<double>")
    assert OD.ood_score(far, ref).first()["ood_score"] == 2.0
    p = df.limit(1).select(F.lit(1).alias("id"), F.array(F.lit(0.1234), F.lit(0.8766)).alias("proba"), "embedding")
    r = OD.classify_products(p, ref, baseline_top1=0.91256).first()
    assert (r["baseline_top1"], r["baseline_delta"], r["low_confidence"]) == (0.913, "-0.036", False)
    r = OD.classify_products(p, ref).first()
    assert r["baseline_top1"] is None and r["baseline_delta"] is None
