import itertools
import random

from storelens.operators import drift as D


def statistic(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in [*a, *b])


def test_p_value_equals_enumeration():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4)):
        places = [statistic(c, [x for x in range(n + m) if x not in c]) for c in itertools.combinations(range(n + m), n)]
        for d in set(places):
            assert abs(D.lattice_pvalue(n, m, d) - sum(x >= d - 1e-12 for x in places) / len(places)) < 1e-12, (n, m, d)


def test_two_tables_equal_brute_force_with_ties(spark):
    rng = random.Random(9)
    a = [(f, float(rng.randrange(12)) if f == "ties" else rng.random()) for f in ("ties", "smooth") for _ in range(70)] + [("only_a", 1.0), ("ties", None)]
    b = [(f, float(rng.randrange(3, 15)) if f == "ties" else rng.random() ** 2) for f in ("ties", "smooth") for _ in range(55)] + [("only_b", 1.0)]
    same = [("same", 5.0)] * 9
    frame = lambda rows: spark.createDataFrame(rows, "feature string, value double").repartition(5)
    got = {r["feature"]: r for r in D.ks_two_sample(frame(a + same), frame(b + same)).collect()}
    assert set(got) == {"ties", "smooth", "same"}
    for f in ("ties", "smooth"):
        x, y = [v for g, v in a if g == f and v is not None], [v for g, v in b if g == f]
        d = statistic(x, y)
        assert (got[f]["n_a"], got[f]["n_b"]) == (70, 55) and abs(got[f]["ks_stat"] - d) < 1e-12
        assert abs(got[f]["ks_pvalue"] - D.lattice_pvalue(70, 55, d)) < 1e-12
    assert got["same"]["ks_stat"] == 0.0 and got["same"]["ks_pvalue"] == 1.0
    rough = {r["feature"]: r["ks_pvalue"] for r in D.ks_two_sample(frame(a), frame(b), exact_cells=0).collect()}
    assert abs(rough["smooth"] - got["smooth"]["ks_pvalue"]) < 0.1 and rough["ties"] < 0.2
