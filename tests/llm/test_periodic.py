import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import periodic


def brute_runs(w, least=6, exponent=4):
    """Every maximal stretch, period by period, whose smallest period it is."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(least, exponent * q):
                part = w[start:start + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(5)
    out = ["", None, " \t\n", "a", "a " * 4, "a " * 5, "a " * 6, "a b " * 4 + "a", "x a b c a b c a b c a b d"]
    for letters in (1, 2, 3, 4):
        out += [" ".join(rng.choice("abcd"[:letters]) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    for _ in range(120):  # nested and neighbouring runs
        w = []
        while len(w) < rng.randrange(20, 300):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
            if rng.random() < 0.3:
                unit = unit + unit[:1] * rng.randrange(4, 9)
            w += (unit * rng.randrange(1, 8))[: rng.randrange(1, 80)]
        out.append(" ".join(w))
    return out


def test_runs_equal_brute_force():
    texts = samples()
    runs, kept = periodic.text_runs(texts)
    for text, got, left in zip(texts, runs, kept):
        w = (text or "").split()
        want = brute_runs(w)
        assert [(r["start"], r["length"], r["period"]) for r in got] == want, text
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert left == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_results_do_not_depend_on_the_batch():
    texts = samples()[:80]
    together = periodic.text_runs(texts)
    assert [periodic.text_runs([t])[0][0] for t in texts] == together[0]


def test_long_text_is_linear_enough():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 50_000, 400_000)]
    words[1000:1000 + 9000] = words[1000:1003] * 3000
    words[200_000:360_000] = words[200_000:240_000] * 4
    runs, _ = periodic.text_runs([" ".join(words)])
    assert {(r["start"], r["period"]) for r in runs[0]} >= {(1000, 3), (200_000, 40_000)}


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_equals_brute_force(spark, odd_documents):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", " c", "Ω"]) for _ in range(rng.randrange(0, 60))), "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, *[tuple(r)[:2] + ("x",) for r in odd_documents.collect() if len(r[1] or "") < 1000]],
                                 "doc_id bigint, text string, runs string").repartition(3)
    got = [tuple(r) for r in periodic.report(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                                          "runs_sha256", "collapsed_sha256").collect()]
    key = lambda r: (str(r[0]), str(r))
    assert sorted(got, key=key) == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_tables(spark, odd_documents, no_documents):
    assert periodic.report(no_documents).count() == 0
    assert periodic.report(odd_documents).count() == odd_documents.count()
    clash = odd_documents.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(2))
    out = periodic.add_runs(clash)
    assert sorted(out.columns) == sorted(clash.columns) and out.where("text is null").select("collapsed").distinct().first()[0] == ""


@pytest.mark.parametrize("n", [3, 7, 64, 65, 200])
def test_every_period_is_found(n):
    unit = [f"w{i}" for i in range(n)]
    runs, _ = periodic.text_runs([" ".join(["x", *unit * 4, "y"])])
    assert [tuple(r.values()) for r in runs[0]] == [(1, 4 * n, n)]
