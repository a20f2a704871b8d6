import re

import pytest
from pyspark.sql import functions as F

from storelens.llm import pii, quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {j for p in at.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_statistics_equal_brute_force(spark, odd_documents):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(
        ["a b c a b c", "a a a a", "x|y <b> #\nx|y <b> #\n\n \n", "ab c a bc ab c", "é é 🙂 | 🙂"])], "doc_id bigint, text string")
    docs = odd_documents.select("doc_id", "text").unionByName(extra).unionByName(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    for r in Q.with_statistics(docs).collect():
        s = r["__stats"]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_statistics(r.text), r.doc_id


def test_rules_find_junk_and_keep_clean_documents(spark):
    got = Q.verdicts(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))).toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(got, on="doc_id")
    assert len(got) == 1000 and not (got.base_failed & got.kept).any()
    passed = labels[~labels.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.98
    assert passed[passed.quality == 0].kept.mean() < 0.5


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 0), (999, 0)], "doc_id bigint, quality int")
    assert Q.judge(odd_documents, labels).count() == odd_documents.count()
    kept = Q.keep_good(odd_documents, labels.where("false"))
    n = {r.doc_id: brute_statistics(r.text) for r in odd_documents.collect()}
    assert kept.columns == odd_documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in n.items() if s[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert Q.keep_good(no_documents, labels).count() == 0


def test_native_operators_run_no_python(spark, odd_documents):
    plan = Q.with_statistics(odd_documents)._jdf.queryExecution().executedPlan().toString() + pii.find(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(text):
    out = []
    for nth, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 10 <= len(d) <= 15):
                out.append((m.start(), nth, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def tricky(spark):
    import random
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f x@y.z", "a@b@c.d .a@b.c..d", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 é 4111-1111-1111-1111",
             "+1 (375) 555-4393 x +12 3 +1----------2345678901", "é🙂 a@b.co 🙂 +44 20 7946 0958.", None, "", "1" * 30_000, "1 " * 30_000,
             "a" * 50_000 + "@", "+" + "1" * 50_000, "1." * 20_000, "@" * 1000, "a@b.c" * 300]
    texts += ["".join(rng.choice("ab@.+-_ 0123456789()é\n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["".join(rng.choice(["a@", "b.c", "+1 ", "234", "567-", "8901", "4111 1111", ".", "@", " ", "1.2", "255."]) for _ in range(12)) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)


def test_base_spans_equal_brute_force(tricky):
    texts = {r.doc_id: r.text for r in tricky.collect()}
    for r in pii.find(tricky).collect():
        assert [tuple(x) for x in r.base] == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_spans_keep_the_base_and_never_overlap_it(tricky, odd_documents, no_documents):
    for docs in (tricky, odd_documents, no_documents):
        rows = pii.detect(docs.select("doc_id", "text"), trees=3).collect()
        assert len(rows) == docs.count()
        for r in rows:
            for a in r.added:
                assert all(a.end <= b.start or b.end <= a.start for b in r.base)
                assert sum(a.start < x.end and x.start < a.end for x in r.added) == 1


def test_boosting_adds_spans_of_the_same_format(spark):
    numbers = [f"call me on {'+' if i % 10 else ''}1 (555) {100 + i % 800}-{1000 + i} please" for i in range(900)]
    clean = [f"the year {1900 + i % 120} and {i} of {i + 7} items in room {i % 50}-{i % 9}-{i % 7}-{i}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(numbers + clean)), "doc_id bigint, text string").repartition(4)
    got = pii.detect(docs, precision=0.8).toPandas()
    added = got.added.map(len)
    assert added[(got.doc_id < 900) & (got.doc_id % 10 == 0)].mean() > 0.9
    assert added[got.doc_id >= 900].sum() == 0


def test_trees_and_thresholds_see_every_candidate(spark, monkeypatch):
    text = F.concat(F.when(F.col("id") % 2 == 0, F.lit("call +1 (555) ")).otherwise(F.lit("no 1 (555) ")), (F.col("id") % 800 + 100).cast("string"), F.lit("-4567 x"))
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(4)
    learned, judged = [], []

    class Watched(pii.GBTClassifier):
        def fit(self, rows):
            learned.append(rows.count())
            model = super().fit(rows)
            transform = model.transform
            model.transform = lambda df: judged.append(df.count()) or transform(df)
            return model

    monkeypatch.setattr(pii, "GBTClassifier", Watched)
    pii.detect(docs, precision=0.5, trees=1, depth=1)
    folds = {r["fold"]: r["n"] for r in pii.candidates(pii.find(docs)).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(folds.values()) == 45_000
    assert learned == [folds[1] + folds[2]] and judged[0] == folds[0]
