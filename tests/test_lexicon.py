import math
import random
import re
from collections import Counter

from storelens.operators import aspects as AS
from storelens.operators import lexicon as LX


def reviews(n=700, seed=3):
    """Reviews that speak of aspects in their own words; every label is for the whole review."""
    rng = random.Random(seed)
    say = {"Battery": ["battery", "charger", "accumulator"], "Price": ["price", "bargain", "billing"], "Shipping": ["shipping", "parcel", "courier"]}
    tone = {"positive": ["splendid", "lovely", "superb"], "negative": ["dreadful", "shoddy", "rotten"], "neutral": ["ordinary", "plain", "usual"]}
    filler = ["the", "this", "that", "with", "and", "was", "very", "box", "came", "today"]
    rows, terms = [], []
    for i in range(n):
        a, s = rng.choice(list(say)), rng.choice(list(tone))
        words = [rng.choice(filler) for _ in range(6)]
        text = f"{' '.join(words)}. The {rng.choice(say[a])} was {rng.choice(tone[s])} {rng.choice(tone[s])}! {' '.join(rng.sample(filler, 4))}"
        rows.append((f"r{i}", text, s))
        terms.append((f"r{i}", a.lower() if i % 2 else f"the {a.lower()} thing", s))
    return rows, terms


def brute(rows, labels):
    """The lexicon by plain counting."""
    parts = [(i, re.findall("[a-z]{3,}", c)) for i, t, _ in rows for c in re.split(LX.CLAUSE, t.lower())]
    words = {(i, w) for i, ws in parts for w in ws}
    n, n_w = len({i for i, ws in parts if ws}), Counter(w for _, w in words)
    n_c = Counter(c for _, c in labels)
    n_wc = Counter((w, c) for i, w in words for j, c in labels if i == j)
    weight = {(w, c): math.floor(1000 * math.log((k + 1) * n / ((n_w[w] + 2) * (n_c[c] + 1)))) for (w, c), k in n_wc.items() if n_w[w] >= LX.MIN_TEXTS}
    weight = {k: v for k, v in weight.items() if v > 0}
    times = Counter(tuple(sorted(p)) for _, ws in parts for p in zip(ws, ws[1:]) if p[0] != p[1])
    near = {}
    for (a, b), k in times.items():
        if k >= LX.MIN_PAIRS:
            near.setdefault(a, {})[b] = k
            near.setdefault(b, {})[a] = k
    for _ in range(LX.ROUNDS):
        keys = set(weight) | {(u, c) for u in near for v in near[u] for w, c in weight if w == v}
        new = {}
        for u, c in keys:
            total = sum(near.get(u, {}).values())
            own = weight.get((u, c), 0)
            new[u, c] = (7 * own * total + 3 * sum(k * weight.get((v, c), 0) for v, k in near[u].items())) // (10 * total) if total else own
        weight = {k: v for k, v in new.items() if v > 0}
    return {(w, c, v) for (w, c), v in weight.items() if v >= LX.MIN_WEIGHT}


def test_lexicon_equals_plain_counting(spark):
    rows, terms = reviews(60)
    labels = sorted({(i, next(a for a in AS.ASPECTS if a.lower() in t)) for i, t, _ in terms} | {(i, s) for i, _, s in rows})
    got = LX.induce(spark.createDataFrame(rows, "review_id string, text string, label string"), spark.createDataFrame(labels, "id string, class string"))
    assert {tuple(r) for r in got.select("word", "class", "weight").collect()} == brute(rows, labels)


def test_learned_words_find_aspects_in_other_texts(spark):
    rows, terms = reviews()
    labels = LX.labelled_aspects(spark.createDataFrame(terms, "sentence_id string, term string, polarity string"))
    labels = labels.unionByName(spark.createDataFrame([(i, s) for i, _, s in rows], "id string, class string")).checkpoint()
    lex = LX.induce(spark.createDataFrame(rows, "review_id string, text string, label string"), labels)
    top = {}
    for r in LX.best_words(lex, 3).collect():
        top.setdefault(r["class"], set()).add(r["word"])
    assert top["Battery"] == {"battery", "charger", "accumulator"} and top["negative"] == {"dreadful", "shoddy", "rotten"}
    filler = "this box came today. " * 3000
    texts = {"far": filler + "Accumulator superb and lovely", "two": "A bargain, splendid. But the parcel was rotten and shoddy", "none": "nothing known here",
             "empty": "", "null": None, "apart": "The courier came. Dreadful"}
    docs = spark.createDataFrame(list(texts.items()), "review_id string, text string")
    scores = LX.score_by_lexicon(docs, lex)
    got = {(r.review_id, r.aspect, r.sentiment) for r in AS.extract_aspects(scores).collect()}
    assert got >= {("far", "Battery", "Positive"), ("two", "Price", "Positive"), ("two", "Shipping", "Negative")}
    assert {r[0] for r in got} <= {"far", "two", "apart"} and ("apart", "Shipping", "Negative") not in got
    assert all(abs(r["s"] - 1) < 1e-9 for r in scores.groupBy("review_id", "aspect").agg({"score": "sum"}).toDF("r", "a", "s").collect())
    again = LX.score_by_lexicon(docs.repartition(5), lex)
    assert sorted(map(str, again.collect())) == sorted(map(str, scores.collect()))


def test_labelled_aspects_follow_the_match_rule(spark):
    t = [("1", "battery life", "positive"), ("1", "Battery", "negative"), ("2", "ship", "neutral"), ("3", "pr", "positive"), ("4", "price", "conflict"),
         ("5", None, "positive"), ("6", "support team", "positive"), ("7", "zebra", "positive")]
    got = LX.labelled_aspects(spark.createDataFrame(t, "sentence_id string, term string, polarity string")).collect()
    assert {tuple(r) for r in got} == {("1", "Battery"), ("2", "Shipping"), ("6", "Support")}
