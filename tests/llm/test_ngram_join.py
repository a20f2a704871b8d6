import random
from fractions import Fraction

import numpy as np
import pytest

from storelens.llm import ngram_join as N
from storelens.llm.components import components


def brute_force(rows, width, threshold):
    """Smallest reachable id per row, by holding every pair of texts against each other."""
    t = Fraction(str(threshold))
    def words(s):
        s = "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
        for c in "\t\n\x0b\x0c\r":
            s = s.replace(c, " ")
        return [w for w in s.split(" ") if w]
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and t.denominator * len(a & b) >= t.numerator * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups=12, size=14):
    """Families of copies with a few words changed, around the threshold, and a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("width, threshold", [(3, 0.9), (5, 0.8)])
def test_equals_brute_force(spark, width, threshold):
    rows = near_copies(width)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = N.near_components(docs, width=width, threshold=threshold).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, width, threshold))


def test_tiles_and_frequent_shingles_do_not_change_links(spark, monkeypatch):
    rows = near_copies(9, groups=3, size=40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(brute_force(rows, 3, 0.9))
    monkeypatch.setattr(N, "TILE", 8)
    whole = N.frequent_shingles
    monkeypatch.setattr(N, "frequent_shingles", lambda d, w: whole(d, w, one_in=1, least=20))
    assert sorted(map(tuple, N.near_components(docs).collect())) == want


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = N.near_components(odd_documents).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_force(rows, 3, 0.9), key=key)
    assert N.near_components(no_documents).count() == 0
    stay = N.one_of_each(odd_documents)
    assert stay.columns == odd_documents.columns
    assert {r.doc_id for r in stay.collect()} == {r[0] for r in brute_force(rows, 3, 0.9) if r[0] == r[2]}


def test_one_of_each_goes_by_row(spark):
    long = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [
        (1, long("a"), "x"), (None, long("a") + " more", "x"),  # a near copy without an id ...
        (None, long("b"), "x"), (None, "", "x"), (None, None, "x"),  # ... takes no other row without an id with it
        (2, long("c"), "x"), (3, long("c") + " more", "x"), (3, long("d"), "x"),  # nor one of the same id
        (None, long("e"), "x"), (None, long("e") + " more", "x"),  # near copies without an id
        (4, long("f"), "x"), (4, long("f") + " more", "x"), (5, long("f") + " and", "x"),  # that share the smallest id
        (6, long("g"), "x"), (6, long("g"), "y"), (7, "", "x"), (7, "", "x"),  # that share id and text
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    stay = N.one_of_each(docs)
    assert stay.columns == docs.columns
    got = stay.collect()
    assert sorted((r.text or "").split(" ")[0][:1] for r in got) == ["", "", "", "", "a", "b", "c", "d", "e", "f", "g"]
    assert {(r.doc_id, r.text[0]) for r in got if r.text} == {(1, "a"), (None, "b"), (2, "c"), (3, "d"), (None, "e"), (4, "f"), (6, "g")}


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(9, 10)])
def test_linked_sets_share_a_signature(t):
    rng, bands = np.random.default_rng(3), N.Bands(t)
    for _ in range(1500):
        a = int(rng.integers(2, 400))
        b = int(rng.integers(a, int(a / t) + 1))
        least = -(-t.numerator * (a + b) // (t.numerator + t.denominator))
        common = int(rng.integers(min(least, a), a + 1))
        if t.denominator * common < t.numerator * (a + b - common):
            continue
        pool = np.unique(rng.integers(0, 2**63, a + b + 50, dtype=np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:common], pool[a : a + b - common]]))
        if np.array_equal(x, y):
            continue
        frequent = np.sort(pool[: int(rng.integers(0, 3))])
        assert np.intersect1d(N.signatures(x, frequent, bands), N.signatures(y, frequent, bands)).size
        apart = int(np.bitwise_count(N.sketch(x, 4) ^ N.sketch(y, 4)).sum())
        assert apart <= a + b - 2 * common


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 530)] + [(7, 7), (-3, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(500, 530)) and got[9] == got[-3] == -3


def test_a_few_shared_shingles_make_no_candidates():
    """Unrelated sets that share single shingles by chance; once nearly all were one group, whose pairs grow with its square."""
    rng, bands, none = np.random.default_rng(8), N.Bands(Fraction(4, 5)), np.empty(0, dtype=np.uint64)
    phrases = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 400, dtype=np.uint64), rng.choice(phrases, 40)])) for _ in range(300)]
    forest, first = N.Forest(), {}
    for i, s in enumerate(sets):
        for h in N.signatures(s, none, bands).tolist():
            forest.join(first.setdefault(h, i), i)
    roots = [forest.root(i) for i in range(len(sets))]
    assert max(map(roots.count, set(roots))) < 15


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(9, 10)])
def test_sets_of_frequent_shingles_share_a_signature(t):
    """Linked sets of which all, or all but a few, shingles are frequent."""
    rng, bands = np.random.default_rng(4), N.Bands(t)
    for _ in range(600):
        a = int(rng.integers(4, 300))
        common = int(rng.integers(-(-t.numerator * a // t.denominator), a + 1))
        pool = np.unique(rng.integers(0, 2**63, 2 * a + 50, dtype=np.uint64))
        rng.shuffle(pool)
        x, y = np.sort(pool[:a]), np.sort(pool[a - common : 2 * a - common][: int(common / t)])
        shared = len(np.intersect1d(x, y))
        if np.array_equal(x, y) or t.denominator * shared < t.numerator * (len(x) + len(y) - shared):
            continue
        whole = rng.permutation(pool[: 2 * a])
        for keep in (0, 1, len(whole) // 20, len(whole) // 4, len(whole) // 2):
            frequent = np.sort(whole[keep:])
            assert np.intersect1d(N.signatures(x, frequent, bands), N.signatures(y, frequent, bands)).size
