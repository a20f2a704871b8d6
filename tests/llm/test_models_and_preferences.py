import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.llm import langid, preference, toxicity
from storelens.llm.queries import ORACLE, QUERIES

SF01 = "/root/testdata/sf0.01"


def subsequence_kernel(s, t, decay, p=3):
    """Over all pairs of equal subsequences of length p that cover at most MAX_SPAN characters."""
    from itertools import combinations
    def phi(x):
        out = {}
        for at in combinations(range(len(x)), p):
            if at[-1] - at[0] < toxicity.MAX_SPAN:
                k = tuple(toxicity._codes([x])[0][list(at)])
                out[k] = out.get(k, 0.0) + decay ** (at[-1] - at[0] + 1)
        return out
    a, b = phi(s), phi(t)
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_landmark_machine_equals_the_kernel_it_stands_for():
    words = ["idiot", "idi.ot", "scum", "table", "tabled", "house", "mouse", "idol", "xidiotx", "sc-um"]
    toxic = np.array([1, 1, 1, 0, 0, 0, 0, 0, 1, 1], dtype=bool)
    m = toxicity.train(words, toxic, np.ones(len(words)), landmarks=50)
    k = np.array([[subsequence_kernel(a, b, m.decay) for b in words] for a in words])
    # with every example a landmark, margins lie in the span of the kernel's rows
    margin = m.margins(words) - m.bias
    assert np.allclose(k @ np.linalg.lstsq(k, margin, rcond=None)[0], margin, atol=1e-4)
    assert (m.margins(words)[toxic] > 0).all() and (m.margins(words)[~toxic] < 0).all()
    assert m.margins(["i.d.i.o.t"])[0] > m.margins(["terrace"])[0]


def test_spans_put_single_characters_together():
    assert toxicity.spans("you i d i o t there") == ["you", "idiot", "there"]
    assert toxicity.pieces("(!)") == [] and toxicity.pieces("ab") == []
    assert len(toxicity.pieces("x" * 1000)) > 50


@pytest.mark.parametrize("text", ["i . d . i . o . t", "i. d. i. o. t", "i, d, i, o, t", "i* d* i* o* t*", "(i) (d) (i) (o) (t)",
                                  "i\nd\ni\no\nt", "id iot", "idi, ot", "i diot", "idio t", "id i ot", "id. iot"])
def test_gapped_and_split_words_reach_the_kernel(text):
    for whole in (text, f"we heard {text} yesterday", f"Stopping. {text}! Nothing"):
        assert "\x02idiot\x03" in {p for w in toxicity.spans(whole) for p in toxicity.pieces(w)}


def test_words_of_two_characters_beyond_ascii_are_scored():
    assert toxicity.pieces("바보") == ["\x02바보\x03"] and toxicity.pieces("笨蛋!") == ["\x02笨蛋\x03"]
    machine = toxicity.train([f"\x02{w}\x03" for w in ("바보", "笨蛋", "사과", "苹果")], np.array([True, True, False, False]), np.ones(4), landmarks=10)
    got = toxicity.Worst(machine).of(["바보!", "사과", None])
    assert got[0][1] == "바보" and got[0][0] > got[1][0] > toxicity.NO_SPAN == got[2][0]


def planted(spark, n=600):
    rng = np.random.default_rng(4)
    part = ["ka", "lo", "mi", "ren", "tas", "vor", "bel", "sun", "dri", "pol"]
    text = lambda: [" ".join("".join(rng.choice(part, 3)) for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(n):
        s = text()
        if i % 4 == 0:
            bad = rng.choice(["wuzzgrub", "snarfhex"])
            at = int(rng.integers(1, len(bad) - 1))
            s[1] += " " + (bad if i % 8 else bad[:at] + "." + bad[at:])
        rows.append((i, ". ".join(s), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)


def test_toxicity_held_out_with_inserted_characters(spark):
    docs = planted(spark)
    got = toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    test = got[got.held_out]
    assert len(got) == 600 and test.score.between(0, 1).all()
    assert test[test.toxic == 1].predicted.mean() > 0.9 and test[test.toxic == 0].predicted.mean() < 0.05
    assert set(got.predicted) <= {0, 1} and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    for docs in (odd_documents, no_documents):
        for known in (labels, labels.where("false")):
            rows = toxicity.toxicity(docs, known).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op6_language_mixture"](spark, SF01).toPandas()
    truth = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    test = truth[truth.held_out & truth.lang.notna()]
    assert len(got) == 1000 and (test.lang == test.lang_pred).mean() > 0.97


def test_mixture_proportions_of_a_text_in_two_languages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = langid.learn(docs.where("lang IS NOT NULL"))
    one = {r.lang: r.text for r in docs.where("length(text) > 3000").select("lang", "text").collect()}
    cut = {k: " ".join(v.split()[:200]) for k, v in one.items()}
    got = dict(langid.Mixture(model).languages([cut["de"] + " " + cut["fr"]])[0])
    assert set(list(got)[:2]) == {"de", "fr"} and all(0.25 < got[k] < 0.75 for k in ("de", "fr"))
    alone = langid.Mixture(model).languages([cut["es"]])[0]
    assert alone[0][0] == "es" and alone[0][1] > 0.9


def test_all_of_a_long_run_of_letters_is_counted_and_scored(spark):
    rng = np.random.default_rng(6)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    # learning: the second half's letters stand behind the 64th
    head = run("xyz", 64)
    docs = [("a", head + run("abc", 3000)), ("b", head + run("def", 3000)), ("c", "日本語" * 40 + run("カタナ", 3000))]
    model = langid.learn(spark.createDataFrame(docs, "lang string, text string"))
    for tail, lang in (("abc", "a"), ("def", "b"), ("カタナ", "c")):
        assert langid.Mixture(model).languages([run(tail, 40)])[0][0][0] == lang
        assert langid.Mixture(model).languages([head + run(tail, 5000)])[0][0][0] == lang
    # scoring: each language has its share of one run
    got = dict(langid.Mixture(model).languages([run("abc", 2000) + run("def", 3000)])[0])
    assert set(got) == {"a", "b"} and 0.35 < got["a"] < 0.45
    # pieces have the trigrams of the whole run, each once
    for n in (65, 128, 129, 5000):
        word = run("abcdefghij", n)
        pieces = langid._draws(word)
        cut, whole = langid._grams(list(langid._known(pieces).values())), langid._grams([f"  {word} "])
        assert all((a == b).all() for a, b in zip(cut[:2], whole[:2])) and len(pieces) == -(-n // 64)
    assert langid._draws("a" * 64) == ["a" * 64] and langid._draws(None) == []


def test_language_odd_rows(odd_documents, no_documents):
    for docs in (odd_documents, odd_documents.withColumn("lang", F.lit(None).cast("string")), no_documents):
        rows = langid.identify(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert 0 <= r.score <= 1 and r.held_out is not None
    blank = {r.doc_id: r.lang_pred for r in langid.identify(odd_documents).collect()}
    assert blank[4] == blank[5] == blank[6] == "und" and blank[7] != "und"


@pytest.mark.parametrize("rows", [
    [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no é🙂"), (1, 2, None, None)],
    [(2, 0, "user", "hi"), (3, 0, "user", "hi"), (5, 0, "user", "alone"), (None, 0, "user", "x"), (6, None, "user", "a"), (6, None, "user", "a"), (7, 1, "assistant", "")],
    [],
])
def test_preferences_equal_sql(spark, same_as_sql, rows):
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit("x"))
    same_as_sql(preference.by_neighbours(turns), preference.ORACLE, {"conversations": turns.toArrow()})


def test_preferences_whole_table(spark, same_as_sql):
    same_as_sql(QUERIES["op2_preference_format"](spark, SF01), ORACLE["op2_preference_format"], sf_dir=SF01)


def test_mask_covers_what_the_assistant_wrote(spark):
    turns = [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "é🙂")]
    a = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "pair_id bigint, turn int, role string, text string")
    row = preference.format_preferences(a, a.where("turn = 0")).first()
    assert [row.chosen[m.start : m.end] for m in row.chosen_mask] == ["good<|end|>\n", "é🙂<|end|>\n"] and row.rejected == ""
    assert row.prompt == "<|user|>\nq<|end|>\n" and row.n_common == 1
