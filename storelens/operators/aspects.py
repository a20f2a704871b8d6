"""Aspect-based sentiment (J6, L12, L13, M15) on long score tables.

The reference scores each (review, aspect, sentiment) with an NLI model; here
the scores arrive as a table, from ``score_aspects`` (keyword windows and a
polarity lexicon) or any other scorer, and the operators do what follows: pick
the best sentiment per aspect, keep confident ones, turn them into customer
features, and evaluate against labelled aspect terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions.scoring import aspect_label_score
from storelens.operators.metrics import classification_report

# Reference aspect list (in order), sentiments and threshold.
ASPECTS = ["Battery", "Display", "Shipping", "Build", "Price", "Support"]
SENTIMENTS = ["positive", "negative", "neutral"]
CONF_THRESHOLD = 0.70
RETENTION_FEATURE_MAP = {"Battery": "avg_battery_sentiment", "Shipping": "avg_shipping_sentiment",
                         "Price": "avg_price_sentiment"}
EVAL_LABELS = ["positive", "negative", "neutral"]

# Fixed values of the default scorer: each aspect's keywords, the polarity lexicon, words on either side of a keyword.
KEYWORDS = {
    "Battery": "battery batteries charge charges charging charger recharge recharging",
    "Display": "display displays screen screens resolution brightness pixel pixels",
    "Shipping": "shipping shipped shipment delivery delivered deliver delivers arrived arrive courier",
    "Build": "build built durability durable quality material materials construction sturdy flimsy",
    "Price": "price prices priced pricing value cost costs money cheap expensive overpriced affordable",
    "Support": "support service warranty helpdesk representative representatives agent agents",
}
POSITIVE = ("good great excellent amazing awesome fantastic perfect perfectly love loved loves best fast quick quickly happy nice "
            "reliable sturdy durable solid bright sharp clear crisp helpful friendly affordable fair worth recommend pleased "
            "impressive outstanding wonderful superb early responsive long-lasting")
NEGATIVE = ("bad poor poorly terrible awful horrible worst slow slowly late broken broke breaks fails failed failing dead dies died "
            "drain drains drained dim blurry cracked flimsy weak rude unhelpful useless expensive overpriced hate hated disappointing "
            "disappointed waste defective damaged delayed lost faulty unreliable")
NEGATION = "not no never neither nor hardly barely without cannot"
WINDOW = 5
NEGATION_REACH = 3


def score_aspects(docs: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """L12's default scorer: (review_id, aspect, sentiment, score) for each aspect that the whole text mentions.

    A mention is a keyword of the aspect. It votes by the polarity words that stand within ``WINDOW`` words of it
    in its clause: positive or negative as more of them are, else neutral; a negation up to ``NEGATION_REACH``
    words before turns a polarity word. Scores are the votes' shares with 1/4 vote added to each sentiment, so
    one mention alone scores 5/7 and is confident. Null and empty texts mention nothing.
    """
    def among(w, terms):
        return F.coalesce(w.isin(*terms.split()), F.lit(False))

    def negated(words, i):
        back = [F.get(words, i - F.lit(d)) for d in range(1, NEGATION_REACH + 1)]
        hit = [F.coalesce(among(w, NEGATION) | w.endswith("n't"), F.lit(False)) for w in back]
        out = hit[0]
        for h in hit[1:]:
            out = out | h
        return out

    def polarity(words, w, i):
        sign = F.when(among(w, POSITIVE), 1).when(among(w, NEGATIVE), -1).otherwise(0)
        return F.when(sign == 0, 0).when(negated(words, i), -sign).otherwise(sign)

    def clause(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit("([a-z]+(?:['-][a-z]+)*)"), F.lit(1))
        return F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), polarity(ws, w, i).alias("p"))))[0]

    def votes(terms: str):
        def of(ws):
            def vote(i):
                first = F.greatest(i - WINDOW, F.lit(0))
                return F.signum(F.aggregate(F.slice(ws, first + 1, i + WINDOW + 1 - first), F.lit(0), lambda s, x: s + x["p"])).cast("int")
            at = F.filter(F.transform(ws, lambda x, i: F.when(among(x["w"], terms), i)), lambda i: i.isNotNull())
            return F.transform(at, vote)
        return of

    text = F.translate(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "\u2019", "'")
    clauses = F.transform(F.split(text, r"[.!?;:\n\r]+|\bbut\b"), clause)
    d = docs.select(F.col(id_col).alias("review_id"), F.explode(F.array(clauses)).alias("_c"))  # worked out once for all aspects
    cells = F.array(*[F.struct(F.lit(a).alias("aspect"), F.flatten(F.transform("_c", votes(t))).alias("v"))
                      for a, t in KEYWORDS.items()])
    d = d.select("review_id", F.explode(cells).alias("_a")).where(F.size("_a.v") > 0)
    share = lambda x: (F.size(F.filter("_a.v", lambda v: v == x)) + 0.25) / (F.size("_a.v") + 0.75)
    each = F.array(*[F.struct(F.lit(s).alias("sentiment"), share(x).alias("score")) for s, x in zip(SENTIMENTS, (1, -1, 0))])
    return d.select("review_id", "_a.aspect", F.explode(each).alias("s")).select("review_id", "aspect", "s.*")


def extract_aspects(scores: DataFrame, threshold: float = CONF_THRESHOLD) -> DataFrame:
    """Per (review, aspect) the best sentiment (first in sentiment order on
    ties), kept when its score ≥ 0.70; score rounded to 4."""
    order = F.array_position(F.array(*[F.lit(s) for s in SENTIMENTS]), F.col("sentiment"))
    best = scores.groupBy("review_id", "aspect").agg(
        F.max_by(F.struct("sentiment", "score"), F.struct(F.col("score"), -order)).alias("_b"))
    kept = best.where(F.col("_b.score") >= threshold)
    cap = F.concat(F.upper(F.substring("_b.sentiment", 1, 1)), F.lower(F.substring("_b.sentiment", 2, 100)))
    return kept.select("review_id", "aspect", cap.alias("sentiment"), F.round("_b.score", 4).alias("score"))


def aspect_customer_features(aspects: DataFrame, key: str = "review_id") -> DataFrame:
    """Mean of +1/0/−1 for Battery, Shipping, Price per key; 0 when none."""
    s = aspect_label_score(F.col("sentiment"))
    return aspects.groupBy(key).agg(*[
        F.coalesce(F.avg(F.when(F.col("aspect") == a, s)), F.lit(0.0)).alias(f) for a, f in RETENTION_FEATURE_MAP.items()])


def aspect_term_match(terms: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each labelled term gets the sentiment of the first predicted aspect (in
    aspect order) whose lower-cased name contains the term or vice versa;
    default 'neutral'. Conflict / unknown polarities are dropped.

    Equi-join on the sentence id (≤ 6 predictions per sentence) with the
    ``contains`` test as a residual, then ``min_by`` on the aspect order.
    """
    t = terms.where(F.col("polarity").isin(*EVAL_LABELS)) \
             .withColumn("_term", F.lower(F.coalesce(F.col("term"), F.lit(""))))
    order = F.array_position(F.array(*[F.lit(a) for a in ASPECTS]), F.col("aspect"))
    p = predictions.select(F.col("review_id").alias("sentence_id"), F.lower("aspect").alias("_aspect"),
                           F.lower("sentiment").alias("_sent"), order.alias("_ord"))
    contains = (F.instr(F.col("_term"), F.col("_aspect")) > 0) | (F.instr(F.col("_aspect"), F.col("_term")) > 0)
    j = t.join(p, (t.sentence_id == p.sentence_id) & contains, "left")
    g = j.groupBy(t.sentence_id, "term_idx", "term", "polarity").agg(F.min_by("_sent", "_ord").alias("_m"))
    return g.select("sentence_id", "term_idx", "term", F.col("polarity").alias("true_label"),
                    F.coalesce(F.col("_m"), F.lit("neutral")).alias("pred_label"))


def aspect_eval(matched: DataFrame, terms: DataFrame) -> DataFrame:
    """Macro F1 over positive / negative / neutral (absent labels count as 0)."""
    idx = F.array_position(F.array(*[F.lit(x) for x in EVAL_LABELS]), F.col("true_label")) - 1
    pidx = F.array_position(F.array(*[F.lit(x) for x in EVAL_LABELS]), F.col("pred_label")) - 1
    rep = classification_report(matched.select(idx.alias("y_true"), pidx.alias("y_pred")))
    spark = matched.sparkSession
    labels = spark.range(len(EVAL_LABELS)).select(F.col("id").cast("int").alias("label"))
    full = labels.join(rep, "label", "left").select("label", F.coalesce("f1", F.lit(0.0)).alias("f1"))
    f = full.groupBy().agg(F.avg("f1").alias("macro_f1"), *[
        F.max(F.when(F.col("label") == i, F.col("f1"))).alias(f"{n}_f1") for i, n in enumerate(EVAL_LABELS)])
    counts = terms.agg(F.countDistinct(F.when(F.col("term").isNotNull(), F.col("sentence_id"))).alias("n_sentences"),
                       F.count_if(F.col("polarity").isin(*EVAL_LABELS)).alias("n_aspect_labels"))
    both = f.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.round(F.max(c), 4).alias(c) for c in ["macro_f1", *[f"{n}_f1" for n in EVAL_LABELS]]],
                    F.max("n_sentences").cast("bigint").alias("n_sentences"),
                    F.max("n_aspect_labels").cast("bigint").alias("n_aspect_labels"))
