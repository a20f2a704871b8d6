"""Aspect XML scan and aspect-sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.text import clean_review_text, rating_label
from storelens.operators import aspects as AS
from storelens.operators import lexicon as LX
from storelens.plans import oracle as O
from storelens.plans.q_reviews import RAW, clean_sql, label_sql
from storelens.plans.registry import register
from storelens.session import scratch_path, spread
from storelens.sources import files as FL
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables

# How labelled terms are derived from the documents (test adapter).
TERM_WORDS = ["battery life", "display", "shipping", "price", "support team"]
POLARITIES = ["positive", "negative", "neutral", "conflict"]


def _sentences(spark, sf):
    d = spread(Tables(spark, sf).documents)
    from storelens.functions.text import once
    txt = once(clean_review_text(F.col("text")))
    return d.select(F.col("doc_id").cast("string").alias("sentence_id"), F.col("doc_id"), txt.alias("text"))


def _terms(s):
    k = F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))).alias("k")
    d = s.where(F.col("doc_id") % 10 != 0).select("sentence_id", "doc_id", "text", k)
    first = F.element_at(F.split(F.col("text"), " "), 1)
    words = F.array(*[F.lit(w) for w in TERM_WORDS], first)
    pol = F.array(*[F.lit(p) for p in POLARITIES])
    return d.select("sentence_id", "text", F.col("k").alias("term_idx"),
                    F.element_at(words, ((F.col("doc_id") + F.col("k")) % 6 + 1).cast("int")).alias("term"),
                    F.element_at(pol, ((F.col("doc_id") * 7 + F.col("k")) % 4 + 1).cast("int")).alias("polarity"))


def _esc(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_aspect_xml(spark, sf) -> str:
    """Derive SemEval-style XML (one <sentence> per line) from the documents."""
    s = _sentences(spark, sf)
    t = _terms(s)
    tags = t.groupBy("sentence_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(
        "term_idx", F.concat(F.lit('<aspectTerm term="'), _esc(F.col("term")), F.lit('" polarity="'),
                             F.col("polarity"), F.lit('"/>')).alias("x")))).getField("x"), "").alias("terms"))
    j = s.join(tags, "sentence_id", "left")
    line = F.concat(F.lit('<sentence id="'), F.col("sentence_id"), F.lit('"><text>'), _esc(F.col("text")), F.lit("</text>"),
                    F.when(F.col("terms").isNotNull(), F.concat(F.lit("<aspectTerms>"), F.col("terms"), F.lit("</aspectTerms>")))
                     .otherwise(F.lit("")), F.lit("</sentence>"))
    path = scratch_path(spark, "aspects_xml")
    FL.write_xml_lines(j.select(line.alias("value")), path, "sentences")
    return path


SENT_SQL = f"""sent AS (SELECT CAST(doc_id AS VARCHAR) AS sentence_id, doc_id, {clean_sql('text')} AS text FROM documents),
terms AS (SELECT sentence_id, text, CAST(k AS INTEGER) AS term_idx,
    [{', '.join(repr(w) for w in TERM_WORDS)}, split_part(text, ' ', 1)][CAST((doc_id + k) % 6 AS INTEGER) + 1] AS term,
    [{', '.join(repr(p) for p in POLARITIES)}][CAST((doc_id * 7 + k) % 4 AS INTEGER) + 1] AS polarity
  FROM (SELECT *, unnest(range(0, CAST(doc_id % 3 AS INTEGER) + 1)) AS k FROM sent WHERE doc_id % 10 <> 0))"""


@register("scan_aspect_xml", O.with_(SENT_SQL) + """SELECT s.sentence_id, s.text, t.term, t.polarity FROM sent s
  LEFT JOIN terms t USING (sentence_id)""")
def q_scan_xml(spark, sf):
    """Derived XML read back with the built-in XML source"""
    return FL.scan_aspect_xml(spark, write_aspect_xml(spark, sf))


def _labels(spark, sf, terms):
    """Classes of the labelled texts: aspects of their labelled terms (S6), sentiment of their rating."""
    r = FX.reviews_raw(Tables(spark, sf))
    rating = F.col("rating").try_cast("double").cast("int")
    rated = r.where(rating.between(1, 5)).select(F.col("doc_id").cast("string").alias("id"), rating_label(rating).alias("class"))
    return LX.labelled_aspects(terms).unionByName(rated)


def _scored(spark, sf):
    """The labelled terms, and per (sentence, aspect, sentiment) scores by the lexicon learned from the labelled texts."""
    s = _sentences(spark, sf).checkpoint(eager=True)
    terms, parts = _terms(s), LX.clauses(s, "sentence_id").checkpoint(eager=True)
    return terms, LX.score_clauses(parts, LX.induce_from(parts, _labels(spark, sf, terms)))


def _scores(spark, sf):
    return _scored(spark, sf)[1]


_CLASS = "CASE " + " ".join(
    f"WHEN instr(lower(term), '{a.lower()}') > 0 OR (length(term) >= 3 AND instr('{a.lower()}', lower(term)) > 0) THEN '{a}'" for a in AS.ASPECTS) + " END"
SCORES_SQL = RAW + ",\n" + SENT_SQL + f""",
texts AS (SELECT sentence_id AS id, text FROM sent),
labels AS (SELECT DISTINCT id, class FROM (SELECT sentence_id AS id, {_CLASS} AS class FROM terms WHERE polarity IN ('positive', 'negative', 'neutral'))
           WHERE class IS NOT NULL UNION ALL SELECT user_id, {label_sql('rating')} FROM raw WHERE rating BETWEEN 1 AND 5),
""" + LX.lexicon_sql("texts", "labels") + ",\n" + LX.scores_sql("texts")

EXTRACT_SQL = SCORES_SQL + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY review_id, aspect ORDER BY score DESC,
             CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN 2 ELSE 3 END) AS rn FROM scores),
extracted AS (SELECT review_id, aspect, upper(substr(sentiment, 1, 1)) || lower(substr(sentiment, 2)) AS sentiment, round(score, 4) AS score
              FROM ranked WHERE rn = 1 AND score >= 0.7)"""


@register("extract_aspects", O.with_(EXTRACT_SQL) + "SELECT * FROM extracted", ["score"])
def q_extract(spark, sf):
    """Confident best sentiment per (sentence, aspect)"""
    return AS.extract_aspects(_scores(spark, sf))


@register("aspect_customer_features", O.with_(EXTRACT_SQL) + """SELECT review_id,
  coalesce(avg(CASE WHEN aspect = 'Battery' THEN CASE sentiment WHEN 'Positive' THEN 1.0 WHEN 'Negative' THEN -1.0 ELSE 0.0 END END), 0.0) AS avg_battery_sentiment,
  coalesce(avg(CASE WHEN aspect = 'Shipping' THEN CASE sentiment WHEN 'Positive' THEN 1.0 WHEN 'Negative' THEN -1.0 ELSE 0.0 END END), 0.0) AS avg_shipping_sentiment,
  coalesce(avg(CASE WHEN aspect = 'Price' THEN CASE sentiment WHEN 'Positive' THEN 1.0 WHEN 'Negative' THEN -1.0 ELSE 0.0 END END), 0.0) AS avg_price_sentiment
FROM extracted GROUP BY 1""", ["avg_battery_sentiment", "avg_shipping_sentiment", "avg_price_sentiment"])
def q_aspect_features(spark, sf):
    """L13"""
    return AS.aspect_customer_features(AS.extract_aspects(_scores(spark, sf)))


MATCH_SQL = EXTRACT_SQL + """,
pred AS (SELECT review_id AS sentence_id, lower(aspect) AS a, lower(sentiment) AS s,
                list_position(""" + "[" + ", ".join(repr(a) for a in AS.ASPECTS) + """], aspect) AS o FROM extracted),
matched AS (SELECT t.sentence_id, t.term_idx, t.term, t.polarity AS true_label,
                   coalesce(arg_min(p.s, p.o), 'neutral') AS pred_label
            FROM terms t LEFT JOIN pred p ON t.sentence_id = p.sentence_id
              AND (instr(lower(coalesce(t.term, '')), p.a) > 0 OR instr(p.a, lower(coalesce(t.term, ''))) > 0)
            WHERE t.polarity IN ('positive', 'negative', 'neutral')
            GROUP BY t.sentence_id, t.term_idx, t.term, t.polarity)"""


@register("aspect_term_match", O.with_(MATCH_SQL) + "SELECT * FROM matched")
def q_match(spark, sf):
    """J6"""
    terms, scores = _scored(spark, sf)
    return AS.aspect_term_match(terms, AS.extract_aspects(scores))


@register("aspect_eval", O.with_(MATCH_SQL) + """,
lab AS (SELECT unnest(['positive', 'negative', 'neutral']) AS label),
rep AS (SELECT l.label,
   CASE WHEN count(*) FILTER (WHERE m.pred_label = l.label) > 0 THEN count(*) FILTER (WHERE m.pred_label = l.label AND m.true_label = l.label) / count(*) FILTER (WHERE m.pred_label = l.label) ELSE 0.0 END AS p,
   CASE WHEN count(*) FILTER (WHERE m.true_label = l.label) > 0 THEN count(*) FILTER (WHERE m.pred_label = l.label AND m.true_label = l.label) / count(*) FILTER (WHERE m.true_label = l.label) ELSE 0.0 END AS r
   FROM lab l, matched m GROUP BY l.label),
f AS (SELECT label, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM rep)
SELECT round(avg(f1), 4) AS macro_f1, round(max(f1) FILTER (WHERE label = 'positive'), 4) AS positive_f1,
  round(max(f1) FILTER (WHERE label = 'negative'), 4) AS negative_f1, round(max(f1) FILTER (WHERE label = 'neutral'), 4) AS neutral_f1,
  (SELECT CAST(count(DISTINCT sentence_id) AS BIGINT) FROM terms) AS n_sentences,
  (SELECT CAST(count(*) FILTER (WHERE polarity IN ('positive', 'negative', 'neutral')) AS BIGINT) FROM terms) AS n_aspect_labels FROM f""",
          ["macro_f1", "positive_f1", "negative_f1", "neutral_f1"])
def q_aspect_eval(spark, sf):
    """M15"""
    t, scores = _scored(spark, sf)
    return AS.aspect_eval(AS.aspect_term_match(t, AS.extract_aspects(scores)), t)
