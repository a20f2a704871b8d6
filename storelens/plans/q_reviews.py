"""Review / text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions import text as TX
from storelens.operators import reviews as RV
from storelens.operators import splits as SP
from storelens.operators.labels import churn_labels
from storelens.plans import oracle as O
from storelens.plans.registry import register
from storelens.session import scratch_path, spread
from storelens.sources import files as FL
from storelens.sources import fixtures as FX
from storelens.sources.tables import Tables


def clean_sql(x: str) -> str:
    t = f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\\s+', ' ', 'g'))"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, '([!?.]){{3,}}', '\\1\\1', 'g')"
    t = f"regexp_replace({t}, '[^\\x20-\\x7E\\n]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def reason_sql(t: str, r: str) -> str:
    return (f"CASE WHEN {t} IS NULL OR length({t}) < 10 THEN 'too short: ' || CAST(coalesce(length({t}), 0) AS VARCHAR) || ' chars' "
            f"WHEN length({t}) > 50000 THEN 'too long: ' || CAST(length({t}) AS VARCHAR) || ' chars' "
            f"WHEN {r} IS NULL OR {r} NOT BETWEEN 1 AND 5 THEN 'invalid rating: ' || coalesce(CAST({r} AS VARCHAR), 'null') "
            f"ELSE 'ok' END")


def label_sql(r: str) -> str:
    return f"CASE WHEN {r} IN (1, 2) THEN 'negative' WHEN {r} IN (4, 5) THEN 'positive' ELSE 'neutral' END"


RAW = """raw AS (
  SELECT doc_id, CASE WHEN doc_id % 53 = 0 THEN 0 ELSE doc_id % 5 + 1 END AS rating, text,
         source AS asin, CAST(doc_id AS VARCHAR) AS user_id, doc_id AS ts, doc_id % 2 = 0 AS verified_purchase
  FROM documents)"""

REVIEWS = RAW + f""",
cleaned AS (SELECT *, {clean_sql('text')} AS ctext FROM raw),
reviews AS (
  SELECT asin || '_' || substr(sha256(concat_ws('|', user_id, CAST(ts AS VARCHAR), asin)), 1, 16) AS review_id,
         ctext AS text, CAST(rating AS INTEGER) AS rating, {label_sql('rating')} AS label, asin AS source, verified_purchase,
         CAST(length(ctext) AS INTEGER) AS char_length
  FROM cleaned WHERE {reason_sql('ctext', 'rating')} = 'ok')"""


def _reviews(spark, sf):
    return RV.review_records(FX.reviews_raw(Tables(spark, sf)))


@register("clean_review_text", f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents")
def q_clean_text(spark, sf):
    """C1 over whole documents"""
    d = spread(Tables(spark, sf).documents)
    return d.select("doc_id", TX.clean_review_text(F.col("text")).alias("clean_text"))


@register("clean_html_text", f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages")
def q_clean_html(spark, sf):
    """C1 over raw web pages (tag stripping)"""
    p = spread(Tables(spark, sf).pages)
    return p.select("page_id", TX.clean_review_text(F.col("html")).alias("clean_text"))


@register("valid_review", O.with_(RAW) + f"""SELECT user_id AS record_id, CAST(length({clean_sql('text')}) AS INTEGER) AS char_length,
  CAST(rating AS INTEGER) AS rating, {reason_sql(clean_sql('text'), 'rating')} AS reason FROM raw""")
def q_valid(spark, sf):
    """C2"""
    return RV.validate_reviews(FX.reviews_raw(Tables(spark, sf)))


@register("rating_label", O.with_(RAW) + f"SELECT doc_id, CAST(rating AS INTEGER) AS rating, {label_sql('rating')} AS label FROM raw")
def q_rating_label(spark, sf):
    """C3"""
    r = FX.reviews_raw(Tables(spark, sf))
    rating = F.col("rating").try_cast("double").cast("int")
    return r.select("doc_id", rating.alias("rating"), TX.rating_label(rating).alias("label"))


@register("review_records", O.with_(REVIEWS) + "SELECT * FROM reviews")
def q_review_records(spark, sf):
    """S3 rules on a table of raw reviews"""
    return _reviews(spark, sf)


TOKENS = REVIEWS + """,
tok AS (
  SELECT review_id, list_transform(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: length(w) > 0),
                                   lambda w: CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 30000 + 1000) AS ids
  FROM reviews),
tok2 AS (
  SELECT review_id, ids, len(ids) AS n FROM tok),
tokens AS (
  SELECT review_id, CAST(n AS INTEGER) AS n_tokens,
         CASE WHEN n > 510 THEN [101] || list_slice(ids, 1, 128) || list_slice(ids, n - 381, n) || [102]
              ELSE [101] || ids || [102] || list_transform(range(510 - n), lambda x: 0) END AS input_ids,
         CASE WHEN n > 510 THEN 512 ELSE n + 2 END AS mask_ones,
         n > 510 AS truncation_applied
  FROM tok2)"""


@register("head_tail_tokens", O.with_(TOKENS) + """SELECT review_id, n_tokens, CAST(len(input_ids) AS INTEGER) AS n_ids,
  array_to_string(input_ids, ',') AS input_ids_csv, CAST(mask_ones AS INTEGER) AS mask_ones, truncation_applied FROM tokens""")
def q_tokens(spark, sf):
    """C4: ids shown as a comma list (arrays compared as text)"""
    t = RV.tokenize_reviews(_reviews(spark, sf))
    return t.select("review_id", "n_tokens", F.size("input_ids").alias("n_ids"),
                    F.array_join("input_ids", ",").alias("input_ids_csv"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_ones"),
                    "truncation_applied")


@register("truncation_rate", O.with_(TOKENS) + """SELECT CAST(count(*) AS BIGINT) AS n_texts,
  avg(CAST(truncation_applied AS DOUBLE)) AS truncation_rate FROM tokens""", ["truncation_rate"])
def q_trunc_rate(spark, sf):
    """A24"""
    return RV.truncation_rate(RV.tokenize_reviews(_reviews(spark, sf)))


@register("review_preview", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview
  FROM documents""")
def q_preview(spark, sf):
    """C5"""
    return Tables(spark, sf).documents.select("doc_id", TX.review_preview(F.col("text")).alias("preview"))


@register("length_band", O.with_(REVIEWS) + """SELECT review_id, char_length,
  CASE WHEN char_length // 4 < 50 THEN 'short' WHEN char_length // 4 < 300 THEN 'medium' ELSE 'long' END AS length_band
  FROM reviews""")
def q_length_band(spark, sf):
    """C14"""
    return _reviews(spark, sf).select("review_id", "char_length", TX.length_band(F.col("char_length")).alias("length_band"))


@register("label_distribution", O.with_(REVIEWS) + """SELECT label, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM reviews GROUP BY label""", ["pct"])
def q_label_dist(spark, sf):
    """A16"""
    return RV.label_distribution(_reviews(spark, sf))


JSONL_EXPECTED = RAW + f""",
cleaned AS (SELECT *, {clean_sql('text')} AS ctext FROM raw WHERE doc_id % 89 <> 0 AND doc_id % 61 <> 0)
SELECT asin || '_' || substr(sha256(concat_ws('|', user_id, CAST(ts AS VARCHAR), asin)), 1, 16) AS review_id,
       ctext AS text, CAST(rating AS INTEGER) AS rating, {label_sql('rating')} AS label, 'reviews' AS source,
       CASE WHEN doc_id % 3 = 0 THEN false ELSE verified_purchase END AS verified_purchase,
       CAST(length(ctext) AS INTEGER) AS char_length
FROM cleaned WHERE {reason_sql('ctext', 'rating')} = 'ok'"""


def write_reviews_jsonl(spark, sf) -> str:
    """Derive a gzip JSON-lines review file from ``documents``: some lines are
    cut short (malformed), some carry a non-numeric rating, some omit
    ``verified_purchase``."""
    r = FX.reviews_raw(Tables(spark, sf))
    did = F.col("doc_id")
    rec = F.struct(
        F.when(did % 61 == 0, F.lit("n/a")).otherwise(F.col("rating")).alias("rating"),
        "title", "text", "asin", "parent_asin", "user_id", "timestamp", "helpful_vote",
        F.when(did % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("verified_purchase")).alias("verified_purchase"))
    line = F.to_json(rec)
    line = F.when(did % 89 == 0, F.substring(line, 1, 25)).otherwise(line)
    path = scratch_path(spark, "reviews_jsonl")
    r.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return path


@register("scan_reviews_jsonl", O.with_(JSONL_EXPECTED.split(",\ncleaned AS")[0]) + ", cleaned AS" +
          JSONL_EXPECTED.split(",\ncleaned AS")[1])
def q_scan_jsonl(spark, sf):
    """S3: write a JSONL.gz derived from documents, then scan it"""
    return FL.scan_reviews_jsonl(spark, write_reviews_jsonl(spark, sf), source="reviews")


CONV = f"""conv AS (
  SELECT 'conv' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS review_id,
         {clean_sql('text')} AS ctext, CAST((conv_id + turn) % 5 + 1 AS INTEGER) AS rating
  FROM conversations WHERE role = 'user')"""


def _conversation_reviews(spark, sf):
    c = spread(Tables(spark, sf).conversations).where(F.col("role") == "user")
    t = TX.once(TX.clean_review_text(F.col("text")))
    r = ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int")
    out = c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("review_id"),
                   t.alias("text"), r.alias("rating"))
    out = out.where(TX.review_invalid_reason(F.col("text"), F.col("rating")) == "ok")
    return out.select("review_id", "text", "rating", TX.rating_label(F.col("rating")).alias("label"),
                      F.lit("conversations").alias("source"), F.lit(False).alias("verified_purchase"),
                      F.length("text").alias("char_length"))


@register("union_review_sources", O.with_(REVIEWS, CONV) + f"""SELECT * FROM reviews UNION ALL
  SELECT review_id, ctext, rating, {label_sql('rating')}, 'conversations', false, CAST(length(ctext) AS INTEGER)
  FROM conv WHERE {reason_sql('ctext', 'rating')} = 'ok'""")
def q_union_sources(spark, sf):
    """Documents-derived reviews ∪ conversation user turns"""
    return RV.union_review_sources(_reviews(spark, sf), _conversation_reviews(spark, sf))


def rank_sql(part: str, idc: str, seed: int | str = 42) -> str:
    return f"(row_number() OVER (PARTITION BY {part} ORDER BY md5('{seed}' || '|' || CAST({idc} AS VARCHAR)), {idc}) - 1)"


@register("stratified_split", O.with_(REVIEWS) + f""", r AS (
  SELECT review_id, label, {rank_sql('label', 'review_id')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM reviews)
SELECT review_id, label, CASE WHEN rk < floor(n * 0.7) THEN 'train' WHEN rk < floor(n * 0.7) + floor(n * 0.15) THEN 'val'
  ELSE 'test' END AS split FROM r""")
def q_split(spark, sf):
    """W4 by label"""
    return SP.stratified_split(_reviews(spark, sf).select("review_id", "label"), "label", "review_id")


@register("holdout_split", O.with_(REVIEWS) + f""", r AS (
  SELECT review_id, label, {rank_sql('label', 'review_id')} AS rk, count(*) OVER (PARTITION BY label) AS n FROM reviews)
SELECT review_id, label, CASE WHEN rk < greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM r""")
def q_holdout(spark, sf):
    """W5"""
    return SP.holdout_split(_reviews(spark, sf).select("review_id", "label"), "label", "review_id")


@register("per_class_sample", O.with_(REVIEWS) + f""", r AS (
  SELECT review_id, label, {rank_sql('label', 'review_id')} AS rk FROM reviews)
SELECT review_id, label, CAST(rk AS BIGINT) AS _rank FROM r WHERE rk < 100""")
def q_per_class(spark, sf):
    """100 shots per class"""
    return SP.per_class_sample(_reviews(spark, sf).select("review_id", "label"), "label", "review_id", SP.NUM_SHOTS)


@register("stratified_folds", O.with_(O.TRANSACTIONS, O.clean(None), O.OBS, O.HORIZON, O.LABELS) + f"""
SELECT CustomerID, churned, CAST({rank_sql('churned', 'CustomerID')} % 5 AS INTEGER) AS fold FROM labels""")
def q_folds(spark, sf):
    """W7 on churn labels"""
    lab = churn_labels(FX_clean(spark, sf), FX.RETENTION_SNAPSHOT, FX.RETENTION_OBS_START, 90)
    return SP.stratified_folds(lab.select("CustomerID", "churned"), "churned", "CustomerID")


def FX_clean(spark, sf):
    from storelens.operators.clean import clean_transactions
    return clean_transactions(FX.transactions(Tables(spark, sf)), country=None)


@register("category_sample_pool", """SELECT c_mktsegment, c_custkey FROM (
  SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rk,
         count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE n >= 100 AND rk <= 80""")
def q_pool(spark, sf):
    """A23 over customer segments"""
    c = Tables(spark, sf).customer.select("c_mktsegment", "c_custkey")
    return SP.category_sample_pool(c, "c_mktsegment", "c_custkey")
