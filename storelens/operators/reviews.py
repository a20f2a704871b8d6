"""Review records: validation, labels, truncation stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.text import (clean_review_text, head_tail_tokens, once, rating_label,
                                      review_invalid_reason, kept_token_ids)
from storelens.session import spread


def review_records(raw: DataFrame, source: str | None = None) -> DataFrame:
    """Raw review rows (rating as text) → clean, valid, labelled records.

    Same rules as the JSONL scan (S3) for rows already in a table.
    """
    raw = spread(raw)
    rating = F.col("rating").try_cast("double").try_cast("int")
    src = F.lit(source) if source is not None else F.col("asin")
    recs = raw.select(
        F.concat(F.coalesce(F.col("asin"), F.lit("unk")), F.lit("_"),
                 F.substring(F.sha2(F.concat_ws("|", F.col("user_id"), F.col("timestamp").cast("string"),
                                                F.col("asin")), 256), 1, 16)).alias("review_id"),
        once(clean_review_text(F.col("text"))).alias("text"), rating.alias("rating"), src.alias("source"),
        F.coalesce(F.col("verified_purchase"), F.lit(False)).alias("verified_purchase"))
    recs = recs.where(F.col("rating").isNotNull() & (review_invalid_reason(F.col("text"), F.col("rating")) == "ok"))
    return recs.select("review_id", "text", "rating", rating_label(F.col("rating")).alias("label"),
                       "source", "verified_purchase", F.length("text").alias("char_length"))


def validate_reviews(raw: DataFrame) -> DataFrame:
    """C2 report per record: cleaned length, parsed rating, reason."""
    raw = spread(raw)
    rating = F.col("rating").try_cast("double").try_cast("int")
    c = raw.select(F.col("user_id").alias("record_id"), rating.alias("rating"),
                   once(clean_review_text(F.col("text"))).alias("_t"))
    return c.select("record_id", F.length("_t").alias("char_length"), "rating",
                    review_invalid_reason(F.col("_t"), F.col("rating")).alias("reason"))


def label_distribution(reviews: DataFrame, label_col: str = "label") -> DataFrame:
    """Count and percentage per label (total via a window over the tiny result)."""
    from pyspark.sql import Window
    g = reviews.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return g.select(label_col, F.col("n").cast("bigint"), F.round(F.col("n") * 100.0 / tot, 4).alias("pct"))


def tokenize_reviews(reviews: DataFrame, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """C4 per review: pseudo token ids with head+tail truncation."""
    k = reviews.select(id_col, once(kept_token_ids(F.col(text_col))).alias("_k"))
    return k.select(id_col, head_tail_tokens(F.col("_k.ids"), F.col("_k.n")).alias("_t")).select(id_col, "_t.*")


def truncation_rate(tokens: DataFrame) -> DataFrame:
    """Share of texts where head+tail truncation applied."""
    return tokens.agg(F.count(F.lit(1)).alias("n_texts"),
                      F.avg(F.col("truncation_applied").cast("double")).alias("truncation_rate"))


def union_review_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate records of several sources (UNION ALL by name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
