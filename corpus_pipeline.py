"""A corpus pipeline of five stages; each works on the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from storelens.llm.common import documents, prepare, stage, written
from storelens.llm.queries import RANKS


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal after lower-casing A-Z, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more), the document with the smallest id."""
    return ngram_join.one_of_each(docs, width=5, threshold=0.8)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit) of every document, and their number."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality), ("exact_dedup", copies), ("ngram_jaccard_join", near_copies), ("source_mixing", mixture), ("byte_bpe", tokens)]

#: The learned rules and the tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
