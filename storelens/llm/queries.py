"""The operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import align, bpe, exact_dedup, html_text, langid, line_dedup, mixing, ngram_join, periodic, pii, preference, quality_rules, toxicity
from storelens.llm.common import documents, prepare

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def toxicity_query(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op2_preference_format", preference.ORACLE)
def preference_query(spark, sf_dir):
    return preference.by_neighbours(table(spark, sf_dir, "conversations"))


@query("op3_line_dedup", line_dedup.ORACLE)
def line_dedup_query(spark, sf_dir):
    docs = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_ngram_jaccard_join")
def ngram_join_query(spark, sf_dir):
    return ngram_join.near_components(documents(spark, sf_dir))


@query("op5_quality_rules")
def quality_query(spark, sf_dir):
    return quality_rules.verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query("op8_source_mixing", mixing.ORACLE)
def mixing_query(spark, sf_dir):
    return mixing.amounts(documents(spark, sf_dir).select("doc_id", "text", "source"))


@query("op9_exact_dedup", exact_dedup.ORACLE)
def exact_dedup_query(spark, sf_dir):
    return exact_dedup.decide(documents(spark, sf_dir).select("doc_id", "text"))


@query("op6_language_mixture")
def language_query(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


@query("op7_byte_bpe")
def bpe_query(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op10_pii_boosting")
def pii_query(spark, sf_dir):
    return pii.report(documents(spark, sf_dir))


@query("op13_periodic_runs")
def periodic_query(spark, sf_dir):
    return periodic.report(documents(spark, sf_dir))


@query("op12_tokenizer_alignment")
def alignment_query(spark, sf_dir):
    import public_tokenizers

    return align.report(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_html_main_text")
def html_query(spark, sf_dir):
    return html_text.report(table(spark, sf_dir, "pages"))
