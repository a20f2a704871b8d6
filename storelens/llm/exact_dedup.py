"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

Every batch is reduced to one row per digest, merge-anti-joined with the index and what is new is
appended. The index side of the join is never shuffled, so a batch costs what the batch holds.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z;
null ids rank below all others; of rows that share both id and text exactly one stays; an empty table
gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.common import Run, ascii_lower, batch_of, prepare, scratch_path, shuffle_partitions, whole, written


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(whole(text)), 256)


class DigestIndex:
    """(digest, keep_id, n) rows, one per digest ever seen: the row that stays and its group's size in its batch.

    ``repeats`` holds (digest, n) for rows of later batches whose digest was already known.
    """

    KEY = "digest"
    SCHEMA = "digest binary, keep_id bigint, n bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int, index: Run, repeats: Run):
        self.spark, self.path, self.buckets, self.index, self.repeats = spark, path, buckets, index, repeats

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> "DigestIndex":
        none = spark.createDataFrame([], cls.SCHEMA)
        return cls(spark, path, buckets, Run.write(none, f"{path}/index", cls.KEY, buckets),
                   Run.write(none.select("digest", "n"), f"{path}/repeats", cls.KEY, buckets))

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> "DigestIndex":
        return cls(spark, path, buckets, Run.open(spark, f"{path}/index", cls.KEY, buckets, cls.SCHEMA),
                   Run.open(spark, f"{path}/repeats", cls.KEY, buckets, "digest binary, n bigint"))

    def add(self, batch: DataFrame) -> None:
        """Take in (doc_id, digest) rows; the largest id of each new digest stays."""
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        groups = written(groups, "digest-batch")
        known = self.index.frame().select("digest").hint("merge")
        fresh = written(groups.join(known, "digest", "left_anti"), "digest-new")  # before the index changes
        self.repeats.append(groups.join(known, "digest", "left_semi").select("digest", "n"))
        self.index.append(fresh)

    def groups(self) -> DataFrame:
        """digest, keep_id, group_size over all batches so far."""
        more = self.repeats.frame().groupBy("digest").agg(F.sum("n").alias("more"))
        return (self.index.frame().hint("merge").join(more, "digest", "left")
                .select("digest", "keep_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size")))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2,
           buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Batches are id ranges from the largest downwards, so the row already indexed always has the larger id.
    """
    spark = docs.sparkSession
    prepare(spark)
    buckets = buckets or shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("digest"))
    rows = written(rows.withColumn("batch", batch_of(docs, id_col, batches, descending=True)), "digests", ["batch"])
    index = DigestIndex.create(spark, scratch_path(spark, "digest-index"), buckets)
    for b in range(batches):
        index.add(rows.where(F.col("batch") == b).drop("batch"))
    tied = Window.partitionBy("digest", "doc_id").orderBy("doc_id")
    rows = rows.withColumn("nth", F.row_number().over(tied))
    # a digest may hold a third of all rows: both sides are plain exchanges, so AQE splits its partition
    out = rows.join(written(index.groups(), "digest-groups"), "digest")
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that stay, with their own columns."""
    kept = (decide(docs, id_col, text_col, **kw).where("kept")
            .select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__kept_digest")))
    own = docs.withColumn("__digest", F.unhex(digest(F.col(text_col))))
    same = (own["__digest"] == kept["__kept_digest"]) & own[id_col].cast("bigint").eqNullSafe(kept["__id"])
    return own.join(kept, same, "left_semi").dropDuplicates(["__digest", id_col]).drop("__digest")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth FROM n)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND nth = 1) AS kept, text_sha256 FROM g
"""
