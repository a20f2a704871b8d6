"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A batch of documents (an id range, smallest ids first) is reduced to one row per line hash. It is
merge-anti-joined with every run on disk; what is left is new and becomes a run of level 0. When a
level has ``fanout`` runs, they are compacted into one run of the next level. Runs are bucketed and
sorted by hash, so only the batch is shuffled.

Defined results: null or empty text is one empty line; documents that share an id are one document
for "found in two documents", though each row keeps its own text; null ids rank after all others and
are one document; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import (ASCII_SPACE, Run, ascii_lower, batch_of, prepare, scratch_path, shuffle_partitions,
                                  whole, written)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


class LineRuns:
    """Runs of (key, owner): the smallest id that held the line when it was first seen."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = 3):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.levels: list[list[Run]] = []
        self.written = 0

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in (doc_id, key) rows; return (key, owner) of the batch's keys that a second document holds."""
        new = written(batch.groupBy("key").agg(F.min("doc_id").alias("first_id"),
                                               F.max(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("last_id")), "line-batch")
        new = new.repartition(self.buckets, "key")
        known = None
        for run in self.runs():
            old = run.frame().hint("merge")
            hit = new.select("key").join(old, "key").select("key", "owner")
            known = hit if known is None else known.unionByName(hit)
            new = new.join(run.frame().select("key").hint("merge"), "key", "left_anti")
        new = written(new, "line-new")
        self._push(0, new.select("key", F.col("first_id").alias("owner")))
        shared = new.where(~F.col("first_id").eqNullSafe(F.when(F.col("last_id") < 2**63 - 1, F.col("last_id"))))
        shared = shared.select("key", F.col("first_id").alias("owner"))
        return shared if known is None else shared.unionByName(known)

    def _push(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.written += 1
        self.levels[level].append(Run.write(rows, f"{self.path}/level={level}/run-{self.written:05d}", "key", self.buckets))
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0].frame()
            for r in self.levels[level][1:]:
                merged = merged.unionByName(r.frame())
            self.levels[level] = []
            self._push(level + 1, merged)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4,
                fanout: int = 3, buckets: int | None = None) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    Keys of at least ``min_chars`` code points found in two documents or more lose their lines except
    in the smallest id that holds them.
    """
    spark = docs.sparkSession
    prepare(spark)
    lines = F.split(whole(F.col(text_col)), "\n", -1)
    mark = F.xxhash64(whole(F.col(text_col)))  # tells rows that share an id apart
    at = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), mark.alias("mark"),
                     batch_of(docs, id_col, batches).alias("batch"), F.posexplode(lines).alias("pos", "line"))
    at = at.withColumn("line", line_key("line")).where(F.length("line") >= min_chars)
    at = written(at.select("doc_id", "mark", "pos", F.unhex(F.sha2("line", 256)).alias("key"), "batch"), "lines", ["batch"])
    runs = LineRuns(spark, scratch_path(spark, "line-runs"), buckets or shuffle_partitions(spark), fanout)
    shared = None
    for b in range(batches):
        found = runs.add(at.where(F.col("batch") == b).select("doc_id", "key"))
        found = written(found, "line-shared")
        shared = found if shared is None else shared.unionByName(found)
    shared = written(shared.dropDuplicates(["key"]), "line-owners")  # a key has one owner
    # a line may stand in a third of all documents: both sides are exchanges that AQE splits
    gone = at.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__gone_mark"), "__gone")
    own = docs.withColumn("__mark", mark)
    own = own.join(gone, own[id_col].cast("bigint").eqNullSafe(gone["__id"]) & (own["__mark"] == gone["__gone_mark"]), "left")
    n = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__gone"))  # hashed: linear in the lines
    kept = F.when(F.col("__gone").isNull(), whole(F.col(text_col))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    out = own.withColumn("__lines", lines).withColumns({
        "kept_text": kept, "n_lines": n.cast("bigint"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")})
    return out.drop("__mark", "__gone_mark", "__id", "__gone", "__lines")


ORACLE = """
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
d AS (SELECT k.*, (o.key IS NOT NULL AND k.doc_id IS DISTINCT FROM o.owner) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY rid, doc_id
"""
