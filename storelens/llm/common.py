"""Helpers shared by the training-data operators: text expressions, input tables, written runs."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens import session
from storelens.session import ensure_checkpoint_dir, scratch_path, ship_package

#: A word is a run of characters that are not ASCII white space; space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """What every operator relies on: UTC, a shared checkpoint folder, the package on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def whole(c: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_LEFT: dict[str, list[str]] = {}  # by application: scratch tables of the stage before


def stage(fn):
    """A pipeline stage. Once its predecessor's result has been written and is read from there, the
    predecessor's scratch tables go; where ``docs`` still reads them, they stay until a later stage."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        app, first = spark.sparkContext.applicationId, len(session._SCRATCH)
        left = _LEFT.pop(app, [])
        files = docs.inputFiles() if left else []
        # a cached or derived input names no files: then nothing goes
        if files and not any(p.split("/storelens/")[-1] in f for p in left for f in files):
            remove(spark, left)
            left = []
        out = fn(spark, docs, sf_dir)
        _LEFT[app] = left + session._SCRATCH[first:]
        return out
    return run


class Run:
    """A table in the shared folder, bucketed and sorted by ``key``: a scan joins on the key without a shuffle.

    Data and bucketing live under ``path``; the session's catalogue only names them, so a later
    session reopens the run with ``Run.open``.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int, name: str):
        self.spark, self.path, self.key, self.buckets, self.name = spark, path, key, buckets, name

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, buckets: int) -> "Run":
        run = cls(df.sparkSession, path, key, buckets, f"run_{uuid.uuid4().hex[:16]}")
        run._save(df, "overwrite")
        return run

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str, buckets: int, schema: str) -> "Run":
        name = f"run_{uuid.uuid4().hex[:16]}"
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, path, key, buckets, name)

    def append(self, df: DataFrame) -> None:
        self._save(df, "append")

    def _save(self, df: DataFrame, mode: str) -> None:
        (df.repartition(self.buckets, self.key).write.format("parquet").mode(mode)
         .bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name))

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)


def batch_of(df: DataFrame, id_col: str, batches: int, descending: bool = False) -> Column:
    """Number of the contiguous id range a row belongs to, 0 first; rows without an id come last."""
    lo, hi = df.agg(F.min(id_col), F.max(id_col)).first()
    if lo is None:
        return F.lit(batches - 1)
    lo, hi, at = int(lo), int(hi), F.col(id_col).cast("bigint")
    if hi - lo >= 2**62:  # a quarter of the ids: their differences are 64-bit numbers again
        lo, hi, at = lo >> 2, hi >> 2, F.shiftright(at, 2)
    step = max(1, -(-(hi - lo + 1) // batches))
    at = (F.lit(hi) - at) if descending else (at - F.lit(lo))
    return F.coalesce(F.floor(at / F.lit(step)).cast("int"), F.lit(batches - 1))
