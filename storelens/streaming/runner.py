"""Drive a monitor as a Structured Streaming query over a file source.

``replay_as_files`` cuts a table into time-ordered Parquet chunks (one Spark
write per chunk, so file modification order = event-time order);
``run_available_now`` processes every file present (``availableNow``) with
``maxFilesPerTrigger=1`` into a Parquet sink with a checkpoint in the shared
folder, so a restarted driver resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.session import scratch_path


def replay_as_files(df: DataFrame, ts: str, n_chunks: int, start: str, end: str, name: str) -> str:
    """Write ``df`` as ``n_chunks`` Parquet folders in ``ts`` order; returns the root."""
    spark = df.sparkSession
    root = scratch_path(spark, name)
    t0 = spark.sql(f"SELECT unix_micros(TIMESTAMP'{start}') AS a, unix_micros(TIMESTAMP'{end}') AS b").first()
    step = (t0["b"] - t0["a"]) / n_chunks
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    for k in range(n_chunks):  # n_chunks writes (time slices), not a loop over rows
        lo, hi = t0["a"] + k * step, t0["a"] + (k + 1) * step
        cond = (us >= F.lit(int(lo))) & ((us < F.lit(int(hi))) if k < n_chunks - 1 else F.lit(True))
        if k == 0:
            cond = cond | (us < F.lit(int(lo)))
        df.where(cond).coalesce(1).write.mode("overwrite").parquet(f"{root}/chunk={k:04d}")
    return root


def append_file(df: DataFrame, root: str, chunk: int) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(f"{root}/chunk={chunk:04d}")


def run_available_now(spark: SparkSession, source_root: str, schema, transform: Callable[[DataFrame], DataFrame],
                      name: str, output_mode: str = "append") -> DataFrame:
    """Run ``transform`` over the file stream until all files are processed; read the sink."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_root))
    out = transform(stream)
    sink = scratch_path(spark, f"{name}-sink")
    q = (out.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", sink + "-checkpoint")
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return spark.read.parquet(sink)
