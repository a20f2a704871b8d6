"""Session construction and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "storelens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    The operators only rely on ``spark.sql.session.timeZone=UTC``; the rest is
    tuning. On a cluster the master comes from spark-submit.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    we never override it. Tests without it get a folder under /tmp.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = os.path.join("/tmp", "storelens-checkpoints")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables.

    The checkpoint folder belongs to this application and scratch tables go
    with it: they are removed when the driver's Python ends in good order.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/storelens/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_remove_scratch, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def _remove_scratch(spark: SparkSession) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is None:
            return
        for p in _SCRATCH:
            at = sc._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already; the folder's owner cleans up
        return


def spread(df, factor: int = 2):
    """Spread a CPU-heavy narrow stage (regex, hashing, pandas UDFs) over the cluster.

    A scan of a few large files or row groups yields fewer partitions than
    cores; then the expensive per-row work would run on a handful of tasks.
    Round-robin repartition only in that case — at scale, scans already have
    thousands of splits and this is a no-op (no extra shuffle).
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * factor) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Make ``storelens`` importable on executors (UDFs are pickled by module).

    Zips the package once per session and registers it with ``addPyFile`` (the
    ``--py-files`` mechanism); a no-op when already shipped or when the package
    is installed on the workers (set ``spark.storelens.ship=false``).
    """
    import io
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if sc.getConf().get("spark.storelens.ship", "true") == "false" or getattr(sc, "_storelens_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    # the archive is code, not data: Spark copies it from the driver to every executor
    path = os.path.join(tempfile.gettempdir(), f"storelens-{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    sc._storelens_shipped = True
