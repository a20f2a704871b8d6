"""File scans and sinks (S1, S3–S9, S11, S12). Explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens import schemas as S
from storelens.functions.text import clean_review_text, once, rating_label, review_invalid_reason
from storelens.session import spread

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
VALID_LABELS = {"negative": 0, "neutral": 1, "positive": 2}


def scan_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header (UTF-8, BOM tolerated) → ``transactions``.

    Anything not ending in .csv (file or folder) is rejected like the
    reference's unsupported-suffix error.
    """
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError(f"Unsupported format: {path}")
    return (spark.read.schema(S.TRANSACTIONS).option("header", True)
            .option("encoding", "UTF-8").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
            .csv(path))


def union_transaction_years(*sheets: DataFrame) -> DataFrame:
    """Concatenate yearly sheets by column name, no dedup."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s)
    return out


def scan_reviews_jsonl(spark: SparkSession, paths: str | list[str], source: str | None = None,
                       max_valid_per_file: int | None = None, partitions: int | None = None) -> DataFrame:
    """S3: JSON lines (optionally .gz) → cleaned, validated review records.

    Malformed lines land in ``_corrupt_record`` and are dropped; a rating that
    does not parse as a number is dropped; text is cleaned (C1) and checked
    (C2); label from rating (C3). gzip files are one task each, so the scan is
    followed by a repartition to spread the cleaning regexes: to ``partitions``,
    or where the scan has fewer parts than the cluster has cores. With
    ``max_valid_per_file``, each file gives at most so many valid records, the
    first in the order of the review id's hash.
    """
    raw = (spark.read.schema(S.REVIEWS_RAW)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(paths)
           .withColumn("_file", F.col("_metadata.file_name")))
    ok = raw.where(F.col("_corrupt_record").isNull())
    ok = ok.repartition(partitions) if partitions else spread(ok)
    rating = F.col("rating").try_cast("double").try_cast("int")
    text = once(clean_review_text(F.col("text")))
    stem = F.regexp_extract(F.col("_file"), r"^(.*)\.[^.]*$", 1)
    src = F.lit(source) if source is not None else stem
    recs = ok.select(
        F.concat(F.coalesce(F.col("asin"), F.lit("unk")), F.lit("_"),
                 F.substring(F.sha2(F.concat_ws("|", F.col("user_id"), F.col("timestamp").cast("string"),
                                                F.col("asin")), 256), 1, 16)).alias("review_id"),
        text.alias("text"), rating.alias("rating"), src.alias("source"),
        F.coalesce(F.col("verified_purchase"), F.lit(False)).alias("verified_purchase"), "_file",
    )
    recs = recs.where(F.col("rating").isNotNull()).where(review_invalid_reason(F.col("text"), F.col("rating")) == "ok")
    if max_valid_per_file is not None:  # the cap is the feature; Spark keeps that many rows a task before the shuffle
        nth = F.row_number().over(Window.partitionBy("_file").orderBy(F.md5("review_id"), "review_id", "text"))
        recs = recs.withColumn("_nth", nth).where(F.col("_nth") <= max_valid_per_file)
    return recs.select("review_id", "text", "rating", rating_label(F.col("rating")).alias("label"),
                       "source", "verified_purchase", F.length("text").alias("char_length"))


def scan_feature_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Feature / label / sentiment Parquet (pruning and pushdown by Catalyst)."""
    return spark.read.parquet(path)


def scan_image_tree(spark: SparkSession, root: str) -> DataFrame:
    """``root/{category}/**`` image files (jpg/jpeg/png/webp, any case).

    ``binaryFile`` lists and reads files in parallel; the category is the
    first directory below the root.
    """
    import re
    from urllib.parse import urlparse
    root = root.rstrip("/")
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    ext = F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1))
    root_path = urlparse(root).path.rstrip("/") or root
    rel = F.regexp_extract(F.col("path"), r"^.*" + re.escape(root_path) + r"/(.*)$", 1)
    return (df.where(ext.isin(*IMAGE_EXTENSIONS))
            .select("path", F.regexp_extract(rel, r"^([^/]+)/", 1).alias("category"),
                    "length", "modificationTime", "content"))


def scan_aspect_xml(spark: SparkSession, path: str) -> DataFrame:
    """``<sentence id><text/><aspectTerms><aspectTerm term polarity/>`` → one row per term.

    Spark 4's built-in XML source with an explicit schema; attributes arrive as ``_term``/``_polarity``.
    Sentences without terms are kept with null term.
    """
    x = spark.read.format("xml").option("rowTag", "sentence").schema(S.ASPECT_SENTENCES).load(path)
    terms = F.col("aspectTerms.aspectTerm")
    return x.select(F.col("_id").cast("string").alias("sentence_id"), F.col("text"),
                    F.explode_outer(terms).alias("t")).select(
        "sentence_id", "text", F.col("t._term").alias("term"), F.col("t._polarity").alias("polarity"))


def scan_labelled_reviews(spark: SparkSession, path: str, split_col: str | None = "split") -> DataFrame:
    """Labelled split CSV; drop blank text and unknown labels; label → 0/1/2;
    defaults rating 3 and source 'unknown'. A ``split=…`` folder becomes a column."""
    schema = S.LABELLED_REVIEWS
    if split_col:
        from pyspark.sql import types as T
        schema = T.StructType([*schema.fields, T.StructField(split_col, T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True) \
        .option("escape", '"').csv(path)
    lab = F.lower(F.trim(F.col("label")))
    m = F.create_map(*[x for k, v in VALID_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return (df.where(F.col("text").isNotNull() & (F.length(F.trim(F.col("text"))) > 0))
            .where(lab.isin(*VALID_LABELS))
            .select("review_id", "text", F.element_at(m, lab).alias("label"),
                    F.coalesce(F.col("rating"), F.lit(3)).alias("rating"),
                    F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
                    *([split_col] if split_col else [])))


def sink_feature_table(features: DataFrame, base: str, real_sentiment: bool, csv_copy: bool = True) -> str:
    """Write the feature table; version v2 when real sentiment was joined."""
    version = "v2" if real_sentiment else "v1"
    out = f"{base.rstrip('/')}/rfm_behavioral_{version}"
    features.write.mode("overwrite").parquet(out + ".parquet")
    if csv_copy:
        features.write.mode("overwrite").option("header", True).csv(out + ".csv")
    return out + ".parquet"


def sink_split_manifests(df: DataFrame, path: str, split_col: str = "split") -> str:
    """One CSV folder per split in one pass (empty splits simply produce no folder)."""
    cols = [c for c in df.columns if c != split_col] + [split_col]
    df.select(*cols).write.mode("overwrite").partitionBy(split_col).option("header", True) \
      .option("escape", '"').csv(path)
    return path


def dataset_fingerprint(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """MD5 per file (``binaryFile`` or any (path, bytes/text) table)."""
    return files.select(F.col(path_col).alias("file"), F.md5(F.col(content_col)).alias("md5"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """S11 (table variant): order-free digest = row count + Σ xxhash64(row)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def append_perf_snapshot(metrics: DataFrame, snapshot_date: str, path: str) -> None:
    """S12 as a sink: a snapshot is one folder of the history, so writing a date again replaces it."""
    perf_snapshot_append(metrics, snapshot_date).drop("snapshot_date").write.mode("overwrite").parquet(
        f"{path}/snapshot_date={snapshot_date}")


def perf_snapshot_append(metrics: DataFrame, snapshot_date: str) -> DataFrame:
    """Keep metrics whose value is numeric, stamp the snapshot date."""
    v = F.col("value").try_cast("double")
    return (metrics.where(v.isNotNull())
            .select(F.lit(snapshot_date).cast("date").alias("snapshot_date"), "metric", v.alias("value")))


def write_xml_lines(lines: DataFrame, path: str, root: str) -> None:
    """Write one-element-per-row XML text, each output file wrapped in ``<root>``.

    The XML source needs a single document element per file; the wrapper is
    added per partition (``mapInPandas`` sees a partition's batches in order).
    """
    import pandas as pd

    def wrap(batches):
        yield pd.DataFrame({"value": [f"<{root}>"]})
        for b in batches:
            yield b
        yield pd.DataFrame({"value": [f"</{root}>"]})

    lines.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)
