"""Content files / product images.

Files come from ``binaryFile`` (path, length, content) or any table with a
path and bytes. Rules are column expressions on ``length``, the extension and
the first bytes; only the image dimensions need Python (header parsing in a
vectorised pandas UDF over a bounded byte prefix).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reference limits.
VALID_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]
MIN_FILE_SIZE_BYTES = 5_000
MAX_FILE_SIZE_BYTES = 10_000_000
MIN_UPLOAD_SIZE_BYTES = 5_000
MAX_UPLOAD_SIZE_BYTES = 10 * 1024 * 1024
MIN_DIMENSION_PX = 64
HEADER_BYTES = 64  # PNG and WebP say their size here; a JPEG says it after its metadata, however long


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name ('' when none), like ``Path.suffix``."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def magic_ok(content: Column, ext: Column) -> Column:
    """C11 magic bytes: JPEG FFD8, PNG 89 'PNG', WEBP at bytes 8..12; other types pass."""
    head4 = F.substring(content, 1, 4)
    jpeg = F.substring(content, 1, 2) == F.unhex(F.lit("FFD8"))
    png = head4 == F.unhex(F.lit("89504E47"))
    webp = (F.length(content) >= 12) & (F.substring(content, 9, 4) == F.lit("WEBP").cast("binary"))
    return (F.when(F.length(content) < 4, F.lit(False))
             .when(ext.isin(".jpg", ".jpeg"), jpeg).when(ext == ".png", png).when(ext == ".webp", webp)
             .otherwise(F.lit(True)))


def upload_rules(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """C11: size 5,000 B … 10 MiB, allowed extension, magic bytes; (valid, reason)."""
    size = F.length(F.col(content))
    ext = extension(F.col(path))
    reason = (F.when(size < MIN_UPLOAD_SIZE_BYTES, F.concat(F.lit("File too small: "), size.cast("string"),
                                                             F.lit(f" bytes < {MIN_UPLOAD_SIZE_BYTES}")))
               .when(size > MAX_UPLOAD_SIZE_BYTES, F.concat(F.lit("File too large: "), size.cast("string"),
                                                            F.lit(f" bytes > {MAX_UPLOAD_SIZE_BYTES}")))
               .when(~ext.isin(*VALID_EXTENSIONS), F.concat(F.lit("Invalid extension: "), ext))
               .when(~magic_ok(F.col(content), ext), F.lit("File content does not match declared image type"))
               .otherwise(F.lit("ok")))
    return files.select(path, (reason == "ok").alias("valid"), reason.alias("reason"))


def content_sha256(files: DataFrame, content: str = "content") -> Column:
    """C12"""
    return F.sha2(F.col(content), 256)


def _dims(b: bytes) -> tuple[int, int] | None:
    if b is None or len(b) < 12:
        return None
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24 and b[12:16] == b"IHDR":
        w, h = struct.unpack(">II", b[16:24])
        return w, h
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        kind = b[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
        if kind == b"VP8 " and len(b) >= 30:
            w, h = struct.unpack("<HH", b[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L" and len(b) >= 25:
            v = int.from_bytes(b[21:25], "little")
            return (v & 0x3FFF) + 1, ((v >> 14) & 0x3FFF) + 1
        return None
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b):
            if b[i] != 0xFF:
                i += 1
                continue
            marker = b[i + 1]
            if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
                i += 2
                continue
            seg = int.from_bytes(b[i + 2:i + 4], "big")
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h = int.from_bytes(b[i + 5:i + 7], "big")
                w = int.from_bytes(b[i + 7:i + 9], "big")
                return w, h
            i += 2 + seg
    return None


DIMS_TYPE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


@F.pandas_udf(DIMS_TYPE)
def image_dimensions(prefix: pd.Series) -> pd.DataFrame:
    """Width/height from PNG IHDR, JPEG SOF or WebP headers (Arrow batches)."""
    out = [(_dims(bytes(x)) if x is not None else None) for x in prefix]
    return pd.DataFrame({"width": [o[0] if o else None for o in out],
                         "height": [o[1] if o else None for o in out]})


def image_rules(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Extension, size 5,000–10,000,000 B, readable header, both sides ≥ 64 px.

    Python parses headers only: a few bytes of a PNG or WebP, the segments of a JPEG that isn't too large.
    """
    size = F.length(F.col(content))
    ext = extension(F.col(path))
    jpeg = F.substring(F.col(content), 1, 2) == F.unhex(F.lit("FFD8"))
    header = F.when(jpeg & (size <= MAX_FILE_SIZE_BYTES), F.col(content)).otherwise(F.substring(F.col(content), 1, HEADER_BYTES))
    d = files.withColumn("_d", image_dimensions(header))
    reason = (F.when(~ext.isin(*VALID_EXTENSIONS), F.concat(F.lit("invalid extension: "), ext))
               .when(size < MIN_FILE_SIZE_BYTES, F.concat(F.lit("file too small: "), size.cast("string"),
                                                          F.lit(f" bytes < {MIN_FILE_SIZE_BYTES}")))
               .when(size > MAX_FILE_SIZE_BYTES, F.concat(F.lit("file too large: "), size.cast("string"),
                                                          F.lit(f" bytes > {MAX_FILE_SIZE_BYTES}")))
               .when(F.col("_d").isNull() | F.col("_d.width").isNull(), F.lit("corrupt or unreadable"))
               .when((F.col("_d.width") < MIN_DIMENSION_PX) | (F.col("_d.height") < MIN_DIMENSION_PX),
                     F.concat(F.lit("image too small: "), F.col("_d.width").cast("string"), F.lit("x"),
                              F.col("_d.height").cast("string"), F.lit("px")))
               .otherwise(F.lit("ok")))
    return d.select(*[F.col(c) for c in files.columns if c not in (content, "width", "height", "valid", "reason")],
                    "_d.width", "_d.height", (reason == "ok").alias("valid"), reason.alias("reason"))


def hashed_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with their C10 verdict and content hash; what W8 and A21 work on."""
    return image_rules(files.withColumn("sha256", content_sha256(files, content)), path, content)


def first_seen_dedup(valid: DataFrame, key: str = "sha256", order: tuple = ("category", "path")) -> DataFrame:
    """Keep the first file per content hash in (category, path) order, across
    categories. ``min_by`` aggregate: a hash repeated in a third of all rows is
    reduced map-side instead of sorted in one task."""
    cols = valid.columns
    g = valid.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return g.select("_r.*")


def split_statistics(files: DataFrame, path: str = "path", content: str = "content",
                     category: str = "category") -> DataFrame:
    """Total, valid, invalid_size, invalid_corrupt, duplicates per category and
    overall (``rollup``). Duplicates: valid files whose hash was seen earlier in
    (category, path) order — across categories. An image of too few pixels is an invalid size."""
    d = hashed_files(files, path, content).select(category, path, F.col("reason").alias("_r"), F.col("sha256").alias("_h"))
    first = (d.where(F.col("_r") == "ok").groupBy("_h")
             .agg(F.min_by(F.struct(category, path), F.struct(category, path)).alias("_f")))
    j = d.join(first, "_h", "left")
    is_dup = (F.col("_r") == "ok") & ~((F.col("_f")[category] == F.col(category)) & (F.col("_f")[path] == F.col(path)))
    g = j.rollup(category).agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.count_if((F.col("_r") == "ok") & ~is_dup).cast("bigint").alias("valid"),
        F.count_if(F.col("_r").rlike("too (small|large)")).cast("bigint").alias("invalid_size"),
        F.count_if(F.col("_r").rlike("^(invalid extension|corrupt)")).cast("bigint").alias("invalid_corrupt"),
        F.count_if(is_dup).cast("bigint").alias("duplicates"))
    return g.select(F.coalesce(F.col(category), F.lit("__overall__")).alias(category), "total", "valid",
                    "invalid_size", "invalid_corrupt", "duplicates")
