"""Hashed randomness: reproducible across partitions, retries and engines.

``md5(seed || '|' || id)`` orders rows; the first 13 hex digits of it, read
as an integer and divided by 16^13, is a uniform in [0, 1). Never ``rand()``:
a re-executed task after an executor loss would draw different numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(id_col: Column, seed: str | int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), id_col.cast("string")))


def hashed_uniform(id_col: Column, seed: str | int) -> Column:
    h = hash_key(id_col, seed)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
