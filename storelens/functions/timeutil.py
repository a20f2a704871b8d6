"""Time arithmetic on naive (timestamp_ntz) facts."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000


def ts_lit(value: str | _dt.date | _dt.datetime) -> Column:
    """A naive timestamp literal (midnight for a date string)."""
    return F.lit(str(value)).cast("timestamp_ntz")


def micros(c: Column) -> Column:
    # Session time zone is UTC, so ntz -> timestamp is a pure relabel.
    return F.unix_micros(c.cast("timestamp"))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days elapsed = floor((end - start) / 24h), like a timedelta's ``.days``.

    Not ``datediff``: that counts calendar midnights (34 h across two
    midnights is 1 elapsed day but 2 calendar days).
    """
    return F.floor((micros(end) - micros(start)) / F.lit(float(_DAY_US))).cast("bigint")


def add_days(ts: Column, days: int) -> Column:
    return ts + F.make_interval(days=F.lit(int(days)))
