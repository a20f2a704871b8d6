"""Transaction cleaning (P1–P12): projections, filters and the model matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.timeutil import add_days, ts_lit
from storelens.schemas import FEATURE_COLUMNS, FEATURE_DEFAULTS

# Reference defaults.
DEFAULT_COUNTRY = "United Kingdom"
DEFAULT_SNAPSHOT = "2010-11-30"
DEFAULT_OBS_START = "2009-12-01"
DEFAULT_HORIZON_DAYS = 90

CUST = "`Customer ID`"


def exclude_guests(df: DataFrame) -> DataFrame:
    """Drop guest checkouts (null customer id)."""
    return df.where(F.col(CUST).isNotNull())


def scope_country(df: DataFrame, country: str | None = DEFAULT_COUNTRY) -> DataFrame:
    """Keep one country (pushed to the Parquet scan); ``None`` keeps all."""
    return df if country is None else df.where(F.col("Country") == F.lit(country))


def normalise_customer_id(df: DataFrame) -> DataFrame:
    """Float id → integer → string ("100.0" → "100")."""
    return df.withColumn("Customer ID", F.col(CUST).cast("bigint").cast("string"))


def drop_cancellations(df: DataFrame) -> DataFrame:
    """Drop invoices whose number starts with ``C``."""
    return df.where(~F.coalesce(F.col("Invoice").startswith("C"), F.lit(False)))


def positive_lines(df: DataFrame) -> DataFrame:
    """P5: keep ``Quantity > 0 AND Price > 0``."""
    return df.where((F.col("Quantity") > 0) & (F.col("Price") > 0))


def line_total(df: DataFrame) -> DataFrame:
    """``LineTotal = Quantity * Price``."""
    return df.withColumn("LineTotal", F.col("Quantity").cast("double") * F.col("Price"))


def clean_transactions(df: DataFrame, country: str | None = DEFAULT_COUNTRY) -> DataFrame:
    """P1 → P2 → P3 → P4 → P5 → P6 as one lazy chain (one scan, no shuffle)."""
    out = exclude_guests(df)
    out = scope_country(out, country)
    out = normalise_customer_id(out)
    out = drop_cancellations(out)
    out = positive_lines(out)
    return line_total(out)


def cleaning_funnel(df: DataFrame, country: str | None = DEFAULT_COUNTRY) -> DataFrame:
    """Rows remaining / removed after each cleaning step, in ONE aggregate.

    Cumulative predicates are counted with ``count_if`` in a single pass
    (partial aggregation per task, one tiny final merge) and then stacked.
    """
    guest_ok = F.col(CUST).isNotNull()
    country_ok = F.lit(True) if country is None else (F.col("Country") == F.lit(country))
    cancel_ok = ~F.coalesce(F.col("Invoice").startswith("C"), F.lit(False))
    pos_ok = (F.col("Quantity") > 0) & (F.col("Price") > 0)
    c1 = guest_ok
    c2 = c1 & country_ok
    c3 = c2 & cancel_ok
    c4 = c3 & pos_ok
    agg = df.agg(
        F.count(F.lit(1)).alias("s0"),
        F.count_if(c1).alias("s1"), F.count_if(c2).alias("s2"),
        F.count_if(c3).alias("s3"), F.count_if(c4).alias("s4"),
    )
    steps = ["raw", "exclude_guests", "scope_country", "drop_cancellations", "positive_lines"]
    parts = []
    for i, name in enumerate(steps):
        prev = f"s{i - 1}" if i else "s0"
        parts.append(f"{i}, '{name}', s{i}, {prev} - s{i}, {prev}")
    stacked = agg.selectExpr(
        f"stack({len(steps)}, {', '.join(parts)}) as (step_no, step, rows_remaining, rows_removed, prev_rows)")
    return stacked.select(
        F.col("step_no").cast("int"), "step",
        F.col("rows_remaining").cast("bigint"), F.col("rows_removed").cast("bigint"),
        F.when(F.col("prev_rows") > 0, F.round(F.col("rows_removed") * 100.0 / F.col("prev_rows"), 4))
         .otherwise(F.lit(0.0)).alias("pct_removed"),
    )


def observation_window(df: DataFrame, obs_start: str = DEFAULT_OBS_START,
                       snapshot: str = DEFAULT_SNAPSHOT) -> DataFrame:
    """``InvoiceDate BETWEEN obs_start AND snapshot`` (both at midnight, inclusive)."""
    return df.where(F.col("InvoiceDate").between(ts_lit(obs_start), ts_lit(snapshot)))


def horizon_window(df: DataFrame, snapshot: str = DEFAULT_SNAPSHOT,
                   horizon_days: int = DEFAULT_HORIZON_DAYS) -> DataFrame:
    """P10: ``InvoiceDate BETWEEN snapshot + 1 day AND snapshot + horizon`` (midnights).

    Orders after 00:00 on the snapshot day fall in neither window (reference
    behaviour, kept on purpose).
    """
    s = ts_lit(snapshot)
    return df.where(F.col("InvoiceDate").between(add_days(s, 1), add_days(s, horizon_days)))


def feature_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Complete a scoring request: add missing feature columns, fill nulls."""
    defaults = dict(FEATURE_DEFAULTS if defaults is None else defaults)
    out = df
    for c, v in defaults.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(v))))
        else:
            out = out.withColumn(c, F.lit(float(v)))
    return out


# Columns never fed to the model.
EXCLUDE_COLS = ["CustomerID", "churned", "first_order_date", "last_order_date"]


def select_model_matrix(features: DataFrame, label: str = "churned",
                        feature_cols: list[str] | None = None) -> DataFrame:
    """Labelled rows only, model columns in order, nulls → 0, label as int."""
    cols = feature_cols or [c for c in FEATURE_COLUMNS if c in features.columns]
    out = features.where(F.col(label).isNotNull())
    return out.select(
        "CustomerID",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols],
        F.col(label).cast("int").alias(label),
    )
