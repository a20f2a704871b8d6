"""Data-quality suite (Q1–Q8): rules evaluated in ONE aggregate pass.

The result table is ``(gate, rule, column_name, observed, unexpected, success)``.
Row-level rules become conditional counts inside a single ``agg`` (partial
aggregation per task, one tiny merge); only the compound-uniqueness rule needs
its own grouped pass (a shuffle on the key columns).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    gate: str
    kind: str  # columns | not_null | between | compound_unique | row_count | count_zero
    column: str | None = None
    min_value: object = None
    max_value: object = None
    mostly: float = 1.0
    columns: tuple = field(default_factory=tuple)
    predicate: str | None = None  # for count_zero: SQL predicate of violating rows


# The retail suite (gates G1–G8) as published by the reference.
RETAIL_SUITE = [
    Rule("G1", "columns", columns=("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate",
                                   "Price", "Customer ID", "Country")),
    Rule("G1", "not_null", "Invoice"),
    Rule("G1", "not_null", "InvoiceDate"),
    Rule("G2", "not_null", "Customer ID", mostly=0.7),
    Rule("G3", "between", "Quantity", -10000, 100000),
    Rule("G3", "between", "Price", 0, 50000, mostly=0.99),
    Rule("G3", "between", "Quantity", 1, 100000, mostly=0.9),
    Rule("G4", "compound_unique", columns=("Invoice", "StockCode")),
    Rule("G5", "row_count", min_value=10000, max_value=2000000),
    Rule("G6", "between", "InvoiceDate", "2009-01-01", "2012-12-31", mostly=0.999),
    Rule("G7", "not_null", "Country"),
    Rule("G8", "not_null", "InvoiceDate"),
]

RESULT_SCHEMA = T.StructType([
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("gate", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("observed", T.DoubleType()),
    T.StructField("unexpected", T.LongType()),
    T.StructField("success", T.BooleanType()),
])


def _c(name: str):
    return F.col(f"`{name}`")


def _bound(v, dtype):
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)) and isinstance(v, str):
        return F.lit(v).cast(dtype)
    return F.lit(v)


def run_suite(df: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Q8: evaluate all rules; one scan for row rules, one grouped pass for Q4."""
    rules = RETAIL_SUITE if rules is None else rules
    spark: SparkSession = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(rules):
        if r.kind == "not_null":
            aggs.append(F.count_if(_c(r.column).isNull()).alias(f"u{i}"))
        elif r.kind == "between":
            c = _c(r.column)
            ok = c.between(_bound(r.min_value, types[r.column]), _bound(r.max_value, types[r.column]))
            aggs += [F.count(c).alias(f"nn{i}"), F.count_if(c.isNotNull() & ~ok).alias(f"u{i}")]
        elif r.kind == "count_zero":
            aggs.append(F.count_if(F.expr(r.predicate)).alias(f"u{i}"))
    row = df.agg(*aggs)
    parts = []
    for i, r in enumerate(rules):
        col = F.lit(r.column).cast("string")
        if r.kind == "columns":
            missing = [c for c in r.columns if c not in df.columns]
            parts.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.gate).alias("gate"), F.lit("expect_columns").alias("rule"),
                                  F.lit(",".join(r.columns)).alias("column_name"),
                                  F.lit(float(len(r.columns) - len(missing)) / len(r.columns)).alias("observed"),
                                  F.lit(len(missing)).cast("bigint").alias("unexpected"),
                                  F.lit(not missing).alias("success")))
        elif r.kind == "not_null":
            frac = F.when(F.col("n") > 0, 1.0 - F.col(f"u{i}") / F.col("n")).otherwise(F.lit(1.0))
            parts.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.gate).alias("gate"), F.lit("expect_not_null").alias("rule"),
                                  col.alias("column_name"), frac.alias("observed"),
                                  F.col(f"u{i}").cast("bigint").alias("unexpected"),
                                  (frac >= F.lit(r.mostly)).alias("success")))
        elif r.kind == "between":
            frac = F.when(F.col(f"nn{i}") > 0, 1.0 - F.col(f"u{i}") / F.col(f"nn{i}")).otherwise(F.lit(1.0))
            parts.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.gate).alias("gate"), F.lit("expect_between").alias("rule"),
                                  col.alias("column_name"), frac.alias("observed"),
                                  F.col(f"u{i}").cast("bigint").alias("unexpected"),
                                  (frac >= F.lit(r.mostly)).alias("success")))
        elif r.kind == "row_count":
            ok = (F.col("n") >= r.min_value) & (F.col("n") <= r.max_value)
            parts.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.gate).alias("gate"), F.lit("expect_row_count").alias("rule"),
                                  F.lit(None).cast("string").alias("column_name"), F.col("n").cast("double").alias("observed"),
                                  F.when(ok, 0).otherwise(1).cast("bigint").alias("unexpected"), ok.alias("success")))
        elif r.kind == "count_zero":
            parts.append(F.struct(F.lit(i).alias("rule_no"), F.lit(r.gate).alias("gate"), F.lit("expect_zero_rows").alias("rule"),
                                  col.alias("column_name"), F.col(f"u{i}").cast("double").alias("observed"),
                                  F.col(f"u{i}").cast("bigint").alias("unexpected"), (F.col(f"u{i}") == 0).alias("success")))
    out = row.select(F.explode(F.array(*parts)).alias("r")).select("r.*") if parts else \
        spark.createDataFrame([], RESULT_SCHEMA)
    for i, r in enumerate(rules):
        if r.kind == "compound_unique":
            out = out.unionByName(compound_unique(df, list(r.columns), r.gate, i))
    return out


def compound_unique(df: DataFrame, columns: list[str], gate: str = "G4", rule_no: int = 0) -> DataFrame:
    """Q4: rows whose key combination occurs more than once (rows with all key
    values null are ignored). One grouped pass: partial counts per task."""
    keys = [_c(c) for c in columns]
    all_null = None
    for k in keys:
        all_null = k.isNull() if all_null is None else (all_null & k.isNull())
    g = df.where(~all_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    s = g.agg(F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("u"),
              F.sum("_c").alias("n"))
    return s.select(F.lit(rule_no).alias("rule_no"), F.lit(gate).alias("gate"), F.lit("expect_compound_unique").alias("rule"),
                    F.lit(",".join(columns)).alias("column_name"),
                    F.when(F.col("n") > 0, 1.0 - F.coalesce(F.col("u"), F.lit(0)) / F.col("n")).otherwise(1.0).alias("observed"),
                    F.coalesce(F.col("u"), F.lit(0)).cast("bigint").alias("unexpected"),
                    (F.coalesce(F.col("u"), F.lit(0)) == 0).alias("success"))


def expect_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q1"""
    return run_suite(df, [Rule("G1", "columns", columns=tuple(columns))])


def expect_not_null(df: DataFrame, column: str, mostly: float = 1.0) -> DataFrame:
    """Q2"""
    return run_suite(df, [Rule("G1", "not_null", column, mostly=mostly)])


def expect_between(df: DataFrame, column: str, lo, hi, mostly: float = 1.0) -> DataFrame:
    """Q3: share of non-null values inside [lo, hi] ≥ mostly."""
    return run_suite(df, [Rule("G3", "between", column, lo, hi, mostly=mostly)])


def expect_row_count(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Q5"""
    return run_suite(df, [Rule("G5", "row_count", min_value=lo, max_value=hi)])


def causal_integrity(reviews: DataFrame, snapshot: str, date_col: str = "review_date") -> DataFrame:
    """Q6: zero rows dated on/after the snapshot may feed snapshot features."""
    pred = f"`{date_col}` >= CAST('{snapshot}' AS TIMESTAMP_NTZ)"
    return run_suite(reviews, [Rule("G8", "count_zero", date_col, predicate=pred)])


def score_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Q7: every listed score inside its closed range (all in one pass)."""
    return run_suite(df, [Rule("Q7", "between", c, lo, hi) for c, (lo, hi) in ranges.items()])
