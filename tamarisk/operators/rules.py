"""Data-quality rules of one table as rows: rule, column, status and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.operators import roles
from tamarisk.operators.profile import business_columns

SCHEMA = ["rule_type", "column_name", "status", "element_count", "unexpected_count", "unexpected_percent"]


def _percent(part, whole):
    return F.round(100 * part / F.nullif(whole, F.lit(0)), 2)


def null_rules(df: DataFrame) -> DataFrame:
    """Row-count and null-share rules from one aggregate over the table."""
    cols = business_columns(df)
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"k{i}") for i, c in enumerate(cols)])
    limit = F.when(F.col("n") < P.SMALL_TABLE_ROWS, F.lit(P.SMALL_TABLE_NULL_HOLD)).otherwise(F.lit(P.NULL_HOLD))
    rows = [F.struct(F.lit("row_count_at_least_one").alias("rule_type"), F.lit(None).cast("string").alias("column_name"),
                     (F.col("n") >= 1).alias("ok"), F.lit(None).cast("bigint").alias("element_count"), F.lit(None).cast("bigint").alias("unexpected_count"))]
    for i, c in enumerate(cols):
        k = F.col(f"k{i}")
        rows.append(F.struct(F.lit("values_not_null").alias("rule_type"), F.lit(c).alias("column_name"),
                             (k <= F.col("n") * limit).alias("ok"), F.col("n").alias("element_count"), k.alias("unexpected_count")))
    return one.select(F.inline(F.array(*rows))).select(
        "rule_type", "column_name", F.when(F.col("ok"), "pass").otherwise("fail").alias("status"), "element_count", "unexpected_count",
        _percent(F.col("unexpected_count"), F.col("element_count")).alias("unexpected_percent"))


def unique_rules(df: DataFrame) -> DataFrame | None:
    """Every row of a repeated identifier value is unexpected.

    Identifier values of all columns are counted together (map-side combine), then summed
    per column; a value repeated on a third of the rows is one counter, not one big group.
    """
    ids = [c for c in business_columns(df) if roles.is_identifier(c)]
    if not ids:
        return None
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in ids])
    counts = df.select(F.explode(entries).alias("e")).groupBy("e.column_name", "e.value").agg(F.count("*").alias("n"))
    one = counts.groupBy("column_name").agg(
        F.sum("n").alias("element_count"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("unexpected_count"))
    return one.select(F.lit("values_unique").alias("rule_type"), "column_name",
                      F.when(F.col("unexpected_count") == 0, "pass").otherwise("fail").alias("status"), "element_count", "unexpected_count",
                      _percent(F.col("unexpected_count"), F.col("present")).alias("unexpected_percent"))


def run_rules(df: DataFrame, duplicate_check_ran: bool = False) -> DataFrame:
    out = null_rules(df)
    unique = unique_rules(df)
    if unique is not None:
        out = out.unionByName(unique)
    check = P.inline_table(df.sparkSession, "rule_type, status", [("duplicate_detection_run", "pass" if duplicate_check_ran else "warn")])
    return out.unionByName(check, allowMissingColumns=True).select(*SCHEMA)


def rule_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("rules_total"), F.count_if(F.col("status") == "pass").alias("rules_passed"))
