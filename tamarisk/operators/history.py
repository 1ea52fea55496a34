"""Dated snapshots: deltas, comparison, periods, recording and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.ordered import with_previous
from tamarisk.functions.text import clean_text
from tamarisk.functions.times import quarter_label

ORDER = ["recorded_at", "id"]


def with_deltas(snapshots: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Change of each value since the chronologically previous snapshot of the same series."""
    out = with_previous(snapshots, keys, ORDER, values)
    for v in values:
        out = out.withColumn(f"{v}_delta", F.round(F.col(v) - F.col(f"prev_{v}"), 1)).drop(f"prev_{v}")
    return out


def newest(snapshots: DataFrame, limit: int) -> DataFrame:
    return snapshots.orderBy(*[F.desc(c) for c in ORDER]).limit(limit)


def all_identical(snapshots: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Whether a series of more than one snapshot has never moved."""
    n, present = F.count("*"), F.count(value)
    same = (present == 0) | ((present == n) & (F.min(value) == F.max(value)))
    return snapshots.groupBy(*keys).agg(n.alias("snapshots"), ((n > 1) & same).alias("all_identical"))


def periods(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(quarter_label(F.col("recorded_at")).alias("period")).agg(F.count("*").alias("snapshots")).orderBy(F.desc("period"))


def in_period(snapshots: DataFrame, period: str) -> DataFrame:
    return snapshots.where(quarter_label(F.col("recorded_at")) == period)


def compare(domain_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Domain by domain change from the earlier to the later snapshot of each (first_id, second_id).

    The pair is put in chronological order, whichever way round it was asked; the later
    snapshot's domains drive the result. A pair of one snapshot with itself is an error row.
    """
    facts = domain_rows.select(F.col("snapshot_id"), "recorded_at").distinct()
    a, b = facts.toDF("first_id", "first_at"), facts.toDF("second_id", "second_at")
    p = pairs.join(a, "first_id").join(b, "second_id")
    swap = F.struct("first_at", "first_id") > F.struct("second_at", "second_id")
    ordered = p.select(F.when(swap, F.col("second_id")).otherwise(F.col("first_id")).alias("earlier_id"),
                       F.when(swap, F.col("first_id")).otherwise(F.col("second_id")).alias("later_id"))
    side = lambda name: domain_rows.select(F.col("snapshot_id").alias(f"{name}_id"), "code", F.col("maturity").alias(f"{name}_maturity"), F.col("compliance").alias(f"{name}_compliance"))
    out = ordered.where("earlier_id <> later_id").join(side("later"), "later_id").join(side("earlier"), ["earlier_id", "code"], "left")
    return out.select("earlier_id", "later_id", "code", "earlier_maturity", "later_maturity",
                      F.round(F.col("later_maturity") - F.col("earlier_maturity"), 2).alias("maturity_delta"),
                      F.round(F.col("later_compliance") - F.col("earlier_compliance"), 1).alias("compliance_delta"),
                      F.col("earlier_maturity").isNotNull().alias("comparable"))


def record(assessment: DataFrame, recorder: Column, at: Column, note: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshot rows to append, rows refused for want of a recorder): values as computed, blank notes null."""
    out = assessment.withColumns({"recorded_by": clean_text(recorder), "recorded_at": at, "note": clean_text(note)})
    named = F.col("recorded_by").isNotNull()
    return out.where(named), out.where(~named).withColumn("reason", F.lit("the recorder must be named"))


def one_exported(snapshots: DataFrame, snapshot_id: int, array_column: str, path: str) -> None:
    """One snapshot with its domain rows as CSV with a header; an unknown id is an error."""
    rows = one(snapshots, snapshot_id)
    rows.select("id", "recorded_at", "recorded_by", F.inline(array_column)).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def one(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """A single snapshot; an unknown id is an error."""
    found = snapshots.where(F.col("id") == snapshot_id)
    if found.isEmpty():
        raise ValueError(f"no snapshot with id {snapshot_id}")
    return found


def exploded(snapshots: DataFrame, array_column: str = "domains") -> DataFrame:
    return snapshots.select("id", "recorded_at", F.inline(array_column))
