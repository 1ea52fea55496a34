"""Upload to registry: Bronze, Silver, gate, Gold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import profile as prof
from tamarisk.sources import text_tables as tt, zones


@dataclass
class Landed:
    bronze_path: str
    silver_path: str
    gold_path: str | None
    registry: DataFrame


@dataclass
class GoldProfile:
    numeric: DataFrame
    categories: DataFrame


def gold_profile(spark: SparkSession, gold_path: str, dataset: str) -> GoldProfile:
    """What promotion reports of the Gold columns: figures of the quantities, most frequent values of the categories."""
    gold = zones.read_zone(spark, gold_path, dataset)
    return GoldProfile(prof.numeric_summary(gold), prof.top_categories(gold))


def bronze_rows(spark: SparkSession, path: str, as_text: bool) -> DataFrame:
    """One landed load; text loads get their null tokens and types here, from columnar files."""
    rows = zones.read_zone(spark, path, path)
    return tt.typed(tt.normalise_nulls(rows)) if as_text else rows


def run_upload(raw: DataFrame, root: str, safe_name: str, load_ts: str, as_text: bool = False) -> Landed:
    """Lands ``raw`` (with row positions) and carries it as far as its null rates allow.

    ``as_text`` marks a raw text scan, landed as it is. Only the gate's one row and the list
    of sparse columns come to the driver; the rows are shuffled once, for the exact
    de-duplication that writes Silver.
    """
    spark = raw.sparkSession
    bronze_path = zones.land_bronze(raw, root, safe_name, load_ts)
    silver_path = zones.write_version(prof.to_silver(bronze_rows(spark, bronze_path, as_text)), root, "silver", safe_name, load_ts)
    silver = zones.read_zone(spark, silver_path, safe_name)
    profiled = prof.registry_rows(prof.column_profile(silver, safe_name))
    entry = profiled.first()  # one row; Silver is scanned once
    registry = spark.createDataFrame([entry] if entry else [], profiled.schema)
    gold_path = None
    if entry and entry["stage"] == "gold":
        gold_path = zones.write_version(prof.to_gold(silver, entry["dropped_columns"]), root, "gold", safe_name, load_ts)
    paths = registry.withColumns({"bronze_path": F.lit(bronze_path), "silver_path": F.lit(silver_path), "gold_path": F.lit(gold_path).cast("string")})
    return Landed(bronze_path, silver_path, gold_path, paths)


def promote(spark: SparkSession, registry: DataFrame, safe_name: str, root: str, version: str) -> DataFrame:
    """Writes Gold for a held dataset and gives back the changed registry."""
    entry = registry.where(F.col("safe_name") == safe_name).select("stage", "sparse_columns", "silver_path").first()
    if entry is None:
        raise ValueError(f"no dataset found matching '{safe_name}'")
    changed = prof.promote(registry, safe_name)
    if entry["stage"] != "silver_held":
        return changed
    silver = zones.read_zone(spark, entry["silver_path"], safe_name)
    gold_path = zones.write_version(prof.to_gold(silver, entry["sparse_columns"]), root, "gold", safe_name, version)
    return changed.withColumn("gold_path", F.when(F.col("safe_name") == safe_name, F.lit(gold_path)).otherwise(F.col("gold_path")))
