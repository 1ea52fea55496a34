"""Bronze, Silver and Gold zones on shared storage, and lakehouse tables."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.text import clean_text, file_extension, safe_file_name
from tamarisk.session import scratch_path, shared_folder


def land_bronze(raw: DataFrame, root: str, dataset: str, load_ts: str, load_id: str | None = None) -> str:
    """Writes one load, untouched, under its data set, UTC second and load id.

    Two loads of one second stay apart. A load id that is there already is an error, so a retried
    job that names its load cannot land it twice.
    """
    path = f"{root}/bronze/dataset={dataset}/load_ts={load_ts}/load_id={load_id or uuid.uuid4().hex}"
    raw.write.mode("errorifexists").parquet(path)
    return path


def write_version(df: DataFrame, root: str, zone: str, dataset: str, version: str) -> str:
    """A new version beside the old one: a path being read is never overwritten."""
    path = f"{root}/{zone}/{dataset}/{version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_zone(spark: SparkSession, path: str | None, dataset: str) -> DataFrame:
    if not path:
        raise ValueError(f"no dataset found matching '{dataset}'")
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"'{dataset}' is registered, but its files are missing; load it again") from e


def write_table(df: DataFrame, table: str, location: str | None = None) -> int:
    """Creates or replaces ``schema.table`` and gives back its row count (from the footers).

    The rows are written to a folder of their own first; the catalog is changed only when they are
    there, so a failed write leaves the table as it was. Readers of the old files finish on them:
    they are not removed here.
    """
    spark = df.sparkSession
    schema, _ = table.split(".", 1)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}` LOCATION '{shared_folder(spark)}/schemas/{schema}'")
    path = location or scratch_path(spark, "table")
    df.write.mode("errorifexists").parquet(path)
    target = quoted(table)
    if spark.catalog.tableExists(target) and spark.table(target).dtypes == spark.read.parquet(path).dtypes:
        spark.sql(f"ALTER TABLE {target} SET LOCATION '{path}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {target}")
        spark.sql(f"CREATE TABLE {target} USING parquet LOCATION '{path}'")
    spark.catalog.refreshTable(target)
    return spark.table(target).count()


def quoted(table: str) -> str:
    """``schema.table`` as the catalog knows it.

    Table names hold letters a-z, digits and '_' there; any other character becomes its number, as in
    ``my_x2d_data``, and so does the '_' of a literal ``_x``, so that two names never meet.
    """
    schema, name = table.split(".", 1)
    name = re.sub(r"_(?=x)|[^A-Za-z0-9_]", lambda m: f"_x{ord(m[0]):x}_", name)
    return f"`{schema}`.`{name}`"


def ready(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(quoted(table)) and not spark.table(quoted(table)).isEmpty()


def bronze_stats(spark: SparkSession, root: str) -> DataFrame:
    """Objects, bytes and newest time per data set, from the file listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/bronze")
    dataset = F.regexp_extract("path", r"/dataset=([^/]+)/", 1)
    return (files.select(dataset.alias("dataset"), "length", "modificationTime").groupBy("dataset")
            .agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")))


def table_counts(spark: SparkSession, tables: dict[str, list[str]]) -> DataFrame:
    """Existing tables and rows per zone; a zone without tables has 0 rows and never ran."""
    out = None
    for zone, names in tables.items():
        found = [n for n in names if spark.catalog.tableExists(quoted(n))]
        rows = [spark.table(quoted(n)).agg(F.count("*").alias("rows")) for n in found] or [spark.range(0).agg(F.count("*").alias("rows"))]
        for counted, name in zip(rows, found or [None]):
            one = counted.select(F.lit(zone).alias("zone"), F.lit(name).cast("string").alias("table_name"), "rows")
            out = one if out is None else out.unionByName(one)
    return out.groupBy("zone").agg(F.count("table_name").alias("tables"), F.sum("rows").alias("rows")).withColumn("never_run", F.col("tables") == 0)


def accept_documents(files: DataFrame, extensions, max_bytes: int) -> DataFrame:
    """(filename, size_bytes, uploaded_by, ..) with the reason a document is rejected, or null."""
    name = clean_text(F.col("filename"))
    reason = (F.when(name.isNull(), "a file name is required")
              .when(~file_extension(name).isin(*extensions), "file type not allowed")
              .when(F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, "file is empty")
              .when(F.col("size_bytes") > max_bytes, "file is too large")
              .when(clean_text(F.col("uploaded_by")).isNull(), "the uploader must be named"))
    return files.withColumn("storage_key", safe_file_name(name)).withColumn("reason", reason)


def listed_documents(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes below a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"))


def export_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Ordered CSV parts with a header; nulls are empty text. Part files are in sort order."""
    df.orderBy(*order).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
