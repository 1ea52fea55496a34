"""Keyed tables as lists of Parquet files: a change set rewrites only the files that hold a changed key.

Below ``root`` lie ``empty`` (the schema), one folder of files for every write, and one folder below
``versions`` for every state of the table: the files it consists of, with their rows. Files are in key
order, so the smallest and greatest key in a Parquet footer tell what can be skipped. A version is
written after its files and never changed; readers of an older one finish on it, and nothing is removed.

Rows and keys stay on the executors. The names of files go through the driver, as in any listing.

Defined cases: rows or changes without a whole key match nothing, so such rows stay and such changes do
nothing; several rows of one key are changed alike; a change set that meets no file keeps all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators import changes as ch
from tamarisk.session import materialise

LISTED_KEYS = 1000       # distinct first key values up to which a scan is told them one by one


def _file() -> Column:
    """Folder and name of the file that a row is from; both are plain letters, whatever the root's name holds."""
    return F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), "_metadata.file_name")


def files(spark: SparkSession, root: str, version: str) -> DataFrame:
    """file, rows of a version."""
    return spark.read.schema("file string, rows long").parquet(f"{root}/versions/{version}")


def _scan(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{root}/empty").schema
    return spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names] or [f"{root}/empty"])


def _names(listed: DataFrame) -> list[str]:
    return sorted(r.file for r in listed.select("file").toLocalIterator())


def rows_in(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The rows of some of a table's files."""
    return _scan(spark, root, _names(listed))


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    return rows_in(spark, root, files(spark, root, version))


def _write_files(df: DataFrame, root: str, keys: list[str], count: int) -> DataFrame:
    """Writes rows as about ``count`` files in key order and lists them; rows of one key may fill several files."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    spread = df.repartitionByRange(count, *keys, F.xxhash64(*df.columns))
    spread.sortWithinPartitions(*keys).write.parquet(f"{root}/{folder}")
    return spark.read.schema(df.schema).parquet(f"{root}/{folder}").groupBy(_file().alias("file")).agg(F.count("*").alias("rows"))


def _write_version(listed: DataFrame, root: str) -> str:
    version = uuid.uuid4().hex
    listed.select("file", "rows").write.parquet(f"{root}/versions/{version}")
    return version


def create(df: DataFrame, root: str, keys: list[str], count: int | None = None) -> str:
    """Writes a table in ``count`` files (as many as shuffle partitions unless given); its first version."""
    spark = df.sparkSession
    df.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{root}/empty")
    return _write_version(_write_files(df, root, keys, count or int(spark.conf.get("spark.sql.shuffle.partitions"))), root)


def _near(changed: DataFrame, key: str) -> Column:
    """A condition on the first key that the scan can hold against footers: its values, or their range where they are many."""
    listed = [r[0] for r in changed.select(key).distinct().limit(LISTED_KEYS + 1).collect()]
    if len(listed) <= LISTED_KEYS:
        return F.col(key).isin(listed) if listed else F.lit(False)
    low, high = changed.agg(F.min(key), F.max(key)).first()
    return F.col(key).between(low, high)


def holding(spark: SparkSession, root: str, version: str, changed: DataFrame, keys: list[str]) -> list[str]:
    """Files of a version with a row of any changed key; only the key columns are read, and not where footers rule them out."""
    scan = read(spark, root, version).select(*keys, _file().alias("file")).where(_near(changed, keys[0]))
    return _names(scan.join(changed, keys, "left_semi").select("file").distinct())


def rewrite(spark: SparkSession, root: str, version: str, changed: DataFrame, keys: list[str],
            change: Callable[[DataFrame], DataFrame]) -> tuple[str, list[str]]:
    """(new version, files replaced): ``change`` is given the rows of all files that hold a changed key, and gives their new rows."""
    met = holding(spark, root, version, changed, keys)
    rows = change(_scan(spark, root, met))
    fresh = _write_files(rows, root, keys, max(1, len(met)))
    listed = files(spark, root, version)
    replaced = spark.createDataFrame([(n,) for n in met], "file string")
    return _write_version(listed.join(replaced, "file", "left_anti").unionByName(fresh), root), met


def _keys_of(changes: DataFrame, keys: list[str]) -> DataFrame:
    return materialise(ch.keyed(changes, keys).select(*keys).distinct())


def upsert(spark: SparkSession, root: str, version: str, changes: DataFrame, keys: list[str], order: str) -> tuple[str, list[str]]:
    """Each key's last change in place (see ``changes.upsert_by_key``)."""
    changes = materialise(changes)
    return rewrite(spark, root, version, _keys_of(changes, keys), keys, lambda rows: ch.upsert_by_key(rows, changes, keys, order))


def update(spark: SparkSession, root: str, version: str, changes: DataFrame, keys: list[str], columns: list[str],
           order: str) -> tuple[str, list[str], DataFrame]:
    """The listed columns changed where given (see ``changes.update_existing``); also the changes of unknown or missing keys.

    A known key's rows are in the files met, so these files also tell which keys are unknown.
    """
    changes = materialise(changes)
    known = _keys_of(changes, keys)
    now, met = rewrite(spark, root, version, known, keys, lambda rows: ch.update_existing(rows, changes, keys, columns, order)[0])
    return now, met, changes.join(_scan(spark, root, met).select(*keys), keys, "left_anti")


def delete(spark: SparkSession, root: str, version: str, gone: DataFrame, keys: list[str]) -> tuple[str, list[str]]:
    known = _keys_of(gone, keys)
    return rewrite(spark, root, version, known, keys, lambda rows: ch.delete_by_key(rows, known, keys))
