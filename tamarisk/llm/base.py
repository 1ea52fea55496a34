"""What the corpus operators share: tables, words, arrow rows, and objects kept by a Python worker."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.ordered import running_totals
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The six ASCII white-space characters, as a pattern and as text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array; a text without words gives an empty array."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def over_rows(df: DataFrame, batch: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with plain lists: ``batch(*columns)`` returns one list or array for each output column.

    It is given some rows of a batch at once, so that a task holds the Python texts of few documents.
    ``keeps`` names the worker object that it uses, if any.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                columns = batch(*[c.to_pylist() for c in b.slice(at, ROWS_AT_ONCE).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def with_row_numbers(docs: DataFrame, name: str, scanned: bool) -> DataFrame:
    """Adds a number of its own to every row, the same whenever the rows are read again.

    ``scanned``: the frame is a direct scan of Parquet files, whose rows have a place in their file; only
    one row per file is ordered to find where each file starts. Any other frame is written first.
    """
    scan = docs if scanned else materialise(docs)
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_r_file"), F.col("_metadata.row_index").alias("_r_at"))
    files = tagged.groupBy("_r_file").agg(F.count("*").alias("_r_rows"))
    upto = running_totals(files, [], ["_r_file"], {"_r_end": F.col("_r_rows")})
    starts = materialise(upto.select("_r_file", (F.col("_r_end") - F.col("_r_rows")).alias("_r_start")))
    return tagged.join(starts, "_r_file").select(*docs.columns, (F.col("_r_start") + F.col("_r_at")).alias(name))


def _worker_objects() -> dict:
    return sys.modules.setdefault("tamarisk_worker_objects", types.ModuleType("tamarisk_worker_objects")).__dict__


def release(keeps: str | None = None) -> None:
    """Gives back what this Python worker keeps under other names, to the system and not only to Python."""
    kept = _worker_objects()
    others = [k for k, v in kept.items() if isinstance(v, tuple) and k != keeps]
    for k in others:
        kept.pop(k)
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
        if trim:
            trim(0)


def worker_object(key: tuple, make: Callable):
    """The one object that a Python worker keeps, by its key; a stage uses one key, and the next stage's takes its place.

    Functions reach workers by value, so a module global would be made anew for every task. Workers outlive
    stages, so memory of the stage before is given back first; stages that keep nothing call ``release``.
    """
    kept = _worker_objects()
    if kept.get(key[0], (None,))[0] != key:
        release()  # before the new one is made, so that they are never there together
        kept[key[0]] = key, make()
    return kept[key[0]][1]


def rows_of(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[tuple]:
    """The rows as Python values, a few at once."""
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from zip(*[c.to_pylist() for c in b.slice(at, at_once).columns])


def join_names(rows: DataFrame, names: DataFrame, on: list[str], total: int) -> DataFrame:
    """Rows joined with the names of their keys, which tell how many ``copies`` each key has.

    Keys with very many copies are fewer than four for each partition: their rows need no shuffle,
    and without them no key fills a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = F.col("copies") > F.lit(total // (4 * parts))
    hot = F.broadcast(names.filter(common))
    columns = [*rows.columns, *[c for c in names.columns if c not in on]]
    rest = rows.join(hot, on, "left_anti").join(names.filter(~common), on)
    return rows.join(hot, on).select(*columns).unionAll(rest.select(*columns))
