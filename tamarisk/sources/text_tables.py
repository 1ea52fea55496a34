"""Delimited text: raw scan with stable row positions, null tokens, type inference, schema union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk import params as P
from tamarisk.functions.ordered import running_totals
from tamarisk.session import materialise
from tamarisk.sources import text_scan

POSITION = "_row_pos"


def with_row_positions(scan: DataFrame) -> DataFrame:
    """Adds the 0-based position of each row in (file, offset) order.

    ``scan`` is a direct file scan. It is run once and written with its splits, and positions come from that
    copy: a second scan might be planned into other splits, in which no row would be found again. Inside one
    split, rows keep their order and get consecutive ids; only one small row per split is ordered.
    """
    tagged = materialise(scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                                     F.monotonically_increasing_id().alias("_id")))
    splits = tagged.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    upto = running_totals(splits, [], ["_file", "_block"], {"_upto": F.col("_n")})
    starts = materialise(upto.select("_file", "_block", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_shift")))
    # one row per split, in a written copy whose size the planner knows
    out = tagged.join(starts, ["_file", "_block"])
    return out.select(*scan.columns, (F.col("_id") + F.col("_shift")).alias(POSITION))


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    """Every cell as text, with row positions; a malformed file is an error, so is an empty one.

    Quoted cells may hold line breaks; files with them are read by as many tasks as any other.
    ``options`` are those of Spark's CSV reader.
    """
    given = {"header": True, "mode": "FAILFAST", "escape": '"', **options, "multiLine": True}
    schema = spark.read.options(**given).csv(path).schema
    header = str(given.pop("header")).lower() == "true"
    rows = text_scan.numbered_records(spark, path, header, given.get("sep", given.get("delimiter", ",")), given.get("quote", '"'), given["escape"], given.get("comment"))
    given["lineSep"] = "\n"  # a record is one row, whatever line ends are in it
    cells = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(schema))])
    parsed = rows.select(F.from_csv("record", cells.simpleString()[7:-1].replace(":", " "), {k: str(v) for k, v in given.items()}).alias("r"), "position")
    return parsed.select(*[F.col(f"r.c{k}").alias(f.name) for k, f in enumerate(schema)], F.col("position").alias(POSITION))


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*P.NA_TOKENS), c)


def normalise_nulls(df: DataFrame, keep: tuple[str, ...] = (POSITION,)) -> DataFrame:
    """Null tokens in every text column become null."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)} - set(keep)
    return df.select(*[null_tokens(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])


# Shapes of text a type can read. Matching beats trying casts: a failed cast costs an exception per cell.
# Blanks around a number belong to it. A whole number of 19 digits may or may not fit a long.
SHAPES = {
    "bigint": r"^\s*[+-]?[0-9]{1,18}\s*$",
    "double": r"^\s*[+-]?([0-9]{1,18}|[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]{1,3}|[iI]nf|[iI]nfinity)\s*$",
    "boolean": r"^(true|false|True|False|TRUE|FALSE)$",
}
_LONG_WHOLE = r"^\s*[+-]?0*[0-9]{19}\s*$"


def has_shape(c: str, kind: str) -> Column:
    hit = F.rlike(c, F.lit(SHAPES[kind]))
    if kind == "boolean":
        return hit
    long_whole = F.rlike(c, F.lit(_LONG_WHOLE))
    fits = F.when(long_whole, F.col(c).try_cast("bigint").isNotNull()).otherwise(F.lit(False))
    return hit | (fits if kind == "bigint" else long_whole)


def infer_types(df: DataFrame, keep: tuple[str, ...] = (POSITION,)) -> dict[str, str]:
    """Narrowest type that reads every value of each text column; one aggregate over the data."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not text:
        return {}
    exprs = [F.count(c).alias(f"n{i}") for i, c in enumerate(text)]
    for i, c in enumerate(text):
        exprs += [F.count_if(has_shape(c, kind)).alias(f"{kind}{i}") for kind in SHAPES]
    seen = df.agg(*exprs).first()
    pick = lambda i: next((k for k in SHAPES if seen[f"n{i}"] and seen[f"{k}{i}"] == seen[f"n{i}"]), "string")
    return {c: pick(i) for i, c in enumerate(text)}


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    types = infer_types(df) if types is None else types
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, types: dict[str, str] | None = None, **options) -> DataFrame:
    """Raw scan, null tokens and types in one call."""
    return typed(normalise_nulls(read_raw(spark, path, **options)), types)


WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def common_type(names: set[str]) -> str:
    """The narrowest type that holds the values of all; text when they are not all numbers."""
    if names <= set(WHOLE_NUMBERS):
        return max(names, key=WHOLE_NUMBERS.index)
    return "double" if names <= {*WHOLE_NUMBERS, "float", "double"} else "string"


def union_parts(*parts: DataFrame) -> DataFrame:
    """Union by name; numbers of different types widen, other mixed types become text, absent columns null."""
    types: dict[str, set] = {}
    for p in parts:
        for f in p.schema:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    wider = {c: common_type(t) for c, t in types.items() if len(t) > 1}
    cast = lambda p: p.select(*[F.col(c).cast(wider[c]).alias(c) if c in wider else F.col(c) for c in p.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, parts))


# ---- loosely laid out sheets ----------------------------------------------------------

def header_rows(cells: DataFrame, first: int = 5) -> DataFrame:
    """The header row of each file: of its first rows, the one leaving fewest columns unnamed.

    ``cells`` is (file, row_pos, cells array). The earliest row wins a tie; a row naming no
    column or with nothing below it is never a header, and a file without a candidate is left out.
    """
    width = F.size("cells")
    named = F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    widest = cells.groupBy("file").agg(F.max(width).alias("width"), F.max(F.when(filled, F.col("row_pos"))).alias("last"))
    tried = cells.where(F.col("row_pos") < first).select("file", "row_pos", named.alias("named"), "cells")
    share = 1 - F.col("named") / F.col("width")
    return (tried.join(widest, "file").where((F.col("named") > 0) & (F.col("width") > 0) & (F.col("row_pos") < F.col("last")))
            .groupBy("file").agg(F.min_by(F.struct("row_pos", "width", (F.col("width") - F.col("named")).alias("unnamed"), "cells"),
                                          F.struct(share, F.col("row_pos"))).alias("h"))
            .select("file", F.col("h.row_pos").alias("header_row"), "h.width", "h.unnamed", F.col("h.cells").alias("header")))


def body_cells(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header with any content, one row per named cell."""
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))
    rows = cells.where(filled).join(headers, "file").where(F.col("row_pos") > F.col("header_row"))
    out = rows.select("file", "row_pos", "header", F.posexplode("cells").alias("col_pos", "value"))
    name = F.nullif(F.trim(F.try_element_at("header", F.col("col_pos") + 1)), F.lit(""))
    return out.select("file", "row_pos", "col_pos", F.coalesce(name, F.concat(F.lit("Unnamed: "), F.col("col_pos").cast("string"))).alias("column_name"),
                      F.nullif(F.trim("value"), F.lit("")).alias("value"))


def choose_sheet(sheets: DataFrame, keyword: str = "customer", fallback_first: bool = True) -> DataFrame:
    """Per file the first sheet whose name contains the keyword, else the first sheet (or none)."""
    hit = F.contains(F.lower("sheet"), F.lit(keyword))
    rows = sheets if fallback_first else sheets.where(hit)
    return rows.groupBy("file").agg(F.min_by("sheet", F.struct(~hit, F.col("pos"))).alias("sheet"), F.max(hit).alias("matched"))
