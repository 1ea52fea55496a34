"""Delimited text whose quoted cells may hold line breaks, cut into rows by many tasks at once.

A file is read by its byte ranges, line by line. Whether a line break ends a row depends on whether a quote is
open before it, which a task cannot know for the start of its range. So it follows both cases: every line notes
whether a quote is open before and after it, and how many rows have begun, if the range began outside a quoted
cell and if it began inside one. A range then is one row, a map from the state at its start to that at its end; an ordered
scan over the ranges of a file composes these maps and settles, for every range, which case is true and how many
rows lie before it. With that, a line knows its row's number from its own row and the range's. Only the lines of
rows that go over several lines are brought together; all others stay where they are.

The lines are written once with their file, range and place. Everything after reads that copy, so a row's place
depends on neither the planning of a later scan nor on lost executors.

Quotes are those of the reader's options: a quote opens a cell at its start only, a doubled (or escaped) quote stays
inside, and characters behind a closing quote belong to the cell up to the next separator. Lines of blanks outside
quotes are no rows, nor are comments. Line ends are ``\\n`` or ``\\r\\n``; those inside a cell are kept as they are.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tamarisk.functions.ordered import running_totals
from tamarisk.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = "file string, block long, at long, line string, outside int, inside int, rows_outside long, rows_inside long"
# bits of ``outside`` and ``inside``: what holds for a line if its range begins outside, or inside, a quoted cell
BEFORE, AFTER, BEGINS = 1, 2, 4


def quote_patterns(sep: bytes, quote: bytes, escape: bytes) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end inside a quoted cell: of those that begin outside one, and of those that begin inside."""
    s, q, e = map(re.escape, (sep, quote, escape))
    body = rb"(?:[^%b]|%b%b)*+" % (q, q, q) if escape == quote else rb"(?:[^%b%b]|%b.)*+" % (q, e, e)
    rest = rb"(?:(?!%b).)*+" % s
    cell = rb"(?:%b%b%b%b|(?!%b)%b)" % (q, body, q, rest, q, rest)
    begun = rb"%b%b" % (q, body)
    return (re.compile(rb"(?:%b%b)*+%b" % (cell, s, begun), re.S),
            re.compile(rb"%b(?:%b%b(?:%b%b)*+%b%b)?+" % (body, q, rest, s, cell, s, begun), re.S))


def states_before(flips: np.ndarray, fixed: np.ndarray, value: np.ndarray, state: bool) -> tuple[np.ndarray, bool]:
    """The state before every line, and after the last: a line fixes the state to ``value``, flips it, or leaves it."""
    turns = np.concatenate([[0], np.cumsum(flips & ~fixed)])
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(fixed)), -1)) if len(fixed) else np.empty(0, np.int64)
    last = np.concatenate([[-1], last])
    start = np.where(last >= 0, value[np.maximum(last, 0)] if len(value) else False, state)
    after = start ^ ((turns - turns[np.where(last >= 0, last + 1, 0)]) % 2 == 1)
    return after[:-1], bool(after[-1])


def _lines(spark: SparkSession, path: str, sep: str, quote: str, escape: str, comment: str | None) -> DataFrame:
    outside_pattern, inside_pattern = quote_patterns(sep.encode(), quote.encode(), escape.encode())
    mark = quote.encode()
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("line", pa.string()), ("outside", pa.int32()),
                        ("inside", pa.int32()), ("rows_outside", pa.int64()), ("rows_inside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, states, counts = None, 0, [False, True], [0, 0]
        for b in batches:
            files, blocks, lines = b.columns
            place = list(zip(files.to_pylist(), blocks.to_pylist()))
            cuts = [0, *[i for i in range(1, len(place)) if place[i] != place[i - 1]], len(place)]
            quoted = pc.match_substring(lines.cast(pa.binary()), mark).to_numpy(zero_copy_only=False)
            blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
            no_row = (blank if comment is None else pc.or_(blank, pc.starts_with(lines, comment))).to_numpy(zero_copy_only=False)
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if place[a] != key:
                    key, at, states, counts = place[a], 0, [False, True], [0, 0]
                n = z - a
                # without a quote a line leaves the state as it is
                opens, stays, row = np.zeros(n, bool), np.ones(n, bool), ~no_row[a:z]
                part = lines.slice(a, n)
                for i in np.flatnonzero(quoted[a:z]):
                    line = part[int(i)].as_py().encode()
                    # a quote in a comment opens nothing
                    opens[i], stays[i] = bool(row[i] and outside_pattern.fullmatch(line)), inside_pattern.fullmatch(line) is not None
                made = []
                for h in (0, 1):
                    before, states[h] = states_before(opens & ~stays, opens == stays, opens, states[h])
                    after = np.append(before[1:], states[h])
                    begins = ~before & row
                    upto = counts[h] + np.cumsum(begins)
                    counts[h] = int(upto[-1])
                    made.append((pa.array((before * BEFORE + after * AFTER + begins * BEGINS).astype(np.int32)), pa.array(upto.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([files.slice(a, n), blocks.slice(a, n), pa.array(np.arange(at, at + n)), part,
                                                  made[0][0], made[1][0], made[0][1], made[1][1]], schema=schema)
                at += n

    scan = spark.read.option("lineSep", "\n").text(path)
    tagged = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return materialise(tagged.mapInArrow(run, LINES))


def _ranges(lines: DataFrame) -> DataFrame:
    """One row per range: whether it begins inside a cell, and the rows and header rows before it (header: a file's first row)."""
    ends = lines.groupBy("file", "block").agg(F.max_by(F.struct("outside", "inside", "rows_outside", "rows_inside"), "at").alias("e"))
    ends = ends.select("file", "block", ((F.col("e.outside") / AFTER).cast("int") % 2 == 1).alias("from_outside"),
                       ((F.col("e.inside") / AFTER).cast("int") % 2 == 1).alias("from_inside"), "e.rows_outside", "e.rows_inside")
    in_file = W.partitionBy("file").orderBy("block")
    earlier, upto = in_file.rowsBetween(W.unboundedPreceding, -1), in_file.rowsBetween(W.unboundedPreceding, 0)
    fixes = F.col("from_outside") == F.col("from_inside")
    turns = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int"))
    ends = ends.withColumn("turns", turns.over(upto)).withColumn("turns_before", F.coalesce(turns.over(earlier), F.lit(0)))
    fix = F.last(F.when(fixes, F.struct("from_outside", "turns")), ignorenulls=True).over(earlier)
    flipped = (F.col("turns_before") - F.coalesce("fix.turns", F.lit(0))) % 2 == 1
    ends = ends.withColumn("fix", fix).withColumn("begins_inside", F.coalesce("fix.from_outside", F.lit(False)) != flipped)
    rows = F.when(F.col("begins_inside"), F.col("rows_inside")).otherwise(F.col("rows_outside"))
    ends = ends.withColumn("rows", rows).withColumn("ends_inside", F.when(F.col("begins_inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
    ends = ends.withColumn("rows_in_file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    ends = ends.withColumn("open_end", (F.lead("block").over(in_file)).isNull() & F.col("ends_inside"))
    ends = materialise(ends.select("file", "block", "begins_inside", "rows", "rows_in_file", "open_end"))
    heads = ((F.col("rows_in_file") == 0) & (F.col("rows") > 0)).cast("long")
    total = running_totals(ends, [], ["file", "block"], {"rows_upto": F.col("rows"), "heads": heads})
    return materialise(total.select("file", "block", "begins_inside", "rows_in_file", (F.col("rows_upto") - F.col("rows")).alias("rows_before"), "heads", "rows", "open_end"))


def numbered_records(spark: SparkSession, path: str, header: bool = True, sep: str = ",", quote: str = '"', escape: str = '"',
                     comment: str | None = None) -> DataFrame:
    """record, position: the text of every row below the headers and its 0-based place in (file, offset) order."""
    lines = _lines(spark, path, sep, quote, escape, comment)
    ranges = _ranges(lines)
    seen = ranges.agg(F.max(F.struct("open_end", "file")).alias("open"), F.sum("rows").alias("rows"), F.max("heads").alias("heads")).first()
    if seen["open"] and seen["open"]["open_end"]:
        raise ValueError(f"malformed: {seen['open']['file']} ends inside a quoted cell")
    if (seen["rows"] or 0) - (seen["heads"] if header else 0) * bool(seen["rows"]) <= 0:
        raise ValueError(f"{path} contains no rows")
    of = lambda plain, quoted: F.when(F.col("begins_inside"), F.col(quoted)).otherwise(F.col(plain))
    placed = lines.join(ranges, ["file", "block"]).select(
        "file", "block", "at", "line", of("outside", "inside").alias("bits"), of("rows_outside", "rows_inside").alias("n"), "rows_in_file", "rows_before", "heads")
    placed = placed.withColumn("row", F.col("rows_in_file") + F.col("n"))
    position = F.col("rows_before") + F.col("n") - 1 - (F.col("heads") if header else F.lit(0))
    below = F.col("row") > (1 if header else 0)
    whole = placed.filter((F.col("bits") == BEGINS) & below).select(F.col("line").alias("record"), position.alias("position"))
    several = placed.filter(((F.col("bits").bitwiseAND(F.lit(BEFORE | AFTER))) > 0) & below)
    joined = several.groupBy("file", "row").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"), F.min(position).alias("position"))
    long = joined.select(F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"), "position")
    bare = F.when(F.endswith("record", F.lit("\r")), F.substr("record", F.lit(1), F.char_length("record") - 1)).otherwise(F.col("record"))
    return whole.unionAll(long).select(bare.alias("record"), "position")
