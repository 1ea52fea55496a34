"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (a piecewise-linear curve). Its integral,
scaled so that it ends at the source's target, is the cumulative demand for the source's words. The
source's documents, in a fixed shuffled order and repeated for as many passes as allowed, hold
intervals of its words; inverting the demand at the middle of a document's interval gives the time
at which that copy is trained. Copies whose middle is never demanded have no position and are not
taken, so a source's taken words miss its target by half a document at most.

Targets share ``SHARE`` of all words by weight; a source stops at ``MOST_REPEATS`` times its size
and the excess goes to the others by weight until none is above its stop.

The query writes the order of the taken copies, range-sorted by time, and reads from it what is taken; ``mixed`` sorts
the documents themselves by it.

Column expressions, aggregates and windows only. The running sum of a source is split over many
tasks; the one window without a key runs over one row per source.

Defined cases: a null source is a source, last in order; a null text has size 0; documents of size 0
have no words to take; sources of size 0 have target 0. Repeated rows are documents of their own.
An empty table gives no rows. Extra columns stay in ``mixed``; ``plan`` replaces columns of the names it adds;
working columns start with ``_m_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tamarisk.functions.ordered import running_totals
from tamarisk.llm.base import SPACE_CLASS, SPACES, table, text_or_empty, with_row_numbers
from tamarisk.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SEED = "mix"
# Weight schedules as (time, weight) knots, dealt to the sources in turn: early, steady, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``size``, the number of words."""
    bare = F.btrim(text_or_empty(text), F.lit(SPACES))
    return docs.withColumn("size", F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long"))


def sizes(docs: DataFrame, text: str = "text", *more: str) -> DataFrame:
    """doc_id, source, size as a written table: the order of a source is cut by a sample of it, and the texts are read once."""
    return materialise(sized(docs, text).select(*more, "doc_id", "source", "size"))


def targets(sized_docs: DataFrame) -> DataFrame:
    """source, source_size, rank, target, from rows of (source, size): water-filling by the ratio of stop and weight."""
    per = sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int"))
    per = per.withColumn("rank", rank).withColumn("_m_weight", weight)
    per = per.withColumn("_m_stop", F.col("source_size") * MOST_REPEATS).withColumn("_m_ratio", F.col("_m_stop") / F.col("_m_weight").cast("double"))
    order = W.orderBy("_m_ratio", "rank")
    all_rows = W.orderBy("_m_ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stopped = F.coalesce(F.sum("_m_stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("_m_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("_m_level", (F.sum("source_size").over(all_rows) * SHARE - stopped) / open_weight)
    is_open = F.col("_m_level") < F.col("_m_ratio")
    level = F.min(F.when(is_open, F.struct("_m_ratio", "rank", "_m_level"))).over(all_rows)["_m_level"]
    target = F.least(F.col("_m_stop").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("_m_weight"))
    return per.select("source", "source_size", "rank", target.alias("target"))


def inverse_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise-linear schedule reaches a share of its whole."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (t1 - t0) * (w0 + w1) / 2
    time = None
    for t0, w0, slope, before in reversed(pieces):
        need = share * total - before
        inside = F.lit(t0) + 2 * need / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + 2 * slope * need))
        time = inside if time is None else F.when(share * total < upper, inside).otherwise(time)
        upper = before
    return time


def plan(docs: DataFrame) -> DataFrame:
    """Adds source_size, target and ``positions`` (training time of each taken copy) to rows of (source, doc_id, size).

    Documents of a source are shuffled by a digest of their id, so that reruns agree.
    """
    docs = docs.drop("source_size", "target", "positions", "rank")
    keyed = docs.withColumn("_m_key", F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"))))
    placed = running_totals(keyed, ["source"], ["_m_key", "size"], {"_m_end": F.col("size")})
    per = targets(placed).withColumnRenamed("source", "_m_source")
    joined = placed.join(per, F.col("source").eqNullSafe(F.col("_m_source")))

    def position(copy: Column) -> Column:
        middle = copy * F.col("source_size") + F.col("_m_end") - F.col("size") / 2
        share = middle / F.col("target")
        time = inverse_demand(share, SCHEDULES[0])
        for k, knots in enumerate(SCHEDULES[1:], 1):
            time = F.when(F.col("rank") % len(SCHEDULES) == k, inverse_demand(share, knots)).otherwise(time)
        return F.when((F.col("size") > 0) & (middle < F.col("target")), time)

    passes = F.array(*[position(F.lit(k)) for k in range(MOST_REPEATS)])
    return joined.select(*docs.columns, "source_size", "target", F.array_compact(passes).alias("positions"))


def in_training_order(rows: DataFrame) -> DataFrame:
    """Rows of taken copies, range-sorted by training position."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "_m_position", "_m_row").sortWithinPartitions("_m_position", "_m_row")


def copies(placed: DataFrame, *more: str) -> DataFrame:
    """One row for each taken copy of a plan."""
    return placed.select("_m_row", *more, F.explode("positions").alias("_m_position"))


def mixed(docs: DataFrame, text: str = "text", scanned: bool = False) -> DataFrame:
    """The documents as trained: one row for each taken copy, range-sorted by training position; the columns stay.

    Rows get a number of their own, because ids may repeat; ``scanned`` as in with_row_numbers.
    """
    numbered = with_row_numbers(docs, "_m_row", scanned)
    placed = plan(sizes(numbered, text, "_m_row"))
    return in_training_order(numbered.join(copies(placed), "_m_row")).select(*docs.columns)


def training_order(placed: DataFrame) -> DataFrame:
    """The mix itself without the texts, written in training order: row, size and position of every taken copy."""
    return materialise(in_training_order(copies(placed, "size")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix, written in training order and read back, holds of each document.

    The positions are in billionths of the training time; null where a copy is not trained.
    """
    numbered = with_row_numbers(table(spark, sf_dir, "documents"), "_m_row", scanned=True)
    placed = materialise(plan(sizes(numbered, "text", "_m_row")))
    trained = training_order(placed).groupBy("_m_row").agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("_m_position")).alias("at"))
    at = [F.floor(F.get("at", F.lit(k)) * 1e9).cast("long").alias(f"position_{k + 1}") for k in range(MOST_REPEATS)]
    return placed.drop("positions").join(trained, "_m_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *at)


def _position_sql(copy: int) -> str:
    """The training time of a copy, from the curves of the three schedules solved by hand."""
    middle = f"({copy}.0e0 * source_size + upto - size / 2)"
    x = f"({middle} / target)"
    time = (f"CASE rank % 3 WHEN 0 THEN 2 * {x} / (1.5e0 + sqrt(2.25e0 - 2 * {x})) WHEN 1 THEN 2 * {x} / (1 + sqrt(1e0)) "
            f"ELSE CASE WHEN {x} < 0.3125e0 THEN 2 * {x} / (0.25e0 + sqrt(0.0625e0 + 3 * {x})) "
            f"ELSE 0.5e0 + 2 * ({x} - 0.3125e0) / (1 + sqrt(1 + 3 * ({x} - 0.3125e0))) END END")
    return f"CASE WHEN size > 0 AND {middle} < target THEN CAST(floor({time} * 1e9) AS BIGINT) END AS position_{copy + 1}"


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + rank % 3] AS weight, 2 * source_size AS stop FROM s),
r AS (SELECT *, CAST(stop AS DOUBLE) / weight AS ratio FROM w),
-- a source is stopped when the level that it would set together with all sources of a higher ratio is not below its ratio
v AS (SELECT a.*, (SELECT sum(source_size) FROM r) * 1.5e0 AS whole,
        (SELECT coalesce(sum(stop), 0) FROM r b WHERE (b.ratio, b.rank) < (a.ratio, a.rank)) AS stopped,
        (SELECT sum(weight) FROM r b WHERE (b.ratio, b.rank) >= (a.ratio, a.rank)) AS open_weight FROM r a),
l AS (SELECT (whole - stopped) / open_weight AS level FROM v WHERE (whole - stopped) / open_weight < ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size, rank, least(CAST(stop AS DOUBLE), coalesce((SELECT level FROM l), 'inf'::DOUBLE) * weight) AS target FROM r),
c AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '{SEED}', doc_id)), size ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (CAST(upto - size / 2 < target AS INT) + CAST(source_size + upto - size / 2 < target AS INT)) END AS BIGINT) AS taken,
       {_position_sql(0)}, {_position_sql(1)}
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source"""
