"""Profiling, exact de-duplication and the Silver-to-Gold gate.

Silver keeps one row per distinct business row with the first position and the number of
raw copies, so every figure of the gate (before and after de-duplication) is one scan of
Silver and the raw rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.operators import roles

POSITION, COPIES = "_row_pos", "_copies"
BOOKKEEPING = {POSITION, COPIES}
TRACKED = 50  # values that a frequent-items buffer tracks, as a multiple of those allowed


def business_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in BOOKKEEPING]


def to_silver(raw: DataFrame) -> DataFrame:
    """Distinct business rows (nulls equal), first position kept; copies combine map-side."""
    return raw.groupBy(*business_columns(raw)).agg(F.min(POSITION).alias(POSITION), F.count("*").alias(COPIES))


def column_profile(silver: DataFrame, dataset: Column | str) -> DataFrame:
    """(dataset, pos, column_name, rows, raw_rows, null_count before, null_after) in one aggregate."""
    label = F.lit(dataset) if isinstance(dataset, str) else dataset
    cols = business_columns(silver)
    copies = F.col(COPIES) if COPIES in silver.columns else F.lit(1)
    raw_nulls = [F.sum(F.when(F.col(c).isNull(), copies).otherwise(0)).alias(f"b{i}") for i, c in enumerate(cols)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"a{i}") for i, c in enumerate(cols)]
    grouped = silver if isinstance(dataset, str) else silver.groupBy(label.alias("dataset"))
    one = grouped.agg(F.count("*").alias("rows"), F.coalesce(F.sum(copies), F.lit(0)).alias("raw_rows"), *raw_nulls, *nulls)
    entries = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column_name"), F.coalesce(f"b{i}", F.lit(0)).alias("null_count"),
                                 F.col(f"a{i}").alias("null_after")) for i, c in enumerate(cols)])
    name = label.alias("dataset") if isinstance(dataset, str) else F.col("dataset")
    return one.select(name, "rows", "raw_rows", F.inline(entries))


def hold_threshold(rows: Column) -> Column:
    return F.when(rows < P.SMALL_TABLE_ROWS, F.lit(P.SMALL_TABLE_NULL_HOLD)).otherwise(F.lit(P.NULL_HOLD))


def _gate_figures() -> list[Column]:
    rate = F.when(F.col("rows") > 0, F.col("null_count") / F.col("rows"))
    relevant = F.when(rate <= P.GOLD_DROP, rate)  # sparser columns are dropped by Gold anyway
    return [F.max("rows").alias("rows"), (F.max("raw_rows") - F.max("rows")).alias("duplicate_rows_removed"),
            F.coalesce(F.max(relevant), F.lit(0.0)).alias("max_null_rate")]


def _with_verdict(figures: DataFrame) -> DataFrame:
    held = F.col("max_null_rate") > hold_threshold(F.col("rows"))
    percent = lambda c: F.concat(F.format_number(F.bround(c * 100, 0), 0), F.lit("%"))
    small = F.when(F.col("rows") < P.SMALL_TABLE_ROWS, F.concat(F.lit(" (small-table threshold, "), F.col("rows").cast("string"), F.lit(" rows)"))).otherwise("")
    reason = F.concat(F.lit("a column is "), percent(F.col("max_null_rate")), F.lit(" null, over the "),
                      percent(hold_threshold(F.col("rows"))), F.lit(" auto-promotion threshold"), small)
    return (figures.withColumn("held", held).withColumn("stage", F.when(held, "silver_held").otherwise("gold"))
            .withColumn("hold_reason", F.when(held, reason)))


def gate(profile: DataFrame) -> DataFrame:
    """One row per dataset: counts, worst relevant null rate, held or not, and why."""
    return _with_verdict(profile.groupBy("dataset").agg(*_gate_figures()))


def sparse_columns(profile: DataFrame) -> DataFrame:
    """Columns more than half null in Silver: dropped on the way to Gold."""
    share = F.when(F.col("rows") > 0, F.col("null_after") / F.col("rows"))
    return profile.where(share > P.GOLD_DROP).select("dataset", "pos", "column_name", F.round(share, 4).alias("null_share"))


def to_gold(silver: DataFrame, dropped: list[str]) -> DataFrame:
    return silver.drop(*dropped, *BOOKKEEPING)


def numeric_summary(df: DataFrame) -> DataFrame:
    """Sum, mean, min and max of every quantity column that has a value; one aggregate.

    NaN counts as missing. Sums are exact: amounts below 10^18 to 8 places, amounts up to 10^36,
    whole numbers as doubles, apart; beyond that, and for infinities, as doubles.
    """
    cols = roles.quantity_columns(df.drop(*BOOKKEEPING))
    exprs = []
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        size = F.abs(x)
        exprs += [F.sum(F.when(size < 1e18, F.round(x, 8).cast("decimal(28,8)"))).alias(f"s{i}"),
                  F.sum(F.when((size >= 1e18) & (size < 1e36), x.cast("decimal(38,0)"))).alias(f"l{i}"), F.sum(F.when(size >= 1e36, x)).alias(f"e{i}"),
                  F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    two = lambda v: F.when(F.abs(v) < 1e15, F.round(v, 2)).otherwise(v)  # a larger double has no second place
    whole = lambda i: sum((F.coalesce(F.col(f"{k}{i}").cast("double"), F.lit(0.0)) for k in "le"), F.lit(0.0))
    total = lambda i: F.when(F.col(f"l{i}").isNull() & F.col(f"e{i}").isNull(), F.col(f"s{i}").cast("double")).otherwise(
        F.coalesce(F.col(f"s{i}").cast("double"), F.lit(0.0)) + whole(i))
    rounded = lambda i: F.when(F.col(f"l{i}").isNull() & F.col(f"e{i}").isNull(), F.round(f"s{i}", 2).cast("double")).otherwise(total(i))
    entries = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), rounded(i).alias("sum"),
        two(total(i) / F.nullif(f"n{i}", F.lit(0))).alias("mean"),
        two(F.col(f"lo{i}")).alias("min"), two(F.col(f"hi{i}")).alias("max")) for i, c in enumerate(cols)])
    return df.agg(*exprs).select(F.inline(entries)).where("n > 0").drop("n")


def top_categories(df: DataFrame, max_distinct: int = 20, top: int = 5, max_columns: int = 5) -> DataFrame:
    """Most frequent values of the first text columns with few distinct values.

    One aggregate over all rows: each column keeps a frequent-items buffer of bounded size, which is exact while it
    has seen fewer values than it tracks, and merges. A column is wide when it has more values, or when its counts do
    not add up to the rows; no value is shuffled by itself.
    """
    cols = roles.category_columns(df.drop(*BOOKKEEPING), max_columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long, rank int")
    buffers = [F.call_function("approx_top_k", F.col(c).cast("string"), F.lit(max_distinct + 2), F.lit(TRACKED * max_distinct)).alias(f"t{i}") for i, c in enumerate(cols)]
    seen = [F.approx_count_distinct(F.col(c), 0.05).alias(f"d{i}") for i, c in enumerate(cols)]
    one = df.agg(F.count("*").alias("rows"), *buffers, *seen)
    ranked = lambda i: F.array_sort(F.transform(F.filter(f"t{i}", lambda x: x["item"].isNotNull()), lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("value"))))
    exact = lambda i: (F.aggregate(f"t{i}", F.lit(0).cast("long"), lambda n, x: n + x["count"]) == F.col("rows")) & (F.col(f"d{i}") <= 2 * max_distinct)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(exact(i), ranked(i)).alias("values")) for i, c in enumerate(cols)])
    few = one.select(F.inline(entries)).where(F.size("values").between(1, max_distinct))
    return few.select("column_name", F.posexplode(F.slice("values", 1, top)).alias("at", "v")).select(
        "column_name", F.col("v.value").alias("value"), (-F.col("v.less")).alias("n"), (F.col("at") + 1).cast("int").alias("rank"))


def registry_rows(profile: DataFrame) -> DataFrame:
    """The dataset registry entry of each profiled dataset; null counts as a map of non-zero columns.

    The profile has one row per column, so the collected list is as long as the schema.
    """
    entry = F.struct("pos", "column_name", "null_count", "null_after")
    one = _with_verdict(profile.groupBy("dataset").agg(*_gate_figures(), F.array_sort(F.collect_list(entry)).alias("c")))
    with_nulls = F.filter("c", lambda x: x["null_count"] > 0)
    sparse = F.filter("c", lambda x: (F.col("rows") > 0) & (x["null_after"] > F.col("rows") * F.lit(P.GOLD_DROP)))
    names = lambda entries: F.transform(entries, lambda x: x["column_name"])
    return one.select(
        F.col("dataset").alias("safe_name"), "stage", "rows", names(F.col("c")).alias("columns"), "duplicate_rows_removed",
        F.map_from_entries(F.transform(with_nulls, lambda x: F.struct(x["column_name"], x["null_count"]))).alias("null_counts"),
        F.when(F.col("held"), F.array().cast("array<string>")).otherwise(names(sparse)).alias("dropped_columns"),
        names(sparse).alias("sparse_columns"), "hold_reason")


def promote(registry: DataFrame, safe_name: str) -> DataFrame:
    """Moves a held dataset to Gold, dropping its sparse columns; anything already there is left alone."""
    held = (F.col("safe_name") == safe_name) & (F.col("stage") == "silver_held")
    return (registry.withColumn("dropped_columns", F.when(held, F.col("sparse_columns")).otherwise(F.col("dropped_columns")))
            .withColumn("message", F.when(held, "promoted").when(F.col("safe_name") == safe_name, "already in gold"))
            .withColumn("stage", F.when(held, "gold").otherwise(F.col("stage"))))


def upload_summary(registry: DataFrame) -> DataFrame:
    """Rows in Gold or held, and the null share of the first e-mail column that has nulls."""
    email = F.filter("columns", lambda c: F.contains(F.lower(c), F.lit("email")) & F.map_contains_key("null_counts", c))
    nulls = F.try_element_at("null_counts", F.try_element_at(email, F.lit(1)))
    return registry.select("safe_name", F.col("rows").alias("total_rows"),
                           F.when(F.col("stage") == "gold", F.col("rows")).otherwise(0).alias("gold_rows"),
                           F.when(F.col("stage") == "silver_held", F.col("rows")).otherwise(0).alias("held_rows"),
                           F.round(100 * nulls / F.nullif("rows", F.lit(0)), 1).alias("email_null_pct"))
