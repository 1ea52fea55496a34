"""Distribution drift of columns between a reference slice and a current slice."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.session import materialise

SERIES_TERMS = 100
CELLS = 4096             # stretches into which the values of a feature are cut in a pass
FEW_VALUES = 1 << 16     # open values that are settled one by one on the driver
LOG_REACH = 1e-12        # of the largest magnitude: where a logarithmic grid begins

# Python workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shifted(df: DataFrame, feature: str, is_reference: Column, multiplier: float, offset: float) -> DataFrame:
    """Applies the test shift to one feature of the current slice only."""
    if feature not in df.columns:
        raise ValueError(f"unknown feature '{feature}'")
    return df.withColumn(feature, F.when(is_reference, F.col(feature)).otherwise(F.col(feature) * multiplier + offset))


def value_counts(df: DataFrame, features: list[str], is_reference: Column, kind: str, weight: Column | None = None) -> DataFrame:
    """(feature, value, n_reference, n_current): one pass over the rows, combined map-side.

    ``weight``: how many observations a row stands for, when the rows are counts already.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("value")) for f in features])
    times = F.lit(1) if weight is None else weight
    long = df.select(is_reference.alias("_ref"), times.cast("long").alias("_n"), F.explode(entries).alias("e")).where(F.col("e.value").isNotNull())
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0))
    return long.groupBy("e.feature", "e.value").agg(count(F.col("_ref")).alias("n_reference"), count(~F.col("_ref")).alias("n_current"))


def kolmogorov_p(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic."""
    x = F.sqrt(n.cast("double") * m / (n + m)) * statistic  # the product of two counts is beyond a long
    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), F.lit(0.0),
                         lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _observations(df: DataFrame, features: list[str], is_reference: Column, weight: Column | None) -> DataFrame:
    """(feature number, value, reference, current): one row for each value, counted nowhere yet."""
    entries = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f).cast("double").alias("value")) for k, f in enumerate(features)])
    times = (F.lit(1) if weight is None else weight).cast("long")
    long = df.select(is_reference.alias("_ref"), times.alias("_n"), F.explode(entries).alias("e")).where(F.col("e.value").isNotNull())
    count = lambda hit: F.coalesce(F.when(hit, F.col("_n")), F.lit(0).cast("long"))
    return long.select("e.feature", (F.col("e.value") + 0.0).alias("value"), count(F.col("_ref")).alias("reference"), count(~F.col("_ref")).alias("current"))


def _cell(value: Column, lo: Column, hi: Column, cells: Column) -> Column:
    """The stretch of [lo, hi] that holds a value: never lower for a higher value, first for lo, last for hi.

    Logarithmic where the ends differ much in magnitude or sign, else linear; infinities and NaN are alone.
    """
    largest = F.greatest(F.abs(lo), F.abs(hi))
    log = lambda x: F.signum(x) * F.log1p(F.abs(x) / largest / LOG_REACH)
    wide = (F.signum(lo) != F.signum(hi)) | (F.greatest(F.abs(lo), F.abs(hi)) > 4 * F.least(F.abs(lo), F.abs(hi)))
    place = lambda x, a, b: F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * cells)
    inside = F.when(lo == hi, 0).when(wide, place(log(value), log(lo), log(hi))).otherwise(place(value, lo, hi)).cast("int")
    kept = F.when(value == lo, 0).when(value == hi, cells).otherwise(F.greatest(F.lit(0), F.least(cells, inside)))
    return F.when(F.isnan(value), cells + 2).when(value == float("inf"), cells + 1).when(value == float("-inf"), -1).otherwise(kept).cast("int")


def _in_cells(rows: DataFrame, stretches: list[tuple]) -> DataFrame:
    """The rows with the number and the cell of their stretch (number, feature, lo, hi, cells): as many rows as open stretches."""
    known = rows.sparkSession.createDataFrame(stretches, "stretch int, feature int, lo double, hi double, cells int")
    on = ["stretch"] if "stretch" in rows.columns else ["feature"]
    met = rows.join(F.broadcast(known if on == ["feature"] else known.drop("feature")), on)
    return met.select("stretch", "feature", "value", "reference", "current", _cell(F.col("value"), F.col("lo"), F.col("hi"), F.col("cells")).alias("cell"))


class _Gaps:
    """Largest gap found so far for each feature, and which stretches between known places can still beat it."""

    def __init__(self, sizes: dict[int, tuple[int, int]]):
        self.sizes, self.best = sizes, dict.fromkeys(sizes, 0.0)

    def settle(self, feature: int, before: tuple[int, int], steps: np.ndarray) -> list[tuple[int, tuple[int, int]]]:
        """(step, counts before it) of the steps inside which a larger gap may lie; ``steps``: reference, current, single value or not."""
        n, m = self.sizes[feature]
        ends = np.cumsum(steps[:, :2], axis=0) + np.array(before, np.int64)
        begins = np.vstack([[before], ends[:-1]])
        share = lambda counts: (counts[:, 0] / n, counts[:, 1] / m)
        (f1, h1), (f0, h0) = share(ends), share(begins)
        self.best[feature] = max(self.best[feature], float(np.abs(f1 - h1).max(initial=0.0)))
        most = np.maximum(f1 - h0, h1 - f0)
        return [(int(k), (int(begins[k, 0]), int(begins[k, 1]))) for k in np.flatnonzero((most > self.best[feature]) & (steps[:, 2] == 0))]


def numeric_drift(df: DataFrame, features: list[str], is_reference: Column, weight: Column | None = None, cells: int = CELLS, few: int = FEW_VALUES) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per numeric feature, exact, without a shuffle of values.

    A pass counts the rows of each cell of a grid over the values, so what is shuffled is bounded by tasks times
    cells. At the end of every cell the gap between the two distribution functions is known; inside a cell it
    cannot exceed the larger of both functions' cross differences. Only cells in which a larger gap than the best
    may lie are cut again, and only their rows are written for the next pass. Once few values are left they are
    counted one by one.
    """
    spark = df.sparkSession
    rows = _observations(df, features, is_reference, weight)
    finite = F.when(F.abs(F.col("value")) < float("inf"), F.col("value"))
    whole = rows.groupBy("feature").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.sum("reference").alias("n"), F.sum("current").alias("m")).collect()
    sizes = {r.feature: (r.n, r.m) for r in whole}
    gaps = _Gaps({f: nm for f, nm in sizes.items() if nm[0] and nm[1]})
    stretches = [(r.feature, r.feature, r.lo, r.hi, cells) for r in whole if r.feature in gaps.sizes]
    before = {s[0]: (0, 0) for s in stretches}
    while stretches:
        placed = _in_cells(rows, stretches)
        steps = placed.groupBy("stretch", "feature", "cell").agg(
            F.sum("reference"), F.sum("current"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*")).toPandas()
        steps = steps.sort_values(["stretch", "cell"])
        steps["single"] = (steps.lo == steps.hi) | (steps.lo.isna())
        by_stretch = [(int(s), int(part.feature.iloc[0]), part) for s, part in steps.groupby("stretch")]
        for _ in range(2):  # the second time against the best of all stretches
            found = [(s, f, part, k, b) for s, f, part in by_stretch
                     for k, b in gaps.settle(f, before[s], part[["sum(reference)", "sum(current)", "single"]].to_numpy(np.int64))]
        if not found:
            break
        size = max(2, cells * len(features) // len(found))
        nearer = [(j, f, float(part.lo.iloc[k]), float(part.hi.iloc[k]), size) for j, (_, f, part, k, _) in enumerate(found)]
        now = spark.createDataFrame([(s, int(part.cell.iloc[k]), j) for j, (s, _, part, k, _) in enumerate(found)], "stretch int, cell int, next int")
        left = sum(int(part["count(1)"].iloc[k]) for _, _, part, k, _ in found)
        open_rows = placed.join(F.broadcast(now), ["stretch", "cell"]).select(F.col("next").alias("stretch"), "feature", "value", "reference", "current")
        before = {j: b for j, (_, _, _, _, b) in enumerate(found)}
        if left <= few:
            values = open_rows.groupBy("stretch", "feature", "value").agg(F.sum("reference"), F.sum("current")).toPandas().sort_values(["stretch", "value"])
            for s, part in values.groupby("stretch"):
                gaps.settle(int(part.feature.iloc[0]), before[int(s)], part[["sum(reference)", "sum(current)"]].assign(single=1).to_numpy(np.int64))
            break
        rows, stretches = materialise(open_rows), nearer
    results = [(features[f], "ks", n, m, gaps.best.get(f)) for f, (n, m) in sorted(sizes.items())]
    found = spark.createDataFrame(results, "feature string, test string, n long, m long, statistic double")
    return found.withColumn("p_value", kolmogorov_p(F.col("statistic"), F.col("n"), F.col("m")))


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail for whole degrees of freedom (one value per feature)."""

    def tail(x: float, k: int) -> float:
        if k <= 0 or x <= 0:
            return 1.0
        half = x / 2
        if k % 2 == 0:
            term = total = math.exp(-half)
            for i in range(1, k // 2):
                term *= half / i
                total += term
            return total
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) / math.sqrt(math.pi * half)
        for i in range(k // 2):
            term *= half / (i + 0.5)
            total += term
        return min(total, 1.0)

    return pd.Series([tail(float(x), int(k)) if x == x else None for x, k in zip(statistic, dof)], dtype="float64")


def categorical_drift(df: DataFrame, features: list[str], is_reference: Column, weight: Column | None = None) -> DataFrame:
    """Chi-square test of homogeneity per category feature, from the table of counts."""
    counts = value_counts(df, features, is_reference, "string", weight)
    sizes = counts.groupBy("feature").agg(F.sum("n_reference").alias("n"), F.sum("n_current").alias("m"), F.count("*").alias("values"))
    both = counts.join(F.broadcast(sizes), "feature")
    all_rows, of_value = F.col("n") + F.col("m"), F.col("n_reference") + F.col("n_current")

    def part(observed: str, size: str) -> Column:
        expected = of_value.cast("double") * F.col(size) / all_rows
        return F.when(expected > 0, F.pow(F.col(observed) - expected, F.lit(2.0)) / expected).otherwise(0.0)

    cell = F.round(part("n_reference", "n") + part("n_current", "m"), 10).cast("decimal(30,10)")
    one = both.groupBy("feature").agg(F.sum(cell).cast("double").alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"), (F.first("values") - 1).alias("dof"))
    return one.select("feature", F.lit("chi_square").alias("test"), "n", "m", "statistic", chi_square_p("statistic", F.col("dof")).alias("p_value"))


def strongest(results: DataFrame, k: int = 5) -> DataFrame:
    return results.orderBy(F.asc("p_value"), "feature").limit(k)


def drift_share(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    return results.agg(F.count("*").alias("metric_count"), F.count_if(F.col("p_value") < alpha).alias("drifted"))
