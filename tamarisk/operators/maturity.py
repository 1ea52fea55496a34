"""Maturity assessment and readiness scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.operators import roles


def level(score: Column) -> Column:
    """Named level of a score; a score between two bands has no band and falls to the lowest."""
    out = F.when(F.lit(False), "")
    for low, high, name in P.MATURITY_LEVELS:
        out = out.when(score.between(F.lit(low), F.lit(high)), name)
    return out.otherwise(P.MATURITY_LEVELS[0][2])


def band(pct: Column) -> Column:
    return F.when(pct >= P.COMPLIANCE_HIGH, "high").when(pct >= P.COMPLIANCE_MEDIUM, "medium").otherwise("low")


def domain_table(spark: SparkSession) -> DataFrame:
    weight = lambda code: P.PDP_WEIGHT_PCT if code == "PDP" else P.DOMAIN_WEIGHT_PCT
    return P.inline_table(spark, "domain_no, code, name, spec_count, is_oe, weight_pct", [(i, c, n, s, oe, weight(c)) for i, (c, n, s, oe) in enumerate(P.MATURITY_DOMAINS)])


def baseline_scores(spark: SparkSession) -> DataFrame:
    return P.inline_table(spark, "entity, code, maturity, compliance_pct", [(0, c, float(m), float(p)) for c, (m, p) in P.MATURITY_BASELINE.items()])


def domains(scores: DataFrame) -> DataFrame:
    """(entity, code, maturity, compliance_pct) with the domain's facts and status."""
    return scores.join(F.broadcast(domain_table(scores.sparkSession)), "code").withColumn("compliance_status", band(F.col("compliance_pct")))


def _exact(c: Column) -> Column:
    return F.round(c, 6).cast("decimal(20,6)")


def assess(scores: DataFrame) -> DataFrame:
    """Overall figures per entity; the 14-row domain table is the only other input."""
    d = domains(scores)
    n_oe = sum(oe for *_, oe in P.MATURITY_DOMAINS)
    specs = F.bround(F.col("spec_count") * F.col("compliance_pct") / 100, 0).cast("bigint")
    one = d.groupBy("entity").agg(
        F.sum(_exact(F.col("maturity") * F.col("weight_pct"))).alias("m"), F.sum(F.when(F.col("is_oe"), _exact(F.col("maturity")))).alias("oe"),
        F.sum(specs).alias("compliant_specs"), F.sum(F.col("spec_count").cast("bigint")).alias("total_specs"))
    overall = F.round(F.col("m").cast("double") / 100, 3)
    return one.select(
        "entity", overall.alias("overall_maturity"), F.round(overall * 20, 1).alias("display_score"), level(overall).alias("maturity_level"),
        F.round(100 * F.col("compliant_specs") / F.col("total_specs"), 1).alias("overall_compliance_pct"),
        F.round(F.coalesce(F.col("oe").cast("double"), F.lit(0.0)) / n_oe, 3).alias("overall_oe_score"), "compliant_specs", "total_specs")


def oe_split(scores: DataFrame) -> DataFrame:
    """Average maturity and compliance of operational-excellence domains against the others."""
    mean = lambda c: F.round(F.sum(_exact(F.col(c))).cast("double") / F.count(c), 4)
    return domains(scores).groupBy("entity", "is_oe").agg(F.count("*").alias("domains"), mean("maturity").alias("avg_maturity"), mean("compliance_pct").alias("avg_compliance"))


def priorities(scores: DataFrame, k: int = 6) -> DataFrame:
    """The k least compliant domains of each entity (at most 14 rows each), with the bar length."""
    w = W.partitionBy("entity")
    longest = F.greatest(F.max("compliance_pct").over(w), F.lit(1.0))
    out = domains(scores).withColumns({
        "priority": F.row_number().over(w.orderBy("compliance_pct", "domain_no")),
        "bar_share": F.round(F.col("compliance_pct") / longest, 4)})
    return out.where(F.col("priority") <= k).select("entity", "code", "compliance_pct", "priority", "bar_share")


# ---- readiness scorecards ---------------------------------------------------------------

def scorecard_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a label, as (keys, row_pos, label, current, target).

    Where a sheet's "current" column averages above its "target", the two are swapped.
    """
    current, target, label = roles.scorecard_roles(df.drop(*keys, "row_pos"))
    rows = df.select(*keys, "row_pos", (F.col(label) if label else F.lit("Domain")).cast("string").alias("label"),
                     F.col(current).cast("double").alias("c"), F.col(target).cast("double").alias("t")).where("label IS NOT NULL")
    means = rows.groupBy(*keys).agg(
        (F.sum(_exact(F.col("c"))) * F.count("t") > F.sum(_exact(F.col("t"))) * F.count("c")).alias("swapped"))
    swapped = F.coalesce("swapped", F.lit(False))
    return rows.join(means, keys).select(*keys, "row_pos", "label", F.when(swapped, F.col("t")).otherwise(F.col("c")).alias("current_score"),
                         F.when(swapped, F.col("c")).otherwise(F.col("t")).alias("target_score"))


def readiness(rows: DataFrame, keys: list[str]) -> DataFrame:
    mean = lambda c: F.sum(_exact(F.col(c))).cast("double") / F.nullif(F.count(c), F.lit(0))
    one = rows.groupBy(*keys).agg(F.count("*").alias("domain_count"), mean("current_score").alias("c"), mean("target_score").alias("t"))
    return one.select(*keys, "domain_count", F.round("c", 2).alias("avg_current"), F.round("t", 2).alias("avg_target"),
                      F.round(F.col("c") / F.nullif("t", F.lit(0.0)) * 100, 1).alias("readiness_index"))


def top_gaps(rows: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k widest gaps per scorecard, earliest row first on a tie (the ranking is cut before the shuffle)."""
    gap = F.round(F.col("target_score") - F.col("current_score"), 2)
    order = W.partitionBy(*keys).orderBy(F.desc_nulls_last("gap"), "row_pos")
    return rows.withColumn("gap", gap).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
