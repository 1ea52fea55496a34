"""Silver to lakehouse tables, and the Gold results computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.operators import ecl, maturity, roles
from tamarisk.operators.profile import BOOKKEEPING
from tamarisk.sources import zones


def silver_to_table(silver: DataFrame, dataset: str) -> int:
    return zones.write_table(silver.drop(*BOOKKEEPING), f"silver.{dataset}")


def gold_compute(spark: SparkSession, dataset: str) -> DataFrame:
    """Always a one-row maturity table; a one-row credit-loss table only when the columns allow.

    Gives back the lineage rows (job, uri, direction) of what was really read and written.
    """
    silver = spark.table(zones.quoted(f"silver.{dataset}"))
    assessment = maturity.assess(maturity.baseline_scores(spark))
    outputs = [f"gold.{dataset}_ndi"]
    zones.write_table(assessment.select("display_score", "overall_compliance_pct", "maturity_level"), outputs[0])
    if roles.modelling_ready(silver.columns):
        loss = ecl.totals(ecl.per_loan(silver))
        outputs.append(f"gold.{dataset}_ifrs9")
        zones.write_table(loss.select("total_ecl", F.lit(P.REPORTING_DATE).alias("reporting_date"), F.lit("lookup").alias("engine_mode")), outputs[1])
    rows = [("gold_compute", f"silver.{dataset}", "input")] + [("gold_compute", t, "output") for t in outputs]
    return P.inline_table(spark, "job, uri, direction", rows)


def promote_dataset(spark: SparkSession, silver: DataFrame, dataset: str) -> DataFrame:
    """Table promotion followed by the Gold results, refusing an absent or empty Silver."""
    if silver.isEmpty():
        raise ValueError(f"Silver of '{dataset}' is empty")
    silver_to_table(silver, dataset)
    return gold_compute(spark, dataset)
