"""Sensitivity tiers of columns, from their names, with completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions.text import matched_keyword, normal_name


def classify(columns: DataFrame) -> DataFrame:
    """(dataset, pos, column_name, null_count, rows) with tier, matched keyword, completeness."""
    name = normal_name(F.col("column_name"))
    restricted = matched_keyword(name, P.RESTRICTED_KEYWORDS)
    confidential = matched_keyword(name, P.CONFIDENTIAL_KEYWORDS)
    complete = F.round(100 * (F.col("rows") - F.col("null_count")) / F.nullif(F.col("rows"), F.lit(0)), 1)
    return (columns.withColumn("tier", F.when(restricted.isNotNull(), "RESTRICTED").when(confidential.isNotNull(), "CONFIDENTIAL").otherwise("INTERNAL"))
            .withColumn("matched_keyword", F.coalesce(restricted, confidential))
            .withColumn("is_identifier", matched_keyword(name, P.IDENTIFIER_KEYWORDS).isNotNull())
            .withColumn("completeness_pct", complete))


def coverage(classified: DataFrame) -> DataFrame:
    personal = F.col("tier") != "INTERNAL"
    mean = F.avg(F.when(personal, F.col("completeness_pct").cast("decimal(5,1)")))
    return classified.groupBy("dataset").agg(
        F.count("*").alias("columns"), F.count_if(F.col("tier") == "RESTRICTED").alias("restricted"),
        F.count_if(F.col("tier") == "CONFIDENTIAL").alias("confidential"), F.count_if(F.col("tier") == "INTERNAL").alias("internal"),
        F.round(mean, 1).cast("double").alias("personal_completeness_pct"))
