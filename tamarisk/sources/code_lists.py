"""Standard code lists a fresh registry is seeded with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk import params as P

COUNTRIES, CURRENCIES, REGIONS = "iso-country-codes", "iso-currency-codes", "saudi-administrative-regions"


def standard_values(spark: SparkSession, countries: DataFrame) -> DataFrame:
    """(slug, code, label); ``countries`` is the published list (code, label), as a file or table of the user's."""
    fixed = {CURRENCIES: P.CURRENCIES, REGIONS: P.ADMIN_REGIONS}
    rows = P.inline_table(spark, "slug, code, label", [(slug, c, n) for slug, values in fixed.items() for c, n in values])
    return countries.select(F.lit(COUNTRIES).alias("slug"), F.col("code").cast("string").alias("code"), "label").unionByName(rows)
