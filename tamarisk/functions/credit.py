"""Per-loan credit expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarisk import params as P


def remaining_years(maturity: Column, reporting_date: str, data_type: str = "string") -> Column:
    """Years to maturity, at least 0.1; null when the date is missing or unreadable."""
    due = F.try_to_date(maturity) if data_type == "string" else maturity.cast("date")
    years = F.datediff(due, F.lit(reporting_date).cast("date")) / F.lit(365.25)
    return F.when(years < 0.1, F.lit(0.1)).otherwise(years)


def lifetime_pd(pd: Column, years: Column) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - pd, years)


def capped(x: Column) -> Column:
    """At most 1; null stays null."""
    return F.when(x > 1.0, F.lit(1.0)).otherwise(x)


def dpd_stage(dpd: Column) -> Column:
    return F.when(dpd > 90, 3).when(dpd >= 30, 2).otherwise(1)


def total(x: Column) -> Column:
    """Sum in whole millionths: exact, so it does not depend on the order of addition.

    Millionths of most loans fit a long, which keeps the per-row work off arbitrary-precision
    arithmetic. From 10^12 on a double has no millionths left to round: such amounts are whole
    numbers of millionths as they are, and are summed apart. An infinite amount is an error of the data and
    ends the query: left out it would make the total look whole. NaN counts as missing.
    """
    x = F.when(F.abs(x) == float("inf"), F.raise_error(F.lit("an amount is infinite")).cast("double")).otherwise(F.nanvl(x, F.lit(None).cast("double")))
    large = F.abs(x) >= 1e12
    small = F.sum(F.when(large, F.lit(0)).otherwise(F.floor(x * 1e6 + 0.5)).cast("decimal(18,0)"))
    return small + F.coalesce(F.sum(F.when(large, (x * 1e6).cast("decimal(32,0)"))), F.lit(0))


def amount(total_millionths: Column, places: int = 2) -> Column:
    return F.round(total_millionths * F.lit("0.000001").cast("decimal(7,6)"), places).cast("double")


def scenario_loss(pd: Column, lgd: Column, ead: Column, scenario: str) -> Column:
    pd_factor, lgd_factor, _ = P.SCENARIOS[scenario]
    return capped(pd * F.lit(pd_factor)) * capped(lgd * F.lit(lgd_factor)) * ead
