"""Compliance scores from measured signals only; an unmeasured domain stays null.

"Never checked" is not zero and not a hundred: scores that need a duplicate check are null
until one has run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P


def _total(map_column):
    return F.aggregate(F.map_values(map_column), F.lit(0).cast("bigint"), lambda a, x: a + x)


def signals(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Registry rows (with a ``checked`` flag) next to their cluster counts."""
    counts = decisions.groupBy(F.col("dataset").alias("safe_name")).agg(
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") != "pending").alias("decided"),
        F.sum(F.when(F.col("status") == "pending", F.col("size")).otherwise(0)).alias("records_pending"),
        F.count_if(F.col("status") == "confirmed_duplicate").alias("confirmed"),
        F.sum(F.when(F.col("status") == "confirmed_duplicate", F.greatest(F.col("size") - 1, F.lit(0))).otherwise(0)).alias("extra_records"))
    zero = {c: 0 for c in ("pending", "decided", "records_pending", "confirmed", "extra_records")}
    return registry.join(counts, "safe_name", "left").fillna(zero, list(zero))


def scores(signal: DataFrame) -> DataFrame:
    rows, cells = F.col("rows"), F.size("columns") * F.col("rows")
    nulls = _total("null_counts")
    dq = F.when((nulls > 0) & (rows > 0), F.greatest(F.lit(0.0), 100 - 100 * nulls / F.nullif(cells, F.lit(0)))).otherwise(100.0)
    has_pii = lambda c: F.exists(F.array(*[F.lit(k) for k in P.PII_KEYWORDS]), lambda k: F.contains(F.lower(c), k))
    pii = F.filter("columns", has_pii)
    pii_nulls = _total(F.map_filter("null_counts", lambda k, v: has_pii(k)))
    pdp = F.when((F.size(pii) > 0) & (rows > 0), F.greatest(F.lit(0.0), 100 - 100 * pii_nulls / F.nullif(F.size(pii) * rows, F.lit(0))))
    reviewed = F.col("pending") + F.col("decided")
    dg = F.when(F.col("checked"), F.coalesce(100 * F.col("decided") / F.nullif(reviewed, F.lit(0)), F.lit(100.0)))
    rmd = F.when(F.col("checked"), F.coalesce(100 * F.greatest(F.lit(0), rows - F.col("records_pending")) / F.nullif(rows, F.lit(0)), F.lit(100.0)))
    measured = {"DG": dg, "DQ": dq, "RMD": rmd, "PDP": pdp}
    out = signal
    for code, value in measured.items():
        out = out.withColumn(f"score_{code}", F.round(value, 1))
    return out


def domain_rows(scored: DataFrame) -> DataFrame:
    measured = {"DG", "DQ", "RMD", "PDP"}
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("code"), F.lit(n).alias("name"),
                              (F.col(f"score_{c}") if c in measured else F.lit(None).cast("double")).alias("score"))
                     for i, (c, n) in enumerate(P.COMPLIANCE_DOMAINS)])
    out = scored.select(F.col("safe_name").alias("dataset"), F.inline(rows))
    return out.withColumn("status", F.when(F.col("score").isNull(), "not_measured").otherwise("measured"))


def checks(scored: DataFrame) -> DataFrame:
    """Five report lines per dataset with status and the figure behind it."""
    ok = lambda c: F.when(c, "ok").otherwise("warn")
    after_check = lambda c: F.when(F.col("checked"), ok(c)).otherwise("not_measured")
    ready = F.size(F.array_intersect("columns", F.array(*[F.lit(c) for c in P.MODELLING_COLUMNS]))) == len(P.MODELLING_COLUMNS)
    figure = lambda c: c.cast("double")
    lines = [
        ("Data Governance", after_check(F.col("score_DG") >= 80), figure(F.col("score_DG"))),
        ("MDM", after_check(F.col("pending") == 0), F.when(F.col("checked"), figure(F.col("pending")))),
        ("Data Classification", F.lit("not_measured"), F.lit(None).cast("double")),
        ("PDPL", ok(F.coalesce("score_PDP", F.lit(0.0)) >= 90), figure(F.col("score_PDP"))),
        ("IFRS 9 readiness", ok(ready), F.when(ready, 1.0).otherwise(0.0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(l).alias("label"), s.alias("status"), v.alias("figure")) for i, (l, s, v) in enumerate(lines)])
    return scored.select(F.col("safe_name").alias("dataset"), F.inline(rows))


def alerts(scored: DataFrame) -> DataFrame:
    """The one thing to look at first: no check yet, open reviews, else the lowest measured domain."""
    order = [(i, c, n) for i, (c, n) in enumerate(P.COMPLIANCE_DOMAINS) if c in ("DG", "DQ", "RMD", "PDP")]
    entries = F.array(*[F.struct(F.col(f"score_{c}").alias("score"), F.lit(i).alias("pos"), F.lit(n).alias("name")) for i, c, n in order])
    lowest = F.array_min(F.filter(entries, lambda e: e["score"].isNotNull()))
    return scored.select(
        F.col("safe_name").alias("dataset"),
        F.when(~F.col("checked"), "check_never_run").when(F.col("pending") > 0, "pending_reviews").when(lowest.isNotNull(), "lowest_domain").otherwise("nothing_measured").alias("alert"),
        F.when(~F.col("checked"), "duplicate detection has not been run")
        .when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" duplicate cluster(s) still need review")))
        .when(lowest.isNotNull(), F.concat(lowest["name"], F.lit(" is lowest"))).otherwise("no measured domain").alias("message"))


def average(domain: DataFrame) -> DataFrame:
    """Mean of the measured domains per dataset; null when none is."""
    mean = F.sum(F.col("score").cast("decimal(6,1)")).cast("double") / F.nullif(F.count("score"), F.lit(0))
    return domain.groupBy("dataset").agg(F.count("score").alias("measured"), F.round(mean, 1).alias("average_score"))


def customer_360(signal: DataFrame) -> DataFrame:
    golden = F.greatest(F.col("rows") - F.col("extra_records"), F.lit(0))
    when_checked = lambda c: F.when(F.col("checked"), c)
    return signal.select(
        F.col("safe_name").alias("dataset"), F.col("rows").alias("total_records"), when_checked(golden).alias("golden_estimate"),
        when_checked(F.round(100 * golden / F.nullif("rows", F.lit(0)), 1)).alias("uniqueness_pct"), F.lit(P.UNIQUENESS_TARGET).alias("uniqueness_target"),
        when_checked(F.col("confirmed")).alias("clusters_confirmed"), when_checked(F.col("extra_records")).alias("extra_records"))
