"""Access decisions over a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P


def gate(requests: DataFrame) -> DataFrame:
    """Restricted data needs an approved override; drift validation is always audited."""
    label = F.coalesce("classification", F.lit("UNSPECIFIED"))
    blocked = (label == "RESTRICTED") & ~F.coalesce("override_approved", F.lit(False))
    rules = (F.when(blocked, F.array(F.lit("restricted-data-requires-override")))
             .when(F.col("intent") == "validate_drift", F.array(F.lit("validate-drift-requires-audit-log")))
             .otherwise(F.array().cast("array<string>")))
    note = F.when(blocked, F.lit("blocked: restricted data without an approved override")).otherwise(
        F.concat(F.lit("'"), label, F.lit("' cleared for '"), F.col("intent"), F.lit("'")))
    return requests.withColumns({"allowed": ~blocked, "applied_rules": rules, "note": note})


def role_policy(requests: DataFrame, grants: dict[str, tuple[str, ...]] = P.POLICY_GRANTS) -> DataFrame:
    """Allowed when any role of the user is granted; an unknown rule denies."""
    granted = F.create_map(*[x for rule, roles in grants.items() for x in (F.lit(rule), F.array(*[F.lit(r) for r in roles]))])
    held = F.transform(F.split(F.coalesce("roles", F.lit("")), ","), F.trim)
    return requests.withColumn("allowed", F.coalesce(F.arrays_overlap(held, F.try_element_at(granted, F.col("rule"))), F.lit(False)))
