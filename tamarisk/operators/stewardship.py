"""Roles, policies, tasks, glossary and code lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions import text as X


def role_grid(datasets: DataFrame, assignments: DataFrame) -> DataFrame:
    """All five roles of every dataset, assigned or not."""
    grid = datasets.select("dataset", F.explode(F.array(*[F.lit(r) for r in P.STEWARD_ROLES])).alias("role"))
    return grid.join(assignments, ["dataset", "role"], "left").withColumn("assigned", F.col("assignee_name").isNotNull())


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Every parent with its number of children, zero when it has none."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def role_coverage(datasets: DataFrame, assignments: DataFrame) -> DataFrame:
    known = assignments.where(F.col("role").isin(*P.STEWARD_ROLES))
    out = child_counts(datasets.select("dataset"), known, "dataset", "roles_assigned")
    return out.withColumn("fully_assigned", F.col("roles_assigned") == len(P.STEWARD_ROLES))


def coverage_totals(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count("*").alias("datasets"), F.count_if("fully_assigned").alias("fully_assigned"))


def policies(datasets: DataFrame, settings: DataFrame) -> DataFrame:
    """Every dataset with its policy, if any, and the frequency's label."""
    label = F.initcap(F.replace(F.col("review_frequency"), F.lit("_"), F.lit("-")))
    known = settings.withColumn("_set", F.lit(True))
    return (datasets.select("dataset").join(known, "dataset", "left").withColumn("configured", F.coalesce("_set", F.lit(False)))
            .withColumn("frequency_label", F.when(F.col("review_frequency").isin(*P.REVIEW_FREQUENCIES), label)).drop("_set"))


CLOSED = ("done", "cancelled")


def task_list(tasks: DataFrame) -> DataFrame:
    """Open work first, newest first inside."""
    return tasks.withColumn("is_open", ~F.col("status").isin(*CLOSED)).orderBy(F.desc("is_open"), F.desc("id"))


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("dataset").agg(F.count("*").alias("tasks"), F.count_if(~F.col("status").isin(*CLOSED)).alias("open_tasks"))


def glossary(terms: DataFrame) -> DataFrame:
    return terms.withColumn("tag_list", X.tags(F.col("tags"))).orderBy(F.lower("term"))


def search_terms(terms: DataFrame, text: str) -> DataFrame:
    q = text.strip().lower()
    hit = X.contains_ci(F.col("term"), q) | X.contains_ci(F.col("definition"), q) | F.exists("tag_list", lambda t: X.contains_ci(t, q))
    return glossary(terms).where(hit)


def used_domains(terms: DataFrame) -> DataFrame:
    return terms.groupBy("domain").agg(F.count("*").alias("terms")).orderBy("domain")


def search_values(values: DataFrame, text: str) -> DataFrame:
    q = text.strip().lower()
    return values.where(X.contains_ci(F.col("code").cast("string"), q) | X.contains_ci(F.col("label"), q)).orderBy(F.lower(F.col("code").cast("string")))


def labelled(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows with the label of their code; codes outside the list have none."""
    return rows.join(values.select(F.col("code").alias(column), F.col("label").alias(f"{column}_label")), column, "left")


def violations(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Codes outside the list with their number of rows: counted first, so only distinct codes are joined."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count("*").alias("rows"))
    return counts.join(values.select("code"), "code", "left_anti")


def seed_values(lists: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed values of the lists whose slug is not there yet."""
    return seeds.join(lists.select("slug"), "slug", "left_anti")
