"""Change sets applied to tables: four operators and their validation.

Changes are few against a large base, so each operator joins the base once by key (small
change sets are broadcast by the adaptive planner) and first reduces them to one row per key.
"""

from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions.ordered import extreme_of_each, numbered
from tamarisk.functions.text import clean_text
from tamarisk.session import materialise

# Python workers get these functions by value: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 3                # of first claims, before what is left is grouped by shared values
GROUP_ROWS = 100_000      # changes that one task walks through

NO_KEY, TAKEN = "the key is missing", "the key is taken"


def keyed(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes that name a whole key; a change without one can neither match nor be matched."""
    return changes.dropna(subset=keys)


def without_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The other changes, with the reason why they are refused."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return changes.where(missing).withColumn("reason", F.lit(NO_KEY))


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key; of several last ones the greatest."""
    return extreme_of_each(keyed(changes, keys), keys, [order])


def first(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first change of each key; of several first ones the smallest."""
    return extreme_of_each(keyed(changes, keys), keys, [order], last=False)


def upsert_by_key(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with each key's last change in place; changes without a key are left out (see ``without_key``)."""
    new = latest(changes, keys, order).select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new keys added, every change not added and why)."""
    fresh = first(changes, keys, order).join(base.select(*keys), keys, "left_anti")
    accepted = base.unionByName(fresh.select(*base.columns))
    taken = keyed(changes, keys).exceptAll(fresh).withColumn("reason", F.lit(TAKEN))
    return accepted, taken.unionByName(without_key(changes, keys))


def _conflict_groups(open_: DataFrame, uniques: list[str]) -> DataFrame:
    """(place, group): open changes linked by shared values, directly or over others; the group is its first place.

    Each value links its changes to the first of them. A round hangs every place on the lowest neighbour of its
    neighbours (the larger ones, then the smaller ones), which at least halves long paths, so rounds grow with the
    logarithm of the longest path.
    """
    places = materialise(open_.select("_n", *uniques))
    links = reduce(DataFrame.unionByName, [
        places.join(places.groupBy(u).agg(F.min("_n").alias("b")), u).where("_n > b").select(F.col("_n").alias("a"), "b") for u in uniques])
    links, last = materialise(links.distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(small, "a")
        links = materialise(hung.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
        if now == last:
            break
        last = now
    return places.select("_n").join(links.select(F.col("a").alias("_n"), F.col("b").alias("group")), "_n", "left").withColumn("group", F.coalesce("group", "_n"))


def _walk(uniques: list[str]):
    """The places of one group that are accepted, when its changes come one after another."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        taken: list[set] = [set() for _ in uniques]
        won = []
        for n, *values in part[["_n", *uniques]].itertuples(index=False, name=None):
            if not any(v in t for v, t in zip(values, taken)):
                won.append(n)
                for v, t in zip(values, taken):
                    t.add(v)
        return pd.DataFrame({"_n": won}, dtype="int64")
    return run


def insert_unique(base: DataFrame, changes: DataFrame, uniques: list[str], order: str, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(table with the accepted changes added, every other change): each of several columns is unique by itself.

    As if the changes came one after another: one is refused when an earlier accepted one, or the table, has
    any of its values. A round accepts the changes that are the first undecided ones in all their values and
    refuses those that share a value with them; that settles all but long chains of conflicts. What is left after
    ``ROUNDS`` falls into groups that share no value: each of at most ``group_rows`` changes is walked through in
    order by one task, and only larger ones go on in rounds.
    """
    place = F.struct(order, *[c for c in changes.columns if c != order])
    named = keyed(changes, uniques)
    for u in uniques:
        named = named.join(base.select(u), u, "left_anti")
    # equal changes are one, and a change's number tells its place
    open_ = materialise(numbered(named.select(*changes.columns).distinct().withColumn("_place", place), [], ["_place"], "_n").drop("_place"))
    accepted, rounds = [], 0
    while not open_.isEmpty():
        if rounds == ROUNDS:
            few = open_.count() <= group_rows  # then all of them are one task's work
            grouped = open_.withColumn("group", F.lit(0)) if few else materialise(open_.join(_conflict_groups(open_, uniques), "_n"))
            sizes = grouped.groupBy("group").agg(F.count("*").alias("rows"))
            small = grouped.join(sizes.where(F.col("rows") <= group_rows), "group", "left_semi")
            won = materialise(small.groupBy("group").applyInPandas(_walk(uniques), "_n long"))
            accepted.append(materialise(open_.join(won, "_n", "left_semi")))
            open_ = materialise(grouped.join(sizes.where(F.col("rows") > group_rows), "group", "left_semi").select(*open_.columns))
            rounds += 1
            continue
        firsts = open_
        for u in uniques:
            firsts = firsts.join(open_.groupBy(u).agg(F.min("_n").alias("_first")), u).where(F.col("_n") == F.col("_first")).drop("_first")
        won = materialise(firsts.select(*open_.columns))
        accepted.append(won)
        rest = open_
        for u in uniques:
            rest = rest.join(won.select(u), u, "left_anti")
        open_, rounds = materialise(rest.select(*open_.columns)), rounds + 1
    fresh = reduce(DataFrame.unionByName, accepted, open_.limit(0)).select(*changes.columns)
    return base.unionByName(fresh.select(*base.columns)), changes.exceptAll(fresh)


def update_existing(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(table with the listed columns changed where given, changes of unknown or missing keys)."""
    last = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_new_{c}") for c in columns])
    joined = base.join(last, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c))
    return joined.select(*base.columns), changes.join(base.select(*keys), keys, "left_anti")


def delete_by_key(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Removes a key from every table (name -> (table, its key column)); also rows removed per table."""
    kept, counts = {}, None
    for name, (df, column) in tables.items():
        ids = gone.select(F.col(key).alias(column)).distinct()
        kept[name] = df.join(ids, column, "left_anti")
        n = df.join(ids, column, "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("removed"))
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def unknown_keys(changes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Change rows that point at something not registered."""
    return changes.join(known.select(key), key, "left_anti")


# ---- validation: every failed condition adds a reason ---------------------------------------

def required(column: str) -> tuple[Column, str]:
    return clean_text(F.col(column)).isNull(), f"{column} is required"


def member_of(column: str, allowed, optional: bool = False) -> tuple[Column, str]:
    inside = F.coalesce(F.col(column).isin(*allowed), F.lit(optional))
    return ~inside, f"{column} is not one of the allowed values"


def positive_integer(column: str) -> tuple[Column, str]:
    given = clean_text(F.col(column))
    value = F.when(given.rlike(r"^[+-]?[0-9]+$"), given.try_cast("bigint"))
    return given.isNotNull() & ~F.coalesce(value > 0, F.lit(False)), f"{column} must be a positive whole number"


def percentage(column: str) -> tuple[Column, str]:
    given = clean_text(F.col(column))
    return given.isNotNull() & ~F.coalesce(given.try_cast("double").between(0, 100), F.lit(False)), f"{column} must be between 0 and 100"


def validate(changes: DataFrame, conditions: list[tuple[Column, str]]) -> DataFrame:
    """Adds ``reasons`` (empty when the change is acceptable) and ``accepted``."""
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in conditions]))
    return changes.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def assignment_conditions() -> list[tuple[Column, str]]:
    return [member_of("role", P.STEWARD_ROLES), required("assignee_name"), required("assigned_by")]


def policy_conditions() -> list[tuple[Column, str]]:
    return [required("dataset"), positive_integer("retention_days"), member_of("review_frequency", P.REVIEW_FREQUENCIES, optional=True),
            percentage("threshold_pct"), required("assigned_by")]


def json_list(column: str) -> tuple[Column, str]:
    """Absent, or the text of a list."""
    given = clean_text(F.col(column))
    return given.isNotNull() & F.from_json(F.when(given.startswith("["), given), "array<string>").isNull(), f"{column} must be a list"


def task_conditions() -> list[tuple[Column, str]]:
    return [required("dataset"), required("title"), required("assignee_name"), required("created_by")]


def task_status_conditions() -> list[tuple[Column, str]]:
    return [required("dataset"), member_of("status", P.TASK_STATUSES)]


def with_default_domain(terms: DataFrame) -> DataFrame:
    """A term without a domain belongs to the last one, which is for all others."""
    return terms.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.lit(P.GLOSSARY_DOMAINS[-1])))


def term_conditions() -> list[tuple[Column, str]]:
    return [required("term"), required("definition"), member_of("domain", P.GLOSSARY_DOMAINS), json_list("tags"), required("created_by")]


def list_conditions() -> list[tuple[Column, str]]:
    return [required("name"), required("slug"), required("created_by")]


def value_conditions() -> list[tuple[Column, str]]:
    return [(F.col("list_id").isNull(), "list_id is required"), required("code"), required("label")]
