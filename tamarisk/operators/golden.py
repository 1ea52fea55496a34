"""Golden records: field-level survivorship over confirmed clusters, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE = "src_"


def merge(rows: DataFrame, members: DataFrame, data_columns: list[str]) -> DataFrame:
    """One golden record per cluster.

    The base is the row with most values (first on a tie); a field it lacks is taken from
    the first other row that has it. A member id names every row that carries it, once.

    Where those rows are is a minimum of numbers per cluster, which combines in hash maps
    before the shuffle, however large a cluster is. Only the rows found (one for the base and
    one for each field at most) are read again with their texts. When the base lacks a field,
    the first value is by definition another row's.
    """
    filled = sum((F.col(c).isNotNull().cast("long") for c in data_columns), F.lit(0).cast("long"))
    ids = members.select("dataset", "cluster_id", "row_id").distinct()
    joined = rows.select("dataset", "row_id", "row_pos", *data_columns).join(ids, ["dataset", "row_id"])
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.col("row_pos"))).alias(f"_at{i}") for i, c in enumerate(data_columns)]
    most = [F.min(F.when(filled == n, F.col("row_pos"))).alias(f"_with{n}") for n in range(len(data_columns) + 1)]
    places = joined.groupBy("dataset", "cluster_id").agg(F.count("*").alias("source_rows"), *firsts, *most)
    base_at = F.coalesce(*[F.col(f"_with{n}") for n in range(len(data_columns), -1, -1)])
    places = places.select("dataset", "cluster_id", "source_rows", base_at.alias("_base_at"), *[f"_at{i}" for i in range(len(data_columns))])
    wanted = F.array_contains(F.array_compact(F.array("_base_at", *[f"_at{i}" for i in range(len(data_columns))])), F.col("row_pos"))
    found = joined.join(places, ["dataset", "cluster_id"]).where(wanted)
    only = lambda hit, value: F.get(F.array_sort(F.collect_list(F.when(hit, value))), F.lit(0))
    base = only(F.col("row_pos") == F.col("_base_at"), F.struct("row_id", *data_columns)).alias("_base")
    firsts = [only(F.col("row_pos") == F.col(f"_at{i}"), F.struct(F.col(c).alias("v"), F.col("row_id").alias("r"))).alias(f"_first_{c}")
              for i, c in enumerate(data_columns)]
    agg = found.groupBy("dataset", "cluster_id", "source_rows").agg(base, *firsts)
    out = [F.col("_base.row_id").alias("base_row_id")]
    for c in data_columns:
        own = F.col("_base")[c]
        first = F.when(F.col(f"_first_{c}.v").isNotNull(), F.col(f"_first_{c}"))
        out.append(F.coalesce(own, first["v"]).alias(c))
        out.append(F.when(own.isNotNull(), F.col("_base.row_id")).otherwise(first["r"]).alias(SOURCE + c))
    return agg.select("dataset", "cluster_id", "source_rows", *out)


def pending_merges(decisions: DataFrame, golden: DataFrame) -> DataFrame:
    """Confirmed clusters without a golden record yet, so a rerun merges nothing twice."""
    return decisions.where("status = 'confirmed_duplicate'").join(golden.select("dataset", "cluster_id"), ["dataset", "cluster_id"], "left_anti")


def merge_errors(wanted: DataFrame, golden: DataFrame) -> DataFrame:
    """Confirmed clusters none of whose source rows exist any more."""
    return (wanted.select("dataset", "cluster_id").join(golden, ["dataset", "cluster_id"], "left_anti")
            .withColumn("reason", F.lit("source rows not found in the current silver data")))


def as_maps(golden: DataFrame, data_columns: list[str]) -> DataFrame:
    """The schema-free registry form: merged values and field sources as maps."""
    keys = F.array(*[F.lit(c) for c in data_columns])
    values = F.array(*[F.col(c).cast("string") for c in data_columns])
    sources = F.array(*[F.col(SOURCE + c).cast("string") for c in data_columns])
    return golden.select("dataset", "cluster_id", "base_row_id", "source_rows",
                         F.map_from_arrays(keys, values).alias("merged"), F.map_from_arrays(keys, sources).alias("field_sources"))


def search(registry: DataFrame, text: str) -> DataFrame:
    """Records whose dataset or any merged value contains the text; says which fields did."""
    q = F.lit(text.strip().lower())
    fields = F.map_keys(F.map_filter("merged", lambda k, v: v.isNotNull() & F.contains(F.lower(v), q)))
    in_name = F.contains(F.lower("dataset"), q)
    matched = F.concat(F.when(in_name, F.array(F.lit("dataset"))).otherwise(F.array().cast("array<string>")), fields)
    out = registry.withColumn("matched_fields", matched)
    return out if not text.strip() else out.where(F.size("matched_fields") > 0)


def contributions(registry: DataFrame, field: str) -> DataFrame:
    """Golden records in which the field has a value, and the row it came from."""
    value = F.try_element_at("merged", F.lit(field))
    return registry.where(value.isNotNull()).select("dataset", "cluster_id", F.try_element_at("field_sources", F.lit(field)).alias("source_row_id"))


def listing(golden: DataFrame, decisions: DataFrame, dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Golden records with their cluster's evidence, newest first; a page of them where a limit is given."""
    facts = decisions.select("dataset", "cluster_id", "tier", "size", "status", "decided_by", "decided_at")
    out = golden.join(facts, ["dataset", "cluster_id"], "left")
    if dataset:
        out = out.where(F.col("dataset") == dataset)
    out = out.orderBy(F.desc_nulls_last("decided_at"), F.desc("cluster_id"))
    return out if limit is None else out.limit(limit)
