"""Search for a part of a value by trigram postings, written once and read by many searches.

A value is a text of one field, lower-cased; equal values of a field are stored once, however many records
hold them. ``values`` says which they are, ``postings`` which of them hold each run of three code points,
``holders`` which records hold each value. Postings are in order of their trigram and values and holders in
order of the value's number, in as many files as the rows need, so that a search reads the row groups it asks
for: those of a few trigrams, then those of the values that hold all of them. Every candidate is verified.

Numbers of values are 128-bit hashes of field and value; the verification reads the value itself. A trigram
of a third of all values fills as many tasks as it has rows. A text of fewer than three code points has no
trigram: it is held against the distinct values.

Defined cases: null values are not stored, and an empty table has an empty index; an empty text (or one of
blanks) matches every stored value; a record that holds a value twice is named once for each field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.session import materialise

GRAM = 3
ASKED = 4                # trigrams of a text that are asked for, the rarest ones
LISTED = 1000            # candidates up to which a scan is told their numbers one by one


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _grams(value: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(value) - (GRAM - 1))
    return F.when(F.char_length(value) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(value, i, F.lit(GRAM))))).otherwise(
        F.array().cast("array<string>"))


def build(records: DataFrame, keys: list[str], fields: list[str], path: str) -> Index:
    """Writes the index of some fields of a table whose records are told apart by ``keys``."""
    spark = records.sparkSession
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("value")) for f in fields])
    stored = records.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").where("value IS NOT NULL")
    number = F.unhex(F.substring(F.sha2(F.concat_ws("\x00", "field", "value"), 256), 1, 32)).alias("number")
    numbered = materialise(stored.select(*keys, "field", "value", number))
    by = lambda df, *order: df.repartitionByRange(*order).sortWithinPartitions(*order)
    by(numbered.select("number", *keys).distinct(), "number", *keys).write.parquet(f"{path}/holders")
    values = numbered.groupBy("number").agg(F.first("field").alias("field"), F.first("value").alias("value"))  # equal within a number
    by(values, "number").write.parquet(f"{path}/values")
    postings = spark.read.parquet(f"{path}/values").select(F.explode(_grams(F.col("value"))).alias("gram"), "number")
    by(postings, "gram", "number").write.parquet(f"{path}/postings")
    by(spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("held")), "gram").write.parquet(f"{path}/grams")
    return Index(spark, path, tuple(keys))


def _among(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen numbers; few of them are told to the scan, so that footers rule files out."""
    listed = [r.number for r in chosen.limit(LISTED + 1).collect()]
    if len(listed) <= LISTED:
        return df.where(F.col("number").isin(*[F.lit(bytes(n)) for n in listed]) if listed else F.lit(False))
    return df.join(chosen, "number", "left_semi")


def candidates(index: Index, text: str) -> DataFrame | None:
    """Numbers of values that hold the rarest trigrams of a text; None when it has no trigram."""
    text = text.strip().lower()
    grams = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    held = {r.gram: r.held for r in index.part("grams").where(F.col("gram").isin(grams)).collect()}
    if len(held) < len(grams):
        return index.part("postings").limit(0).select("number")      # some trigram is in no value
    asked = sorted(grams, key=lambda g: (held[g], g))[:ASKED]
    hits = index.part("postings").where(F.col("gram").isin(asked))
    return hits.groupBy("number").agg(F.count("*").alias("n")).where(F.col("n") == len(asked)).select("number")


def matches(index: Index, text: str) -> DataFrame:
    """number, field, value of every stored value that holds the text."""
    chosen = candidates(index, text)
    some = index.part("values") if chosen is None else _among(index.part("values"), materialise(chosen))
    return some.where(F.contains("value", F.lit(text.strip().lower())))


def find(index: Index, text: str, fields: list[str]) -> DataFrame:
    """Records with any matching field, and ``matched_fields`` in the order given."""
    met = materialise(matches(index, text).select("number", "field"))
    named = _among(index.part("holders"), met.select("number")).join(met, "number")
    agg = named.groupBy(*index.keys).agg(F.collect_set("field").alias("_met"))   # at most one entry a field
    return agg.withColumn("matched_fields", F.array_intersect(F.array(*[F.lit(f) for f in fields]), "_met")).drop("_met")
