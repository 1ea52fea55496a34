import random

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import changes as ch
from tamarisk.session import scratch_path
from tamarisk.sources import keyed_files as kf

SCHEMA = "a long, b string, v string, seq long"


def rows(df):
    return sorted(df.collect(), key=repr)


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(n, "x" if n % 2 else "y", f"v{n}", 0) for n in range(400)] + [(None, "x", "no key", 0), (7, None, "half a key", 0)], SCHEMA)


@pytest.fixture
def table(spark, base):
    root = scratch_path(spark, "a b%20")      # a folder whose name needs escapes
    return root, kf.create(base, root, ["a", "b"], 8)


def some_changes(spark, keys, n=30, seed=5):
    rng = random.Random(seed)
    made = [(k := rng.choice(keys), "x" if k % 2 else "y", rng.choice([f"new{i}", None]), rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame([*made, (None, "x", "lost", 3)], SCHEMA)


@pytest.mark.parametrize("listed", [1000, 2])
def test_equal_to_the_whole_table_forms(spark, base, table, listed, monkeypatch):
    monkeypatch.setattr(kf, "LISTED_KEYS", listed)
    root, first = table
    keys = ["a", "b"]
    changes = some_changes(spark, [*range(20, 60), 1000, 1001])
    up, met = kf.upsert(spark, root, first, changes, keys, "seq")
    assert rows(kf.read(spark, root, up)) == rows(ch.upsert_by_key(base, changes, keys, "seq"))
    assert 0 < len(met) < 8
    new, met, refused = kf.update(spark, root, first, changes, keys, ["v"], "seq")
    want, unknown = ch.update_existing(base, changes, keys, ["v"], "seq")
    assert rows(kf.read(spark, root, new)) == rows(want) and rows(refused) == rows(unknown)
    left, met = kf.delete(spark, root, first, changes, keys)
    assert rows(kf.read(spark, root, left)) == rows(ch.delete_by_key(base, ch.keyed(changes, keys), keys))
    # files that were not met are the same ones, the first version is untouched, and the lists tell the rows
    before, after = ({r.file for r in kf.files(spark, root, v).collect()} for v in (first, left))
    assert before - after == set(met) and before & after
    assert rows(kf.read(spark, root, first)) == rows(base)
    assert kf.files(spark, root, left).agg(F.sum("rows")).first()[0] == kf.read(spark, root, left).count()


def test_nothing_met_nothing_left_and_empty(spark, base, table):
    root, first = table
    none = base.limit(0)
    same, met = kf.delete(spark, root, first, none, ["a", "b"])
    assert met == [] and rows(kf.read(spark, root, same)) == rows(base)
    empty_root = scratch_path(spark, "empty")
    empty = kf.create(none, empty_root, ["a", "b"])
    assert kf.read(spark, empty_root, empty).count() == 0 and kf.read(spark, empty_root, empty).columns == base.columns
    filled, _ = kf.upsert(spark, empty_root, empty, base, ["a", "b"], "seq")
    assert rows(kf.read(spark, empty_root, filled)) == rows(ch.keyed(base, ["a", "b"]))
    gone, _ = kf.delete(spark, empty_root, filled, base, ["a", "b"])
    assert kf.read(spark, empty_root, gone).count() == 0


def test_rows_of_one_key_fill_several_files(spark):
    root, hot = scratch_path(spark, "hot"), spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("a"), F.col("id").cast("string").alias("v"))
    first = kf.create(hot, root, ["a"], 12)
    now, met = kf.delete(spark, root, first, spark.createDataFrame([(1,)], "a long"), ["a"])
    assert 2 <= len(met) < 12 and kf.read(spark, root, now).count() == hot.where("a <> 1").count()
