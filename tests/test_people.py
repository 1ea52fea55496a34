import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tamarisk.functions import similarity as sim
from tamarisk.operators import dedup, golden


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * plain_lcs(a, b) / (len(a) + len(b))


def names(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(string.ascii_letters + "éü中", k=rng.randint(1, 9)))
    return [" ".join(word() for _ in range(rng.randint(0, 3))) for _ in range(n)]


def test_min_cross_ratio_equals_brute_force():
    left, right = names(25), names(30, 9)
    sort = lambda xs: [" ".join(sorted(x.split())) for x in xs]
    assert sim.min_cross_ratio(sort(left), sort(right)) == pytest.approx(min(plain_ratio(a, b) for a in left for b in right))
    inside = [n for n in left if n][:12]
    assert sim.min_cross_ratio(sort(inside), None) == pytest.approx(min(plain_ratio(a, b) for i, a in enumerate(inside) for b in inside[i + 1:]))


def test_long_names_and_empty_names():
    long = ["x" * 30 + "ab" * 30, "ab" * 40, "q" * 64, "", "b"]
    pairs = lambda xs: [(a, b) for i, a in enumerate(xs) for b in xs[i + 1:]]
    for some in (long, long[:2], long[1:3], [long[0], "b"], ["", ""], ["q" * 64, "q" * 63 + "z"]):
        assert sim.min_cross_ratio(some, None) == pytest.approx(min(plain_ratio(a, b) for a, b in pairs(some)))


def people(spark, rows):
    return spark.createDataFrame(rows, "dataset string, CUST_ID string, FULL_NAME string, DOB string, PHONE string, row_pos long")


def test_tiers(spark):
    df = people(spark, [
        ("d", "1", "Sara Ali", "1990-01-01", "05", 0), ("d", "2", "Ali Sara", "1990-01-01", None, 1),
        ("d", "3", "Omar Zed", "1991-01-01", "05", 2), ("d", "4", "Huda Kim", "1991-01-01", "05", 3),
        ("d", "5", "Lone Wolf", "1992-01-01", "05", 4), ("d", "6", "No Date", None, "05", 5), ("d", "7", "No Date", None, "05", 6)])
    got = {r["dob"]: r for r in dedup.find_clusters(dedup.candidates(df)).collect()}
    assert set(got) == {"1990-01-01", "1991-01-01"}
    assert (got["1990-01-01"]["tier"], got["1990-01-01"]["min_name_similarity"], got["1990-01-01"]["cluster_index"]) == ("high_confidence", 100.0, 0)
    assert (got["1991-01-01"]["tier"], got["1991-01-01"]["cluster_index"]) == ("needs_review", 1)
    assert dedup.summary(dedup.find_clusters(dedup.candidates(df))).first()["records_involved"] == 4


@pytest.mark.parametrize("n,chunk", [(20, 2048), (70, 2048), (70, 16), (90, 7)])
def test_hot_block_is_scored_whole_whatever_the_chunking(spark, n, chunk):
    """A block holding most rows, in one list, one chunk or many chunk pairs, gives the brute-force minimum."""
    given = names(n, n + chunk)
    rows = [("d", str(i), x, "1900-01-01", None, i) for i, x in enumerate(given)] + [("d", "x", "Solo", "1999-01-01", None, 10_000)]
    found = dedup.find_clusters(dedup.candidates(people(spark, rows)), chunk_names=chunk).collect()
    assert len(found) == 1 and found[0]["size"] == n
    want = min(plain_ratio(a, b) for i, a in enumerate(given) for b in given[i + 1:])
    assert found[0]["min_name_similarity"] == pytest.approx(want, abs=0.051)


def of_digits(n):
    """Names of two words, numbers in two alphabets; the longest have all letters, the shortest are short."""
    spell = lambda k, letters: "".join(letters[int(c)] for c in str(k))
    numbers = [*range(10), *range(10_000, 100_000, 90_000 // n)]
    return [f"kalesimort{k} bucdyhfwgp" for k in range(7)] + [f"{spell(k, 'kalesimort')} {spell(str(k)[::-1], 'bucdyhfwgp')}" for k in numbers]


@pytest.mark.parametrize("given", [names(400, 5), of_digits(700), [f"Name{k % 50} Family{k % 37}" for k in range(600)]])
def test_long_block_is_scored_whole(spark, given):
    rows = [("d", str(i), x, "1900-01-01", None, i) for i, x in enumerate(given)]
    found = dedup.find_clusters(dedup.candidates(people(spark, rows)), chunk_names=64).collect()
    sort = sorted({" ".join(sorted(x.split())) for x in given})
    assert len(found) == 1 and found[0]["n_names"] == len(sort) > dedup.SHORT_BLOCK
    assert found[0]["min_name_similarity"] == pytest.approx(sim.min_cross_ratio(sort, None), abs=0.051)


def test_groups_that_can_only_equal_the_score_do_not_meet():
    """Names of 15 without a common letter have a bound of 200 / 30: not below that score, but below any higher one."""
    part = pd.DataFrame({"dataset": "d", "dob": "x", "grp": [(1 << 12) + (1 << 6) + 1, (1 << 12) + (2 << 6) + 2], "shared": 0, "longest": 15, "n": 5})
    met = lambda score: sim.groups_to_meet(part.assign(score=score), 6)
    assert met(200 / 30).empty
    above = met(200 / 29.5)
    assert (above["grp"] != above["other"]).all() and len(above) == 1 and above["least"].item() == 15
    for sure in range(5):
        for score in (200.0 * a / b for a in range(1, 6) for b in range(1, 50)):
            assert sim.least_total(np.array([sure]), score)[0] == next(t for t in range(1, 1000) if 200.0 * sure / t < score)


def test_the_longest_names_lower_the_score_to_beat(spark):
    """Names of all groups find a lower score before any cell is scored, and none that no pair has."""
    given = of_digits(700)
    rows = [("d", str(i), x, "1900-01-01", None, i) for i, x in enumerate(given)]
    found = dedup.block_names(dedup.candidates(people(spark, rows)))
    inside = found.select(*dedup.BLOCK, "sorted_name", F.char_length("sorted_name").alias("len"))
    bounds = inside.groupBy(*dedup.BLOCK).agg(F.max(F.lit(20.0)).alias("score"))
    probed = dedup._probed_scores(dedup._signatures(inside, bounds)).first()["score"]
    assert sim.min_cross_ratio(sorted({" ".join(sorted(x.split())) for x in given}), None) <= probed < 10


def test_lists_of_names_are_scored_by_pairs():
    rng = random.Random(4)
    text = lambda: "".join(rng.choices("abcdé 𝒳xyz", k=rng.choice([0, 1, 3, 8, 30, 63, 64, 65, 100, 256, 300])))
    lists = [sorted({text() for _ in range(rng.randint(1, 14))}) for _ in range(200)]
    want = [min([sim.ratio(a, b) for i, a in enumerate(x) for b in x[i + 1:]], default=100.0) for x in lists]
    assert sim.min_ratio_in.func(pd.Series(lists)).tolist() == want


def test_not_applicable(spark):
    with pytest.raises(ValueError, match="date-of-birth"):
        dedup.candidates(spark.sql("SELECT 'd' AS dataset, 0 AS row_pos, 1 AS id, 2 AS value"))


def test_decided_member_sets_are_not_reported_again(spark):
    df = people(spark, [("d", c, "N", dob, None, i) for i, (c, dob) in enumerate(
        [("1", "a"), ("2", "a"), ("3", "b"), ("4", "b"), ("5", "c"), ("6", "c"), ("7", "c")])])
    rows = dedup.candidates(df)
    old = spark.sql("SELECT * FROM VALUES ('d', 1, '1'), ('d', 1, '2'), ('d', 2, '3'), ('d', 2, '4'), ('d', 2, '9'), ('d', 3, '5'), ('d', 3, '6') AS t(dataset, cluster_id, row_id)")
    left = dedup.unseen(dedup.blocks(dedup.block_names(rows)), rows, old)
    assert {r["dob"] for r in left.collect()} == {"b", "c"}
    decisions = spark.sql("SELECT * FROM VALUES ('d', 'a', 2L, 'high_confidence', 'not_duplicate'), ('d', 'z', 2L, 'high_confidence', 'pending') AS t(dataset, dob, size, tier, status)")
    queue = dedup.refreshed_queue(decisions, left.withColumn("tier", F.lit("needs_review")))
    assert {(r["dob"], r["status"]) for r in queue.collect()} == {("a", "not_duplicate"), ("b", "pending"), ("c", "pending")}


@pytest.fixture
def decisions(spark):
    return spark.sql("""SELECT * FROM VALUES (1, 'a', 'high_confidence', 'pending', NULL, CAST(NULL AS TIMESTAMP), 2), (2, 'a', 'needs_review', 'pending', NULL, NULL, 3),
        (3, 'a', 'high_confidence', 'not_duplicate', 'r', TIMESTAMP '2026-01-01 00:00:00', 2) AS t(cluster_id, dataset, tier, status, decided_by, decided_at, size)""")


def test_bulk_confirm_by_tier_and_all(decisions):
    status = lambda df: {r["cluster_id"]: r["status"] for r in df.collect()}
    assert status(dedup.bulk_confirm(decisions, "me", "2026-02-02 00:00:00", tier="high_confidence")) == {1: "confirmed_duplicate", 2: "pending", 3: "not_duplicate"}
    assert status(dedup.bulk_confirm(decisions, "me", "2026-02-02 00:00:00")) == {1: "confirmed_duplicate", 2: "confirmed_duplicate", 3: "not_duplicate"}


def test_bulk_target_must_be_unambiguous(spark, decisions):
    assert dedup.confirm_target(decisions) == "a"
    with pytest.raises(ValueError, match="no pending"):
        dedup.confirm_target(decisions.where("status <> 'pending'"))
    with pytest.raises(ValueError, match="several"):
        dedup.confirm_target(decisions.withColumn("dataset", F.col("cluster_id").cast("string")))


def test_decide_reports_bad_choices(spark, decisions):
    choices = spark.sql("SELECT * FROM VALUES (1, 'not_duplicate', 'x', TIMESTAMP '2026-03-01 00:00:00'), (2, 'maybe', 'x', TIMESTAMP '2026-03-01 00:00:00'), (9, 'not_duplicate', 'x', TIMESTAMP '2026-03-01 00:00:00') AS t(cluster_id, choice, actor, at)")
    updated, errors = dedup.decide(decisions, choices)
    assert {r["cluster_id"]: r["status"] for r in updated.collect()} == {1: "not_duplicate", 2: "pending", 3: "not_duplicate"}
    assert {r["cluster_id"]: r["reason"] for r in errors.collect()} == {2: "invalid status", 9: "unknown cluster"}


def test_survivorship(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('d', 'r1', 0, 'Ann', NULL, NULL, 'x'), ('d', 'r2', 1, 'Anna', 'p2', 'e2', NULL), ('d', 'r3', 2, 'Annie', 'p3', 'e3', NULL),
        ('d', 's1', 3, 'Bob', NULL, NULL, NULL) AS t(dataset, row_id, row_pos, name, phone, email, note)""")
    members = spark.sql("SELECT * FROM VALUES ('d', 1, 'r1'), ('d', 1, 'r2'), ('d', 1, 'r3'), ('d', 2, 's1'), ('d', 3, 'gone') AS t(dataset, cluster_id, row_id)")
    out = golden.merge(rows, members, ["name", "phone", "email", "note"])
    got = {r["cluster_id"]: r for r in out.collect()}
    assert set(got) == {1, 2}
    g = got[1]
    assert (g["base_row_id"], g["source_rows"], g["name"], g["phone"], g["note"], g["src_note"], g["src_name"]) == ("r2", 3, "Anna", "p2", "x", "r1", "r2")
    assert got[2]["phone"] is None and got[2]["src_phone"] is None
    wanted = spark.sql("SELECT 'd' AS dataset, explode(array(1, 2, 3)) AS cluster_id")
    assert [r["cluster_id"] for r in golden.merge_errors(wanted, out).collect()] == [3]
    registry = golden.as_maps(out, ["name", "phone", "email", "note"])
    hits = {r["cluster_id"]: r["matched_fields"] for r in golden.search(registry, " P2 ").collect()}
    assert hits == {1: ["phone"]}
    assert golden.search(registry, " ").count() == 2
    assert [r["source_row_id"] for r in golden.contributions(registry, "note").collect()] == ["r1"]
