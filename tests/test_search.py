import random

import pytest

from tamarisk.operators import search
from tamarisk.session import scratch_path

SCHEMA = "k long, name string, n int, city string"
FIELDS = ["name", "n", "city"]


def records(n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aAbBcé中 ", k=rng.randint(0, 9)))
    rows = [(k, rng.choice([word(), None, "Hot Value"]), rng.choice([None, rng.randrange(5000)]), rng.choice([word(), "hot value"])) for k in range(n)]
    return [*rows, *rows[:20], (n, None, None, None), (n + 1, "a'b\\%_ c", 0, "")]


@pytest.fixture(scope="module")
def made(spark):
    rows = records()
    return rows, search.build(spark.createDataFrame(rows, SCHEMA), ["k"], FIELDS, scratch_path(spark, "index"))


def brute(rows, text):
    text, out = text.strip().lower(), {}
    for k, *values in rows:
        for f, v in zip(FIELDS, values):
            if v is not None and text in str(v).lower():
                out.setdefault(k, set()).add(f)
    return {(k, tuple(f for f in FIELDS if f in met)) for k, met in out.items()}


@pytest.mark.parametrize("text", ["HOT", " hot value ", "t v", "abc", "aba", "é中", "12", "123", "", "nowhere", "hot vxx", "'b\\%_ c", "aaab"])
def test_equal_to_a_scan(made, text):
    rows, index = made
    assert {(r.k, tuple(r.matched_fields)) for r in search.find(index, text, FIELDS).collect()} == brute(rows, text)


def test_many_candidates_and_few_asked(made, monkeypatch):
    rows, index = made
    monkeypatch.setattr(search, "LISTED", 1)
    monkeypatch.setattr(search, "ASKED", 1)
    for text in ("a b", "bca", "value"):
        assert {(r.k, tuple(r.matched_fields)) for r in search.find(index, text, FIELDS).collect()} == brute(rows, text)


def test_candidates_are_few_and_values_stored_once(made):
    rows, index = made
    assert search.candidates(index, "hot value").count() == 2          # one value of each of two fields
    stored = {(f, str(v).lower()) for r in rows for f, v in zip(FIELDS, r[1:]) if v is not None}
    assert index.part("values").count() == len(stored)


def test_empty_table(spark):
    index = search.build(spark.createDataFrame([], SCHEMA), ["k"], FIELDS, scratch_path(spark, "index"))
    assert [search.find(index, t, FIELDS).count() for t in ("abc", "a", "")] == [0, 0, 0]
