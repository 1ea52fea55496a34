import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.functions import ordered, text as X
from tamarisk.operators import drift, lineage, runs
from tamarisk.session import shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one key."""
    key = F.when(F.col("id") % 3 == 0, F.col("id") % 50).when(F.col("id") % 31 > 1, -1)  # and some without a key
    return spark.range(3000).select(key.alias("k"), F.hash("id").alias("o"), "id", (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("buckets", [1, 5, 13])
def test_ordered_work_equals_plain_windows(skewed, buckets):
    w = W.partitionBy("k").orderBy("o", "id")
    plain = {r["id"]: (r["s"], r["n"], r["p"]) for r in skewed.select("id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"),
                                                                      F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p")).collect()}
    total = {r["id"]: r["s"] for r in ordered.running_totals(skewed, ["k"], ["o", "id"], {"s": F.col("v")}, buckets).collect()}
    number = {r["id"]: r["n"] for r in ordered.numbered(skewed, ["k"], ["o", "id"], "n", buckets).collect()}
    before = {r["id"]: r["prev_v"] for r in ordered.with_previous(skewed, ["k"], ["o", "id"], ["v"], buckets=buckets).collect()}
    assert {i: (total[i], number[i], before[i]) for i in plain} == plain


def test_hot_key_is_spread_over_buckets(skewed):
    cut = ordered.range_bucketed(skewed, ["k"], ["o", "id"], 6)
    sizes = [r["count"] for r in cut.groupBy(ordered.BUCKET).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 0.4 * 3000


class FakeSession:
    """Just the settings ``shared_folder`` looks at."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext, self.master, self.applicationId, self.chosen = self, master, "fake", None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_shared_folder_follows_the_session():
    named = FakeSession("yarn", "hdfs://shared/tmp")
    assert shared_folder(named) == named.chosen == "hdfs://shared/tmp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn", None))
    local = FakeSession("local[2]", None)
    assert shared_folder(local) == shared_folder(local) == local.chosen


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "from_id string, to_id string")


def test_levels_are_longest_paths_and_cycles_have_none(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d"), ("p", "q"), ("q", "p"), ("q", "r")]
    nodes = spark.createDataFrame([(n,) for n in "abcdxpqrz"], "id string")
    got = {r["id"]: r["level"] for r in lineage.levels(nodes, graph(spark, pairs)).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "x": 0, "z": 0, "p": None, "q": None, "r": None}


def test_lineage_from_run_reports(spark):
    rows = spark.sql(r"""SELECT * FROM VALUES
      ('pipe.verify', 'bank', 'verify', 'ok', '[]', '[]', 1, 1, 1), ('pipe.silver', 'bank', 'silver', 'ok', '[{\'uri\': \'s/clean.csv\', \'extra\': None}]', '[{\'uri\': \'t/silver/\', \'extra\': None}]', 1, 1, 1),
      ('pipe.gold', 'bank', 'gold_compute', 'old', '[{\'uri\': \'gone\'}]', '[]', 1, 1, 1),
      ('pipe.gold', 'bank', 'gold_compute', 'ok', '[{\'uri\': \'t/silver/\'}]', '[{\'uri\': \'t/gold_ndi\'}, {\'uri\': \'t/gold_IFRS9\'}]', 2, 1, 1), ('pipe.bad', 'bank2', 'gold_compute', 'failed', 'not a list', '[]', 1, 1, 1)
      AS t(job, dataset, task, state, inlets, outlets, started_at, run_key, task_no)""").withColumn("ended_at", F.col("started_at"))
    jobs = lineage.with_outlets(lineage.latest_runs(rows))
    edges = {(r["from_id"], r["to_id"]) for r in lineage.edges(jobs).collect()}
    assert edges == {("s/clean.csv", "pipe.silver"), ("pipe.silver", "t/silver/"), ("t/silver/", "pipe.gold"), ("pipe.gold", "t/gold_ndi"), ("pipe.gold", "t/gold_IFRS9")}
    labels = {r["id"]: r["label"] for r in lineage.nodes(jobs).collect()}
    assert labels["t/silver/"] == "t/silver/" and labels["s/clean.csv"] == "clean.csv" and "pipe.verify" not in labels
    trace = lineage.gold_traces(jobs, "ifrs9").first()
    assert (trace["output"], trace["state"]) == ("t/gold_IFRS9", "ok")


def test_run_prefix_is_literal(spark):
    df = spark.createDataFrame([("ds1__a",), ("ds1xxb",), ("ds12__c",), ("ds1__d__e",)], "run_id string")
    assert [r["run_id"] for r in runs.runs_of(df, "ds1").collect()] == ["ds1__a", "ds1__d__e"]


def test_ks_equals_brute_force(spark):
    rng = random.Random(5)
    a, b = [rng.gauss(0, 1) for _ in range(400)], [rng.gauss(0.2, 1) for _ in range(300)]
    a += [0.5] * 100
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "x double, ref boolean")
    got = drift.numeric_drift(df, ["x"], F.col("ref")).first()
    cdf = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    d = max(abs(cdf(a, v) - cdf(b, v)) for v in a + b)
    assert got["statistic"] == pytest.approx(d, abs=1e-12) and (got["n"], got["m"]) == (500, 300)
    lam = math.sqrt(500 * 300 / 800) * d
    assert got["p_value"] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101)), abs=1e-12)


def test_shift_is_found_and_no_shift_is_not(spark):
    df = spark.range(2000).select((F.col("id") % 97).cast("double").alias("x"), ((F.col("id") * 7919) % 2 == 0).alias("ref"))
    assert drift.numeric_drift(df, ["x"], F.col("ref")).first()["p_value"] > 0.05
    moved = drift.shifted(df, "x", F.col("ref"), 1.6, 3)
    assert drift.numeric_drift(moved, ["x"], F.col("ref")).first()["p_value"] < 0.001
    with pytest.raises(ValueError, match="unknown feature"):
        drift.shifted(df, "nope", F.col("ref"), 1, 0)


def test_chi_square(spark):
    df = spark.sql("SELECT explode(array_repeat(v, n)) AS c, ref FROM VALUES ('a', 10, true), ('b', 20, true), ('c', 30, true), ('a', 20, false), ('b', 20, false), ('c', 20, false) AS t(v, n, ref)")
    r = drift.categorical_drift(df, ["c"], F.col("ref")).first()
    want = 2 * (25 / 15) + 2 * (25 / 25)
    assert r["statistic"] == pytest.approx(want) and r["p_value"] == pytest.approx(math.exp(-want / 2))
    one = drift.categorical_drift(df.where("c <> 'c'"), ["c"], F.col("ref")).first()
    assert one["p_value"] == pytest.approx(math.erfc(math.sqrt(one["statistic"] / 2)))


def test_text_helpers(spark):
    row = spark.sql("SELECT ' a , ,b,' AS t, ' My List ' AS s, 'x/y/' AS u, 'Report.V2.PDF' AS f, '  ' AS e").select(
        X.tags(F.col("t")), X.slug(F.col("s")), X.uri_tail(F.col("u")), X.file_extension(F.col("f")), X.clean_text(F.col("e"))).first()
    assert tuple(row) == (["a", "b"], "my-list", "x/y/", ".pdf", None)
    flags = spark.sql("SELECT explode(array('true', 'False', 'yes', '0', '2', 'maybe', NULL)) AS c").select(X.flag(F.col("c")))
    assert [r[0] for r in flags.collect()] == [True, False, True, False, True, False, False]


def plain_levels(links):
    """Longest path from a source to every node, None on or behind a cycle."""
    inputs = {}
    for a, b in links:
        inputs.setdefault(b, set()).add(a)
        inputs.setdefault(a, set())
    level = {}
    while True:
        ready = [n for n, up in inputs.items() if n not in level and all(u in level for u in up)]
        if not ready:
            return {n: level.get(n) for n in inputs}
        level.update({n: max((level[u] + 1 for u in inputs[n]), default=0) for n in ready})


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(40)]
    links = {(nodes[a], nodes[b]) for a, b in (sorted(rng.sample(range(40), 2)) for _ in range((30, 45, 60, 90)[seed]))}
    links |= {(f"c{k}", f"c{k + 1}") for k in range(30)} | {("c30", nodes[20]), (nodes[3], "c0")}  # a chain into and out of the rest
    links |= {("x1", "x2"), ("x2", "x1"), ("x2", "x3"), ("x3", nodes[39]), ("s", "s"), ("s", "t")}  # cycles, and what is behind them
    if seed % 2:
        links |= {(nodes[30], "y1"), ("y1", "y2"), ("y2", "y1")}
    graph = spark.createDataFrame(sorted(links), "from_id string, to_id string")
    want = plain_levels(links)
    got = {r.id: r.level for r in lineage.levels(spark.createDataFrame([(n,) for n in [*want, "alone"]], "id string"), graph).collect()}
    assert got == {**want, "alone": 0}


def test_levels_of_a_long_chain_take_few_rounds(spark):
    graph = spark.range(2000).select(F.concat(F.lit("j"), F.col("id")).alias("from_id"), F.concat(F.lit("j"), F.col("id") + 1).alias("to_id"))
    ids = spark.range(2001).select(F.concat(F.lit("j"), F.col("id")).alias("id"))
    got = lineage.levels(ids, graph)
    assert got.where(F.substr("id", F.lit(2)).cast("int") != F.col("level")).isEmpty() and got.agg(F.max("level")).first()[0] == 2000


def test_ks_on_extreme_values_equals_brute_force(spark):
    """Few cells, so that stretches are cut again; values of every magnitude, infinities, NaN and heavy single values."""
    rng = random.Random(12)
    far = [1e308, -1e308, 1e-308, 0.0, -0.0, math.inf, -math.inf, math.nan, 1.0]
    rows = [(rng.random() < 0.3, rng.choice(far), 5.0 if rng.random() < 0.4 else rng.choice([-1, 1]) * math.exp(rng.gauss(0, 9)), 3.0, None, 1.0 if k % 2 else None)
            for k in range(4000)]
    df = spark.createDataFrame(rows, "ref boolean, far double, heavy double, one double, none double, half double")
    features = ["far", "heavy", "one", "none", "half"]

    def plain(k):
        key = lambda x: (math.isnan(x), x)
        values = sorted(((key(r[k]), r[0]) for r in rows if r[k] is not None))
        n, m = sum(r for _, r in values), sum(not r for _, r in values)
        best = a = b = 0
        for i, (x, r) in enumerate(values):
            a, b = a + r, b + (not r)
            if i + 1 == len(values) or values[i + 1][0] != x and not (x[0] and values[i + 1][0][0]):
                best = max(best, abs(a / n - b / m))
        return n, m, best

    want = {f: plain(k + 1) for k, f in enumerate(features) if f != "none"}
    for cells, few in ((drift.CELLS, drift.FEW_VALUES), (16, 40)):
        found = drift.numeric_drift(df, features, F.col("ref"), cells=cells, few=few).collect()
        assert {r.feature: (r.n, r.m, r.statistic) for r in found} == want


def test_ks_shuffles_no_values(spark):
    df = spark.range(50_000).select((F.col("id") % 3 == 0).alias("ref"), F.rand(3).alias("x"))
    cells = drift._in_cells(drift._observations(df, ["x"], F.col("ref"), None), [(0, 0, 0.0, 1.0, 64)]).groupBy("stretch", "cell").count()
    assert cells.count() <= 65


def test_ties_of_one_time_on_one_key(spark):
    df = spark.range(20_000, numPartitions=8).select(F.lit(1).alias("k"), F.lit(5).alias("t"), (F.col("id") * 7919 % 20_000).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"))
    last, first = (ordered.extreme_of_each(df, ["k"], ["t"], last=l) for l in (True, False))
    assert last.first().a == 19_999 and first.first().a == 0
    assert "collect_set" not in last._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_newest_runs_need_no_end(spark):
    """The graph is the one that whole newest runs give, also among equal runs, and the end of a run is not read."""
    uri = lambda x: f'[{{"uri": "{x}", "extra": None}}]'
    rows = [("j", "d", "t", s, uri("a"), uri(o), f"2026-01-0{d} 00:00:00", f"2026-02-0{e} 00:00:00", k, 1)
            for s, o, d, e, k in [("failed", "z", 1, 9, 9), ("success", "b", 2, 1, 3), ("running", "c", 2, 5, 3), ("success", "b", 2, 4, 3)]]
    rows += [("k", "d", "t", None, uri("b"), "[]", "2026-01-01 00:00:00", None, 1, 1), ("n", "d", "t", "failed", "not a list", "[]", "2026-01-01 00:00:00", None, 1, 1)]
    history = spark.createDataFrame(rows, "job string, dataset string, task string, state string, inlets string, outlets string, started_at string, ended_at string, run_key long, task_no long")
    history = history.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumn("ended_at", F.col("ended_at").cast("timestamp"))
    whole = lineage.with_outlets(lineage.latest_runs(history))
    links = lineage.latest_links(history.drop("ended_at"))
    assert sorted(links.collect()) == sorted(whole.select("job", "in_uris", "out_uris").collect()) and links.count() == 2
    assert sorted(lineage.node_ids(links).collect()) == sorted(whole.transform(lineage.nodes).select("id").collect())
