import random

import pytest
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.functions.times import freshness, quarter_label
from tamarisk.operators import access, changes as ch, compliance as cp, history as hs, maturity as mt, stewardship as st


def test_maturity_anchor(spark):
    r = mt.assess(mt.baseline_scores(spark)).first()
    assert (r["display_score"], r["overall_compliance_pct"], r["maturity_level"], r["total_specs"]) == (48.3, 60.2, "Developing", 191)
    weights = [row["weight_pct"] for row in mt.domain_table(spark).collect()]
    assert len(weights) == 14 and sum(weights) == pytest.approx(99.9623)


def test_levels_fall_through_between_bands(spark):
    level = lambda s: spark.range(1).select(mt.level(F.lit(s))).first()[0]
    assert [level(s) for s in (0.0, 0.25, 2.49, 2.495, 2.5, 4.75, 5.0)] == ["Capability No", "Emerging", "Developing", "Capability No", "Defined", "Leading", "Leading"]


def card(spark, rows):
    return spark.createDataFrame(rows, "sheet string, row_pos long, `Domain (Arabic)` string, `Domain (English)` string, `Current Score` double, `Target Score` double, Gap double")


def test_scorecard(spark):
    df = card(spark, [("s", 0, "x", "Quality", 2.0, 4.0, 2.0), ("s", 1, "y", "Security", 3.5, 4.0, 0.5), ("s", 2, "z", "Open Data", 1.0, 4.0, 3.0), ("s", 3, None, None, 6.5, 12.0, 5.5),
                      ("t", 0, "x", "Swapped", 4.0, 1.0, 0.0)])
    rows = mt.scorecard_rows(df, ["sheet"])
    got = {r["sheet"]: r for r in mt.readiness(rows, ["sheet"]).collect()}
    assert (got["s"]["domain_count"], got["s"]["avg_target"], got["s"]["readiness_index"]) == (3, 4.0, 54.2)
    assert (got["t"]["avg_current"], got["t"]["avg_target"]) == (1.0, 4.0)
    gaps = [r["label"] for r in mt.top_gaps(rows, ["sheet"], 2).where("sheet = 's'").orderBy("rank").collect()]
    assert gaps == ["Open Data", "Quality"]


@pytest.fixture
def registry(spark):
    return spark.sql("""SELECT * FROM VALUES
      ('done', 100L, array('CUST_ID', 'EMAIL', 'NAME', 'X'), map('EMAIL', 20L), true), ('open', 100L, array('A', 'PHONE'), map('A', 10L, 'PHONE', 30L), true),
      ('never', 50L, array('RATING', 'FACILITY_TYPE', 'DPD', 'ORIGINATION', 'MATURITY', 'EAD'), CAST(map() AS MAP<STRING, BIGINT>), false) AS t(safe_name, rows, columns, null_counts, checked)""")


@pytest.fixture
def clusters(spark):
    return spark.sql("SELECT * FROM VALUES ('done', 'confirmed_duplicate', 3), ('done', 'not_duplicate', 2), ('open', 'pending', 4), ('open', 'confirmed_duplicate', 2), ('open', 'pending', 2) AS t(dataset, status, size)")


def test_compliance_scores(registry, clusters):
    scored = cp.scores(cp.signals(registry, clusters))
    got = {r["safe_name"]: (r["score_DG"], r["score_DQ"], r["score_RMD"], r["score_PDP"]) for r in scored.collect()}
    assert got == {"done": (100.0, 95.0, 100.0, 80.0), "open": (33.3, 80.0, 94.0, 70.0), "never": (None, 100.0, None, None)}
    rows = cp.domain_rows(scored)
    assert rows.where("dataset = 'never' AND status = 'measured'").count() == 1 and rows.count() == 24
    assert {r["dataset"]: r["average_score"] for r in cp.average(rows).collect()} == {"done": 93.8, "open": 69.3, "never": 100.0}
    alert = {r["dataset"]: (r["alert"], r["message"]) for r in cp.alerts(scored).collect()}
    assert alert == {"done": ("lowest_domain", "Personal Data Protection is lowest"), "open": ("pending_reviews", "2 duplicate cluster(s) still need review"),
                     "never": ("check_never_run", "duplicate detection has not been run")}
    status = {(r["dataset"], r["label"]): r["status"] for r in cp.checks(scored).collect()}
    assert status[("done", "MDM")] == "ok" and status[("open", "MDM")] == "warn" and status[("never", "MDM")] == "not_measured"
    assert status[("never", "IFRS 9 readiness")] == "ok" and status[("done", "PDPL")] == "warn" and status[("never", "PDPL")] == "warn"


def test_customer_360(registry, clusters):
    got = {r["dataset"]: (r["golden_estimate"], r["uniqueness_pct"], r["clusters_confirmed"]) for r in cp.customer_360(cp.signals(registry, clusters)).collect()}
    assert got == {"done": (98, 98.0, 1), "open": (99, 99.0, 1), "never": (None, None, None)}


@pytest.fixture
def snapshots(spark):
    return spark.sql("""SELECT * FROM VALUES (1L, 'a', TIMESTAMP '2026-01-31 23:30:00', 40.0D), (2L, 'a', TIMESTAMP '2026-04-01 00:30:00', 42.5D), (3L, 'a', TIMESTAMP '2026-04-01 00:30:00', NULL),
        (4L, 'a', TIMESTAMP '2026-05-01 00:00:00', 41.0D), (5L, 'b', TIMESTAMP '2026-01-01 00:00:00', 10.0D), (6L, 'b', TIMESTAMP '2026-02-01 00:00:00', 10.0D), (7L, 'c', TIMESTAMP '2026-02-01 00:00:00', 1.0D)
        AS t(id, dataset, recorded_at, score)""")


def test_deltas(snapshots):
    got = {r["id"]: r["score_delta"] for r in hs.with_deltas(snapshots, ["dataset"], ["score"]).collect()}
    assert got == {1: None, 2: 2.5, 3: None, 4: None, 5: None, 6: 0.0, 7: None}
    overall = {r["id"]: r["score_delta"] for r in hs.with_deltas(snapshots, [], ["score"]).collect()}
    assert overall[5] is None and overall[1] == 30.0
    assert [r["id"] for r in hs.newest(snapshots, 2).collect()] == [4, 3]


def test_identical_periods_and_single_reads(snapshots):
    assert {r["dataset"]: r["all_identical"] for r in hs.all_identical(snapshots, ["dataset"], "score").collect()} == {"a": False, "b": True, "c": False}
    assert [(r["period"], r["snapshots"]) for r in hs.periods(snapshots).collect()] == [("2026 Q2", 3), ("2026 Q1", 4)]
    assert hs.in_period(snapshots, "2026 Q2").count() == 3
    assert hs.one(snapshots, 4).first()["score"] == 41.0
    with pytest.raises(ValueError, match="no snapshot"):
        hs.one(snapshots, 99)


def test_compare_is_chronological_and_driven_by_the_later(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, DATE '2026-01-01', 'DG', 2.0D, 50.0D), (1, DATE '2026-01-01', 'OLD', 1.0D, 10.0D), (2, DATE '2026-02-01', 'DG', 2.55D, 61.25D),
        (2, DATE '2026-02-01', 'NEW', 3.0D, 70.0D) AS t(snapshot_id, recorded_at, code, maturity, compliance)""")
    for pair in ("1 AS first_id, 2 AS second_id", "2 AS first_id, 1 AS second_id"):
        got = {r["code"]: (r["maturity_delta"], r["comparable"]) for r in hs.compare(rows, spark.sql("SELECT " + pair)).collect()}
        assert got == {"DG": (0.55, True), "NEW": (None, False)}
    assert hs.compare(rows, spark.sql("SELECT 1 AS first_id, 1 AS second_id")).count() == 0


def test_recording(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('code', 'DG', 'score', 1.5D), named_struct('code', 'DQ', 'score', 2D)) AS domains")
    out, refused = hs.record(df, F.lit("  me "), F.lit("2026-01-01").cast("timestamp"), F.lit("  "))
    assert refused.count() == 0
    assert out.select("recorded_by", "note").first() == ("me", None)
    none, refused = hs.record(df, F.lit(" "), F.lit("2026-01-01").cast("timestamp"), F.lit("n"))
    assert none.count() == 0 and {r["reason"] for r in refused.collect()} == {"the recorder must be named"}
    assert [r["code"] for r in hs.exploded(out).collect()] == ["DG", "DQ"]


def test_access(spark):
    req = spark.sql("""SELECT * FROM VALUES (1, 'validate_drift', 'RESTRICTED', false, 'admin,data_owner', 'classification_allow'), (2, 'validate_drift', 'INTERNAL', false, 'data_consumer', 'classification_allow'),
        (3, 'add_dataset', 'RESTRICTED', true, 'data_steward', 'stewardship_assign_allow'), (4, 'list_datasets', NULL, false, 'data_owner,data_consumer', 'stewardship_assign_allow'),
        (5, 'add_dataset', 'PUBLIC', false, '', 'no_such_rule') AS t(req_id, intent, classification, override_approved, roles, rule)""")
    got = {r["req_id"]: (r["allowed"], r["applied_rules"]) for r in access.gate(req).collect()}
    assert got == {1: (False, ["restricted-data-requires-override"]), 2: (True, ["validate-drift-requires-audit-log"]), 3: (True, []), 4: (True, []), 5: (True, [])}
    assert {r["req_id"]: r["allowed"] for r in access.role_policy(req).collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}


@pytest.fixture
def changes(spark):
    return spark.sql("""SELECT * FROM VALUES (1, 'bank', 'data_owner', 'Person A', 'admin', '90', '365', 'monthly'), (2, 'bank', 'data_owner', 'Person B', 'admin', '101', '30', 'weekly'),
        (3, 'bank', 'data_steward', '  ', 'admin', NULL, NULL, NULL), (4, 'shop', 'chief', 'Person C', 'admin', '80', '-5', 'annual'), (5, 'nowhere', 'data_owner', 'Person D', 'admin', '75', 'abc', NULL),
        (6, 'shop', 'data_consumer', 'Person E', NULL, '0', '1', NULL) AS t(seq, dataset, role, assignee_name, assigned_by, threshold_pct, retention_days, review_frequency)""")


def test_validation(changes):
    a = {r["seq"]: list(r["reasons"]) for r in ch.validate(changes, ch.assignment_conditions()).collect()}
    assert a[1] == a[2] == a[5] == [] and a[3] == ["assignee_name is required"] and a[6] == ["assigned_by is required"] and len(a[4]) == 1
    p = {r["seq"]: len(r["reasons"]) for r in ch.validate(changes, ch.policy_conditions()).collect()}
    assert p == {1: 0, 2: 2, 3: 0, 4: 1, 5: 1, 6: 1}


def test_change_operators(spark, changes):
    base = spark.sql("SELECT * FROM VALUES ('bank', 'data_owner', 'Old', 0), ('mill', 'data_owner', 'Keep', 0) AS t(dataset, role, assignee_name, seq)")
    names = lambda df: {(r["dataset"], r["role"]): r["assignee_name"] for r in df.collect()}
    small = changes.select("dataset", "role", "assignee_name", "seq")
    assert names(ch.upsert_by_key(base, small.where("dataset = 'bank' AND role = 'data_owner'"), ["dataset", "role"], "seq")) == {("bank", "data_owner"): "Person B", ("mill", "data_owner"): "Keep"}
    table, rejected = ch.insert_new(base, small.where("role = 'data_owner'"), ["dataset", "role"], "seq")
    assert names(table) == {("bank", "data_owner"): "Old", ("mill", "data_owner"): "Keep", ("nowhere", "data_owner"): "Person D"}
    assert {r["seq"] for r in rejected.collect()} == {1, 2}
    table, rejected = ch.update_existing(base, small.where("seq IN (1, 3, 5)"), ["dataset", "role"], ["assignee_name"], "seq")
    assert names(table)[("bank", "data_owner")] == "Person A" and {r["seq"] for r in rejected.collect()} == {3, 5}
    assert names(ch.delete_by_key(base, small, ["dataset"])) == {("mill", "data_owner"): "Keep"}
    kept, counts = ch.delete_cascade({"child": (small, "dataset"), "parent": (base, "dataset")}, spark.sql("SELECT 'bank' AS dataset"), "dataset")
    assert {r[0]: r[1] for r in counts.collect()} == {"child": 3, "parent": 1} and kept["parent"].count() == 1
    assert {r["seq"] for r in ch.unknown_keys(changes, spark.sql("SELECT explode(array('bank', 'shop')) AS dataset"), "dataset").collect()} == {5}


def test_stewardship(spark):
    datasets = spark.sql("SELECT explode(array('a', 'b')) AS dataset")
    assigned = spark.sql("SELECT 'a' AS dataset, explode(array('business_owner','data_owner','data_steward','data_custodian','data_consumer')) AS role, 'P' AS assignee_name")
    assert st.role_grid(datasets, assigned).where("assigned").count() == 5 and st.role_grid(datasets, assigned).count() == 10
    cover = st.role_coverage(datasets, assigned)
    assert {r["dataset"]: r["roles_assigned"] for r in cover.collect()} == {"a": 5, "b": 0} and st.coverage_totals(cover).first() == (2, 1)
    policy = st.policies(datasets, spark.sql("SELECT 'a' AS dataset, 'semi_annual' AS review_frequency"))
    assert {r["dataset"]: (r["configured"], r["frequency_label"]) for r in policy.collect()} == {"a": (True, "Semi-annual"), "b": (False, None)}
    tasks = spark.sql("SELECT * FROM VALUES (1, 'a', 'open'), (2, 'a', 'done'), (3, 'b', 'in_progress') AS t(id, dataset, status)")
    assert [r["id"] for r in st.task_list(tasks).collect()] == [3, 1, 2]
    values = spark.sql("SELECT * FROM VALUES ('SA', 'Saudi Arabia'), ('FR', 'France') AS t(code, label)")
    rows = spark.sql("SELECT explode(array('SA', 'XX', 'XX', NULL)) AS country")
    assert [tuple(r) for r in st.violations(rows, "country", values).collect()] == [("XX", 2)]
    assert [r["code"] for r in st.search_values(values, "ran").collect()] == ["FR"]


def test_labels(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    at = spark.sql("SELECT explode(array(NULL, '2026-01-01 23:59:30', '2026-01-01 23:50:00', '2026-01-01 20:00:00', '2025-12-30 00:00:00')) AS t").select(freshness(F.col("t").cast("timestamp"), now))
    assert [r[0] for r in at.collect()] == ["never run", "just now", "10m ago", "4h ago", "3d ago"]
    assert spark.range(1).select(quarter_label(F.lit("2026-03-31 23:59:59").cast("timestamp"))).first()[0] == "2026 Q1"
    assert P.inline_table(spark, "a, b", [("it's \\ ok", None)]).first()[0] == "it's \\ ok"


@pytest.mark.parametrize("group_rows", [100_000, 40])
def test_conflicts_are_settled_as_if_one_by_one(spark, group_rows):
    """Chains that rounds would take one by one, random conflicts, and equal changes."""
    rng = random.Random(2)
    chain = [(k, f"n{(k + 1) // 2}", f"s{k // 2}") for k in range(1, 2001 if group_rows > 40 else 35)]
    mixed = [(10_000 + k, f"m{rng.randrange(60)}", f"t{rng.randrange(60)}") for k in range(200)]
    rows = [*chain, *mixed, chain[4], (None, None, "u"), (3, "n5x", None)]
    base = spark.createDataFrame([(0, "n5", "x")], "seq long, name string, slug string")
    done, refused = ch.insert_unique(base, spark.createDataFrame(rows, base.schema), ["name", "slug"], "seq", group_rows)
    names, slugs, want = {"n5"}, {"x"}, {(0, "n5", "x")}
    for s, n, g in sorted(r for r in set(rows) if None not in r):
        if n not in names and g not in slugs:
            names.add(n), slugs.add(g), want.add((s, n, g))
    assert sorted(tuple(r) for r in done.collect()) == sorted(want) and refused.count() == len(rows) - len(want) + 1
