"""Maturity, compliance, history, stewardship, code-list, access and change-set queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.catalog.base import Registry, placed, spark_sql, table, view
from tamarisk.functions import text as X
from tamarisk.functions.times import quarter_label
from tamarisk.operators import access, changes as ch, compliance as cp, history as hs, maturity as mt, search, stewardship as st
from tamarisk.operators import profile as prof
from tamarisk.session import scratch_path
from tamarisk.sources import keyed_files, zones

R = Registry()

# ---- maturity -------------------------------------------------------------------------------

_DOM = ", ".join(f"('{c}', {s}, {str(oe).lower()}, {P.PDP_WEIGHT_PCT if c == 'PDP' else P.DOMAIN_WEIGHT_PCT}::DOUBLE)" for c, n, s, oe in P.MATURITY_DOMAINS)
_LEVEL = "CASE " + " ".join(f"WHEN s BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN '{n}'" for lo, hi, n in P.MATURITY_LEVELS) + " ELSE 'Capability No' END"
_ASSESSED = f"""WITH dom(code, specs, is_oe, w) AS (VALUES {_DOM}), d AS (SELECT * FROM v_scores JOIN dom USING (code)),
    a AS (SELECT entity, round(sum(CAST(round(maturity * w, 6) AS DECIMAL(20,6)))::DOUBLE / 100, 3) AS s,
          coalesce(sum(CASE WHEN is_oe THEN CAST(round(maturity, 6) AS DECIMAL(20,6)) END)::DOUBLE, 0) AS oe,
          CAST(sum(round_even(specs * compliance_pct / 100, 0)) AS BIGINT) AS compliant_specs, CAST(sum(specs) AS BIGINT) AS total_specs FROM d GROUP BY 1)"""


@R.query("maturity_overall", _ASSESSED + f""" SELECT entity, s AS overall_maturity, round(s * 20, 1) AS display_score, {_LEVEL} AS maturity_level,
    round(100.0::DOUBLE * compliant_specs / total_specs, 1) AS overall_compliance_pct, round(oe / 6, 3) AS overall_oe_score, compliant_specs, total_specs FROM a""")
def maturity_overall(spark, sf):
    return mt.assess(view(spark, sf, "v_scores"))


@R.query("maturity_domains", f"""WITH dom(code, specs, is_oe, w) AS (VALUES {_DOM}) SELECT entity, code, specs AS spec_count, is_oe, maturity, compliance_pct,
    CASE WHEN compliance_pct >= 80 THEN 'high' WHEN compliance_pct >= 50 THEN 'medium' ELSE 'low' END AS compliance_status FROM v_scores JOIN dom USING (code)""")
def maturity_domains(spark, sf):
    return mt.domains(view(spark, sf, "v_scores")).select("entity", "code", "spec_count", "is_oe", "maturity", "compliance_pct", "compliance_status")


@R.query("maturity_oe_split", f"""WITH dom(code, specs, is_oe, w) AS (VALUES {_DOM}) SELECT entity, is_oe, count(*) AS domains,
    round(sum(maturity::DECIMAL(20,6))::DOUBLE / count(*), 4) AS avg_maturity, round(sum(compliance_pct::DECIMAL(20,6))::DOUBLE / count(*), 4) AS avg_compliance
    FROM v_scores JOIN dom USING (code) GROUP BY 1, 2""")
def maturity_oe_split(spark, sf):
    return mt.oe_split(view(spark, sf, "v_scores"))


@R.query("maturity_priority", f"""SELECT entity, code, compliance_pct, CAST(priority AS INT) AS priority, round(compliance_pct / greatest(top, 1), 4) AS bar_share FROM
    (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY compliance_pct, list_position({[c for c, *_ in P.MATURITY_DOMAINS]!r}, code)) AS priority,
     max(compliance_pct) OVER (PARTITION BY entity) AS top FROM v_scores) WHERE priority <= 6""")
def maturity_priority(spark, sf):
    return mt.priorities(view(spark, sf, "v_scores"))


_CARD = """WITH r AS (SELECT sheet, row_pos, domain_english AS label, current_score AS c, target_score AS t FROM v_scorecard WHERE domain_english IS NOT NULL),
    w AS (SELECT sheet, sum(c) > sum(t) AS swapped FROM r GROUP BY 1),
    rows AS (SELECT r.sheet, row_pos, label, CASE WHEN swapped THEN t ELSE c END AS current_score, CASE WHEN swapped THEN c ELSE t END AS target_score FROM r JOIN w USING (sheet))"""


def _card(spark, sf):
    return mt.scorecard_rows(view(spark, sf, "v_scorecard"), ["sheet"])


@R.query("readiness_scorecard", _CARD + """ SELECT sheet, count(*) AS domain_count, round(sum(current_score) / count(*), 2) AS avg_current, round(sum(target_score) / count(*), 2) AS avg_target,
    round((sum(current_score) / count(*)) / nullif(sum(target_score) / count(*), 0) * 100, 1) AS readiness_index FROM rows GROUP BY 1""")
def readiness_scorecard(spark, sf):
    return mt.readiness(_card(spark, sf), ["sheet"])


@R.query("readiness_gaps", _CARD + """ SELECT sheet, row_pos, label, current_score, target_score, round(target_score - current_score, 2) AS gap, CAST(rank AS INT) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY round(target_score - current_score, 2) DESC, row_pos) AS rank FROM rows) WHERE rank <= 5""")
def readiness_gaps(spark, sf):
    return mt.top_gaps(_card(spark, sf), ["sheet"])


# ---- compliance ------------------------------------------------------------------------------

PEOPLE = ["CUST_ID", "FULL_NAME", "DOB", "PHONE", "EMAIL", "NATIONAL_ID", "NATION"]
PARTS = ["p_partkey", "p_name", "p_brand"]
_REG = """reg AS (SELECT dataset AS safe_name, count(*) AS rows, 7 AS ncols, """ + " + ".join(f"(count(*) - count({c}))" for c in PEOPLE) + """ AS nulls,
    3 AS npii, (count(*) - count(PHONE)) + (count(*) - count(EMAIL)) + (count(*) - count(NATIONAL_ID)) AS pii_nulls, true AS checked, false AS ready FROM v_customers GROUP BY 1
    UNION ALL SELECT 'parts', count(*), 3, 0, 0, 0, false, false FROM part
    UNION ALL SELECT 'loans', count(*), 6, count(*) - count(MATURITY), 0, 0, true, true FROM v_loans),
    cl AS (SELECT dataset AS safe_name, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status <> 'pending') AS decided,
      coalesce(sum(size) FILTER (WHERE status = 'pending'), 0) AS records_pending, count(*) FILTER (WHERE status = 'confirmed_duplicate') AS confirmed,
      coalesce(sum(greatest(size - 1, 0)) FILTER (WHERE status = 'confirmed_duplicate'), 0) AS extra FROM v_decisions GROUP BY 1),
    sig AS (SELECT reg.*, coalesce(pending, 0) AS pending, coalesce(decided, 0) AS decided, coalesce(records_pending, 0) AS records_pending,
      coalesce(confirmed, 0) AS confirmed, CAST(coalesce(extra, 0) AS BIGINT) AS extra FROM reg LEFT JOIN cl USING (safe_name)),
    sc AS (SELECT *, CASE WHEN checked THEN round(coalesce(100.0::DOUBLE * decided / nullif(pending + decided, 0), 100), 1) END AS dg,
      round(CASE WHEN nulls > 0 AND rows > 0 THEN greatest(0, 100 - 100.0::DOUBLE * nulls / (ncols * rows)) ELSE 100 END, 1) AS dq,
      CASE WHEN checked THEN round(coalesce(100.0::DOUBLE * greatest(0, rows - records_pending) / nullif(rows, 0), 100), 1) END AS rmd,
      CASE WHEN npii > 0 AND rows > 0 THEN round(greatest(0, 100 - 100.0::DOUBLE * pii_nulls / (npii * rows)), 1) END AS pdp FROM sig)"""
_DOMAINS = ", " + """dom AS (SELECT safe_name AS dataset, unnest([""" + ", ".join(
    f"{{'pos': {i}, 'code': '{c}', 'name': '{n}', 'score': {dict(DG='dg', DQ='dq', RMD='rmd', PDP='pdp').get(c, 'NULL::DOUBLE')}}}" for i, (c, n) in enumerate(P.COMPLIANCE_DOMAINS)) + """]) AS x FROM sc)"""


def signals(spark, sf):
    """Registry rows of three sources, measured from the whole tables, beside their clusters."""
    def entry(df, name, checked):
        reg = prof.registry_rows(prof.column_profile(df, name))
        return reg.select("safe_name", "rows", "columns", "null_counts", F.lit(checked).alias("checked"))

    people = entry(view(spark, sf, "v_customers").select("dataset", *PEOPLE), F.col("dataset"), True)
    people = people.withColumn("columns", F.filter("columns", lambda c: c != "dataset"))
    reg = (people.unionByName(entry(table(spark, sf, "part").select(*PARTS), "parts", False))
           .unionByName(entry(view(spark, sf, "v_loans").select(*P.MODELLING_COLUMNS), "loans", True)))
    return cp.signals(reg, view(spark, sf, "v_decisions"))


@R.query("compliance_domains", f"WITH {_REG} {_DOMAINS} SELECT dataset, CAST(x.pos AS INT) AS pos, x.code AS code, x.name AS name, x.score AS score, CASE WHEN x.score IS NULL THEN 'not_measured' ELSE 'measured' END AS status FROM dom")
def compliance_domains(spark, sf):
    return cp.domain_rows(cp.scores(signals(spark, sf)))


@R.query("compliance_checks", f"""WITH {_REG} SELECT safe_name AS dataset, 0 AS pos, 'Data Governance' AS label, CASE WHEN NOT checked THEN 'not_measured' WHEN dg >= 80 THEN 'ok' ELSE 'warn' END AS status, dg AS figure FROM sc
    UNION ALL SELECT safe_name, 1, 'MDM', CASE WHEN NOT checked THEN 'not_measured' WHEN pending = 0 THEN 'ok' ELSE 'warn' END, CASE WHEN checked THEN pending::DOUBLE END FROM sc
    UNION ALL SELECT safe_name, 2, 'Data Classification', 'not_measured', NULL FROM sc
    UNION ALL SELECT safe_name, 3, 'PDPL', CASE WHEN coalesce(pdp, 0) >= 90 THEN 'ok' ELSE 'warn' END, pdp FROM sc
    UNION ALL SELECT safe_name, 4, 'IFRS 9 readiness', CASE WHEN ready THEN 'ok' ELSE 'warn' END, CASE WHEN ready THEN 1.0 ELSE 0.0 END::DOUBLE FROM sc""")
def compliance_checks(spark, sf):
    return cp.checks(cp.scores(signals(spark, sf)))


@R.query("compliance_alert", f"""WITH {_REG} SELECT safe_name AS dataset, CASE WHEN NOT checked THEN 'check_never_run' WHEN pending > 0 THEN 'pending_reviews' ELSE 'lowest_domain' END AS alert,
    CASE WHEN NOT checked THEN 'duplicate detection has not been run' WHEN pending > 0 THEN concat(pending, ' duplicate cluster(s) still need review')
      ELSE concat(CASE least(dg, dq, rmd, pdp) WHEN dg THEN 'Data Governance' WHEN dq THEN 'Data Quality' WHEN rmd THEN 'Risk Management Data' ELSE 'Personal Data Protection' END, ' is lowest') END AS message FROM sc""")
def compliance_alert(spark, sf):
    return cp.alerts(cp.scores(signals(spark, sf)))


@R.query("compliance_average", f"""WITH {_REG} {_DOMAINS} SELECT dataset, count(x.score) AS measured, round(sum(CAST(x.score AS DECIMAL(6,1)))::DOUBLE / count(x.score), 1) AS average_score FROM dom GROUP BY 1""")
def compliance_average(spark, sf):
    return cp.average(cp.domain_rows(cp.scores(signals(spark, sf))))


@R.query("customer_360", f"""WITH {_REG} SELECT safe_name AS dataset, rows AS total_records, CASE WHEN checked THEN greatest(rows - extra, 0) END AS golden_estimate,
    CASE WHEN checked THEN round(100.0::DOUBLE * greatest(rows - extra, 0) / rows, 1) END AS uniqueness_pct, 99.0::DOUBLE AS uniqueness_target,
    CASE WHEN checked THEN confirmed END AS clusters_confirmed, CASE WHEN checked THEN extra END AS extra_records FROM sig""")
def customer_360(spark, sf):
    return cp.customer_360(signals(spark, sf))


# ---- snapshot history -------------------------------------------------------------------------

_DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias("recorded_on")


@R.query("dataset_history", """SELECT dataset, id, strftime(recorded_at, '%Y-%m-%d') AS recorded_on, score, round(score - lag(score) OVER w, 1) AS score_delta,
    round(compliance_pct - lag(compliance_pct) OVER w, 1) AS compliance_pct_delta FROM v_snapshots WINDOW w AS (PARTITION BY dataset ORDER BY recorded_at, id)""")
def dataset_history(spark, sf):
    out = hs.with_deltas(view(spark, sf, "v_snapshots"), ["dataset"], ["score", "compliance_pct"])
    return out.select("dataset", "id", _DAY("recorded_at"), "score", "score_delta", "compliance_pct_delta")


@R.query("overall_history", """SELECT id, strftime(recorded_at, '%Y-%m-%d') AS recorded_on, score, score_delta FROM
    (SELECT *, round(score - lag(score) OVER (ORDER BY recorded_at, id), 1) AS score_delta FROM v_snapshots) ORDER BY recorded_at DESC, id DESC LIMIT 100""")
def overall_history(spark, sf):
    """One series over all snapshots: deltas first, then the newest page."""
    out = hs.newest(hs.with_deltas(view(spark, sf, "v_snapshots"), [], ["score"]), 100)
    return out.select("id", _DAY("recorded_at"), "score", "score_delta")


@R.query("history_identical", """SELECT dataset, count(*) AS snapshots, count(*) > 1 AND count(DISTINCT coalesce(score, -1)) = 1 AS all_identical FROM v_snapshots GROUP BY 1""")
def history_identical(spark, sf):
    return hs.all_identical(view(spark, sf, "v_snapshots"), ["dataset"], "score")


@R.query("history_periods", "SELECT concat(year(recorded_at), ' Q', quarter(recorded_at)) AS period, count(*) AS snapshots FROM v_snapshots GROUP BY 1")
def history_periods(spark, sf):
    return hs.periods(view(spark, sf, "v_snapshots"))


@R.query("run_periods", "SELECT concat(year(started_at), ' Q', quarter(started_at)) AS period, dataset, count(*) AS runs FROM v_runs WHERE concat(year(started_at), ' Q', quarter(started_at)) = '1997 Q2' GROUP BY ALL")
def run_periods(spark, sf):
    runs = view(spark, sf, "v_runs").withColumn("recorded_at", F.col("started_at"))
    return hs.in_period(runs, "1997 Q2").groupBy(quarter_label(F.col("recorded_at")).alias("period"), "dataset").agg(F.count("*").alias("runs"))


_PAIRS = "SELECT max(id) AS first_id, min(id) AS second_id FROM v_snapshots GROUP BY dataset"


@R.query("history_compare", f"""WITH p AS ({_PAIRS}), l AS (SELECT p.second_id AS earlier_id, p.first_id AS later_id, d.* FROM p JOIN v_snapshot_domains d ON d.snapshot_id = p.first_id WHERE p.first_id <> p.second_id)
    SELECT l.earlier_id, l.later_id, l.code, e.maturity AS earlier_maturity, l.maturity AS later_maturity, round(l.maturity - e.maturity, 2) AS maturity_delta,
           round(l.compliance - e.compliance, 1) AS compliance_delta, e.maturity IS NOT NULL AS comparable
    FROM l LEFT JOIN v_snapshot_domains e ON e.snapshot_id = l.earlier_id AND e.code = l.code""")
def history_compare(spark, sf):
    return hs.compare(view(spark, sf, "v_snapshot_domains"), spark_sql(spark, sf, _PAIRS))


@R.query("history_export", "SELECT dataset, CAST(id AS VARCHAR) AS id, coalesce(CAST(CAST(score * 10 AS INT) AS VARCHAR), '') AS score_tenths FROM v_snapshots")
def history_export(spark, sf):
    """Ordered CSV export, nulls as empty text, read back as text."""
    path = scratch_path(spark, "export")
    zones.export_csv(view(spark, sf, "v_snapshots").select("dataset", "recorded_at", "id", (F.col("score") * 10).cast("int").alias("score_tenths")), path, hs.ORDER)
    back = spark.read.option("header", True).csv(path)
    return back.select("dataset", "id", F.coalesce("score_tenths", F.lit("")).alias("score_tenths"))


def _recorded(spark, sf):
    """Assessments stored with their domain rows inside, then exploded again; unnamed recorders are refused."""
    stored = view(spark, sf, "v_scores").groupBy("entity").agg(F.collect_list(F.struct("code", "compliance_pct")).alias("domains"))
    n = F.size("domains")
    recorder = F.when(n > 2, F.concat(F.lit(" rec"), n.cast("string"))).otherwise(F.lit("  "))
    return hs.record(stored, recorder, F.lit("2026-09-01").cast("timestamp"), F.when(n > 6, F.lit(" note ")).otherwise(F.lit("  ")))


@R.query("snapshot_recorded", """WITH n AS (SELECT entity, count(*) AS n FROM v_scores GROUP BY 1)
    SELECT entity, concat('rec', n) AS recorded_by, CASE WHEN n > 6 THEN 'note' END AS note, code, compliance_pct FROM v_scores JOIN n USING (entity) WHERE n > 2""")
def snapshot_recorded(spark, sf):
    return _recorded(spark, sf)[0].select("entity", "recorded_by", "note", F.inline("domains"))


@R.query("snapshot_refused", "SELECT entity, count(*) AS domains, 'the recorder must be named' AS reason FROM v_scores GROUP BY 1 HAVING count(*) <= 2")
def snapshot_refused(spark, sf):
    return _recorded(spark, sf)[1].select("entity", F.size("domains").cast("bigint").alias("domains"), "reason")


@R.query("snapshot_exported", """SELECT CAST(s.id AS VARCHAR) AS id, s.dataset AS recorded_by, d.code, CAST(CAST(floor(d.compliance) AS BIGINT) AS VARCHAR) AS compliance
    FROM v_snapshots s JOIN v_snapshot_domains d ON d.snapshot_id = s.id WHERE s.id = (SELECT max(snapshot_id) FROM v_snapshot_domains JOIN v_snapshots ON id = snapshot_id)""")
def snapshot_exported(spark, sf):
    """The newest snapshot with its domain rows as a CSV file, read back as text."""
    domains = view(spark, sf, "v_snapshot_domains").select(F.col("snapshot_id").alias("id"), "code", F.floor("compliance").alias("compliance"))
    held = domains.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "compliance"))).alias("domains"))
    snapshots = view(spark, sf, "v_snapshots").select("id", "recorded_at", F.col("dataset").alias("recorded_by")).join(held, "id")
    newest, path = snapshots.agg(F.max("id")).first()[0], scratch_path(spark, "export")
    if newest is None:
        return spark.createDataFrame([], "id string, recorded_by string, code string, compliance string")
    hs.one_exported(snapshots, newest, "domains", path)
    return spark.read.option("header", True).csv(path).select("id", "recorded_by", "code", "compliance")


@R.query("snapshot_one", "SELECT id, dataset, score FROM v_snapshots WHERE id = (SELECT min(id) FROM v_snapshots)")
def snapshot_one(spark, sf):
    snapshots = view(spark, sf, "v_snapshots")
    first = snapshots.agg(F.min("id")).first()[0]
    return (snapshots.limit(0) if first is None else hs.one(snapshots, first)).select("id", "dataset", "score")


# ---- access -------------------------------------------------------------------------------------

@R.query("access_gate", """SELECT req_id, NOT blocked AS allowed, CASE WHEN blocked THEN 'restricted-data-requires-override' WHEN intent = 'validate_drift' THEN 'validate-drift-requires-audit-log' ELSE '' END AS rules,
    CASE WHEN blocked THEN 'blocked: restricted data without an approved override' ELSE concat('''', coalesce(classification, 'UNSPECIFIED'), ''' cleared for ''', intent, '''') END AS note
    FROM (SELECT *, coalesce(classification = 'RESTRICTED' AND NOT override_approved, false) AS blocked FROM v_requests)""")
def access_gate(spark, sf):
    return access.gate(view(spark, sf, "v_requests")).select("req_id", "allowed", F.array_join("applied_rules", ",").alias("rules"), "note")


@R.query("policy_any_role", """SELECT req_id, rule, coalesce(CASE rule WHEN 'classification_allow' THEN list_has_any(string_split(roles, ','), ['admin', 'data_owner', 'data_steward'])
    WHEN 'stewardship_assign_allow' THEN list_has_any(string_split(roles, ','), ['admin', 'data_owner']) END, false) AS allowed FROM v_requests""")
def policy_any_role(spark, sf):
    return access.role_policy(view(spark, sf, "v_requests")).select("req_id", "rule", "allowed")


# ---- stewardship -----------------------------------------------------------------------------------

_ROLE_LIST = ", ".join(f"('{r}')" for r in P.STEWARD_ROLES)
_VALID = f"trim(coalesce(assignee_name, '')) <> '' AND assigned_by IS NOT NULL AND role IN ({', '.join(repr(r) for r in P.STEWARD_ROLES)})"
_NEWROLES = f"""lt AS (SELECT dataset, role, trim(assignee_name) AS assignee_name, seq FROM v_changes WHERE {_VALID} AND dataset IN (SELECT dataset FROM v_datasets)
      QUALIFY row_number() OVER (PARTITION BY dataset, role ORDER BY seq DESC) = 1),
    up AS (SELECT * FROM v_assignments a WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.dataset = a.dataset AND lt.role = a.role) UNION ALL SELECT * FROM lt)"""


def _checked_changes(spark, sf):
    return ch.validate(view(spark, sf, "v_changes"), ch.assignment_conditions())


def _good_changes(spark, sf):
    good = _checked_changes(spark, sf).where("accepted").join(view(spark, sf, "v_datasets").select("dataset"), "dataset", "left_semi")
    return good.withColumn("assignee_name", X.clean_text(F.col("assignee_name")))


def _assignments(spark, sf):
    return ch.upsert_by_key(view(spark, sf, "v_assignments"), _good_changes(spark, sf), ["dataset", "role"], "seq")


@R.query("changes_upsert", f"WITH {_NEWROLES} SELECT * FROM up")
def changes_upsert(spark, sf):
    return _assignments(spark, sf)


@R.query("changes_upsert_by_file", f"WITH {_NEWROLES} SELECT * FROM up")
def changes_upsert_by_file(spark, sf):
    """The same on a table of files, of which only those with a changed key are written anew."""
    root, keys = scratch_path(spark, "roles"), ["dataset", "role"]
    now, _ = keyed_files.upsert(spark, root, keyed_files.create(view(spark, sf, "v_assignments"), root, keys), _good_changes(spark, sf), keys, "seq")
    return keyed_files.read(spark, root, now)


def _order_files(spark, sf):
    """Orders as files in key order, with what their first eighth of keys becomes; some changes name no order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    root = scratch_path(spark, "orders")
    first = keyed_files.create(orders, root, ["o_orderkey"], FILES)
    low = orders.where(F.col("o_orderkey") <= F.lit(orders.agg(F.max("o_orderkey") / 8).first()[0]))
    given = F.when(F.col("o_orderkey") % 3 > 0, F.lit("X"))
    changes = low.select(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
                         given.alias("o_orderstatus"), F.col("o_custkey").alias("seq"))
    return root, first, changes


FILES = 24
_LOW = "o_orderkey <= (SELECT max(o_orderkey) / 8 FROM orders)"


@R.query("orders_update_by_file", f"""SELECT o_orderkey, o_custkey, CASE WHEN {_LOW} AND o_orderkey % 3 > 0 AND o_orderkey % 5 <> 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, false AS refused FROM orders
    UNION ALL SELECT -o_orderkey - 1, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN 'X' END, true FROM orders WHERE {_LOW} AND o_orderkey % 5 = 0""")
def orders_update_by_file(spark, sf):
    root, first, changes = _order_files(spark, sf)
    now, _, refused = keyed_files.update(spark, root, first, changes, ["o_orderkey"], ["o_orderstatus"], "seq")
    done = keyed_files.read(spark, root, now).select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(False).alias("refused"))
    return done.unionByName(refused.select("o_orderkey", F.col("seq").alias("o_custkey"), "o_orderstatus", F.lit(True).alias("refused")))


@R.query("orders_delete_by_file", f"""WITH gone AS (SELECT count(*) AS n FROM orders WHERE {_LOW} AND o_orderkey % 5 <> 0), all_rows AS (SELECT count(*) AS n FROM orders)
    SELECT all_rows.n AS rows_before, all_rows.n - gone.n AS rows_after, all_rows.n - gone.n AS rows_listed, 0::BIGINT AS gone_in_kept, true AS most_files_kept FROM all_rows, gone""")
def orders_delete_by_file(spark, sf):
    """What became of the files: rows, rows by the list, rows of removed keys in files that were kept, and whether most were kept."""
    root, first, changes = _order_files(spark, sf)
    now, met = keyed_files.delete(spark, root, first, changes, ["o_orderkey"])
    before, after = (keyed_files.files(spark, root, v) for v in (first, now))
    kept = before.join(after.select("file"), "file", "left_semi")
    left = keyed_files.read(spark, root, now)
    facts = {"rows_before": before.agg(F.sum("rows")), "rows_after": left.agg(F.count("*")), "rows_listed": after.agg(F.sum("rows")), "files": before.agg(F.count("*")),
             "kept": kept.agg(F.count("*")), "gone_in_kept": keyed_files.rows_in(spark, root, kept).join(changes, "o_orderkey", "left_semi").agg(F.count("*"))}
    one = reduce(DataFrame.unionByName, [df.toDF("n").withColumn("fact", F.lit(name)) for name, df in facts.items()])
    out = one.agg(*[F.max(F.when(F.col("fact") == name, F.col("n"))).alias(name) for name in facts])
    most = (F.col("kept") == F.col("files") - len(met)) & (2 * F.col("kept") > F.col("files"))
    return out.select("rows_before", "rows_after", "rows_listed", "gone_in_kept", most.alias("most_files_kept"))


@R.query("steward_roles", f"""WITH {_NEWROLES}, roles(role) AS (VALUES {_ROLE_LIST})
    SELECT d.dataset, r.role, up.assignee_name, up.assignee_name IS NOT NULL AS assigned FROM v_datasets d CROSS JOIN roles r LEFT JOIN up ON up.dataset = d.dataset AND up.role = r.role""")
def steward_roles(spark, sf):
    return st.role_grid(view(spark, sf, "v_datasets"), _assignments(spark, sf)).select("dataset", "role", "assignee_name", "assigned")


@R.query("steward_coverage", f"""WITH {_NEWROLES} SELECT d.dataset, count(up.role) AS roles_assigned, count(up.role) = 5 AS fully_assigned FROM v_datasets d LEFT JOIN up ON up.dataset = d.dataset GROUP BY 1""")
def steward_coverage(spark, sf):
    return st.role_coverage(view(spark, sf, "v_datasets"), _assignments(spark, sf))


@R.query("steward_coverage_totals", f"""WITH {_NEWROLES}, c AS (SELECT d.dataset, count(up.role) AS n FROM v_datasets d LEFT JOIN up ON up.dataset = d.dataset GROUP BY 1)
    SELECT count(*) AS datasets, count(*) FILTER (WHERE n = 5) AS fully_assigned FROM c""")
def steward_coverage_totals(spark, sf):
    return st.coverage_totals(st.role_coverage(view(spark, sf, "v_datasets"), _assignments(spark, sf)))


_RD = "trim(coalesce(retention_days, ''))"
_POLICY_BAD = f"""[CASE WHEN {_RD} <> '' AND NOT coalesce(TRY_CAST(retention_days AS BIGINT) > 0, false) THEN 'retention_days must be a positive whole number' END,
    CASE WHEN review_frequency IS NOT NULL AND review_frequency NOT IN ('monthly', 'quarterly', 'semi_annual', 'annual') THEN 'review_frequency is not one of the allowed values' END,
    CASE WHEN threshold_pct IS NOT NULL AND NOT coalesce(TRY_CAST(threshold_pct AS DOUBLE) BETWEEN 0 AND 100, false) THEN 'threshold_pct must be between 0 and 100' END,
    CASE WHEN assigned_by IS NULL THEN 'assigned_by is required' END]"""


@R.query("changes_validate", f"SELECT seq, array_to_string(list_filter({_POLICY_BAD}, lambda r: r IS NOT NULL), '; ') AS reasons FROM v_changes")
def changes_validate(spark, sf):
    return ch.validate(view(spark, sf, "v_changes"), ch.policy_conditions()).select("seq", F.array_join("reasons", "; ").alias("reasons"))


@R.query("assignments_validate", f"""SELECT seq, array_to_string(list_filter([CASE WHEN role = 'chief' THEN 'role is not one of the allowed values' END,
    CASE WHEN trim(assignee_name) = '' THEN 'assignee_name is required' END, CASE WHEN assigned_by IS NULL THEN 'assigned_by is required' END], lambda r: r IS NOT NULL), '; ') AS reasons FROM v_changes""")
def assignments_validate(spark, sf):
    return _checked_changes(spark, sf).select("seq", F.array_join("reasons", "; ").alias("reasons"))


@R.query("steward_policy", f"""WITH ok AS (SELECT * FROM v_changes WHERE len(list_filter({_POLICY_BAD}, lambda r: r IS NOT NULL)) = 0 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY seq DESC) = 1)
    SELECT d.dataset, ok.retention_days, ok.review_frequency, CASE ok.review_frequency WHEN 'monthly' THEN 'Monthly' WHEN 'quarterly' THEN 'Quarterly' WHEN 'annual' THEN 'Annual' END AS frequency_label,
           ok.dataset IS NOT NULL AS configured FROM v_datasets d LEFT JOIN ok ON ok.dataset = d.dataset""")
def steward_policy(spark, sf):
    good = ch.validate(view(spark, sf, "v_changes"), ch.policy_conditions()).where("accepted")
    settings = ch.latest(good.select("dataset", "seq", "retention_days", "review_frequency"), ["dataset"], "seq")
    return st.policies(view(spark, sf, "v_datasets"), settings).select("dataset", "retention_days", "review_frequency", "frequency_label", "configured")


@R.query("steward_tasks", """SELECT id, dataset, status, status NOT IN ('done', 'cancelled') AS is_open,
    row_number() OVER (ORDER BY CASE WHEN status IN ('done', 'cancelled') THEN 1 ELSE 0 END, id DESC) AS place FROM v_tasks_list""")
def steward_tasks(spark, sf):
    return placed(st.task_list(view(spark, sf, "v_tasks_list")))


@R.query("steward_task_counts", "SELECT dataset, count(*) AS tasks, count(*) FILTER (WHERE status NOT IN ('done', 'cancelled')) AS open_tasks FROM v_tasks_list GROUP BY 1")
def steward_task_counts(spark, sf):
    return st.task_counts(view(spark, sf, "v_tasks_list"))


# ---- the other change operators ------------------------------------------------------------------------

@R.query("changes_insert", """WITH f AS (SELECT dataset, role, trim(assignee_name) AS assignee_name, seq FROM v_changes WHERE assigned_by IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, role ORDER BY seq) = 1)
    SELECT * FROM v_assignments UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM v_assignments a WHERE a.dataset = f.dataset AND a.role = f.role)""")
def changes_insert(spark, sf):
    return _inserted(spark, sf)[0]


def _inserted(spark, sf):
    new = view(spark, sf, "v_changes").where("assigned_by IS NOT NULL").withColumn("assignee_name", F.trim("assignee_name"))
    return ch.insert_new(view(spark, sf, "v_assignments"), new.select("dataset", "role", "assignee_name", "seq"), ["dataset", "role"], "seq")


@R.query("changes_insert_rejected", """WITH c AS (SELECT dataset, role, seq, row_number() OVER (PARTITION BY dataset, role ORDER BY seq) AS n FROM v_changes WHERE assigned_by IS NOT NULL)
    SELECT dataset, role, seq FROM c WHERE n > 1 OR EXISTS (SELECT 1 FROM v_assignments a WHERE a.dataset = c.dataset AND a.role = c.role)""")
def changes_insert_rejected(spark, sf):
    return _inserted(spark, sf)[1].select("dataset", "role", "seq")


# Every tenth change has no data set, every eleventh no role; every change of a fifth sequence number is there twice.
_LOOSE = """SELECT CASE WHEN seq % 10 = 0 THEN NULL ELSE dataset END AS dataset, CASE WHEN seq % 11 = 0 THEN NULL ELSE role END AS role, assignee_name, seq - seq % 3 AS seq FROM v_changes"""
_LOOSE_TWICE = f"{_LOOSE} UNION ALL SELECT * FROM ({_LOOSE}) t WHERE seq % 5 = 0"


@R.query("changes_null_keys", f"""WITH c AS ({_LOOSE_TWICE}),
    k AS (SELECT * FROM c WHERE dataset IS NOT NULL AND role IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_assignments a WHERE a.dataset = c.dataset AND a.role = c.role))
    SELECT 'table' AS part, (SELECT count(*) FROM v_assignments) + (SELECT count(DISTINCT (dataset, role)) FROM k) AS rows
    UNION ALL SELECT 'the key is missing', count(*) FROM c WHERE dataset IS NULL OR role IS NULL
    UNION ALL SELECT 'the key is taken', count(*) FILTER (WHERE dataset IS NOT NULL AND role IS NOT NULL) - (SELECT count(DISTINCT (dataset, role)) FROM k) FROM c
    UNION ALL SELECT 'after upsert', (SELECT count(*) FROM (SELECT dataset, role FROM v_assignments UNION SELECT dataset, role FROM c WHERE dataset IS NOT NULL AND role IS NOT NULL))""")
def changes_null_keys(spark, sf):
    """Changes without a key are refused, and of equal ones one is taken; every change is in one part."""
    base, given = view(spark, sf, "v_assignments"), spark_sql(spark, sf, _LOOSE_TWICE)
    done, refused = ch.insert_new(base, given, ["dataset", "role"], "seq")
    counted = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("rows"))
    out = counted(done, "table").unionByName(counted(ch.upsert_by_key(base, given, ["dataset", "role"], "seq"), "after upsert"))
    return out.unionByName(refused.groupBy(F.col("reason").alias("part")).agg(F.count("*").alias("rows")))


_REASONS = lambda conditions: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{text}' END" for bad, text in conditions) + "], lambda r: r IS NOT NULL), '; ') AS reasons"
_BLANK = lambda c: (f"trim(coalesce({c}, '')) = ''", f"{c} is required")


def _judged(spark, sf, given, key, conditions):
    df = spark_sql(spark, sf, given) if isinstance(given, str) else given
    return ch.validate(df, conditions).select(key, F.array_join("reasons", "; ").alias("reasons"))


_GIVEN_TASKS = "SELECT seq, CASE WHEN seq % 13 = 0 THEN ' ' ELSE dataset END AS dataset, CASE WHEN seq % 9 = 0 THEN NULL ELSE role END AS title, assignee_name, assigned_by AS created_by FROM v_changes"


@R.query("tasks_validate", f"SELECT seq, {_REASONS([_BLANK('dataset'), _BLANK('title'), _BLANK('assignee_name'), _BLANK('created_by')])} FROM ({_GIVEN_TASKS})")
def tasks_validate(spark, sf):
    return _judged(spark, sf, _GIVEN_TASKS, "seq", ch.task_conditions())


_GIVEN_TERMS = """SELECT id, CASE WHEN id % 11 = 0 THEN ' ' ELSE term END AS term, CASE WHEN id % 7 = 0 THEN NULL ELSE definition END AS definition,
    CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Nowhere' WHEN 2 THEN '' ELSE domain END AS domain, CASE id % 4 WHEN 0 THEN 'a, b' WHEN 1 THEN '["a", "b"]' WHEN 2 THEN '[' END AS tags,
    CASE WHEN id % 17 = 0 THEN NULL ELSE 'me' END AS created_by FROM v_terms"""


@R.query("terms_validate", f"""SELECT id, CASE WHEN coalesce(domain, '') = '' THEN 'Other' ELSE domain END AS domain,
    {_REASONS([_BLANK('term'), _BLANK('definition'), ("domain = 'Nowhere'", 'domain is not one of the allowed values'), ("tags IN ('a, b', '[')", 'tags must be a list'), _BLANK('created_by')])} FROM ({_GIVEN_TERMS})""")
def terms_validate(spark, sf):
    checked = ch.validate(ch.with_default_domain(spark_sql(spark, sf, _GIVEN_TERMS)), ch.term_conditions())
    return checked.select("id", "domain", F.array_join("reasons", "; ").alias("reasons"))


_GIVEN_LISTS = """SELECT p_partkey AS seq, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat('Name ', p_partkey % 300) END AS name,
    CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat('Slug ', p_partkey % 170) END AS slug, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'me' END AS created_by FROM {part}"""


@R.query("lists_validate", f"SELECT seq, {_REASONS([_BLANK('name'), _BLANK('slug'), _BLANK('created_by')])} FROM ({_GIVEN_LISTS})")
def lists_validate(spark, sf):
    return _judged(spark, sf, _GIVEN_LISTS, "seq", ch.list_conditions())


_GIVEN_VALUES = """SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS list_id, CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type END AS code,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('l', event_id) END AS label FROM {events}"""


@R.query("values_validate", f"SELECT seq, {_REASONS([('list_id IS NULL', 'list_id is required'), _BLANK('code'), _BLANK('label')])} FROM ({_GIVEN_VALUES})")
def values_validate(spark, sf):
    return _judged(spark, sf, _GIVEN_VALUES, "seq", ch.value_conditions())


@R.query("lists_insert", f"""WITH RECURSIVE g AS (SELECT row_number() OVER (ORDER BY seq) AS i, name, replace(lower(trim(slug)), ' ', '-') AS slug FROM ({_GIVEN_LISTS}) WHERE name IS NOT NULL AND trim(slug) <> '' AND created_by IS NOT NULL),
    walk AS (SELECT 0::BIGINT AS i, (SELECT list(r_name) FROM region) AS names, ['slug-3', 'slug-5'] AS slugs, 0 AS added
      UNION ALL SELECT g.i, CASE WHEN ok THEN list_append(names, g.name) ELSE names END, CASE WHEN ok THEN list_append(slugs, g.slug) ELSE slugs END, CAST(ok AS INT)
      FROM (SELECT walk.*, walk.i + 1 AS at FROM walk) w JOIN g ON g.i = w.at, LATERAL (SELECT NOT list_contains(w.names, g.name) AND NOT list_contains(w.slugs, g.slug) AS ok))
    SELECT g.name, g.slug, walk.added = 1 AS accepted FROM walk JOIN g ON g.i = walk.i""")
def lists_insert(spark, sf):
    """Name and slug are each unique; an earlier accepted list refuses a later one."""
    given = ch.validate(spark_sql(spark, sf, _GIVEN_LISTS), ch.list_conditions()).where("accepted").select("seq", "name", X.slug(F.col("slug")).alias("slug"))
    base = spark_sql(spark, sf, "SELECT r_regionkey AS seq, r_name AS name, CASE r_regionkey WHEN 0 THEN 'slug-3' WHEN 1 THEN 'slug-5' ELSE concat('r', r_regionkey) END AS slug FROM {region}")
    done, refused = ch.insert_unique(base, given, ["name", "slug"], "seq")
    added = done.join(base.select("name"), "name", "left_anti")
    return added.select("name", "slug", F.lit(True).alias("accepted")).unionByName(refused.select("name", "slug", F.lit(False).alias("accepted")))


_EDITS = "SELECT seq, seq AS id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS domain, CASE WHEN event_type = 'click' THEN NULL ELSE concat('v', seq) END AS definition FROM (SELECT event_id AS seq, event_type FROM {events})"


@R.query("changes_update", f"""WITH e AS ({_EDITS}) SELECT t.id, coalesce(e.domain, t.domain) AS domain, coalesce(e.definition, t.definition) AS definition FROM v_terms t LEFT JOIN e ON e.id = t.id""")
def changes_update(spark, sf):
    return ch.update_existing(view(spark, sf, "v_terms"), spark_sql(spark, sf, _EDITS), ["id"], ["domain", "definition"], "seq")[0].select("id", "domain", "definition")


@R.query("changes_update_rejected", f"WITH e AS ({_EDITS}) SELECT seq, id FROM e WHERE id NOT IN (SELECT id FROM v_terms)")
def changes_update_rejected(spark, sf):
    return ch.update_existing(view(spark, sf, "v_terms"), spark_sql(spark, sf, _EDITS), ["id"], ["domain", "definition"], "seq")[1].select("seq", "id")


@R.query("changes_delete", "SELECT dataset, role, assignee_name FROM v_assignments WHERE dataset NOT IN (SELECT dataset FROM v_changes)")
def changes_delete(spark, sf):
    return ch.delete_by_key(view(spark, sf, "v_assignments"), view(spark, sf, "v_changes"), ["dataset"]).select("dataset", "role", "assignee_name")


@R.query("delete_cascade", """WITH g AS (SELECT DISTINCT dataset FROM v_datasets WHERE stage = 'silver_held')
    SELECT 'tasks' AS table_name, count(*) AS removed FROM v_tasks_list WHERE dataset IN (SELECT dataset FROM g)
    UNION ALL SELECT 'assignments', count(*) FROM v_assignments WHERE dataset IN (SELECT dataset FROM g) UNION ALL SELECT 'datasets', count(*) FROM v_datasets WHERE dataset IN (SELECT dataset FROM g)""")
def delete_cascade(spark, sf):
    datasets = view(spark, sf, "v_datasets")
    tables = {"tasks": (view(spark, sf, "v_tasks_list"), "dataset"), "assignments": (view(spark, sf, "v_assignments"), "dataset"), "datasets": (datasets, "dataset")}
    return ch.delete_cascade(tables, datasets.where("stage = 'silver_held'"), "dataset")[1]


@R.query("unknown_dataset_changes", "SELECT seq, dataset FROM v_changes WHERE dataset NOT IN (SELECT dataset FROM v_datasets)")
def unknown_dataset_changes(spark, sf):
    return ch.unknown_keys(view(spark, sf, "v_changes"), view(spark, sf, "v_datasets"), "dataset").select("seq", "dataset")


@R.query("check_marked", """SELECT d.dataset, d.stage, c.dataset IS NOT NULL AS checked FROM v_datasets d LEFT JOIN (SELECT DISTINCT dataset FROM v_changes) c USING (dataset)""")
def check_marked(spark, sf):
    """Registry with the data sets whose duplicate check has run marked."""
    base = view(spark, sf, "v_datasets").select("dataset", "stage").withColumn("ran_at", F.lit(None).cast("bigint"))
    marks = view(spark, sf, "v_changes").select("dataset", F.col("seq").alias("ran_at"), "seq")
    out = ch.update_existing(base, marks, ["dataset"], ["ran_at"], "seq")[0]
    return out.select("dataset", "stage", F.col("ran_at").isNotNull().alias("checked"))


# ---- code lists and glossary ---------------------------------------------------------------------------

_CODES = "SELECT n_nationkey AS code, n_name AS label FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'"


@R.query("code_labels", f"SELECT c_custkey, c_nationkey, v.label AS c_nationkey_label FROM customer LEFT JOIN ({_CODES}) v ON c_nationkey = v.code")
def code_labels(spark, sf):
    return st.labelled(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", spark_sql(spark, sf, _CODES))


@R.query("code_violations", f"SELECT c_nationkey AS code, count(*) AS rows FROM customer WHERE c_nationkey NOT IN (SELECT code FROM ({_CODES})) GROUP BY 1")
def code_violations(spark, sf):
    return st.violations(table(spark, sf, "customer"), "c_nationkey", spark_sql(spark, sf, _CODES))


@R.query("reference_counts", "SELECT r_regionkey, r_name, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal < 0) AS value_count FROM region")
def reference_counts(spark, sf):
    members = spark_sql(spark, sf, "SELECT n_regionkey AS r_regionkey FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
    return st.child_counts(table(spark, sf, "region"), members, "r_regionkey", "value_count")


@R.query("reference_search", """SELECT p_partkey AS code, p_name AS label, row_number() OVER (ORDER BY CAST(p_partkey AS VARCHAR)) AS place FROM part
    WHERE contains(CAST(p_partkey AS VARCHAR), '12') OR contains(lower(p_name), '12')""")
def reference_search(spark, sf):
    return placed(st.search_values(table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label")), "12"))


@R.query("reference_search_indexed", """SELECT 'many' AS text, p_partkey AS code, CASE WHEN contains(CAST(p_partkey AS VARCHAR), '123') THEN 'code,' ELSE '' END || CASE WHEN contains(lower(p_name), '123') THEN 'label,' ELSE '' END AS matched
    FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '123') OR contains(lower(p_name), '123')
    UNION ALL SELECT 'short', p_partkey, CASE WHEN contains(CAST(p_partkey AS VARCHAR), '9') THEN 'code,' ELSE '' END || CASE WHEN contains(lower(p_name), '9') THEN 'label,' ELSE '' END
    FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '9') OR contains(lower(p_name), '9')""")
def reference_search_indexed(spark, sf):
    """Two searches of one index: by postings, and of a text too short for them."""
    values = table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("label"))
    index = search.build(values.withColumn("id", F.col("code")), ["id"], ["code", "label"], scratch_path(spark, "index"))
    found = [search.find(index, text, ["code", "label"]).withColumn("text", F.lit(name)) for name, text in (("many", "123"), ("short", "9"))]
    return found[0].unionByName(found[1]).select("text", F.col("id").alias("code"), F.concat(F.array_join("matched_fields", ","), F.lit(",")).alias("matched"))


@R.query("reference_seeded", "SELECT replace(lower(p_name), ' ', '-') AS slug, p_partkey AS code FROM part WHERE replace(lower(p_name), ' ', '-') NOT IN (SELECT replace(lower(p_name), ' ', '-') FROM part WHERE p_size > 45)")
def reference_seeded(spark, sf):
    parts = table(spark, sf, "part").select(X.slug(F.col("p_name")).alias("slug"), F.col("p_partkey").alias("code"), "p_size")
    return st.seed_values(parts.where("p_size > 45"), parts.drop("p_size"))


@R.query("glossary_search", """SELECT id, term, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags, row_number() OVER (ORDER BY lower(term)) AS place FROM v_terms
    WHERE contains(lower(term), 'small') OR contains(lower(definition), 'small') OR contains(lower(tags), 'small')""")
def glossary_search(spark, sf):
    return placed(st.search_terms(st.glossary(view(spark, sf, "v_terms")), " Small ").select("id", "term", F.array_join("tag_list", "|").alias("tags")))


@R.query("glossary_domains", "SELECT domain, count(*) AS terms FROM v_terms GROUP BY 1")
def glossary_domains(spark, sf):
    return st.used_domains(view(spark, sf, "v_terms"))
