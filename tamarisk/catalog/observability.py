"""Lineage, run-history, drift and fitted-parameter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.catalog import credit
from tamarisk.catalog.base import Registry, placed, spark_sql, table, view
from tamarisk.catalog.people import FIELDS, golden_records_of
from tamarisk.functions import text as X
from tamarisk.functions.times import freshness, seconds_between
from tamarisk.operators import dedup, drift, ecl, golden, lineage, models, profile as prof, runs
from tamarisk.session import materialise

R = Registry()

# ---- lineage ----------------------------------------------------------------------------------

_URIS = lambda c: f"regexp_extract_all({c}, '\"uri\": \"([^\"]*)\"', 1)"
_GRAPH = f"""WITH lr AS (SELECT * FROM v_jobs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_key DESC, task_no DESC) = 1),
    j AS (SELECT job, dataset, task, state, (epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds, {_URIS('inlets')} AS i, {_URIS('outlets')} AS o FROM lr),
    k AS (SELECT * FROM j WHERE len(i) + len(o) > 0),
    e AS (SELECT unnest(i) AS from_id, job AS to_id, 'input' AS type FROM k UNION ALL SELECT job, unnest(o), 'output' FROM k),
    u AS (SELECT DISTINCT unnest(list_concat(i, o)) AS id FROM k)"""
_RECURSIVE = _GRAPH.replace("WITH lr", "WITH RECURSIVE lr") + """,
    lv(id, n) AS (SELECT id, 0 FROM (SELECT id FROM u UNION ALL SELECT job FROM k) WHERE id NOT IN (SELECT to_id FROM e)
                  UNION ALL SELECT e.to_id, lv.n + 1 FROM lv JOIN e ON e.from_id = lv.id)"""


def _jobs(spark, sf):
    return lineage.with_outlets(lineage.latest_runs(view(spark, sf, "v_jobs")))


@R.query("lineage_jobs", _GRAPH + " SELECT job, dataset, task, state, len(i) AS inputs, len(o) AS outputs, seconds FROM k")
def lineage_jobs(spark, sf):
    return _jobs(spark, sf).select("job", "dataset", "task", "state", F.size("in_uris").cast("bigint").alias("inputs"), F.size("out_uris").cast("bigint").alias("outputs"),
                                   seconds_between(F.col("started_at"), F.col("ended_at")).alias("seconds"))


@R.query("lineage_edges", _GRAPH + " SELECT * FROM e")
def lineage_edges(spark, sf):
    return lineage.edges(_jobs(spark, sf))


@R.query("lineage_nodes", _GRAPH + """ SELECT job AS id, 'job' AS type, task AS label, dataset, state AS run_state FROM k
    UNION ALL SELECT id, 'dataset', coalesce(nullif(string_split(id, '/')[-1], ''), id), NULL, NULL FROM u""")
def lineage_nodes(spark, sf):
    return lineage.nodes(_jobs(spark, sf))


@R.query("lineage_levels", _RECURSIVE + " SELECT id, max(n) AS level FROM lv GROUP BY 1")
def lineage_levels(spark, sf):
    jobs = lineage.latest_links(view(spark, sf, "v_jobs"))
    return lineage.levels(lineage.node_ids(jobs), lineage.edges(jobs))


@R.query("lineage_gold_traces", _GRAPH + """ SELECT dataset, state, list_filter(o, lambda x: contains(lower(x), 'ifrs9'))[1] AS output, array_to_string(i, ',') AS inputs
    FROM k WHERE task = 'gold_compute' AND len(list_filter(o, lambda x: contains(lower(x), 'ifrs9'))) > 0""")
def lineage_gold_traces(spark, sf):
    jobs = _jobs(spark, sf)
    return lineage.gold_traces(jobs, "ifrs9").select("dataset", "state", "output", F.array_join("in_uris", ",").alias("inputs"))


def field_registry(spark, sf):
    """People datasets with their profile, and the pipelines' datasets with no profile of their own."""
    people = prof.registry_rows(prof.column_profile(view(spark, sf, "v_customers").select("dataset", *FIELDS), F.col("dataset")))
    people = people.select(F.col("safe_name").alias("dataset"), "columns", "rows", "null_counts", F.lit(True).alias("checked"))
    none = F.array().cast("array<string>")
    others = view(spark, sf, "v_datasets").select("dataset", none.alias("columns"), F.col("total_rows").alias("rows"),
                                                  F.create_map().cast("map<string,bigint>").alias("null_counts"), F.lit(False).alias("checked"))
    return people.unionByName(others)


_FIELD = _GRAPH + """, dec AS (SELECT dataset, count(*) FILTER (WHERE status = 'pending') AS p, count(*) FILTER (WHERE status = 'confirmed_duplicate') AS c, count(*) FILTER (WHERE status = 'not_duplicate') AS r FROM v_decisions GROUP BY 1),
    ppl AS (SELECT dataset, count(*) AS n, count(*) - count(NATIONAL_ID) AS nulls FROM v_customers GROUP BY 1),
    gm AS (SELECT d.dataset, d.cluster_id, count(c.NATIONAL_ID) AS ids FROM v_decisions d JOIN v_members m ON m.dataset = d.dataset AND m.cluster_id = d.cluster_id
           JOIN v_customers c ON c.dataset = m.dataset AND c.CUST_ID = m.row_id WHERE d.status = 'confirmed_duplicate' GROUP BY 1, 2),
    gn AS (SELECT dataset, count(*) AS golden, count(*) FILTER (WHERE ids > 0) AS contributed FROM gm GROUP BY 1),
    ds AS (SELECT dataset, true AS person FROM ppl UNION ALL SELECT dataset, false FROM v_datasets),
    g3 AS (SELECT dataset, state, i, list_filter(o, lambda x: contains(lower(x), 'ifrs9'))[1] AS eo, list_filter(o, lambda x: contains(lower(x), 'ndi'))[1] AS no FROM k WHERE task = 'gold_compute'),
    s AS (
      SELECT dataset, 'NATIONAL_ID' AS field, true AS available, NULL AS reason, unnest([{'n': 1, 's': 'bronze', 't': 'column as uploaded'},
        {'n': 2, 's': 'silver', 't': concat(nulls, ' null of ', n, ' rows')}, {'n': 3, 's': 'golden', 't': concat('contributed to ', contributed, ' golden record(s)')}]) AS x FROM ppl JOIN gn USING (dataset)
      UNION ALL SELECT dataset, 'NATIONAL_ID', false, 'column not present', NULL FROM ds WHERE NOT person
      UNION ALL SELECT dataset, 'DUPLICATE_FLAG', true, NULL, unnest([{'n': 1, 's': 'silver', 't': 'clustering input'}, {'n': 2, 's': 'detection', 't': concat(p, ' pending, ', c, ' confirmed, ', r, ' rejected')},
        {'n': 3, 's': 'golden', 't': concat(golden, ' merged')}]) FROM dec JOIN gn USING (dataset)
      UNION ALL SELECT dataset, 'DUPLICATE_FLAG', false, 'duplicate detection has not been run', NULL FROM ds WHERE NOT person
      UNION ALL SELECT dataset, 'ECL_SAR', true, NULL, unnest([{'n': 1, 's': 'silver', 't': concat('inputs: ', array_to_string(i, ', '))}, {'n': 2, 's': 'gold_compute', 't': concat('run state: ', state)},
        {'n': 3, 's': 'gold', 't': concat('output: ', eo)}]) FROM g3 WHERE eo IS NOT NULL
      UNION ALL SELECT dataset, 'ECL_SAR', false, 'no Gold credit-loss table from the pipeline yet', NULL FROM ds WHERE dataset NOT IN (SELECT dataset FROM g3 WHERE eo IS NOT NULL)
      UNION ALL SELECT dataset, 'NDI_SCORE', true, NULL, unnest([{'n': 1, 's': 'silver', 't': concat('inputs: ', array_to_string(i, ', '))}, {'n': 2, 's': 'gold_compute', 't': concat('run state: ', state)},
        {'n': 3, 's': 'gold', 't': concat('output: ', no)}]) FROM g3 WHERE no IS NOT NULL
      UNION ALL SELECT dataset, 'NDI_SCORE', false, 'no Gold maturity table and no recorded assessment', NULL FROM ds WHERE dataset NOT IN (SELECT dataset FROM g3 WHERE no IS NOT NULL))"""


@R.query("field_lineage", _FIELD + " SELECT dataset, field, available, reason, CAST(x.n AS INT) AS step_no, x.s AS stage, x.t AS text FROM s")
def field_lineage(spark, sf):
    merged = materialise(golden_records_of(spark, sf))
    ids = golden.contributions(golden.as_maps(merged, FIELDS), "NATIONAL_ID")
    states = dedup.lifecycle_counts(view(spark, sf, "v_decisions"), merged)
    jobs = _jobs(spark, sf)
    return lineage.field_report(materialise(field_registry(spark, sf)), ids, states, lineage.gold_traces(jobs, "ifrs9"), lineage.gold_traces(jobs, "ndi"), assessed=False)


# ---- runs ----------------------------------------------------------------------------------------

_SECONDS = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE"


@R.query("run_history", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY started_at DESC, run_key DESC) AS run_rank FROM v_runs)
    SELECT r.dataset, r.run_id, CAST(run_rank AS INT) AS run_rank, r.state AS run_state, {_SECONDS('r.started_at', 'r.ended_at')} AS run_seconds, t.task, t.task_no, t.state, {_SECONDS('t.started_at', 't.ended_at')} AS task_seconds
    FROM r LEFT JOIN v_tasks t ON t.run_key = r.run_key WHERE run_rank <= 10""")
def run_history(spark, sf):
    out = runs.run_tasks(view(spark, sf, "v_runs"), view(spark, sf, "v_tasks"))
    return out.select("dataset", "run_id", "run_rank", "run_state", "run_seconds", "task", "task_no", "state", "task_seconds")


@R.query("job_runs", f"""SELECT job, run_key, state, {_SECONDS('started_at', 'ended_at')} AS seconds, CASE WHEN state = 'failed' THEN 'run failed' END AS error FROM
    (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_key DESC, task_no DESC) AS n FROM v_jobs) WHERE n <= 10""")
def job_runs(spark, sf):
    from pyspark.sql import Window as W

    newest = W.partitionBy("job").orderBy(F.desc("started_at"), F.desc("run_key"), F.desc("task_no"))
    out = view(spark, sf, "v_jobs").withColumn("n", F.row_number().over(newest)).where("n <= 10")
    return out.select("job", "run_key", "state", seconds_between(F.col("started_at"), F.col("ended_at")).alias("seconds"), F.when(F.col("state") == "failed", "run failed").alias("error"))


@R.query("runs_by_prefix", """SELECT split_part(run_id, '__', 1) AS dataset, count(*) AS runs, count(*) FILTER (WHERE state = 'failed') AS failed FROM v_runs GROUP BY 1""")
def runs_by_prefix(spark, sf):
    out = runs.by_prefix(view(spark, sf, "v_runs").drop("dataset"))
    return out.groupBy("dataset").agg(F.count("*").alias("runs"), F.count_if(F.col("state") == "failed").alias("failed"))


@R.query("last_run", """SELECT dataset, task, state, strftime(ended_at, '%Y-%m-%d %H:%M:%S') AS ended_at FROM v_jobs WHERE ended_at IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dataset, task ORDER BY ended_at DESC, started_at DESC, run_key DESC, task_no DESC) = 1""")
def last_run(spark, sf):
    return runs.last_finished(view(spark, sf, "v_jobs")).withColumn("ended_at", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss"))


@R.query("freshness", f"""WITH a AS (SELECT run_id, floor((epoch_us(TIMESTAMP '1998-06-01 12:00:00') - epoch_us(ended_at)) / 1000000) AS s FROM v_runs)
    SELECT run_id, CASE WHEN s IS NULL THEN 'never run' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ago')
      WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h ago') ELSE concat(CAST(floor(s / 86400) AS BIGINT), 'd ago') END AS label FROM a""")
def freshness_labels(spark, sf):
    now = F.lit("1998-06-01 12:00:00").cast("timestamp")
    return view(spark, sf, "v_runs").select("run_id", freshness(F.col("ended_at"), now).alias("label"))


@R.query("job_list", """SELECT job, job_type, state, row_number() OVER (ORDER BY CASE job_type WHEN 'DAG' THEN 0 ELSE 1 END, job) AS place FROM (SELECT concat(dataset, '') AS job, 'DAG' AS job_type, state, row_number() OVER (PARTITION BY dataset ORDER BY started_at DESC, run_key DESC) AS n FROM v_runs
    UNION ALL SELECT job, 'TASK', state, row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_key DESC, task_no DESC) FROM v_jobs) WHERE n = 1""")
def job_list(spark, sf):
    dags = view(spark, sf, "v_runs").groupBy(F.col("dataset").alias("job")).agg(F.max_by("state", F.struct("started_at", "run_key")).alias("state")).withColumn("job_type", F.lit("DAG"))
    tasks = lineage.latest_runs(view(spark, sf, "v_jobs")).select("job", "state").withColumn("job_type", F.lit("TASK"))
    return placed(runs.job_list(dags.unionByName(tasks)))


_FACETS = """SELECT concat(job, '#', run_key, '-', task_no) AS job, CASE WHEN task = 'notify' THEN 'DAG' ELSE 'TASK' END AS job_type,
    concat('{"latestRun": {"state": ', CASE WHEN state = 'running' THEN 'null' ELSE concat('"', state, '"') END, ', "durationMs": ', run_key % 100000,
      ', "facets": {"task": {"inlets": "', replace(inlets, '"', chr(39)), '"}, "dagRun": {"run_id": "', dataset, '__', run_key, '", "conf": ',
      CASE WHEN task = 'archive' THEN '{}' ELSE concat('{"dataset_name": "', dataset, '"}') END, '}}}}') AS facets FROM v_jobs"""


@R.query("job_facets", f"""WITH f AS ({_FACETS}) SELECT job, job_type, coalesce(json_extract_string(facets, '$.latestRun.state'), 'UNKNOWN') AS state,
    json_extract_string(facets, '$.latestRun.facets.dagRun.run_id') AS run_id, json_extract_string(facets, '$.latestRun.facets.dagRun.conf.dataset_name') AS dataset,
    CAST(json_extract_string(facets, '$.latestRun.durationMs') AS BIGINT) / 1000.0::DOUBLE AS seconds,
    len(regexp_extract_all(json_extract_string(facets, '$.latestRun.facets.task.inlets'), 'uri', 0)) AS inputs FROM f""")
def job_facets(spark, sf):
    out = lineage.job_facets(spark_sql(spark, sf, _FACETS))
    return out.select("job", "job_type", "state", "run_id", "dataset", "seconds", F.size("in_uris").cast("bigint").alias("inputs"))


@R.query("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.unit'), 'none') AS unit FROM events")
def event_properties(spark, sf):
    """Nested JSON read with a schema, absent paths defaulted."""
    p = F.from_json("props", "struct<k:bigint,unit:string>")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["unit"], F.lit("none")).alias("unit"))


# ---- drift -----------------------------------------------------------------------------------------

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_REF = "l_shipdate < TIMESTAMP '1996-06-01 00:00:00'"
_SHIFT = f"""base AS (SELECT {_REF} AS ref, l_quantity, CASE WHEN {_REF} THEN l_extendedprice ELSE l_extendedprice * 1.6::DOUBLE + 3 END AS l_extendedprice, l_discount, l_tax, l_returnflag,
    concat('Q', quarter(l_shipdate)) AS ship_quarter FROM lineitem)"""
_KS = "WITH " + _SHIFT + ", " + ", ".join(
    f"""c_{f} AS (SELECT '{f}' AS feature, {f} AS v, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS b FROM base GROUP BY 2)""" for f in NUMERIC) + f""",
    c AS ({' UNION ALL '.join(f'SELECT * FROM c_{f}' for f in NUMERIC)}),
    r AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m FROM c WINDOW w AS (PARTITION BY feature ORDER BY v)),
    ks AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, max(abs(ca / n::DOUBLE - cb / m::DOUBLE)) AS d FROM r GROUP BY 1),
    ks2 AS (SELECT *, sqrt(n * m / (n + m)::DOUBLE) * d AS x FROM ks),
    res AS (SELECT feature, 'ks' AS test, n, m, d AS statistic, CASE WHEN x < 0.04 THEN 1::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE,
      list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * k * k * x * x))))) END AS p_value FROM ks2)"""


def _slices(spark, sf):
    ref = F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz")
    df = table(spark, sf, "lineitem").select(*NUMERIC, "l_returnflag", F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("ship_quarter"), ref.alias("ref"))
    return drift.shifted(df, "l_extendedprice", F.col("ref"), 1.6, 3.0), F.col("ref")


def _numeric(spark, sf):
    df, ref = _slices(spark, sf)
    return drift.numeric_drift(df, NUMERIC, ref)


@R.query("drift_ks", _KS + " SELECT feature, test, n, m, round(statistic, 9) AS statistic, round(p_value, 9) AS p_value FROM res")
def drift_ks(spark, sf):
    return _numeric(spark, sf).withColumns({"statistic": F.round("statistic", 9), "p_value": F.round("p_value", 9)})


@R.query("drift_top5", _KS + " SELECT feature, round(p_value, 9) AS p_value FROM res ORDER BY res.p_value, feature LIMIT 5")
def drift_top5(spark, sf):
    return drift.strongest(_numeric(spark, sf)).select("feature", F.round("p_value", 9).alias("p_value"))


@R.query("drift_summary", _KS + " SELECT count(*) AS metric_count, count(*) FILTER (WHERE p_value < 0.05) AS drifted FROM res")
def drift_summary(spark, sf):
    return drift.drift_share(_numeric(spark, sf))


_CHI = "WITH " + _SHIFT + """, c AS (SELECT 'l_returnflag' AS feature, l_returnflag AS v, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS b FROM base GROUP BY 2
      UNION ALL SELECT 'ship_quarter', ship_quarter, count(*) FILTER (WHERE ref), count(*) FILTER (WHERE NOT ref) FROM base GROUP BY 2),
    t AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m FROM c),
    x AS (SELECT feature, max(n) AS n, max(m) AS m, sum(pow(a - (a + b) * n / (n + m)::DOUBLE, 2) / ((a + b) * n / (n + m)::DOUBLE) + pow(b - (a + b) * m / (n + m)::DOUBLE, 2) / ((a + b) * m / (n + m)::DOUBLE)) AS s FROM t GROUP BY 1)"""


@R.query("drift_categorical", _CHI + " SELECT feature, 'chi_square' AS test, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(s, 4) AS statistic FROM x")
def drift_categorical(spark, sf):
    df, ref = _slices(spark, sf)
    return drift.categorical_drift(df, ["l_returnflag", "ship_quarter"], ref).select("feature", "test", "n", "m", F.round("statistic", 4).alias("statistic"))


@R.query("drift_categorical_p", _CHI + " SELECT feature, round(exp(-s / 2), 9) AS p_value FROM x WHERE feature = 'l_returnflag'")
def drift_categorical_p(spark, sf):
    df, ref = _slices(spark, sf)
    return drift.categorical_drift(df, ["l_returnflag"], ref).select("feature", F.round("p_value", 9).alias("p_value"))


# A row stands for a million observations: products of two counts leave the range of a long.
_MANY = "count(*) * 1000000"


@R.query("drift_large_counts", "WITH " + _SHIFT + f""",
    c AS (SELECT l_tax AS v, {_MANY} FILTER (WHERE ref) AS a, {_MANY} FILTER (WHERE NOT ref) AS b FROM base GROUP BY 1),
    r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM c WINDOW w AS (ORDER BY v)),
    q AS (SELECT ship_quarter AS v, {_MANY} FILTER (WHERE ref) AS a, {_MANY} FILTER (WHERE NOT ref) AS b FROM base GROUP BY 1),
    t AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, sum(a) OVER ()::DOUBLE AS n, sum(b) OVER ()::DOUBLE AS m FROM q)
    SELECT 'l_tax' AS feature, CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(max(abs(ca / n::DOUBLE - cb / m::DOUBLE)), 9) AS statistic FROM r
    UNION ALL SELECT 'ship_quarter', CAST(max(n) AS BIGINT), CAST(max(m) AS BIGINT),
      round(sum(pow(a - (a + b) * n / (n + m), 2) / ((a + b) * n / (n + m)) + pow(b - (a + b) * m / (n + m), 2) / ((a + b) * m / (n + m))), 2) FROM t""".replace(
        "count(*) * 1000000 FILTER (WHERE ref)", "1000000 * count(*) FILTER (WHERE ref)").replace("count(*) * 1000000 FILTER (WHERE NOT ref)", "1000000 * count(*) FILTER (WHERE NOT ref)"))
def drift_large_counts(spark, sf):
    df, ref = _slices(spark, sf)
    numbers = drift.numeric_drift(df, ["l_tax"], ref, F.lit(1_000_000)).withColumn("statistic", F.round("statistic", 9))
    kinds = drift.categorical_drift(df, ["ship_quarter"], ref, F.lit(1_000_000)).withColumn("statistic", F.round("statistic", 2))
    checked = numbers.where("p_value BETWEEN 0 AND 1").unionByName(kinds.where("p_value BETWEEN 0 AND 1"))
    return checked.select("feature", "n", "m", "statistic")


# A list as Python prints it: names of constants as values and inside strings.
_LITERALS = r"""SELECT event_id, concat('[{\'uri\': \'lake://None/', event_type, '\', \'extra\': ', CASE event_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'True' ELSE 'False' END,
    '}, {"uri": "it\'s True, ', user_id, '"}, {"uri": None}]') AS listed FROM {events}"""


@R.query("lineage_python_literals", "SELECT event_id, concat('lake://None/', event_type) AS first_uri, concat('it''s True, ', user_id) AS second_uri, 2 AS uris FROM events")
def lineage_python_literals(spark, sf):
    uris = spark_sql(spark, sf, _LITERALS).select("event_id", X.listed_uris(F.col("listed")).alias("u"))
    return uris.select("event_id", F.get("u", F.lit(0)).alias("first_uri"), F.get("u", F.lit(1)).alias("second_uri"), F.size("u").alias("uris"))


# ---- fitted parameters --------------------------------------------------------------------------------

_RANKS = ", ".join(f"('{k}', {i})" for i, k in enumerate(P.PD_BY_RATING))
# Newton steps over the counts of (rank, label): intercept and slope, the slope penalised by one over all rows.
_NEWTON = f"""rk(k, x) AS (VALUES {_RANKS}),
    cn AS (SELECT x::DOUBLE AS x, CAST(DPD > 90 AS INT)::DOUBLE AS y, count(*)::DOUBLE AS w FROM v_loans JOIN rk ON RATING = k GROUP BY 1, 2),
    tt AS (SELECT sum(w) AS n, sum(w * y) / sum(w) AS mean FROM cn),
    nw(i, a, b) AS (SELECT 0, ln(mean / (1 - mean)), 0::DOUBLE FROM tt
      UNION ALL SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT i, a, b, sum(w * (p - y)) / max(n) AS g0, sum(w * (p - y) * x) / max(n) + b / max(n) AS g1, sum(w * p * (1 - p)) / max(n) AS h00,
          sum(w * p * (1 - p) * x) / max(n) AS h01, sum(w * p * (1 - p) * x * x) / max(n) + 1 / max(n) AS h11
        FROM (SELECT nw.i, nw.a, nw.b, cn.*, tt.n, 1 / (1 + exp(-(nw.a + nw.b * cn.x))) AS p FROM nw, cn, tt WHERE nw.i < 30) GROUP BY i, a, b)),
    fit AS (SELECT k, x, 1 / (1 + exp(-(a + b * x))) AS pd FROM rk, nw WHERE i = 30)"""


@R.query("pd_model", f"WITH RECURSIVE {_NEWTON} SELECT k AS rating_key, x AS rating_rank, round(pd, 6) AS rating_pd FROM fit")
def pd_model(spark, sf):
    """Default scorecard fitted on all loans."""
    labels = view(spark, sf, "v_loans").select("RATING", (F.col("DPD") > 90).alias("defaulted"))
    return models.fit_default_scorecard(labels).select("rating_key", "rating_rank", F.round("rating_pd", 6).alias("rating_pd"))


_SEV = f"""SELECT FACILITY_TYPE AS facility_key, greatest(0.05::DOUBLE, least(0.95::DOUBLE, sum(CAST(round(LGD * 10, 8) AS DECIMAL(28,8)))::DOUBLE / count(*))) AS facility_lgd
    FROM v_loans WHERE FACILITY_TYPE IN ({', '.join(repr(k) for k in P.LGD_BY_FACILITY)}) GROUP BY 1"""


def _severity(spark, sf):
    return models.fit_severity(view(spark, sf, "v_loans").select("FACILITY_TYPE", (F.col("LGD") * 10).alias("severity")))


@R.query("lgd_model", f"SELECT facility_key, round(facility_lgd, 9) AS facility_lgd FROM ({_SEV})")
def lgd_model(spark, sf):
    return _severity(spark, sf).withColumn("facility_lgd", F.round("facility_lgd", 9))


@R.query("ecl_trained", credit.MODEL_SQL.replace("WITH ", f"WITH RECURSIVE {_NEWTON}, sev AS ({_SEV}), ", 1)
         .replace("coalesce(rpd, 0.1::DOUBLE) AS pd0, coalesce(flgd, 0.55::DOUBLE) AS lgd",
                  "coalesce((SELECT pd FROM fit WHERE k = RATING), 0.1::DOUBLE) AS pd0, coalesce((SELECT facility_lgd FROM sev WHERE facility_key = FACILITY_TYPE), 0.55::DOUBLE) AS lgd") + f"""
    SELECT count(*) AS loan_count, {credit.AMOUNT(credit.TOTAL('EAD'))} AS total_ead, {credit.AMOUNT(credit.TOTAL('ecl_base'))} AS total_ecl,
           round({credit.TOTAL('ecl_base')}::DOUBLE / {credit.TOTAL('EAD')}::DOUBLE, 4) AS coverage_ratio FROM loss""")
def ecl_trained(spark, sf):
    """Credit loss with both fitted parameter tables in place of the stated ones."""
    loans = view(spark, sf, "v_loans")
    ratings = models.fit_default_scorecard(loans.select("RATING", (F.col("DPD") > 90).alias("defaulted")))
    return ecl.totals(ecl.per_loan(loans, ratings=ratings, facilities=_severity(spark, sf)))
