"""Input views over the given tables, shared by the Spark queries and their SQL checks.

Every view is SQL text that both engines read alike; ``{table}`` stands for a given table.
Views derive the business columns (ratings, birth dates, run states, ...) from whole
tables, so each query's work grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.ordered import numbered

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "v_loans": """
        SELECT concat('LN-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS LOAN_ID,
               concat(CASE WHEN l_returnflag = 'N' THEN 'C' ELSE 'S' END, l_suppkey) AS CUST_ID,
               CASE WHEN l_partkey % 97 = 0 THEN 'ZZZ' ELSE
                 CASE l_partkey % 10 WHEN 0 THEN 'AAA' WHEN 1 THEN 'AA' WHEN 2 THEN 'A' WHEN 3 THEN 'BBB'
                      WHEN 4 THEN 'BB' WHEN 5 THEN 'B' WHEN 6 THEN 'CCC' WHEN 7 THEN 'CC' WHEN 8 THEN 'C'
                      ELSE 'D' END END AS RATING,
               CASE l_suppkey % 7 WHEN 0 THEN 'تمويل عقاري' WHEN 1 THEN 'تمويل مشاريع' WHEN 2 THEN 'تمويل مركبات'
                    WHEN 3 THEN 'تمويل تجاري' WHEN 4 THEN 'تمويل شخصي' WHEN 5 THEN 'بطاقة ائتمانية'
                    ELSE 'leasing' END AS FACILITY_TYPE,
               CAST((l_orderkey * 7 + l_linenumber * 13) % 121 AS INT) AS DPD,
               CAST(l_shipdate AS DATE) AS ORIGINATION,
               CASE WHEN l_partkey % 211 = 0 THEN NULL
                    ELSE CAST(l_shipdate AS DATE) + CAST(9000 + (l_partkey * 37) % 4500 AS INT) END AS MATURITY,
               l_extendedprice AS EAD, l_returnflag = 'R' AS WATCHLIST,
               l_discount AS PD, l_tax AS LGD, CAST(1 + l_linenumber % 3 AS INT) AS STAGE,
               l_extendedprice * 0.001e0 AS ECL_SAR
        FROM {lineitem}""",
    "v_people": """
        SELECT 'C' AS src, CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS INT) AS nation, c_acctbal AS bal,
               c_mktsegment AS seg FROM {customer}
        UNION ALL
        SELECT 'S', CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS INT), s_acctbal, CAST(NULL AS STRING) FROM {supplier}
        UNION ALL
        SELECT 'U', CAST(user_id AS BIGINT), CAST(NULL AS INT), max(value), max(event_type) FROM {events} GROUP BY user_id""",
    "v_customers": """
        SELECT CASE WHEN k % 4 = 1 THEN 'ds_a' ELSE 'ds_b' END AS dataset,
               concat(src, k) AS CUST_ID,
               CASE src WHEN 'C' THEN concat('Name', k % 50, ' Family', k % 37)
                        WHEN 'S' THEN concat('Family', k % 37, ' Name', k % 50)
                        ELSE concat('Other', k % 13, ' ', seg) END AS FULL_NAME,
               CASE WHEN src = 'C' AND bal < 0 THEN '1900-01-01'
                    ELSE CAST(DATE '1950-01-01' + CAST((k * 7919) % 18000 AS INT) AS STRING) END AS DOB,
               CASE WHEN src = 'U' OR k % 3 = 0 THEN NULL ELSE concat('05', 10000000 + k) END AS PHONE,
               CASE WHEN src = 'U' OR (src = 'C' AND k % 4 = 0) THEN NULL ELSE concat('u', k, '@example.com') END AS EMAIL,
               CASE WHEN src = 'S' THEN NULL ELSE 1000000000 + k END AS NATIONAL_ID,
               nation AS NATION,
               k * 3 + CASE src WHEN 'C' THEN 0 WHEN 'S' THEN 1 ELSE 2 END AS row_pos
        FROM v_people""",
    "v_clusters": """
        SELECT dataset, DOB AS dob, min(row_pos) AS cluster_id, count(*) AS size,
               CASE WHEN count(*) = 2 THEN 'high_confidence' ELSE 'needs_review' END AS tier,
               min_by(FULL_NAME, row_pos) AS lead_name
        FROM v_customers WHERE DOB <> '' GROUP BY dataset, DOB HAVING count(*) > 1""",
    "v_decisions": """
        SELECT dataset, dob, cluster_id, size, tier, lead_name,
               CASE cluster_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed_duplicate'
                    WHEN 2 THEN 'not_duplicate' ELSE 'confirmed_duplicate' END AS status,
               CASE WHEN cluster_id % 4 = 0 THEN NULL ELSE concat('reviewer', cluster_id % 5) END AS decided_by,
               CASE WHEN cluster_id % 4 = 0 THEN NULL
                    ELSE CAST(DATE '2026-01-01' + CAST(cluster_id % 200 AS INT) AS TIMESTAMP) END AS decided_at
        FROM v_clusters""",
    "v_members": """
        SELECT c.dataset, d.cluster_id, c.CUST_ID AS row_id, c.row_pos
        FROM v_customers c JOIN v_clusters d ON c.dataset = d.dataset AND c.DOB = d.dob""",
    "v_raw": """
        SELECT o_orderkey AS order_id, o_custkey AS cust_id,
               CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END AS amount,
               CASE WHEN o_orderkey % 10 = 3 THEN 'x' ELSE NULL END AS mostly_empty,
               o_orderpriority AS priority, o_orderkey * 2 AS row_pos
        FROM {orders}
        UNION ALL
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderstatus END,
               CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice END,
               CASE WHEN o_orderkey % 10 = 3 THEN 'x' ELSE NULL END,
               o_orderpriority, o_orderkey * 2 + 1
        FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "v_snapshots": """
        SELECT min(event_id) AS id, concat('ds', user_id) AS dataset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS recorded_at,
               concat('rec', count(*) % 3) AS recorded_by,
               CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) * 1.5e0 END AS score,
               count(DISTINCT event_type) * 20.0e0 AS compliance_pct
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "v_snapshot_domains": """
        SELECT s.id AS snapshot_id, s.dataset, s.recorded_at, d.code, d.maturity, d.compliance
        FROM v_snapshots s JOIN (
          SELECT concat('ds', user_id) AS dataset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS recorded_at, event_type AS code,
                 count(*) * 0.25e0 AS maturity, count(*) * 12.5e0 AS compliance
          FROM {events} GROUP BY user_id, CAST(ts AS DATE), event_type) d
        ON s.dataset = d.dataset AND s.recorded_at = d.recorded_at""",
    "v_datasets": """
        SELECT concat('ds', c_custkey) AS dataset, c_mktsegment AS display_name, c_custkey * 10 AS total_rows,
               CASE WHEN c_acctbal < 0 THEN 'silver_held' ELSE 'gold' END AS stage,
               CAST(DATE '2026-01-01' + CAST(c_custkey % 300 AS INT) AS TIMESTAMP) AS updated_at
        FROM {customer}""",
    "v_changes": """
        SELECT event_id AS seq,
               CASE WHEN event_type = 'error' THEN concat('nowhere', user_id) ELSE concat('ds', user_id) END AS dataset,
               CASE event_id % 6 WHEN 0 THEN 'business_owner' WHEN 1 THEN 'data_owner' WHEN 2 THEN 'data_steward'
                    WHEN 3 THEN 'data_custodian' WHEN 4 THEN 'data_consumer' ELSE 'chief' END AS role,
               CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(' Person ', event_id % 40) END AS assignee_name,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'admin' END AS assigned_by,
               CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE CAST(CAST(floor(value * 5) AS INT) AS STRING) END AS threshold_pct,
               CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x1' WHEN 2 THEN '-5' ELSE CAST(30 + user_id AS STRING) END AS retention_days,
               CASE event_id % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'weekly'
                    WHEN 3 THEN NULL ELSE 'annual' END AS review_frequency
        FROM {events}""",
    "v_assignments": """
        SELECT concat('ds', c_custkey) AS dataset, 'data_owner' AS role, concat('Owner ', c_nationkey) AS assignee_name,
               CAST(-1 AS BIGINT) AS seq
        FROM {customer} WHERE c_acctbal > 0""",
    "v_requests": """
        SELECT event_id AS req_id,
               CASE event_type WHEN 'view' THEN 'validate_drift' WHEN 'click' THEN 'add_dataset' ELSE 'list_datasets' END AS intent,
               CASE user_id % 5 WHEN 0 THEN 'RESTRICTED' WHEN 1 THEN 'CONFIDENTIAL' WHEN 2 THEN 'INTERNAL'
                    WHEN 3 THEN 'PUBLIC' ELSE NULL END AS classification,
               value > 10 AS override_approved,
               CASE event_id % 4 WHEN 0 THEN 'admin,data_owner' WHEN 1 THEN 'data_consumer'
                    WHEN 2 THEN 'data_consumer,data_steward' ELSE '' END AS roles,
               CASE event_id % 3 WHEN 0 THEN 'classification_allow' WHEN 1 THEN 'stewardship_assign_allow'
                    ELSE 'no_such_rule' END AS rule
        FROM {events}""",
    "v_runs": """
        SELECT o_orderkey AS run_key, concat('ds', o_custkey) AS dataset, concat('ds', o_custkey, '__', o_orderkey) AS run_id,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS state,
               CAST(o_orderdate AS TIMESTAMP) AS started_at,
               CASE WHEN o_orderstatus = 'O' THEN NULL
                    ELSE CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(o_orderkey % 90 AS INT) END AS ended_at
        FROM {orders}""",
    "v_tasks": """
        SELECT l_orderkey AS run_key, l_partkey * 1000 + l_suppkey AS task_no,
               CASE l_linenumber WHEN 1 THEN 'verify_silver_ready' WHEN 2 THEN 'silver_to_table' WHEN 3 THEN 'gold_compute'
                    WHEN 4 THEN 'report' WHEN 5 THEN 'notify' ELSE 'archive' END AS task,
               CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'success' ELSE 'running' END AS state,
               CAST(l_shipdate AS TIMESTAMP) AS started_at,
               CASE WHEN l_returnflag = 'N' THEN NULL
                    ELSE CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(l_quantity AS INT) END AS ended_at,
               l_discount >= 0.05 AS writes_ifrs9
        FROM {lineitem}""",
    "v_jobs": """
        SELECT r.dataset, concat(r.dataset, '.', t.task) AS job, t.task, t.state, t.run_key, t.task_no, t.started_at, t.ended_at,
               CASE t.task WHEN 'silver_to_table' THEN concat('[{"uri": "lake://silver/', r.dataset, '/cleaned.csv", "extra": None}]')
                    WHEN 'gold_compute' THEN concat('[{"uri": "lake://tables/silver/', r.dataset, '", "extra": None}]')
                    WHEN 'report' THEN concat('[{"uri": "lake://tables/gold/', r.dataset, '_ndi", "extra": None}]')
                    WHEN 'archive' THEN 'not a list' ELSE '[]' END AS inlets,
               CASE WHEN t.task = 'silver_to_table' THEN concat('[{"uri": "lake://tables/silver/', r.dataset, '", "extra": None}]')
                    WHEN t.task = 'gold_compute' AND t.writes_ifrs9 THEN concat('[{"uri": "lake://tables/gold/', r.dataset,
                      '_ndi", "extra": None}, {"uri": "lake://tables/gold/', r.dataset, '_ifrs9", "extra": None}]')
                    WHEN t.task = 'gold_compute' THEN concat('[{"uri": "lake://tables/gold/', r.dataset, '_ndi", "extra": None}]')
                    WHEN t.task = 'report' THEN concat('[{"uri": "lake://reports/', r.dataset, '/", "extra": None}]')
                    ELSE '[]' END AS outlets
        FROM v_runs r JOIN v_tasks t ON r.run_key = t.run_key""",
    "v_scores": """
        SELECT o_custkey AS entity,
               CASE o_orderkey % 14 WHEN 0 THEN 'DG' WHEN 1 THEN 'MDC' WHEN 2 THEN 'DQ' WHEN 3 THEN 'DS' WHEN 4 THEN 'CDM'
                    WHEN 5 THEN 'DMD' WHEN 6 THEN 'DIS' WHEN 7 THEN 'RMD' WHEN 8 THEN 'BIA' WHEN 9 THEN 'DVR' WHEN 10 THEN 'OD'
                    WHEN 11 THEN 'FOI' WHEN 12 THEN 'DC' ELSE 'PDP' END AS code,
               CAST(max(CAST(floor(o_totalprice * 100) AS BIGINT) % 51) AS DOUBLE) / 10 AS maturity,
               CAST(max(CAST(floor(o_totalprice * 100) AS BIGINT) % 101) AS DOUBLE) AS compliance_pct
        FROM {orders} GROUP BY 1, 2""",
    "v_scorecard": """
        SELECT o_orderkey AS row_pos, CAST(o_custkey AS STRING) AS sheet,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('Domain ', o_orderpriority) END AS domain_english,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 6 AS DOUBLE) AS target_score,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 4 AS DOUBLE) AS current_score
        FROM {orders}""",
    "v_terms": """
        SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS term, concat(p_type, ' item by ', p_brand) AS definition,
               CASE p_size % 6 WHEN 0 THEN 'MDM' WHEN 1 THEN 'Catalog' WHEN 2 THEN 'Governance' WHEN 3 THEN 'Security'
                    WHEN 4 THEN 'Banking' ELSE 'Other' END AS domain,
               concat(p_brand, ' , ', p_type, ',, ', p_name) AS tags
        FROM {part}""",
    "v_sheets": """
        SELECT concat('file', user_id, '.xlsx') AS file, event_id AS pos,
               CASE event_type WHEN 'purchase' THEN 'Customer MDM Sheet' WHEN 'signup' THEN 'NDI Assessment'
                    WHEN 'click' THEN 'IFRS9_Portfolio' WHEN 'view' THEN 'First Sheet' ELSE 'Second Sheet' END AS sheet
        FROM {events}""",
    "v_files": """
        SELECT doc_id, concat(source, ' file ', doc_id, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.DOCX'
               WHEN 'de' THEN '.txt' ELSE '' END) AS filename,
               n_chars * 1000 AS size_bytes, CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE concat('user', doc_id % 7) END AS uploaded_by,
               CAST(DATE '2026-01-01' + CAST(doc_id % 100 AS INT) AS TIMESTAMP) AS uploaded_at
        FROM {documents}""",
    "v_tasks_list": """
        SELECT event_id AS id, concat('ds', user_id) AS dataset,
               CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'cancelled' WHEN 'error' THEN 'in_progress' ELSE 'open' END AS status
        FROM {events}""",
}


def _needed(text: str) -> list[str]:
    """Views used by ``text``, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", body):
                visit(VIEWS[name])
                order.append(name)

    visit(text)
    return order


def _with_views(body: str) -> str:
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _needed(body)]
    body = body.strip()
    if not ctes:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return opening + ", ".join(ctes) + ", " + body[len(opening):]
    return "WITH " + ", ".join(ctes) + " " + body


def spark_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    text = _with_views(body)
    for t in TABLES:
        text = text.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")


def placed(ordered: DataFrame) -> DataFrame:
    """Adds each row's place in an ordered result, so that a check of values also checks the order."""
    return numbered(ordered.withColumn("_at", F.monotonically_increasing_id()), [], ["_at"], "place").drop("_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str) -> str:
    text = _with_views(body)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


class Registry:
    """Named queries with their SQL checks."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = oracle(sql)
            return fn
        return add
