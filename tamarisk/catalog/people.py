"""Duplicate-detection, decision and golden-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarisk.catalog.base import Registry, placed, spark_sql, view
from tamarisk.operators import dedup, golden, search
from tamarisk.plans import people as plan
from tamarisk.session import scratch_path

R = Registry()
FIELDS = ["CUST_ID", "FULL_NAME", "DOB", "PHONE", "EMAIL", "NATIONAL_ID", "NATION"]

# Least similar pair of names per block, over distinct sorted-token names.
_CLUSTERS = """
    WITH m AS (SELECT dataset, DOB AS dob, row_pos,
               array_to_string(list_sort(list_filter(string_split_regex(coalesce(FULL_NAME, ''), '\\s+'), lambda t: t <> '')), ' ') AS nm
               FROM v_customers WHERE DOB <> ''),
    n AS (SELECT dataset, dob, nm, string_split(nm, '') AS ch FROM m GROUP BY 1, 2, 3),
    p AS (SELECT a.dataset, a.dob, a.nm AS x, b.nm AS y, a.ch AS xa, b.ch AS ya FROM n a JOIN n b
          ON a.dataset = b.dataset AND a.dob = b.dob AND a.nm < b.nm),
    u AS (SELECT DISTINCT x, y, xa, ya FROM p),
    s AS (SELECT x, y, 200.0::DOUBLE * list_last(list_reduce(range(1, len(xa) + 1), lambda cur, i:
            list_reduce(range(1, len(ya) + 1), lambda row, j:
              list_append(row, CASE WHEN xa[i] = ya[j] THEN cur[j] + 1 ELSE greatest(cur[j + 1], list_last(row)) END), [0::BIGINT]),
            list_transform(range(0, len(ya) + 1), lambda z: 0::BIGINT))) / (len(x) + len(y)) AS score FROM u),
    w AS (SELECT p.dataset, p.dob, min(s.score) AS score FROM p JOIN s ON p.x = s.x AND p.y = s.y GROUP BY 1, 2),
    g AS (SELECT dataset, dob, count(*) AS size, count(DISTINCT nm) AS n_names, min(row_pos) AS first_pos FROM m GROUP BY 1, 2 HAVING count(*) > 1),
    h AS (SELECT g.*, coalesce(w.score, 100::DOUBLE) AS score FROM g LEFT JOIN w ON g.dataset = w.dataset AND g.dob = w.dob),
    clusters AS (SELECT dataset, dob, size, n_names, first_pos, round(score, 1) AS min_name_similarity,
                 CASE WHEN score >= 85 THEN 'high_confidence' ELSE 'needs_review' END AS tier,
                 row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN score >= 85 THEN 0 ELSE 1 END, size DESC, first_pos) - 1 AS cluster_index FROM h)"""


def _rows(spark, sf):
    return dedup.candidates(view(spark, sf, "v_customers"))


@R.query("dup_clusters", _CLUSTERS + " SELECT dataset, dob, CAST(size AS BIGINT) AS size, n_names, first_pos, min_name_similarity, tier, cluster_index FROM clusters")
def dup_clusters(spark, sf):
    return dedup.find_clusters(_rows(spark, sf))


@R.query("dup_members", """
    SELECT c.dataset, c.DOB AS dob, c.CUST_ID AS row_id, c.FULL_NAME AS name, c.PHONE AS phone FROM v_customers c
    WHERE (c.dataset, c.DOB) IN (SELECT (dataset, DOB) FROM v_customers GROUP BY dataset, DOB HAVING count(*) > 1)""")
def dup_members(spark, sf):
    rows = _rows(spark, sf)
    sizes = rows.groupBy(*dedup.BLOCK).agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, dedup.BLOCK, "left_semi").select(*dedup.BLOCK, "row_id", "name", "phone")


@R.query("dup_summary", _CLUSTERS + """
    SELECT dataset, count(*) AS clusters, count(*) FILTER (WHERE tier = 'high_confidence') AS high_confidence,
           count(*) FILTER (WHERE tier = 'needs_review') AS needs_review, CAST(sum(size) AS BIGINT) AS records_involved FROM clusters GROUP BY 1""")
def dup_summary(spark, sf):
    return dedup.summary(dedup.find_clusters(_rows(spark, sf)))


_OLD = """old AS (SELECT m.dataset, m.cluster_id, m.row_id FROM v_members m JOIN v_decisions d ON m.dataset = d.dataset AND m.cluster_id = d.cluster_id
          WHERE d.status <> 'pending' AND NOT m.row_id LIKE 'U%')"""


@R.query("dup_suppressed", f"""
    WITH {_OLD}, os AS (SELECT dataset, cluster_id, list_sort(list(DISTINCT row_id)) AS ids FROM old GROUP BY 1, 2),
    ns AS (SELECT dataset, DOB AS dob, list_sort(list(DISTINCT CUST_ID)) AS ids FROM v_customers WHERE DOB <> '' GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT dataset, dob, len(ids) AS size FROM ns WHERE NOT EXISTS (SELECT 1 FROM os WHERE os.dataset = ns.dataset AND os.ids = ns.ids)""")
def dup_suppressed(spark, sf):
    rows = _rows(spark, sf)
    clusters = dedup.blocks(dedup.block_names(rows))
    decided = view(spark, sf, "v_decisions").where("status <> 'pending'")
    old = view(spark, sf, "v_members").where("row_id NOT LIKE 'U%'").join(decided.select("dataset", "cluster_id"), ["dataset", "cluster_id"], "left_semi")
    return dedup.unseen(clusters, rows, old).select("dataset", "dob", "size")


@R.query("dup_bulk_confirm", """
    SELECT dataset, cluster_id, tier, CASE WHEN status = 'pending' AND tier = 'high_confidence' THEN 'confirmed_duplicate' ELSE status END AS status,
           CASE WHEN status = 'pending' AND tier = 'high_confidence' THEN 'lead' ELSE decided_by END AS decided_by,
           strftime(CASE WHEN status = 'pending' AND tier = 'high_confidence' THEN TIMESTAMP '2026-09-01 08:00:00' ELSE decided_at END, '%Y-%m-%d %H:%M:%S') AS decided_at,
           status = 'pending' AND tier = 'high_confidence' AS newly_confirmed FROM v_decisions""")
def dup_bulk_confirm(spark, sf):
    out = dedup.bulk_confirm(view(spark, sf, "v_decisions"), "lead", "2026-09-01 08:00:00", tier="high_confidence")
    return out.select("dataset", "cluster_id", "tier", "status", "decided_by", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"), "newly_confirmed")


_CHOICES = """SELECT cluster_id + CASE WHEN tier = 'needs_review' THEN 0 ELSE 1000000 END AS cluster_id,
    CASE WHEN size > 3 THEN 'maybe' ELSE 'not_duplicate' END AS choice, 'judge' AS actor, TIMESTAMP '2026-09-02 00:00:00' AS at FROM v_decisions WHERE status = 'pending'"""


def _decided(spark, sf):
    return dedup.decide(view(spark, sf, "v_decisions"), spark_sql(spark, sf, _CHOICES))


@R.query("dup_decide", f"""
    WITH c AS ({_CHOICES})
    SELECT d.dataset, d.cluster_id, CASE WHEN c.choice = 'not_duplicate' THEN c.choice ELSE d.status END AS status,
           CASE WHEN c.choice = 'not_duplicate' THEN c.actor ELSE d.decided_by END AS decided_by
    FROM v_decisions d LEFT JOIN c ON d.cluster_id = c.cluster_id""")
def dup_decide(spark, sf):
    return _decided(spark, sf)[0].select("dataset", "cluster_id", "status", "decided_by")


@R.query("dup_decide_errors", f"""
    WITH c AS ({_CHOICES})
    SELECT cluster_id, choice, CASE WHEN choice <> 'not_duplicate' THEN 'invalid status' ELSE 'unknown cluster' END AS reason
    FROM c WHERE choice <> 'not_duplicate' OR cluster_id NOT IN (SELECT cluster_id FROM v_decisions)""")
def dup_decide_errors(spark, sf):
    return _decided(spark, sf)[1].select("cluster_id", "choice", "reason")


@R.query("dup_queue", "SELECT dataset, cluster_id, size, tier, status, status = 'pending' AS pending FROM v_decisions WHERE dataset IN (SELECT dataset FROM v_customers)")
def dup_queue(spark, sf):
    registered = view(spark, sf, "v_customers").select("dataset").distinct()
    return dedup.queue(view(spark, sf, "v_decisions"), registered).select("dataset", "cluster_id", "size", "tier", "status", "pending")


@R.query("dup_audit", """SELECT dataset, cluster_id, status, decided_by, strftime(decided_at, '%Y-%m-%d') AS decided_on
    FROM v_decisions WHERE status <> 'pending'""")
def dup_audit(spark, sf):
    return dedup.audit(view(spark, sf, "v_decisions")).select("dataset", "cluster_id", "status", "decided_by", F.date_format("decided_at", "yyyy-MM-dd").alias("decided_on"))


@R.query("dup_audit_page", """SELECT cluster_id, row_number() OVER (ORDER BY decided_at DESC, cluster_id DESC) AS place
    FROM v_decisions WHERE status <> 'pending' ORDER BY decided_at DESC, cluster_id DESC LIMIT 20""")
def dup_audit_page(spark, sf):
    """A page that cuts, with each row's place."""
    return placed(dedup.audit(view(spark, sf, "v_decisions"), limit=20).select("cluster_id"))


# All customers on one date: names of two words, a fifth of them with few letters in common with the others.
_HOT = """SELECT dataset, row_pos, CUST_ID, CASE WHEN row_pos % 5 = 0
        THEN concat(translate(CAST(row_pos AS STRING), '0123456789', 'kalesimort'), ' ', translate(reverse(CAST(row_pos AS STRING)), '0123456789', 'bucdyhfwgp'))
        ELSE coalesce(FULL_NAME, 'No Name') END AS FULL_NAME, '1900-01-01' AS DOB FROM v_customers"""


@R.query("dup_hot_block", _CLUSTERS.replace("FROM v_customers WHERE DOB <> ''", f"FROM ({_HOT}) t")
         + " SELECT dataset, dob, CAST(size AS BIGINT) AS size, n_names, min_name_similarity, tier FROM clusters")
def dup_hot_block(spark, sf):
    """A placeholder date that holds every row."""
    found = dedup.find_clusters(dedup.candidates(spark_sql(spark, sf, _HOT)))
    return found.select("dataset", "dob", "size", "n_names", "min_name_similarity", "tier")


@R.query("dup_audit_stats", """
    SELECT count(*) FILTER (WHERE status <> 'pending') AS total, count(*) FILTER (WHERE status = 'confirmed_duplicate') AS merged,
           count(*) FILTER (WHERE status = 'not_duplicate') AS rejected,
           count(*) FILTER (WHERE status <> 'pending' AND tier = 'high_confidence') AS high_confidence FROM v_decisions""")
def dup_audit_stats(spark, sf):
    return dedup.audit_statistics(view(spark, sf, "v_decisions"))


@R.query("dup_search", """SELECT cluster_id, lead_name, decided_by, size FROM v_decisions
    WHERE status <> 'pending' AND (contains(lower(lead_name), 'family1') OR contains(lower(decided_by), 'family1'))""")
def dup_search(spark, sf):
    return dedup.search_decided(view(spark, sf, "v_decisions"), " Family1").select("cluster_id", "lead_name", "decided_by", "size")


@R.query("pending_by_dataset", """SELECT dataset, count(*) AS pending, count(*) FILTER (WHERE tier = 'high_confidence') AS high_confidence
    FROM v_decisions WHERE status = 'pending' GROUP BY 1""")
def pending_by_dataset(spark, sf):
    return dedup.pending_by_dataset(view(spark, sf, "v_decisions"))


def _first(c):
    return f"arg_min(c.{c}, c.row_pos) FILTER (WHERE c.{c} IS NOT NULL)"


_GOLDEN = """
    WITH m AS (SELECT c.*, m.cluster_id, """ + " + ".join(f"(c.{c} IS NOT NULL)::INT" for c in FIELDS) + """ AS filled
               FROM v_customers c JOIN v_members m ON c.dataset = m.dataset AND c.CUST_ID = m.row_id
               JOIN v_decisions d ON d.dataset = m.dataset AND d.cluster_id = m.cluster_id WHERE d.status = 'confirmed_duplicate'),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY dataset, cluster_id ORDER BY filled DESC, row_pos) = 1),
    f AS (SELECT c.dataset, c.cluster_id, count(*) AS source_rows, """ + ", ".join(f"{_first(c)} AS f_{c}, arg_min(c.CUST_ID, c.row_pos) FILTER (WHERE c.{c} IS NOT NULL) AS r_{c}" for c in FIELDS) + """
          FROM m c GROUP BY 1, 2),
    golden AS (SELECT b.dataset, b.cluster_id, f.source_rows, b.CUST_ID AS base_row_id, """ + ", ".join(
    f"coalesce(b.{c}, f.f_{c}) AS {c}, CASE WHEN b.{c} IS NOT NULL THEN b.CUST_ID ELSE f.r_{c} END AS src_{c}" for c in FIELDS) + """
          FROM b JOIN f ON b.dataset = f.dataset AND b.cluster_id = f.cluster_id)"""


def golden_records_of(spark, sf):
    confirmed = view(spark, sf, "v_decisions").where("status = 'confirmed_duplicate'")
    chosen = view(spark, sf, "v_members").join(confirmed.select("dataset", "cluster_id"), ["dataset", "cluster_id"], "left_semi")
    rows = view(spark, sf, "v_customers").withColumn("row_id", F.col("CUST_ID"))
    return golden.merge(rows, chosen, FIELDS)


@R.query("golden_records", _GOLDEN + " SELECT * FROM golden")
def golden_records(spark, sf):
    return golden_records_of(spark, sf)


@R.query("golden_search", _GOLDEN + " SELECT dataset, cluster_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(CAST({c} AS VARCHAR)), 'e1') THEN '{c}' END" for c in FIELDS) + "], lambda x: x IS NOT NULL), ',') AS matched FROM golden WHERE " + " OR ".join(
    f"contains(lower(CAST({c} AS VARCHAR)), 'e1')" for c in FIELDS))
def golden_search(spark, sf):
    found = golden.search(golden.as_maps(golden_records_of(spark, sf), FIELDS), "E1")
    return found.select("dataset", "cluster_id", F.array_join("matched_fields", ",").alias("matched"))


@R.query("golden_search_indexed", _GOLDEN + " SELECT dataset, cluster_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(CAST({c} AS VARCHAR)), 'family1') THEN '{c}' END" for c in FIELDS) + "], lambda x: x IS NOT NULL), ',') AS matched FROM golden WHERE " + " OR ".join(
    f"contains(lower(CAST({c} AS VARCHAR)), 'family1')" for c in FIELDS))
def golden_search_indexed(spark, sf):
    """By postings of trigrams that are written once; only records that hold a matching value are read."""
    index = search.build(golden_records_of(spark, sf), ["dataset", "cluster_id"], FIELDS, scratch_path(spark, "index"))
    return search.find(index, " Family1", FIELDS).select("dataset", "cluster_id", F.array_join("matched_fields", ",").alias("matched"))


@R.query("golden_contributions", _GOLDEN + " SELECT dataset, cluster_id, src_NATIONAL_ID AS source_row_id FROM golden WHERE NATIONAL_ID IS NOT NULL")
def golden_contributions(spark, sf):
    return golden.contributions(golden.as_maps(golden_records_of(spark, sf), FIELDS), "NATIONAL_ID")


@R.query("golden_listing", _GOLDEN + """
    SELECT g.dataset, g.cluster_id, g.base_row_id, d.tier, d.size, d.decided_by FROM golden g
    LEFT JOIN v_decisions d ON g.dataset = d.dataset AND g.cluster_id = d.cluster_id
    ORDER BY d.decided_at DESC NULLS LAST, g.cluster_id DESC LIMIT 20""")
def golden_listing(spark, sf):
    out = golden.listing(golden_records_of(spark, sf), view(spark, sf, "v_decisions"), limit=20)
    return out.select("dataset", "cluster_id", "base_row_id", "tier", "size", "decided_by")


@R.query("golden_pending_merges", _GOLDEN + """
    SELECT d.dataset, d.cluster_id FROM v_decisions d WHERE d.status IN ('pending', 'confirmed_duplicate')
    AND NOT EXISTS (SELECT 1 FROM golden g WHERE g.dataset = d.dataset AND g.cluster_id = d.cluster_id)""")
def golden_pending_merges(spark, sf):
    confirmed = dedup.bulk_confirm(view(spark, sf, "v_decisions"), "lead", "2026-09-01 08:00:00")
    return golden.pending_merges(confirmed, golden_records_of(spark, sf)).select("dataset", "cluster_id")


@R.query("golden_merge_errors", """
    SELECT dataset, cluster_id, 'source rows not found in the current silver data' AS reason FROM v_decisions d WHERE status = 'confirmed_duplicate'
    AND NOT EXISTS (SELECT 1 FROM v_members m WHERE m.dataset = d.dataset AND m.cluster_id = d.cluster_id AND m.row_id LIKE 'S%')""")
def golden_merge_errors(spark, sf):
    confirmed = view(spark, sf, "v_decisions").where("status = 'confirmed_duplicate'")
    left = view(spark, sf, "v_customers").withColumn("row_id", F.col("CUST_ID")).where("CUST_ID LIKE 'S%'")
    return golden.merge_errors(confirmed, golden.merge(left, view(spark, sf, "v_members"), FIELDS)).select("dataset", "cluster_id", "reason")


def _confirmed_and_merged(spark, sf):
    """Existing golden records, then all pending clusters confirmed; customer rows have left Silver since."""
    rows = view(spark, sf, "v_customers").withColumn("row_id", F.col("CUST_ID")).where("CUST_ID NOT LIKE 'C%'")
    return plan.confirm_and_merge(rows, view(spark, sf, "v_members"), view(spark, sf, "v_decisions"), golden_records_of(spark, sf), FIELDS, "lead", "2026-09-01 08:00:00")


@R.query("confirm_and_merge", """SELECT d.dataset, d.cluster_id, d.status <> 'confirmed_duplicate' AS new_record FROM v_decisions d WHERE d.status IN ('confirmed_duplicate', 'pending')
    AND (d.status = 'confirmed_duplicate' OR EXISTS (SELECT 1 FROM v_members m WHERE m.dataset = d.dataset AND m.cluster_id = d.cluster_id AND NOT m.row_id LIKE 'C%'))""")
def confirm_and_merge(spark, sf):
    out = _confirmed_and_merged(spark, sf)
    return out.golden.join(out.decisions.select("dataset", "cluster_id", F.col("newly_confirmed").alias("new_record")), ["dataset", "cluster_id"]).select("dataset", "cluster_id", "new_record")


@R.query("confirm_and_merge_errors", """SELECT d.dataset, d.cluster_id, 'source rows not found in the current silver data' AS reason FROM v_decisions d WHERE d.status = 'pending'
    AND NOT EXISTS (SELECT 1 FROM v_members m WHERE m.dataset = d.dataset AND m.cluster_id = d.cluster_id AND NOT m.row_id LIKE 'C%')""")
def confirm_and_merge_errors(spark, sf):
    return _confirmed_and_merged(spark, sf).errors


_REFRESHED = _CLUSTERS + f""", {_OLD}, os AS (SELECT dataset, cluster_id, list_sort(list(DISTINCT row_id)) AS ids FROM old GROUP BY 1, 2),
    ns AS (SELECT dataset, DOB AS dob, list_sort(list(DISTINCT CUST_ID)) AS ids FROM v_customers WHERE DOB <> '' GROUP BY 1, 2 HAVING count(*) > 1),
    queue AS (SELECT dataset, dob, size, tier, status, NULL::DOUBLE AS min_name_similarity, NULL::BIGINT AS cluster_index, decided_by FROM v_decisions WHERE status <> 'pending'
    UNION ALL SELECT c.dataset, c.dob, CAST(c.size AS BIGINT), c.tier, 'pending', c.min_name_similarity, row_number() OVER (PARTITION BY c.dataset ORDER BY c.cluster_index) - 1, NULL
      FROM clusters c WHERE (c.dataset, c.dob) IN (SELECT (dataset, dob) FROM ns WHERE NOT EXISTS (SELECT 1 FROM os WHERE os.dataset = ns.dataset AND os.ids = ns.ids)))"""


def _refreshed(spark, sf):
    """Whole review cycle: detect, suppress decided member sets, replace the pending queue."""
    decisions = view(spark, sf, "v_decisions")
    decided = decisions.where("status <> 'pending'").select("dataset", "cluster_id")
    old = view(spark, sf, "v_members").where("row_id NOT LIKE 'U%'").join(decided, ["dataset", "cluster_id"], "left_semi")
    return plan.refresh_queue(_rows(spark, sf), decisions, old)


@R.query("dup_refreshed_queue", _REFRESHED + " SELECT * FROM queue")
def dup_refreshed_queue(spark, sf):
    return _refreshed(spark, sf).drop("decided_at")


@R.query("dup_pending_ordered", _REFRESHED + " SELECT dataset, dob, cluster_index, row_number() OVER (ORDER BY dataset, cluster_index) AS place FROM queue WHERE status = 'pending'")
def dup_pending_ordered(spark, sf):
    """The pending list with each row's place in it."""
    return placed(dedup.pending(_refreshed(spark, sf)).select("dataset", "dob", "cluster_index"))


# Three members of every cluster name their row twice, and two rows share each id of the second data set.
_REPEATED = "SELECT *, CASE WHEN dataset = 'ds_b' THEN concat('R', row_pos // 2) ELSE CUST_ID END AS row_id FROM v_customers"
_REPEATED_MEMBERS = f"""SELECT m.dataset, m.cluster_id, r.row_id FROM v_members m JOIN ({_REPEATED}) r ON m.dataset = r.dataset AND m.row_id = r.CUST_ID
    UNION ALL SELECT m.dataset, m.cluster_id, r.row_id FROM v_members m JOIN ({_REPEATED}) r ON m.dataset = r.dataset AND m.row_id = r.CUST_ID WHERE m.row_pos % 3 = 0"""


@R.query("golden_repeated_ids", f"""
    WITH r AS ({_REPEATED}), i AS ({_REPEATED_MEMBERS}), c AS (SELECT DISTINCT dataset, cluster_id FROM i)
    SELECT c.dataset, c.cluster_id, (SELECT count(*) FROM r WHERE r.dataset = c.dataset AND r.row_id IN (SELECT row_id FROM i WHERE i.dataset = c.dataset AND i.cluster_id = c.cluster_id)) AS source_rows FROM c""")
def golden_repeated_ids(spark, sf):
    rows = spark_sql(spark, sf, _REPEATED.replace("row_pos // 2", "row_pos div 2"))
    ids = spark_sql(spark, sf, _REPEATED_MEMBERS.replace("row_pos // 2", "row_pos div 2"))
    return golden.merge(rows, ids, FIELDS).select("dataset", "cluster_id", "source_rows")


# Of each pending cluster: a valid choice, then an invalid one; some confirm, some name no cluster.
_MIXED = """SELECT cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'confirmed_duplicate' ELSE 'not_duplicate' END AS choice, 'first' AS actor, TIMESTAMP '2026-09-02 00:00:00' AS at FROM v_decisions WHERE status = 'pending'
    UNION ALL SELECT cluster_id, 'perhaps', 'second', TIMESTAMP '2026-09-03 00:00:00' FROM v_decisions WHERE status = 'pending'
    UNION ALL SELECT cluster_id, CAST(NULL AS STRING), 'third', TIMESTAMP '2026-09-04 00:00:00' FROM v_decisions WHERE status = 'pending' AND size > 2
    UNION ALL SELECT -1 - cluster_id, 'not_duplicate', 'fourth', TIMESTAMP '2026-09-05 00:00:00' FROM v_decisions WHERE status = 'pending'"""


@R.query("dup_decide_mixed", f"""
    WITH c AS ({_MIXED}), bad AS (SELECT cluster_id FROM c WHERE choice IS NULL OR choice = 'perhaps' OR cluster_id NOT IN (SELECT cluster_id FROM v_decisions))
    SELECT status, decided_by, count(*) AS clusters FROM (SELECT CASE WHEN status <> 'pending' THEN status WHEN cluster_id % 3 = 0 THEN 'confirmed_duplicate' ELSE 'not_duplicate' END AS status,
      CASE WHEN status = 'pending' THEN 'first' ELSE decided_by END AS decided_by FROM v_decisions) GROUP BY 1, 2
    UNION ALL SELECT 'refused', NULL, count(*) FROM bad""")
def dup_decide_mixed(spark, sf):
    updated, refused = dedup.decide(view(spark, sf, "v_decisions"), spark_sql(spark, sf, _MIXED))
    return updated.groupBy("status", "decided_by").agg(F.count("*").alias("clusters")).unionByName(
        refused.agg(F.lit("refused").alias("status"), F.lit(None).cast("string").alias("decided_by"), F.count("*").alias("clusters")))


@R.query("decide_and_merge", f"""
    WITH c AS ({_MIXED}), d AS (SELECT dataset, cluster_id, status = 'confirmed_duplicate' AS old, status = 'confirmed_duplicate' OR (status = 'pending' AND cluster_id % 3 = 0) AS confirmed FROM v_decisions),
    left_rows AS (SELECT dataset, cluster_id FROM v_members WHERE NOT row_id LIKE 'C%')
    SELECT dataset, cluster_id, 'golden' AS outcome FROM d WHERE old OR (confirmed AND EXISTS (SELECT 1 FROM left_rows l WHERE l.dataset = d.dataset AND l.cluster_id = d.cluster_id))
    UNION ALL SELECT dataset, cluster_id, 'error' FROM d WHERE confirmed AND NOT old AND NOT EXISTS (SELECT 1 FROM left_rows l WHERE l.dataset = d.dataset AND l.cluster_id = d.cluster_id)""")
def decide_and_merge(spark, sf):
    """Choices applied and merged; customer rows have left Silver, so some merges fail and their decisions stand."""
    rows = view(spark, sf, "v_customers").withColumn("row_id", F.col("CUST_ID")).where("CUST_ID NOT LIKE 'C%'")
    out, _ = plan.decide_and_merge(rows, view(spark, sf, "v_members"), view(spark, sf, "v_decisions"), spark_sql(spark, sf, _MIXED), golden_records_of(spark, sf), FIELDS)
    return out.golden.select("dataset", "cluster_id", F.lit("golden").alias("outcome")).unionByName(out.errors.select("dataset", "cluster_id", F.lit("error").alias("outcome")))


@R.query("golden_json", _GOLDEN + " SELECT dataset, cluster_id, FULL_NAME AS full_name, src_EMAIL AS email_source FROM golden")
def golden_json(spark, sf):
    """Maps written as JSON text and read back."""
    maps = golden.as_maps(golden_records_of(spark, sf), FIELDS)
    text = maps.select("dataset", "cluster_id", F.to_json("merged").alias("m"), F.to_json("field_sources").alias("s"))
    back = lambda c: F.from_json(c, "map<string,string>")
    return text.select("dataset", "cluster_id", F.try_element_at(back("m"), F.lit("FULL_NAME")).alias("full_name"), F.try_element_at(back("s"), F.lit("EMAIL")).alias("email_source"))


@R.query("dup_lifecycle", _GOLDEN + """
    SELECT d.dataset, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'confirmed_duplicate') AS confirmed_duplicate,
           count(*) FILTER (WHERE status = 'not_duplicate') AS not_duplicate,
           (SELECT count(*) FROM golden g WHERE g.dataset = d.dataset) AS golden_records FROM v_decisions d GROUP BY 1""")
def dup_lifecycle(spark, sf):
    return dedup.lifecycle_counts(view(spark, sf, "v_decisions"), golden_records_of(spark, sf))
