"""Lineage graphs from the in- and outlets that runs report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.ordered import extreme_of_each
from tamarisk.functions.text import listed_uris, uri_tail
from tamarisk.session import materialise


def latest_runs(task_runs: DataFrame) -> DataFrame:
    """The newest run of every job, without a sort of a job's whole history."""
    run = ["job", "dataset", "task", "state", "inlets", "outlets", "started_at", "ended_at", "run_key", "task_no"]
    return extreme_of_each(task_runs.select(*run), ["job"], ["started_at", "run_key", "task_no"]).drop("task_no")


def latest_links(task_runs: DataFrame) -> DataFrame:
    """job, in_uris, out_uris of the newest runs: the graph alone.

    The end of a run is compared last of all and is no part of it, so the run history is shuffled without it.
    """
    run = ["job", "dataset", "task", "state", "inlets", "outlets", "started_at", "run_key", "task_no"]
    newest = extreme_of_each(task_runs.select(*run), ["job"], ["started_at", "run_key", "task_no"])
    return with_outlets(newest.select("job", "inlets", "outlets")).select("job", "in_uris", "out_uris")


def node_ids(jobs: DataFrame) -> DataFrame:
    uris = jobs.select(F.explode(F.concat("in_uris", "out_uris")).alias("id")).distinct()
    return jobs.select(F.col("job").alias("id")).unionByName(uris)


FACETS = """struct<latestRun: struct<state: string, durationMs: bigint,
    facets: struct<task: struct<inlets: string, outlets: string>, dagRun: struct<run_id: string, conf: struct<dataset_name: string>>>>>"""


def job_facets(jobs: DataFrame) -> DataFrame:
    """(job, job_type, facets as JSON text) flattened; absent paths are null or their default.

    Pipelines come before their tasks, then by name.
    """
    run = F.from_json("facets", FACETS)["latestRun"]
    out = jobs.select("job", "job_type", run.alias("r")).select(
        "job", "job_type", F.coalesce("r.state", F.lit("UNKNOWN")).alias("state"), F.col("r.facets.dagRun.run_id").alias("run_id"),
        F.col("r.facets.dagRun.conf.dataset_name").alias("dataset"), (F.col("r.durationMs") / 1000).alias("seconds"),
        listed_uris(F.col("r.facets.task.inlets")).alias("in_uris"), listed_uris(F.col("r.facets.task.outlets")).alias("out_uris"))
    return out.orderBy(F.col("job_type") != "DAG", "job")


def with_outlets(latest: DataFrame) -> DataFrame:
    """Latest runs with parsed uris; jobs with neither in- nor outlets are left out.

    Written once: nodes, edges and traces all start here, and the run history behind it is
    far larger than one row per job.
    """
    return materialise(latest.withColumn("in_uris", listed_uris(F.col("inlets"))).withColumn("out_uris", listed_uris(F.col("outlets")))
            .where((F.size("in_uris") > 0) | (F.size("out_uris") > 0)))


def edges(jobs: DataFrame) -> DataFrame:
    ins = jobs.select(F.explode("in_uris").alias("from_id"), F.col("job").alias("to_id"), F.lit("input").alias("type"))
    outs = jobs.select(F.col("job").alias("from_id"), F.explode("out_uris").alias("to_id"), F.lit("output").alias("type"))
    return ins.unionByName(outs)


def nodes(jobs: DataFrame) -> DataFrame:
    uris = jobs.select(F.explode(F.concat("in_uris", "out_uris")).alias("id")).distinct()
    work = jobs.select(F.col("job").alias("id"), F.lit("job").alias("type"), F.col("task").alias("label"), "dataset", F.col("state").alias("run_state"))
    data = uris.select("id", F.lit("dataset").alias("type"), uri_tail(F.col("id")).alias("label"))
    return work.unionByName(data, allowMissingColumns=True)


def _heads(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contracts chains: (id, up, d) for every node of one input, and the links left between the other nodes.

    ``links`` is (from_id, to_id, w): to_id is at least w levels below from_id. A node of one input points at it; pointers are
    followed by doubling, so a chain takes as many rounds as its length has bits. A pointer that still moves when it
    has covered more steps than there are nodes is on or behind a cycle and ends as null.
    """
    inputs = materialise(links.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"), F.min("from_id").alias("up"), F.max("w").alias("d")))
    chain = inputs.where("n = 1").select("id", "up", "d", F.lit(True).alias("moved"))
    covered, most = 1, None
    while True:
        further = chain.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"), F.lit(True).alias("found"))
        moved = chain.join(further, "up", "left").select(
            "id", F.when(F.col("found"), F.col("next")).otherwise(F.col("up")).alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"),
            F.coalesce("found", F.lit(False)).alias("moved"))
        chain, covered = materialise(moved), 2 * covered
        if chain.where("moved").isEmpty():
            break
        most = chain.count() if most is None else most
        if covered > 2 * most:
            chain = materialise(chain.withColumn("up", F.when(~F.col("moved"), F.col("up"))))
            break
    chain = chain.select("id", "up", "d")
    joins = links.join(inputs.where("n > 1").select(F.col("id").alias("to_id")), "to_id", "left_semi")
    at = chain.select(F.col("id").alias("from_id"), "up", "d", F.lit(True).alias("found"))
    lifted = joins.join(at, "from_id", "left").select(
        F.when(F.col("found"), F.col("up")).otherwise(F.col("from_id")).alias("from_id"), "to_id", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w"))
    return chain, materialise(lifted.groupBy("from_id", "to_id").agg(F.max("w").alias("w")))


def _peeled(links: DataFrame) -> DataFrame:
    """id, level of every target of the links: a node is done in the round after its last input.

    A round reads the links of the nodes done in the round before and rewrites only the nodes that wait.
    """
    inputs = materialise(links.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("inputs")))
    sources = links.select(F.col("from_id").alias("id")).distinct().join(inputs, "id", "left_anti").where("id IS NOT NULL")
    front, waiting, done = materialise(sources.withColumn("level", F.lit(0).cast("long"))), None, []
    while not front.isEmpty():
        met = links.join(front.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(
            F.count("*").alias("met"), F.max(F.col("level") + F.col("w")).alias("level"))
        if waiting is not None:
            met = met.unionAll(waiting).groupBy("id").agg(F.sum("met").alias("met"), F.max("level").alias("level"))
        touched = materialise(met.join(inputs, "id"))
        front, waiting = touched.where("met = inputs").select("id", "level"), touched.where("met < inputs").select("id", "met", "level")
        done.append(front)
    known = reduce(DataFrame.unionAll, done) if done else inputs.select("id", F.lit(None).cast("long").alias("level")).limit(0)
    return materialise(inputs.select("id").join(known, "id", "left"))


def levels(node_ids: DataFrame, graph: DataFrame) -> DataFrame:
    """Longest-path level of every node; nodes on or behind a cycle have none.

    Chains are contracted first, again and again while contraction makes new ones; what is left, nodes that
    several paths meet in, is peeled from its sources. The levels then go back down the chains.
    """
    listed = node_ids.select("id").distinct()
    links = materialise(graph.select("from_id", "to_id").distinct().join(listed.select(F.col("id").alias("to_id")), "to_id", "left_semi")
                        .select("from_id", "to_id", F.lit(1).cast("long").alias("w")))
    chains = []
    while not links.isEmpty():
        chain, left = _heads(links)
        chains.append(chain)
        if chain.isEmpty():
            break
        links = left
    known = _peeled(links) if not links.isEmpty() else None
    for chain in reversed(chains):
        level = F.when(F.col("up").isNotNull(), F.col("d"))
        if known is not None:
            up = known.select(F.col("id").alias("up"), F.col("level").alias("up_level"), F.lit(True).alias("found"))
            level = F.when(F.col("found"), F.col("up_level") + F.col("d")).otherwise(level)
            chain = chain.join(up, "up", "left")
        here = chain.select("id", level.alias("level"))
        known = here if known is None else known.unionAll(here)
    if known is None:
        return listed.select("id", F.lit(0).alias("level"))
    out = listed.join(known.withColumn("found", F.lit(True)), "id", "left")
    return out.select("id", F.when(F.col("found"), F.col("level")).otherwise(F.lit(0)).cast("int").alias("level"))


def gold_traces(jobs: DataFrame, keyword: str, task: str = "gold_compute") -> DataFrame:
    """Per dataset: the first output of its Gold job whose uri holds the keyword, and the job's inputs."""
    hit = jobs.where(F.col("task") == task).select(
        "dataset", "job", "state", "in_uris", F.try_element_at(F.filter("out_uris", lambda u: F.contains(F.lower(u), F.lit(keyword))), F.lit(1)).alias("output"))
    return hit.where(F.col("output").isNotNull())


def field_report(registry: DataFrame, contributions: DataFrame, lifecycle: DataFrame, ecl_traces: DataFrame,
                 maturity_traces: DataFrame, assessed: bool) -> DataFrame:
    """Four field traces per dataset, one row per field and step.

    ``registry`` is (dataset, columns, rows, null_counts, checked); a field that cannot be
    traced has one row with the reason and no step.
    """
    step = lambda n, stage, text: F.struct(F.lit(n).alias("step_no"), F.lit(stage).alias("stage"), text.alias("text"))
    no_steps = F.array(F.struct(F.lit(None).cast("int").alias("step_no"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("text")))
    s = lambda c: F.col(c).cast("string")

    def rows(df, field, available, reason, steps):
        out = df.select("dataset", F.lit(field).alias("field"), available.alias("available"), F.when(~available, F.lit(reason)).alias("reason"),
                        F.inline_outer(F.when(available, F.array(*steps)).otherwise(no_steps)))
        return out

    merged = contributions.groupBy("dataset").agg(F.count("*").alias("contributed"))
    ids = registry.join(merged, "dataset", "left").withColumn("contributed", F.coalesce("contributed", F.lit(0)))
    nulls = F.coalesce(F.try_element_at("null_counts", F.lit("NATIONAL_ID")), F.lit(0)).cast("string")
    national = rows(ids, "NATIONAL_ID", F.array_contains("columns", "NATIONAL_ID"), "column not present", [
        step(1, "bronze", F.lit("column as uploaded")),
        step(2, "silver", F.concat(nulls, F.lit(" null of "), s("rows"), F.lit(" rows"))),
        step(3, "golden", F.concat(F.lit("contributed to "), s("contributed"), F.lit(" golden record(s)")))])

    cycle = registry.join(lifecycle, "dataset", "left").fillna(0, ["pending", "confirmed_duplicate", "not_duplicate", "golden_records"])
    duplicate = rows(cycle, "DUPLICATE_FLAG", F.col("checked"), "duplicate detection has not been run", [
        step(1, "silver", F.lit("clustering input")),
        step(2, "detection", F.concat(s("pending"), F.lit(" pending, "), s("confirmed_duplicate"), F.lit(" confirmed, "), s("not_duplicate"), F.lit(" rejected"))),
        step(3, "golden", F.concat(s("golden_records"), F.lit(" merged")))])

    def traced(field, traces, reason, also=False):
        t = registry.select("dataset").join(traces, "dataset", "left")
        found = F.col("output").isNotNull()
        steps = [step(1, "silver", F.concat(F.lit("inputs: "), F.array_join("in_uris", ", "))),
                 step(2, "gold_compute", F.concat(F.lit("run state: "), F.col("state"))), step(3, "gold", F.concat(F.lit("output: "), F.col("output")))]
        available = found | F.lit(also)
        return t.select("dataset", F.lit(field).alias("field"), available.alias("available"), F.when(~available, F.lit(reason)).alias("reason"),
                        F.inline_outer(F.when(found, F.array(*steps)).otherwise(no_steps)))

    ecl = traced("ECL_SAR", ecl_traces, "no Gold credit-loss table from the pipeline yet")
    score = traced("NDI_SCORE", maturity_traces, "no Gold maturity table and no recorded assessment", assessed)
    return national.unionByName(duplicate).unionByName(ecl).unionByName(score)
