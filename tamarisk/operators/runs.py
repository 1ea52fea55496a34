"""Pipeline run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tamarisk.functions.ordered import extreme_of_each
from tamarisk.functions.times import seconds_between


def newest_runs(runs: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The newest k runs per key; the limit is applied before the shuffle, so a hot key sends k rows per task."""
    order = W.partitionBy(key).orderBy(F.desc("started_at"), F.desc("run_key"))
    return runs.withColumn("run_rank", F.row_number().over(order)).where(F.col("run_rank") <= k)


def run_tasks(runs: DataFrame, tasks: DataFrame, k: int = 10) -> DataFrame:
    """Tasks with durations (null while running) of the newest k runs of each dataset."""
    recent = newest_runs(runs, "dataset", k).select("run_key", "dataset", "run_id", "run_rank", F.col("state").alias("run_state"),
                                                    seconds_between(F.col("started_at"), F.col("ended_at")).alias("run_seconds"))
    out = recent.join(tasks, "run_key", "left").withColumn("task_seconds", seconds_between(F.col("started_at"), F.col("ended_at")))
    return out.orderBy("dataset", "run_rank", "started_at", "task_no")


def runs_of(runs: DataFrame, dataset: str) -> DataFrame:
    """Runs whose id starts with the dataset name and two underscores, taken literally."""
    return runs.where(F.col("run_id").startswith(dataset + "__"))


def by_prefix(runs: DataFrame) -> DataFrame:
    """Runs with the dataset named before the first two underscores of their id."""
    return runs.withColumn("dataset", F.substring_index("run_id", "__", 1))


def last_finished(tasks: DataFrame, key: str = "dataset") -> DataFrame:
    """The latest finished run of every task per key."""
    done = tasks.where(F.col("ended_at").isNotNull()).select(key, "task", "state", "ended_at", "started_at", "run_key", "task_no")
    return extreme_of_each(done, [key, "task"], ["ended_at", "started_at", "run_key", "task_no"]).select(key, "task", "state", "ended_at")


def job_list(latest: DataFrame) -> DataFrame:
    """Pipelines before tasks, then by name."""
    return latest.orderBy(F.col("job_type") != "DAG", "job")
