"""Duplicate review: detection to queue, and bulk confirmation to golden records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.operators import dedup, golden
from tamarisk.session import materialise


@dataclass
class Merged:
    decisions: DataFrame
    golden: DataFrame
    errors: DataFrame


def refresh_queue(rows: DataFrame, decisions: DataFrame, decided_members: DataFrame) -> DataFrame:
    """Detects clusters anew, drops member sets already decided, replaces the pending ones."""
    found = materialise(dedup.find_clusters(rows))
    return dedup.refreshed_queue(decisions, dedup.unseen(found, rows, decided_members))


def confirm_and_merge(rows: DataFrame, members: DataFrame, decisions: DataFrame, existing: DataFrame, data_columns: list[str],
                      decided_by: str, decided_at: str, tier: str | None = None, dataset: str | None = None) -> Merged:
    """Confirms pending clusters and merges every confirmed one that has no golden record yet.

    All clusters merge in one job. A cluster whose rows are gone is reported; its
    confirmation stands.
    """
    return _merged(rows, members, dedup.bulk_confirm(decisions, decided_by, decided_at, tier, dataset), existing, data_columns)


def decide_and_merge(rows: DataFrame, members: DataFrame, decisions: DataFrame, choices: DataFrame, existing: DataFrame, data_columns: list[str]) -> tuple[Merged, DataFrame]:
    """Applies the choices; a confirmed cluster merges at once. Also gives the choices refused.

    A cluster whose rows are gone is reported among the merge errors; its decision stands.
    """
    decided, refused = dedup.decide(decisions, choices)
    return _merged(rows, members, decided, existing, data_columns), refused


def _merged(rows: DataFrame, members: DataFrame, decided: DataFrame, existing: DataFrame, data_columns: list[str]) -> Merged:
    wanted = materialise(golden.pending_merges(decided, existing).select("dataset", "cluster_id"))
    made = materialise(golden.merge(rows, members.join(wanted, ["dataset", "cluster_id"], "left_semi"), data_columns))
    return Merged(decided, existing.unionByName(made.select(*existing.columns)), golden.merge_errors(wanted, made))
