"""All registered queries."""

from __future__ import annotations

from tamarisk.catalog import credit, governance, landing, observability, people

PARTS = (credit, people, landing, governance, observability)


def queries() -> dict:
    return {name: fn for part in PARTS for name, fn in part.R.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.R.oracles.items()}
