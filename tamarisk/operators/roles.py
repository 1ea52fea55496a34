"""Column roles found by name. Works on the schema only; no data is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarisk import params as P


def normal(name: str) -> str:
    return str(name).lower().replace(" ", "_")


def find_containing(columns, keywords) -> str | None:
    """First column (in column order) whose lower-cased name contains any keyword."""
    return next((c for c in columns if any(k in str(c).lower() for k in keywords)), None)


def find_exact(columns, names) -> str | None:
    """First column whose normalised name is one of ``names``."""
    return next((c for c in columns if normal(c) in names), None)


def find_candidate(columns, candidates) -> str | None:
    """First candidate present; when names collide the last such column wins."""
    by_name = {normal(c): c for c in columns}
    return next((by_name[k] for k in candidates if k in by_name), None)


def is_identifier(name: str, keywords=P.IDENTIFIER_KEYWORDS) -> bool:
    low = normal(name)
    return any(low == k or low.startswith(k + "_") or low.endswith("_" + k) for k in keywords)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def quantity_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not identifiers."""
    return [c for c in numeric_columns(df) if not is_identifier(c)]


def category_columns(df: DataFrame, first: int = 5) -> list[str]:
    """The first non-numeric columns; this many are profiled for their top values."""
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric][:first]


def dedup_roles(columns) -> dict[str, str | None]:
    return {
        "dob": find_candidate(columns, P.DOB_CANDIDATES),
        "name": find_candidate(columns, P.NAME_CANDIDATES),
        "phone": find_candidate(columns, P.PHONE_CANDIDATES),
        "id": find_candidate(columns, P.ID_CANDIDATES),
    }


def dedup_applicable(columns) -> bool:
    roles = dedup_roles(columns)
    return bool(roles["dob"] and roles["name"])


def modelling_ready(columns) -> bool:
    return set(P.MODELLING_COLUMNS) <= set(columns)


def scorecard_roles(df: DataFrame) -> tuple[str, str, str | None]:
    """(current, target, label) columns of a readiness scorecard, or ValueError."""
    numeric = numeric_columns(df)
    current = find_containing(df.columns, ("current", "الحالي"))
    target = find_containing(df.columns, ("target", "مستهدف", "هدف"))
    if current is None or target is None:
        not_scores = ("#", "index", "no.", "gap", "فجو", "priority", "أولوي")
        scores = [c for c in numeric if not any(k in c.lower() for k in not_scores)]
        if len(scores) != 2:
            raise ValueError("no current/target columns and not exactly two numeric score columns")
        current, target = scores
    if current not in numeric or target not in numeric:
        raise ValueError(f"score columns '{current}' and '{target}' must be numeric")
    text = [c for c in df.columns if c not in numeric]
    label = next((c for c in text if "english" in c.lower()), text[-1] if text else None)
    return current, target, label
