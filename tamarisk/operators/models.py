"""Fitted default and severity parameters (the trained mode of the credit loss)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk import params as P
from tamarisk.operators.ecl import rating_table

LGD_FLOOR, LGD_CAP = 0.05, 0.95


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, steps: int = 60) -> tuple[float, float]:
    """(intercept, slope) of a weighted logistic fit with a penalty on the slope, to the last bits of a double."""
    total, mean = w.sum(), (w * y).sum() / w.sum()
    if mean in (0.0, 1.0):
        return (math.inf if mean else -math.inf), 0.0
    a, b = math.log(mean / (1 - mean)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a + b * x)))
        v = w * p * (1 - p) / total
        gradient = np.array([(w * (p - y)).sum() / total, (w * (p - y) * x).sum() / total + ridge * b])
        hessian = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + ridge]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-15 * max(1.0, abs(a), abs(b)):
            break
    return float(a), float(b)


def fit_default_scorecard(labels: DataFrame) -> DataFrame:
    """Rating table (key, rank, PD) fitted on (RATING, defaulted) rows.

    The only feature is the rating rank, so the rows are first reduced to counts per
    (rank, label): at most twenty weighted rows give the same optimum as the whole table,
    and Newton's method on them reaches it exactly.
    """
    spark = labels.sparkSession
    ranks = rating_table(spark)
    counts = (labels.join(F.broadcast(ranks), F.col("RATING") == F.col("rating_key")).where(F.col("defaulted").isNotNull())
              .groupBy("rating_rank", "defaulted").agg(F.count("*").alias("n")).orderBy("rating_rank", "defaulted").collect())
    if not counts:
        raise ValueError("no labelled loans with a known rating")
    x, y, w = (np.array([float(r[k]) for r in counts]) for k in range(3))
    intercept, slope = newton_logistic(x, y, w, 1.0 / w.sum())
    score = F.lit(1.0) / (1.0 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col("rating_rank"))))
    return ranks.select("rating_key", "rating_rank", score.alias("rating_pd"))


def fit_severity(labels: DataFrame) -> DataFrame:
    """Facility table (key, LGD) fitted on (FACILITY_TYPE, severity) rows.

    Least squares on a full set of facility indicators is the mean of each facility.
    """
    known = labels.where(F.col("FACILITY_TYPE").isin(*P.LGD_BY_FACILITY))
    mean = F.sum(F.round("severity", 8).cast("decimal(28,8)")).cast("double") / F.nullif(F.count("severity"), F.lit(0))
    one = known.groupBy(F.col("FACILITY_TYPE").alias("facility_key")).agg(mean.alias("m"))
    return one.select("facility_key", F.greatest(F.lit(LGD_FLOOR), F.least(F.lit(LGD_CAP), F.col("m"))).alias("facility_lgd"))
