"""Decisions and reports of rewards as two streams, joined within the horizon.

A left outer interval join: a report that arrives before its decision's horizon is ``rewarded``, each one of them; a
decision without one is ``expired`` with the default reward, once the watermark says that none can come any more. State is
the decisions and reports of one horizon. The same call takes tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(seconds: str):
    return F.timestamp_micros((F.col(seconds) * 1_000_000).cast("bigint"))


def resolved(decisions: DataFrame, reports: DataFrame, *, horizon: float, delay: str = "0 seconds", default_reward: float = 0.0) -> DataFrame:
    """(decision_id, report, kind, reward) of ``decisions`` (decision_id, t) and ``reports`` (decision_id, report, t, reward); ``delay`` is how far their times may lag behind."""
    if not horizon > 0:
        raise ValueError("horizon must be positive")
    made = decisions.select("decision_id", F.col("t").alias("_t0"), _at("t").alias("_made")).withWatermark("_made", delay)
    told = reports.select(F.col("decision_id").alias("_id"), "report", F.col("t").alias("_t"), "reward", _at("t").alias("_told")).withWatermark("_told", delay)
    # whole seconds bound the state; the doubles decide
    near = (F.col("_told") >= F.col("_made")) & (F.col("_told") <= F.col("_made") + F.expr(f"interval {math.ceil(horizon)} seconds"))
    same = (F.col("decision_id") == F.col("_id")) & near & (F.col("_t") < F.col("_t0") + F.lit(float(horizon)))
    out = made.join(told, same, "left_outer")
    there = F.col("_id").isNotNull()
    return out.select("decision_id", "report", F.when(there, "rewarded").otherwise("expired").alias("kind"), F.when(there, F.col("reward")).otherwise(F.lit(float(default_reward))).alias("reward"))
