"""Exactly-once pairing of resolutions with decisions, by position in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(log: DataFrame, order: list[str], carry: list[str], key: list[str] | None = None) -> DataFrame:
    """``log`` with effective, open, what follows (next_event, next_pos, next_reward, as far as the log has them) and, under ``d_``, the ``carry`` columns of the decision that a resolution closes.

    A resolution is effective if the event before it with the same id is a
    decision; a decision is open if no event follows it. No self-join: all
    come from one pass over each id's events. With ``key`` ids belong to their key.
    """
    by = Window.partitionBy(*(key or []), "decision_id").orderBy(*order)
    before, after = F.lag("event").over(by), F.lead("event").over(by)
    taken = (F.col("event") == "resolution") & (F.coalesce(before, F.lit("")) == "decision")
    last = (F.col("event") == "decision") & after.isNull()
    following = [F.lead(c).over(by).alias(f"next_{c}") for c in ("event", "pos", "reward") if c in log.columns]
    return log.select("*", taken.alias("effective"), last.alias("open"), *following, *(F.lag(c).over(by).alias(f"d_{c}") for c in carry))
