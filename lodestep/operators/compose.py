"""Two-level policies: a router chooses an arm, the arm's own model chooses an offer.

A composed record is a decision of each level under one id; the propensity of the pair is the product of theirs. Both levels learn
from the same reward: the router from its arms, each leaf from the records that were routed to it. Offline, each level's
weights come from its own fold, the leaves' from one fold that is keyed by arm, and are multiplied by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import kernel as K
from . import decide as D
from . import fold
from .evaluate import Timeline


def weights(log: DataFrame, order: list[str], *, bits: int, epsilon: float, forgetting: float, key: str | None = None, chunk: int = fold.CHUNK) -> DataFrame:
    """(decision_id, w, reward) of each resolved decision of a log, in which an id is decided once."""
    lines = Timeline(log, order, key, chunk)
    events = lines.events(True)
    carry = fold.carry_rows(events, fold.chunk_counts(events), [(bits, forgetting)])
    per = fold.each_weight(events, carry, (bits, forgetting), epsilon).select("pos", "w", "reward")
    return lines.rows.where("event = 'decision'").select("pos", "decision_id").join(per, "pos").select("decision_id", "w", "reward")


def evaluate(router: DataFrame, leaves: DataFrame, order: list[str], *, arm: str, bits: int, epsilons: tuple[float, float], forgetting: float = K.DEFAULTS["forgetting"], chunk: int = fold.CHUNK) -> DataFrame:
    """One row: resolved, logged_mean, ips, snips, ess and max_weight of the composed policy.

    ``router`` and ``leaves`` are the logs of the two levels with equal decision ids and rewards; each row of ``leaves`` names its ``arm``.
    """
    above = weights(router, order, bits=bits, epsilon=epsilons[0], forgetting=forgetting, chunk=chunk).select("decision_id", F.col("w").alias("w1"))
    below = weights(leaves, order, bits=bits, epsilon=epsilons[1], forgetting=forgetting, key=arm, chunk=chunk)
    both = below.join(above, "decision_id").select("reward", (F.col("w") * F.col("w1")).alias("w"))
    sums = exact.exact_sums(both.withColumn("all", F.lit(0)), ["all"], {"r": F.col("reward"), "s": F.col("w"), "sr": F.col("w") * F.col("reward"), "ss": F.col("w") * F.col("w"), "n": F.lit(1.0)})
    top = both.agg(F.max("w").alias("max_weight"))
    n = F.col("n")
    estimates = ((F.col("r") / n).alias("logged_mean"), (F.col("sr") / n).alias("ips"), F.when(F.col("s") > 0, F.col("sr") / F.col("s")).alias("snips"), F.when(F.col("ss") > 0, F.col("s") * F.col("s") / F.col("ss")).alias("ess"))
    return top.join(sums, F.lit(True), "left").select(F.coalesce(n, F.lit(0.0)).cast("bigint").alias("resolved"), *estimates, "max_weight")  # one row each


def decide(rows: DataFrame, router: DataFrame, leaves: DataFrame, *, bits: int, epsilons: tuple[float, float], salt: str) -> DataFrame:
    """``rows`` (decision_id, context, arms and offers as JSON lists) with arm, offer, propensity of the pair, and the two levels' own.

    ``router`` (slot, xx, xy) scores arms, ``leaves`` (model, slot, xx, xy) the offers by the model of the arm taken. The levels take draws 0 and 1 of the decision's key.
    """
    first = D.decide(rows.select("decision_id", "context", F.col("arms").alias("offers"), F.col("offers").alias("below")), router, bits=bits, epsilon=epsilons[0], salt=salt)
    routed = first.select("decision_id", "context", F.col("below").alias("offers"), F.col("arm").alias("model"), F.col("propensity").alias("router_propensity"))
    second = D.decide(routed, leaves, bits=bits, epsilon=epsilons[1], salt=salt, counter=1, by_model=True)
    return second.select("decision_id", F.col("model").alias("arm"), F.col("arm").alias("offer"), (F.col("router_propensity") * F.col("propensity")).alias("propensity"), "router_propensity", F.col("propensity").alias("leaf_propensity"))
