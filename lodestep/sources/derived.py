"""A decision log made from the ``events`` table: every event is a decision among three offers.

The logger is uniform and draws by the decision's own key, so the log is the same
everywhere. Rewards are quarters and features whole numbers, so that model sums are exact
in any order. Times are whole seconds after each other's event; rewards arrive late, past the
horizon, twice, or never, by fixed rules. A decision and its reports come from one row, so
the draw is made once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import kernel as K
from ..plans.ranking import in_order

SALT, HORIZON = "ev", 3600.0
#: Offers: arm and its action features.
OFFERS = (("north", {"cost": 2.0, "fresh": True}), ("east", {}), ("south", {"cost": 5.0}))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, decision_id, t, seg, hour, u, chosen, propensity."""
    ts = F.col("ts").cast("timestamp")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", F.concat(F.lit(SALT + ":"), F.col("event_id")).alias("decision_id"),
        (F.unix_micros(ts) / F.lit(1_000_000).cast("double")).alias("t"), F.col("event_type").alias("seg"), F.hour(ts).cast("double").alias("hour"),
    )
    with H.wrapping(spark):
        drawn = events.withColumn("u", H.random_unit(H.derive_key(F.col("decision_id"), F.lit(SALT)), 0))
    p = 1.0 / len(OFFERS)
    chosen = F.when(F.col("u") < p, 0).when(F.col("u") < p + p, 1).otherwise(2)
    return drawn.withColumn("chosen", chosen).withColumn("propensity", F.lit(p))


def _reports() -> Column:
    """(report, t, reward) of a decision: none for one in thirteen, two for one in seventeen."""
    delay = F.col("event_id") * 37 % 5000
    reward = (F.col("event_id") * 7 + F.col("chosen") * 3) % 4 / F.lit(4).cast("double")
    one = lambda n, t, r: F.struct(F.lit(n).alias("report"), t.alias("t"), r.alias("reward"))
    first, again = one(0, F.col("t") + delay, reward), one(1, F.col("t") + delay + 60.0, F.lit(1.0) - reward)
    return F.when(F.col("event_id") % 13 == 0, F.array().cast("array<struct<report:int,t:double,reward:double>>")).when(F.col("event_id") % 17 == 0, F.array(first, again)).otherwise(F.array(first))


def resolutions(made: DataFrame) -> DataFrame:
    """event_id, decision_id, report, t, t0, reward: reports of rewards."""
    return made.select("event_id", "decision_id", F.col("t").alias("t0"), F.explode(_reports()).alias("e")).select("event_id", "decision_id", "e.report", "e.t", "t0", "e.reward")


def _late(horizon: float) -> Column:
    return F.col("t0") + F.lit(horizon) <= F.col("t")


def classified(reports: DataFrame, horizon: float = HORIZON, default_reward: float = 0.0) -> DataFrame:
    """Reports with kind and the reward that counts: at or past the horizon a report expires the decision."""
    late = _late(horizon)
    return reports.withColumn("kind", F.when(late, "expired").otherwise("rewarded")).withColumn("reward", F.when(late, F.lit(default_reward)).otherwise(F.col("reward")))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of the log, with what orders them: t, kind_order (decisions first), event_id, report."""
    made = decisions(spark, sf_dir)
    itself = F.array(F.struct(F.lit(-1).alias("report"), F.col("t"), F.lit(None).cast("double").alias("reward")))
    rows = made.withColumn("e", F.explode(F.concat(itself, _reports()))).withColumns({"at": F.col("e.report") < 0, "t0": F.col("t")})
    of = lambda c: F.when(F.col("at"), c)
    alone = F.array(*(F.lit(json.dumps([offer])) for offer in OFFERS))
    rows = rows.select(
        "user_id", "event_id", F.col("e.report").alias("report"), "at", "t0", F.col("e.t").alias("t"), F.col("e.reward").alias("reward"), "decision_id", *(of(F.col(c)).alias(c) for c in ("seg", "hour", "chosen", "propensity")),
        of(F.to_json(F.struct("hour", "seg"))).alias("context"), of(F.lit(json.dumps(OFFERS))).alias("offers"), of(F.element_at(alone, F.col("chosen") + 1)).alias("taken"),
    )
    late = _late(HORIZON)
    return rows.select(
        "t", F.when(F.col("at"), 0).otherwise(1).alias("kind_order"), "event_id", "report", F.when(F.col("at"), "decision").otherwise("resolution").alias("event"), "decision_id", "user_id", "seg", "hour", "chosen", "propensity",
        F.when(~F.col("at"), F.when(late, "expired").otherwise("rewarded")).alias("kind"), F.when(~F.col("at"), F.when(late, 0.0).otherwise(F.col("reward"))).alias("reward"), "context", "offers", "taken",
    )


ORDER = ["t", "kind_order", "event_id", "report"]

#: One event in so many has each kind of damage; which kind is told by the remainder.
DAMAGED = 211
#: Decisions with these remainders are changed in one field; those with the last one are logged twice.
DECISION_DAMAGE = ("bits", "chosen", "propensity", "hash", "features", "context", "json", "shape", "t", "twice")
#: Resolutions with the remainders that follow. Second resolutions are in the log already.
RESOLUTION_DAMAGE = ("kind", "reward", "json", "object", "event", "shape")


def damaged_lines(log: DataFrame, bits: int) -> DataFrame:
    """(line, value): the log as JSON lines in its order, some lines damaged in place."""
    last = F.lit(len(DECISION_DAMAGE) - 1)
    twice = log.where((F.col("event") == "decision") & (F.col("event_id") % DAMAGED == last)).withColumn("copy", F.lit(1))
    ordered = in_order(log.withColumn("copy", F.lit(0)).unionByName(twice), [*ORDER, "copy"], "place")

    def batches(it: Iterator) -> Iterator:
        import pandas as pd

        encoded: dict = {}
        for pdf in it:
            rows = [(r.place + 1, _line(r, bits, encoded)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["line", "value"])

    return ordered.select("place", "event", "event_id", "decision_id", "t", "seg", "hour", "chosen", "propensity", "kind", "reward").mapInPandas(batches, "line bigint, value string")


def _line(r, bits: int, encoded: dict) -> str:
    """A row of the log as a line, damaged as its event's remainder says."""
    from .logfile import decision_line, resolution_line

    kinds = dict(enumerate(DECISION_DAMAGE)) if r.event == "decision" else dict(enumerate(RESOLUTION_DAMAGE, len(DECISION_DAMAGE)))
    damage = kinds.get(r.event_id % DAMAGED)
    if damage == "json":
        return "{"
    if r.event == "resolution":
        x = json.loads(resolution_line(K.Resolution(r.decision_id, r.kind, float(r.reward))))
        if damage == "object":
            return "[]"
        x |= {"kind": {"kind": "lost"}, "reward": {"reward": None}, "event": {"event": "other"}, "shape": {"kind": 1}}.get(damage, {})
        return json.dumps(x, separators=(",", ":"))
    key = r.seg, r.hour
    if key not in encoded:
        context = {name: v for name, v in (("seg", r.seg), ("hour", r.hour)) if v is not None and v == v}
        made = [K.encode(context, arm, action, bits) for arm, action in OFFERS]
        encoded[key] = context, made, K.candidate_hash(made, 1 << bits)
    context, made, own = encoded[key]
    chosen = int(r.chosen)
    whole = decision_line(K.Decision(r.decision_id, float(r.t), own, chosen, tuple(made[chosen]), float(r.propensity), 0, SALT), bits, context, OFFERS)
    if damage in (None, "twice"):
        return whole
    x = json.loads(whole)
    x |= {"bits": {"bits": K.MAX_BITS + 1}, "context": {"context": {"seg": []}}, "shape": {"candidates": None}}.get(damage, {})
    changed = {"chosen": len(OFFERS), "propensity": 0.0, "hash": own ^ 1, "features": made[chosen][1:], "t": float(r.t) - 86_400.0}
    if damage in changed:
        x["record"]["candidate_hash" if damage == "hash" else damage] = changed[damage]
    return json.dumps(x, separators=(",", ":"))
