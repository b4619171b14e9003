"""The decision-log queries by name, and their DuckDB equivalents."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import hashing as H
from ..operators import compose, decide, effective, encode, evaluate, index, metrics, online, verify
from ..sources import derived, logfile
from ..streaming import intervals
from . import oracle
from .shared import written

FLAGSHIP = "evaluate_lattice"
BITS, EPSILON, FORGETTING = 6, 0.1, 0.999


def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("ev:"), F.col("event_id")).alias("name"))
    with H.wrapping(spark):
        return ids.select("event_id", H.hex64(H.fnv1a_64(F.col("name").cast("binary"))).alias("fnv"), H.hex64(H.mix64(F.col("event_id"))).alias("mixed"), H.hex64(H.derive_key(F.col("name"), F.lit("ev"))).alias("key"))


def rng_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("ev:"), F.col("event_id")).alias("name"))
    with H.wrapping(spark):
        keyed = ids.select("event_id", H.derive_key(F.col("name"), F.lit("ev")).alias("key"))
        return keyed.select("event_id", *(H.random_unit(F.col("key"), i).alias(f"u{i}") for i in range(3)))


def logged_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.decisions(spark, sf_dir).select("decision_id", "seg", "hour", "chosen", "propensity")


def encode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived.decisions(spark, sf_dir)
    feats = encode.features(made, derived.OFFERS, BITS)
    same = made.seg.eqNullSafe(feats.seg) & made.hour.eqNullSafe(feats.hour)
    return made.join(feats, same).select("event_id", "cand", "slot", "v")


def effective_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = effective.paired(derived.log(spark, sf_dir), derived.ORDER, ["chosen"])
    return pairs.where("effective").select("decision_id", "report", "kind", "reward", F.col("d_chosen").alias("chosen"))


def horizon_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = derived.classified(derived.resolutions(derived.decisions(spark, sf_dir)))
    return told.groupBy("kind", "report").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


def evaluate_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration that never forgets: all sums are exact."""
    return evaluate.evaluate(derived.log(spark, sf_dir), derived.ORDER, bits=[BITS], epsilons=[EPSILON], forgetting=[1.0], digits=6)


def evaluate_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with forgetting, over the whole log."""
    return evaluate.evaluate(derived.log(spark, sf_dir), derived.ORDER, bits=[BITS], epsilons=[EPSILON], forgetting=[FORGETTING], digits=6)


def sweep_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve configurations in one pass."""
    return evaluate.evaluate(derived.log(spark, sf_dir), derived.ORDER, bits=[4, 8], epsilons=[0.05, 0.2, 1.0], forgetting=[1.0, FORGETTING], digits=4)


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine would earn without the feature hour."""
    log = derived.log(spark, sf_dir).withColumn("context", F.when(F.col("context").isNotNull(), F.to_json(F.struct("seg"))))
    return evaluate.evaluate(log, derived.ORDER, bits=[BITS], epsilons=[EPSILON], forgetting=[1.0], digits=6)


def _slots(states: DataFrame) -> DataFrame:
    return online.state_slots(states.withColumn("one", F.lit(0)), "one").select("slot", "xx", "xy")


def replay_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(evaluate.replay(derived.log(spark, sf_dir), derived.ORDER, bits=BITS, horizon=derived.HORIZON, forgetting=1.0))


def replay_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt state with forgetting: next sequence number, absorbed resolutions and true sums by slot."""
    state = written(evaluate.replay(derived.log(spark, sf_dir), derived.ORDER, bits=BITS, horizon=derived.HORIZON, forgetting=FORGETTING), "state")
    slots = _slots(state).select("slot", F.round("xx", 6).alias("xx"), F.round("xy", 6).alias("xy"))
    return slots.join(state.select(F.col("next_seq").cast("bigint").alias("next_seq"), "model_version"))  # one row


def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logfile.log_counts(derived.log(spark, sf_dir))


def rolling_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of each user's last hundred effective resolutions, at each of them."""
    done = effective.paired(derived.log(spark, sf_dir), derived.ORDER, []).where("effective")
    mean = evaluate.running_mean(done, ["user_id"], derived.ORDER, "reward", 100)
    return done.select("event_id", "user_id", "report", F.round(mean, 9).alias("mean"))


def debiased_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of each arm and segment, weighted by inverse propensity, with the exposure."""
    pairs = effective.paired(derived.log(spark, sf_dir), derived.ORDER, ["chosen", "propensity", "seg"]).where("effective")
    weight = F.lit(1.0) / F.col("d_propensity")
    per = pairs.groupBy(F.col("d_seg").alias("seg"), F.col("d_chosen").alias("chosen"))
    return per.agg(F.count("*").alias("exposure"), F.round(F.sum(F.col("reward") * weight) / F.sum(weight), 9).alias("rate"))


def expiry_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of effective resolutions that are expiries, by day."""
    pairs = effective.paired(derived.log(spark, sf_dir), derived.ORDER, []).where("effective")
    day = F.floor(F.col("t") / 86400).cast("bigint").alias("day")
    return pairs.groupBy(day).agg(F.count("*").alias("n"), F.round(F.avg((F.col("kind") == "expired").cast("double")), 9).alias("expired"))


def verify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the whole derived log, decisions and resolutions as lines, a fixed share of them damaged in each way."""
    return verify.verify(derived.damaged_lines(derived.log(spark, sf_dir), BITS)).select("line", "at", "problem")


def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each line's findings occur: the report by rule."""
    rule = F.regexp_replace(F.regexp_replace("problem", "^line [0-9]+: ", ""), "ev:[0-9]+", "ID")
    return verify_log(spark, sf_dir).groupBy(rule.alias("problem")).agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def per_user_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate(derived.log(spark, sf_dir), derived.ORDER, bits=[BITS], epsilons=[EPSILON], forgetting=[FORGETTING], key="user_id", digits=9)


def per_user_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.replay(derived.log(spark, sf_dir), derived.ORDER, bits=BITS, horizon=derived.HORIZON, forgetting=FORGETTING, key="user_id")


def replay_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt states of all users as a table of slots."""
    return online.state_slots(per_user_replay(spark, sf_dir), "user_id").select("user_id", "slot", F.round("xx", 6).alias("xx"), F.round("xy", 6).alias("xy"))


def per_user_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rebuilt states of all users say of themselves: next sequence number and absorbed resolutions."""
    return per_user_replay(spark, sf_dir).select("user_id", F.col("next_seq").cast("bigint").alias("next_seq"), "model_version")


def slate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.slates(per_user_replay(spark, sf_dir), "user_id", {"seg": "click", "hour": 12.0}, derived.OFFERS, 2)


def preview_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's state would do now, without doing it."""
    return online.previews(per_user_replay(spark, sf_dir), "user_id", {"seg": "click", "hour": 12.0}, derived.OFFERS).withColumns({"estimate": F.round("estimate", 6), "probability": F.round("probability", 6)})


def online_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online.learn_keyed(online.with_outcomes(derived.decisions(spark, sf_dir)), "user_id", derived.OFFERS, bits=BITS, horizon=derived.HORIZON, epsilon=EPSILON)


def softmax(estimates: list[float], epsilon: float) -> list[float]:
    """Probabilities in proportion to exp(4 * estimate)."""
    weights = [math.exp(4 * (e - max(estimates))) for e in estimates]
    return [w / sum(weights) for w in weights]


def byo_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed learner with a caller's exploration."""
    return online.learn_keyed(online.with_outcomes(derived.decisions(spark, sf_dir)), "user_id", derived.OFFERS, bits=BITS, horizon=derived.HORIZON, explore=softmax)


def merged_logs_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of even and odd days pooled in time order, resolutions of one poisoned segment removed, and the model rebuilt."""
    log = derived.log(spark, sf_dir)
    day = F.floor(F.col("t") / 86400) % 2
    pooled = log.where(day == 0).unionByName(log.where(day == 1))
    poisoned = pooled.where("event = 'decision' and seg = 'error'").select("decision_id")
    told = pooled.where("event = 'resolution'").join(poisoned, "decision_id", "left_anti")
    clean = pooled.where("event = 'decision'").unionByName(told.select(*pooled.columns))
    return _slots(evaluate.replay(clean, derived.ORDER, bits=BITS, horizon=derived.HORIZON, forgetting=1.0))


def decide_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rebuilt model, frozen, would choose at every event, with its propensity and its estimate of the choice."""
    log = derived.log(spark, sf_dir)
    slots = written(_slots(evaluate.replay(log, derived.ORDER, bits=BITS, horizon=derived.HORIZON, forgetting=1.0)), "slots")
    asked = log.where("event = 'decision'").select("event_id", "decision_id", "context", "offers")
    out = decide.decide(asked, slots, bits=BITS, epsilon=EPSILON, salt=derived.SALT)
    return out.select("event_id", "chosen", "arm", "propensity", F.get("estimates", F.col("chosen")).alias("estimate"), decide.argmax(F.col("estimates")).alias("best"))


def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of numbers that doubles can't add exactly, rounded once: time, value and both weighted by what was likely, by segment and choice."""
    made = derived.decisions(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id")
    share = F.lit(1.0) / (F.col("chosen") + 2)
    return exact.exact_sums(made, ["seg", "chosen"], {"t": F.col("t"), "value": F.col("value"), "shared": F.col("value") * share, "squares": F.col("value") * F.col("value")})


def _regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of the logged policy: t numbers a user's decisions from 0; best reward, regret of the choice, and what a uniform choice would lose."""
    from pyspark.sql import Window

    made = derived.decisions(spark, sf_dir)
    offered = F.array(*((F.col("event_id") * 7 + i * 3) % 4 / F.lit(4).cast("double") for i in range(3)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1
    best = F.array_max("r")
    rounds = made.select("user_id", "event_id", "chosen", place.alias("t"), offered.alias("r"))
    return rounds.select("user_id", "t", best.alias("best"), (best - F.get("r", F.col("chosen"))).alias("regret"), (best - F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / 3).alias("normalizer"), F.pow(F.get("r", F.col("chosen")) - 0.375, F.lit(2)).alias("squared"))


def regret_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised regret of each user's log, of its last tenth, its root mean squared error, and how soon after its twentieth round it earned half of the best."""
    rounds = written(_regret(spark, sf_dir), "rounds")
    whole = metrics.normalized_regret(rounds, ["user_id"]).withColumnRenamed("normalized", "regret")
    late = metrics.normalized_regret(metrics.final_window(rounds, ["user_id"], 0.1), ["user_id"]).withColumnRenamed("normalized", "late_regret")
    error = rounds.groupBy("user_id").agg(F.round(metrics.rmse(F.col("squared")), 9).alias("rmse"))
    soon = metrics.recovery_time(rounds, ["user_id"], 20, 10, 0.5)
    return whole.join(late, "user_id").join(error, "user_id").join(soon, "user_id").select("user_id", F.round("regret", 9).alias("regret"), F.round("late_regret", 9).alias("late_regret"), "rmse", F.col("recovered").cast("bigint").alias("recovered"))


def regret_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles of the users' normalised regret, by the number of the user's group of ten."""
    per = metrics.normalized_regret(_regret(spark, sf_dir), ["user_id"]).withColumn("grp", F.col("user_id") % 10)
    out = metrics.median_iqr(per, ["grp"], "normalized")
    return out.select("grp", *(F.round(c, 9).alias(c) for c in ("median", "low", "high")))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with their reports inside the horizon, and those that expire without one: what the two streams give."""
    made = derived.decisions(spark, sf_dir)
    reports = derived.resolutions(made).select("decision_id", "report", "t", "reward")
    return intervals.resolved(made, reports, horizon=derived.HORIZON).withColumn("report", F.coalesce("report", F.lit(-1)))


def states_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model before each thousandth line of the log, from one index."""
    lines = evaluate.Timeline(derived.log(spark, sf_dir), derived.ORDER, chunk=1024)
    asked = lines.rows.where("(pos + 1) % 1000 = 0").select("pos")
    out = index.PrefixIndex(spark, BITS, 1.0, chunk=1024).update(lines).states_as_of(lines, asked)
    return out.select((F.col("pos") + 1).alias("line"), "slot", "xx", "xy")


def lateral_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' rebuilt states as a table, by SQL over the table function."""
    online.register(spark)
    states = per_user_replay(spark, sf_dir)
    return spark.sql("select user_id, slot, round(xx, 6) as xx, round(xy, 6) as xy from {states}, lateral state_slots(state)", states=states)


def rolling_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of the last 2,000 effective resolutions of the whole log, at each of them."""
    done = effective.paired(derived.log(spark, sf_dir), derived.ORDER, []).where("effective")
    return evaluate.rolling_mean(done, derived.ORDER, "reward", 2000).select("event_id", "report", F.round("mean", 9).alias("mean"))


def bootstrap_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Poisson replicates of the estimates."""
    out = evaluate.bootstrap(derived.log(spark, sf_dir), derived.ORDER, bits=BITS, epsilon=EPSILON, forgetting=1.0, replicates=3)
    return out.select("replicate", "n", F.round("ips", 9).alias("ips"), F.round("snips", 9).alias("snips"))


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 95 in 100 of 200 replicates of each estimate."""
    out = evaluate.bootstrap(derived.log(spark, sf_dir), derived.ORDER, bits=BITS, epsilon=EPSILON, forgetting=1.0, replicates=200)
    each = out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("estimate"), F.col(c).alias("x")) for c in ("ips", "snips")))).alias("e")).select("e.*")
    return each.groupBy("estimate").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("middle"), F.col("q")[2].alias("high"))


def composed_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The derived log as composed records: the event type as if a uniform router had chosen it, then the offer. Rows of ``leaves`` name their type."""
    log = derived.log(spark, sf_dir)
    types = sorted(r["seg"] for r in log.where("seg is not null").select("seg").distinct().collect())  # event types
    kind = log.where("event = 'decision'").select("decision_id", F.col("seg").alias("arm"))
    named = written(log.join(kind, "decision_id"), "composed")
    number = F.array_position(F.array(*map(F.lit, types)), F.col("arm")).cast("int") - 1
    at = F.col("event") == "decision"
    router = named.withColumns({
        "context": F.when(at, F.to_json(F.struct("hour"))), "offers": F.when(at, F.lit(json.dumps([[t, {}] for t in types]))), "taken": F.when(at, F.concat(F.lit('[["'), F.col("arm"), F.lit('", {}]]'))),
        "chosen": F.when(at, number), "propensity": F.when(at, F.lit(1.0 / len(types))),
    })
    return router, named


def composed_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a router over event types with a model for each type's offers would earn."""
    router, leaves = composed_logs(spark, sf_dir)
    out = compose.evaluate(router, leaves, derived.ORDER, arm="arm", bits=BITS, epsilons=(0.2, EPSILON), forgetting=1.0)
    return out.select("resolved", *(F.round(c, 6).alias(c) for c in ("logged_mean", "ips", "snips", "ess", "max_weight")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        hash_ids, rng_units, logged_choices, encode_events, effective_resolutions, horizon_classes, log_counts, verify_findings, verify_log, evaluate_lattice, evaluate_forget, sweep_lattice, ablation,
        replay_slots, replay_forget, merged_logs_replay, debiased_rates, expiry_rate, rolling_reward, per_user_evaluate, preview_states, per_user_replay, replay_states, slate_topk, online_learner, byo_explore, decide_batch, exact_sums, regret_by_user, regret_quartiles, interval_join, states_as_of, lateral_states, rolling_log, bootstrap_estimates, bootstrap_intervals, composed_evaluate, per_user_heads,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql(BITS, EPSILON, FORGETTING)
