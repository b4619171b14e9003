"""Decisions of a frozen model for a whole table of contexts, as columns: no Python worker.

Each distinct pair of a context and its offers is encoded once. Its features meet the state's slots in
a join, which is broadcast only where the state has been counted to be small; what an offer's
features predict is added in slot order, as one decision at a time would, so estimates are equal to the kernel's
bit for bit, and so are ties. Probabilities, the draw and the choice are array expressions for any number of offers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import kernel as K
from ..plans.shared import written
from .encode import encoded

#: Slots of a state that may be broadcast.
BROADCAST = 100_000
_TOKENS = "array<struct<tok:string,w:double>>"


def tokens(namespace: str, features: Column) -> Column:
    """(tok, w) of a map of names to variants, by name: strings are categories, numbers and booleans weights, nulls absent."""
    def one(e: Column) -> Column:
        kind, name = F.schema_of_variant(e["value"]), F.concat(F.lit(f"{namespace}|"), e["key"])
        number = F.variant_get(e["value"], "$", "double")
        category = F.struct(F.concat(name, F.lit("="), F.variant_get(e["value"], "$", "string")).alias("tok"), F.lit(1.0).alias("w"))
        wrong = F.raise_error(F.concat(F.lit("feature '"), e["key"], F.lit("' has unsupported type "), kind)).cast("double")
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        return F.when(kind == "STRING", category).when(kind != "VOID", F.struct(name.alias("tok"), F.when(numeric, number).otherwise(wrong).alias("w")))

    ordered = F.array_sort(F.transform(F.map_keys(features), lambda k: k))
    return F.array_compact(F.transform(ordered, lambda k: one(F.struct(k.alias("key"), F.element_at(features, k).alias("value")))))


def context_of(json: Column) -> Column:
    """Bias and tokens of a context, a JSON object."""
    bias = F.array(F.struct(F.lit("").alias("tok"), F.lit(1.0).alias("w")))
    return F.concat(bias, tokens("c", F.parse_json(json).cast("map<string,variant>"))).cast(_TOKENS)


def candidates_of(json: Column) -> Column:
    """Offers, a JSON list of [arm, action], as array<struct<cand, arm, tokens>>."""
    bias = F.array(F.struct(F.lit("").alias("tok"), F.lit(1.0).alias("w")))

    def one(offer: Column, i: Column) -> Column:
        arm = F.variant_get(offer[0], "$", "string")
        itself = F.array(F.struct(F.concat(F.lit("i|"), arm).alias("tok"), F.lit(1.0).alias("w")))
        return F.struct(i.alias("cand"), arm.alias("arm"), F.concat(bias, tokens("a", offer[1].cast("map<string,variant>")), itself).cast(_TOKENS).alias("tokens"))

    return F.transform(F.parse_json(json).cast("array<array<variant>>"), one)


def probabilities(estimates: Column, epsilon: float) -> Column:
    """Epsilon-greedy over an array of estimates: ties of the maximum share the greedy part."""
    best = F.array_max(estimates)
    ties = F.size(F.filter(estimates, lambda e: e == best))
    uniform = F.lit(float(epsilon)) / F.size(estimates)
    return F.transform(estimates, lambda e: F.when(e == best, uniform + F.lit(1.0 - epsilon) / ties).otherwise(uniform))


def sample_index(weights: Column, u: Column) -> Column:
    """The first place whose running sum exceeds u; the last one if none does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(False).alias("found"))

    def step(a: Column, p: Column) -> Column:
        total = a["sum"] + p
        return F.struct(total.alias("sum"), F.when(a["found"] | (u < total), a["at"]).otherwise(a["at"] + 1).alias("at"), (a["found"] | (u < total)).alias("found"))

    return F.least(F.aggregate(weights, start, step)["at"], F.size(weights) - 1)


def argmax(values: Column) -> Column:
    """The place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def scored(pairs: DataFrame, slots: DataFrame, bits: int, ridge: float = 1.0) -> DataFrame:
    """(pair, arms, estimates) of pairs (pair, context, offers); ``slots`` has slot and the true sums xx, xy.

    Where both have a column ``model``, each pair is scored by its own.
    """
    of = [c for c in ("model",) if c in pairs.columns]
    made = written(pairs.select("pair", *of, context_of(F.col("context")).alias("ctx"), candidates_of(F.col("offers")).alias("cands")), "candidates")
    features = encoded(made, ["pair", *of], F.col("ctx"), F.col("cands"), bits)
    small = slots.count() <= BROADCAST
    state = slots.select(*of, "slot", "xx", "xy")
    joined = features.join(F.broadcast(state) if small else state, [*of, "slot"], "left")
    sums = F.coalesce("xy", F.lit(0.0)) * (F.lit(1.0) / (F.coalesce("xx", F.lit(0.0)) + F.lit(ridge)))
    per = joined.select("pair", "cand", F.struct("slot", (F.col("v") * sums).alias("term")).alias("x")).groupBy("pair", "cand").agg(F.array_sort(F.collect_list("x")).alias("x"))
    told = per.select("pair", "cand", F.aggregate("x", F.lit(0.0), lambda a, x: a + x["term"]).alias("e"))
    by_pair = told.groupBy("pair").agg(F.map_from_entries(F.collect_list(F.struct("cand", "e"))).alias("of"))
    # an offer whose features cancel out has no row, and predicts 0
    none = F.create_map().cast("map<int,double>")
    return made.join(by_pair, "pair", "left").select("pair", F.transform("cands", lambda c: c["arm"]).alias("arms"), F.transform("cands", lambda c: F.coalesce(F.element_at(F.coalesce("of", none), c["cand"]), F.lit(0.0))).alias("estimates"))


def decide(rows: DataFrame, slots: DataFrame, *, bits: int, epsilon: float = K.DEFAULTS["epsilon"], ridge: float = 1.0, decision_id: str = "decision_id", salt: str | Column = "", counter: int = 0, by_model: bool = False) -> DataFrame:
    """``rows`` (context and offers as JSON, a decision id, anything else) with arm, chosen, propensity and estimates. The model stays as it is.

    With ``by_model`` rows and slots have a column ``model`` that says which of many models decides. ``counter`` numbers the draw of the decision's key.
    """
    K.check_bits(bits)
    K.Bandit(K.Model(1 << bits), 1.0, epsilon=epsilon)  # refuses what is out of range
    of = ["context", "offers", *(["model"] if by_model else [])]
    pairs = written(rows.select(*of).distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    found = written(scored(pairs, slots, bits, ridge).withColumn("weights", probabilities(F.col("estimates"), epsilon)), "scored")
    same = F.lit(True)
    for c in of:
        same = same & rows[c].eqNullSafe(pairs[c])
    asked = rows.join(pairs, same).select(*(rows[c] for c in rows.columns), "pair").join(found, "pair")
    with H.wrapping(rows.sparkSession):
        drawn = asked.withColumn("_u", H.random_unit(H.derive_key(F.col(decision_id), F.lit(salt) if isinstance(salt, str) else salt), counter))
    no = F.raise_error(F.lit("need at least one candidate")).cast("int")
    chosen = drawn.withColumn("chosen", F.when(F.size("arms") > 0, sample_index(F.col("weights"), F.col("_u"))).otherwise(no))
    at = lambda c: F.get(F.col(c), F.col("chosen"))
    return chosen.select(*rows.columns, "chosen", at("arms").alias("arm"), at("weights").alias("propensity"), "estimates")
