"""Hashed interaction features as a column plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import kernel as K
from ..plans.shared import written


def action_tokens(arm: str, action: dict) -> list[tuple[str, float]]:
    return [("", 1.0), *K.tokens("a", action), (f"i|{arm}", 1.0)]


def candidates_column(offers) -> Column:
    """The offers as array<struct<cand, arm, tokens: array<struct<tok, w>>>>."""
    pair = lambda t, w: F.struct(F.lit(t).alias("tok"), F.lit(w).alias("w"))
    return F.array(*(F.struct(F.lit(i).alias("cand"), F.lit(arm).alias("arm"), F.array(*(pair(t, w) for t, w in action_tokens(arm, action))).alias("tokens")) for i, (arm, action) in enumerate(offers)))


def context_tokens(strings: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """Bias and context tokens in name order; null features are absent."""
    made = [(n, F.struct(F.concat(F.lit(f"c|{n}="), c).alias("tok"), F.lit(1.0).alias("w")), c) for n, c in strings.items()]
    made += [(n, F.struct(F.lit(f"c|{n}").alias("tok"), c.cast("double").alias("w")), c) for n, c in numbers.items()]
    ordered = [F.when(c.isNotNull(), s) for _, s, c in sorted(made, key=lambda m: m[0])]
    return F.array_compact(F.array(F.struct(F.lit("").alias("tok"), F.lit(1.0).alias("w")), *ordered))


def encoded(rows: DataFrame, keys: list[str], context: Column, offers, bits: int) -> DataFrame:
    """(keys, cand, slot, v): the nonzero features of every candidate of every row of ``rows``.

    ``offers`` is a list of (arm, action), or a column as ``candidates_column`` gives it. Each distinct pair of tokens is hashed once. What falls into one slot is added
    in the order of the pairs, as one decision at a time would.
    """
    K.check_bits(bits)
    pairs = rows.select(*keys, context.alias("ctx"), F.explode(offers if isinstance(offers, Column) else candidates_column(offers)).alias("c")).select(*keys, F.col("c.cand").alias("cand"), "ctx", F.col("c.tokens").alias("act"))
    pairs = pairs.select(*keys, "cand", F.posexplode("ctx").alias("i", "l"), "act").select(*keys, "cand", "i", "l", F.posexplode("act").alias("j", "r"))
    pairs = pairs.select(*keys, "cand", (F.col("i") * 1000 + F.col("j")).alias("at"), F.col("l.tok").alias("lt"), F.col("r.tok").alias("rt"), (F.col("l.w") * F.col("r.w")).alias("w"))
    with H.wrapping(rows.sparkSession):
        lefts = pairs.select("lt").distinct().withColumn("begun", H.begun(F.col("lt")))
        hashes = pairs.select("lt", "rt").distinct().join(lefts, "lt").select("lt", "rt", H.pair_hash_from(F.col("begun"), F.col("rt")).alias("h"))
    value = F.when(F.col("h") < 0, -F.col("w")).otherwise(F.col("w"))
    placed = pairs.join(hashes, ["lt", "rt"]).select(*keys, "cand", F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("slot"), "at", value.alias("v"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "v"))), F.lit(0.0), lambda a, x: a + x["v"])
    return placed.groupBy(*keys, "cand", "slot").agg(total.alias("v")).where("v <> 0")


def features(made: DataFrame, offers, bits: int) -> DataFrame:
    """(seg, hour, cand, slot, v) of each distinct context of decisions and candidate. Written once."""
    contexts = made.select("seg", "hour").distinct()
    return written(encoded(contexts, ["seg", "hour"], context_tokens({"seg": F.col("seg")}, {"hour": F.col("hour")}), offers, bits), "features")
