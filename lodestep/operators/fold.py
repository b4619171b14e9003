"""Models over chunks of an ordered log, streamed through Arrow batches.

A model can be rebuilt from any place of a log: what it knew before is a decayed sum for
each slot. So the log is cut into chunks of ``CHUNK`` places, which tasks take
independently. ``totals`` says what each chunk adds to each slot (and which slots its
decisions ask for), ``carried`` turns these into the sums with which a chunk begins, and
``weights`` and ``states`` go through the chunks with them. Tasks see rows in the order of
(key, chunk, pos) and hold one model of one chunk, so memory doesn't grow with a key.

Within a chunk all sums are taken in log order, bit for bit as one process would. A log
of one chunk so gives the very bits of a plain fold; carried sums are equal to it up to rounding,
and exactly equal where the log's numbers make sums exact in any order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from ..functions import kernel as K

CHUNK = 8_192
#: Encodings that a task remembers; then it starts anew. Only saves time.
MEMO = 50_000
#: What the folds take, besides the key: events, sums carried into a chunk, and (first of a chunk) what a state is made from.
ROW = {
    "chunk": "bigint", "pos": "bigint", "event": "string", "context": "string", "offers": "string", "chosen": "int", "propensity": "double", "target": "bigint",
    "reward": "double", "model": "int", "slot": "int", "xx": "double", "xy": "double",
}
CARRY, HEAD = -1, -2


class Encodings:
    """Encoded candidates by the JSON of a context and of a list of [arm, action]."""

    def __init__(self, bits: int):
        self.bits, self.known = bits, {}

    def __call__(self, context: str, offers: str) -> list:
        if (found := self.known.get((context, offers))) is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            features = json.loads(context)
            found = self.known[context, offers] = [K.encode(features, arm, action, self.bits) for arm, action in json.loads(offers)]
        return found


class Models:
    """One model for each (bits, forgetting) with the encodings they share."""

    def __init__(self, grid: list[tuple[int, float]], coders: dict[int, Encodings] | None = None):
        self.grid, self.coders = grid, coders or {bits: Encodings(bits) for bits, _ in grid}
        self.models = [K.Model(1 << bits, forgetting) for bits, forgetting in grid]
        self.updates, self.asked, self.told = 0, set(), []

    def fresh(self) -> Models:
        return Models(self.grid, self.coders)

    def update(self, context: str, offers: str, reward: float) -> None:
        self.updates += 1
        for (bits, _), model in zip(self.grid, self.models):
            model.update(self.coders[bits](context, offers)[0], reward)

    def load(self, number: int, slot: int, xx: float, xy: float) -> None:
        self.models[number].xx[slot], self.models[number].xy[slot] = xx, xy


def with_defaults(df: DataFrame) -> DataFrame:
    """``df`` with all columns of ROW, null where it has none."""
    return df.select("key", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in ROW.items()))


def by_chunk(rows: DataFrame, grid: list[tuple[int, float]], out: str, absorb: Callable, finish: Callable) -> DataFrame:
    """``absorb(models, key, row)`` for each row in order and ``finish(models, key, chunk)`` for each chunk give the rows of ``out``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T._parse_datatype_string(out).fields])

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, start = to_arrow_schema(schema), Models(grid)
        own, models = None, None
        sent = lambda found: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), target)], schema=target)
        for batch in it:
            found: list = []
            for key, chunk, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if own != (key, chunk):
                    if own:
                        found += finish(models, *own)
                    own, models = (key, chunk), start.fresh()
                found += absorb(models, key, row)
            if found:
                yield sent(found)
        if own and (found := list(finish(models, *own))):
            yield sent(found)

    ordered = with_defaults(rows).repartition(2 * n, "key", "chunk").sortWithinPartitions("key", "chunk", "pos", F.col("event") != "id")
    return ordered.mapInArrow(batches, schema)


def totals(events: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """(key, chunk, model, slot, xx, xy): what each chunk adds by its end, zeros for slots that are only asked for."""

    def absorb(models: Models, key, row):
        pos, event, context, offers, chosen, propensity, target, reward, *_ = row
        if event == "update":
            models.update(context, offers, reward)
        else:
            models.asked.add((context, offers))
        return ()

    def finish(models: Models, key, chunk):
        for number, ((bits, _), model) in enumerate(zip(models.grid, models.models)):
            slots = {j for ask in models.asked for pairs in models.coders[bits](*ask) for j, _ in pairs}
            for j in slots | model.xx.keys():
                yield key, chunk, number, j, model.scale * model.xx.get(j, 0.0), model.scale * model.xy.get(j, 0.0)

    return by_chunk(events, grid, "chunk bigint, model int, slot int, xx double, xy double", absorb, finish)


def chunk_counts(events: DataFrame) -> DataFrame:
    """(key, chunk, m, n, last): updates in a chunk, before it, and the struct (chunk, n) of the key's last chunk."""
    from pyspark.sql import Window

    per = events.groupBy("key", "chunk").agg(F.sum((F.col("event") == "update").cast("bigint")).alias("m"))
    upto = per.withColumn("n", F.sum("m").over(Window.partitionBy("key").orderBy("chunk")) - F.col("m"))
    return upto.withColumn("last", F.max(F.struct("chunk", "n")).over(Window.partitionBy("key")))


def carried(sums: DataFrame, counts: DataFrame, grid: list[tuple[int, float]]) -> DataFrame:
    """(key, chunk, model, slot, xx, xy): the sums with which a chunk begins, of the slots it has, and of all slots for a key's last chunk.

    Sums decay by their model's forgetting for each update in between. A slot's chunks
    are gone through in order, streaming; there are CHUNK times fewer of them than events.
    """
    n = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = counts.select(F.col("key").alias("_k"), F.col("chunk").alias("_c"), "m", "n", F.col("last.chunk").alias("end"), F.col("last.n").alias("end_n"))
    joined = sums.join(own, sums.key.eqNullSafe(own._k) & (sums.chunk == own._c)).select("key", "model", "slot", "chunk", "xx", "xy", "m", "n", "end", "end_n")
    schema = T.StructType([T.StructField("key", sums.schema["key"].dataType), *T._parse_datatype_string("chunk bigint, model int, slot int, xx double, xy double").fields])

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        own, x, y, at, end = None, 0.0, 0.0, 0, (0, 0)

        def closed():
            """The row of the key's last chunk for a slot that isn't in it."""
            if own and own[3] < end[0]:
                decay = grid[own[1]][1] ** (end[1] - at)
                yield own[0], end[0], own[1], own[2], x * decay, y * decay

        sent = lambda found: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), target)], schema=target)
        for batch in it:
            found: list = []
            for key, model, slot, chunk, xx, xy, m, before, last, last_n in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or own[:3] != (key, model, slot):
                    found += closed()
                    x, y, at = 0.0, 0.0, before
                decay = grid[model][1] ** (before - at)
                x, y = x * decay, y * decay
                if x or y:
                    found.append((key, chunk, model, slot, x, y))
                decay = grid[model][1] ** m
                x, y, at, own, end = x * decay + xx, y * decay + xy, before + m, (key, model, slot, chunk), (last, last_n)
            if found:
                yield sent(found)
        if found := list(closed()):
            yield sent(found)

    return joined.repartition(n, "key", "model", "slot").sortWithinPartitions("key", "model", "slot", "chunk").mapInArrow(batches, schema)


def carry_rows(events: DataFrame, counts: DataFrame, grid: list[tuple[int, float]]) -> DataFrame | None:
    """The rows that bring earlier sums into chunks; None where every key has one chunk only."""
    many = counts.groupBy("key").agg(F.count("*").alias("chunks")).where("chunks > 1").select(F.col("key").alias("_many"))
    if many.isEmpty():
        return None
    of_many = events.join(many, F.col("key").eqNullSafe(F.col("_many")), "left_semi")
    return carried(totals(of_many, grid), counts, grid).withColumns({"pos": F.lit(CARRY), "event": F.lit("carry")})


def weights(events: DataFrame, carry: DataFrame | None, grid: list[tuple[int, float]], configs: list[tuple[int, float]]) -> DataFrame:
    """(key, config, name, k, s, top) of each chunk: the limbs of its exact sums, and its largest weight.

    A weight is the probability of the logged choice over its propensity. Sums are ``n``, ``r`` of the rewards, ``s`` of the
    weights, ``sr`` of both multiplied, ``ss`` of the squared weights. ``configs`` are (number of the model, epsilon). Models are asked in log order.
    """

    def absorb(models: Models, key, row):
        pos, event, context, offers, chosen, propensity, target, reward, model, slot, xx, xy = row
        if event == "carry":
            models.load(model, slot, xx, xy)
        elif event == "update":
            models.update(context, offers, reward)
        else:
            estimates = [[m.predict(pairs) for pairs in models.coders[bits](context, offers)] for (bits, _), m in zip(models.grid, models.models)]
            models.told.append((reward, *(K.probabilities(estimates[number], epsilon)[chosen] / propensity for number, epsilon in configs)))
        return ()

    def finish(models: Models, key, chunk):
        import numpy as np

        if models.told:
            rewards, *found = np.array(models.told).T
            for config, w in enumerate(found):
                top = float(w.max())
                yield key, config, "n", 0, len(w), top
                for name, values in (("r", rewards), ("s", w), ("sr", w * rewards), ("ss", w * w)):
                    for k, s in exact.limbs_of(values).items():
                        yield key, config, name, k, s, top

    rows = events if carry is None else with_defaults(events).unionByName(with_defaults(carry))
    return by_chunk(rows, grid, "config int, name string, k int, s bigint, top double", absorb, finish)


def each_weight(events: DataFrame, carry: DataFrame | None, model: tuple[int, float], epsilon: float) -> DataFrame:
    """(key, pos, w, reward) of each decision event of one configuration."""

    def absorb(models: Models, key, row):
        pos, event, context, offers, chosen, propensity, target, reward, number, slot, xx, xy = row
        if event == "carry":
            models.load(number, slot, xx, xy)
        elif event == "update":
            models.update(context, offers, reward)
        else:
            estimates = [models.models[0].predict(pairs) for pairs in models.coders[models.grid[0][0]](context, offers)]
            yield key, pos, K.probabilities(estimates, epsilon)[chosen] / propensity, reward

    rows = events if carry is None else with_defaults(events).unionByName(with_defaults(carry))
    return by_chunk(rows, [model], "pos bigint, w double, reward double", absorb, lambda *_: ())


def resampled(events: DataFrame, carry: DataFrame | None, model: tuple[int, float], epsilon: float, replicates: int, salt: str) -> DataFrame:
    """(key, replicate, name, k, s) of each chunk: the limbs of the sums n, s and sr of ``weights`` with each decision taken a Poisson number of times.

    The number is drawn by the decision's id, which comes in a row of its own before the decision: counter b of its key is replicate b's draw. So a decision
    has the same numbers wherever it is, and all replicates share the pass.
    """

    def absorb(models: Models, key, row):
        pos, event, context, offers, chosen, propensity, target, reward, number, slot, xx, xy = row
        if event == "carry":
            models.load(number, slot, xx, xy)
        elif event == "update":
            models.update(context, offers, reward)
        elif event == "id":
            models.name = context
        else:
            bits = models.grid[0][0]
            estimates = [models.models[0].predict(pairs) for pairs in models.coders[bits](context, offers)]
            models.told.append((K.derive_key(models.name, salt), reward, K.probabilities(estimates, epsilon)[chosen] / propensity))
        return ()

    def finish(models: Models, key, chunk):
        import numpy as np

        if models.told:
            keys = np.array([x[0] for x in models.told], dtype=np.uint64)
            rewards, w = np.array([x[1:] for x in models.told]).T
            for b in range(replicates):
                times = poisson(keys, b)
                yield key, b, "n", 0, int(times.sum())
                for name, values in (("s", w), ("sr", w * rewards)):
                    for k, s in exact.limbs_of(np.repeat(values, times)).items():
                        yield key, b, name, k, s

    rows = events if carry is None else with_defaults(events).unionByName(with_defaults(carry))
    return by_chunk(rows, [model], "replicate int, name string, k int, s bigint", absorb, finish)


#: How often a Poisson number with mean 1 is at most 0, 1, 2, ...: beyond the last one lies less than 2**-53.
POISSON = [math.fsum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(18)]


def poisson(keys, counter: int):
    """Poisson numbers with mean 1 of an array of keys: the draw ``counter`` of each."""
    import numpy as np

    x = keys + np.uint64(counter * K.GOLDEN & K.MASK)
    x = (x ^ x >> np.uint64(30)) * np.uint64(K.MIX_1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(K.MIX_2)
    unit = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) * 2.0**-53
    return np.searchsorted(POISSON, unit, side="right")


def states(events: DataFrame, carry: DataFrame | None, counts: DataFrame, heads: DataFrame, model: tuple[int, float], horizon: float, default_reward: float, epsilon: float) -> DataFrame:
    """(key, state, next_seq, model_version) of each row of ``heads`` (key, next_seq string, updates): the model after the log's last update."""
    end = counts.where("chunk = last.chunk").select(F.col("key").alias("_k"), F.col("chunk").alias("_c"))
    of_end = lambda df: df.join(end, df.key.eqNullSafe(end._k) & (df.chunk == end._c), "left_semi")
    first = heads.join(end, heads.key.eqNullSafe(end._k), "left").select("key", F.coalesce("_c", F.lit(0)).alias("chunk"), F.lit(HEAD).alias("pos"), F.lit("head").alias("event"), F.col("next_seq").alias("context"), F.col("updates").alias("target"))
    rows = with_defaults(first).unionByName(with_defaults(of_end(events)))
    if carry is not None:
        rows = rows.unionByName(with_defaults(of_end(carry)))

    def absorb(models: Models, key, row):
        pos, event, context, offers, chosen, propensity, target, reward, number, slot, xx, xy = row
        if event == "head":
            models.head = context, target
        elif event == "carry":
            models.load(number, slot, xx, xy)
        else:
            models.update(context, offers, reward)
        return ()

    def finish(models: Models, key, chunk):
        next_seq, updates = models.head
        made = K.Bandit(models.models[0], horizon, default_reward, epsilon, int(next_seq), updates)
        yield key, K.serialize(made), next_seq, updates

    return by_chunk(rows, [model], "state string, next_seq string, model_version bigint", absorb, finish)
