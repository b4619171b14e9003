"""One learner per key: sequential within a key, parallel over keys.

A learner's own choices feed its model, so a key's events are taken in order by the
scalar kernel. Tasks see them sorted by key and time and go through them as they
come, batch by batch: what is held is one key's model and open decisions, however long the key.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernel as K

RUN = "decision_id string, chosen int, propensity double, kind string, reward double, t double"
MEMO = 50_000


def _typed(df: DataFrame, key: str, rest: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(rest).fields])


class Learner:
    """A bandit with the rewards that are on their way to it."""

    def __init__(self, salt: str, offers: list, known: dict, bandit: K.Bandit, score, explore, train):
        self.salt, self.offers, self.known, self.bandit = salt, offers, known, bandit
        self.score, self.explore, self.train = score, explore, train
        self.due: list = []
        self.open: dict[str, K.Decision] = {}
        self.horizons: deque[float] = deque()

    def _ended(self, told: K.Resolution | None) -> Iterator[tuple]:
        if told is not None:
            d = self.open.pop(told.decision_id)
            yield d.decision_id, d.chosen, d.propensity, told.kind, told.reward, d.t

    def _sweep(self, t: float) -> Iterator[tuple]:
        overdue = False
        while self.horizons and self.horizons[0] <= t:
            overdue = bool(self.horizons.popleft())
        if overdue:
            for told in self.bandit.expire(t, self.train):
                yield from self._ended(told)

    def until(self, t: float) -> Iterator[tuple]:
        """Rewards that arrive up to t, in order of arrival; before each, what is overdue expires."""
        while self.due and self.due[0][0] <= t:
            at, _, name, reward = heapq.heappop(self.due)
            yield from self._sweep(at)
            yield from self._ended(self.bandit.learn(name, reward, at, self.train))

    def decide(self, t: float, context: str, delay: float | None, rewards: list[float]) -> Iterator[tuple]:
        yield from self.until(t)
        yield from self._sweep(t)
        if (encoded := self.known.get(context)) is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            encoded = self.known[context] = [K.encode(json.loads(context), arm, action, self.bandit.bits) for arm, action in self.offers]
        score = self.score and (lambda: self.score(json.loads(context), self.offers))
        d = self.bandit.decide_encoded(encoded, t, self.salt, score, self.explore)
        self.open[d.decision_id] = d
        self.horizons.append(t + self.bandit.horizon)
        if delay is not None:
            heapq.heappush(self.due, (t + delay, self.bandit.next_seq, d.decision_id, rewards[d.chosen]))

    def close(self) -> Iterator[tuple]:
        """All rewards that still come; then what nobody has ended is open."""
        yield from self.until(float("inf"))
        for d in self.open.values():
            yield d.decision_id, d.chosen, d.propensity, None, None, d.t


def learn_keyed(events: DataFrame, key: str, offers, *, bits: int, horizon: float, epsilon: float = K.DEFAULTS["epsilon"], forgetfulness: float = K.DEFAULTS["forgetting"], default_reward: float = 0.0, score: Callable | None = None, explore: Callable | None = None, train: Callable | None = None) -> DataFrame:
    """Decide at every event of a key, learn from its delayed reward, expire what is overdue.

    ``events``: key, event_id, t, context (JSON), delay (null: no reward comes), reward per offer (array).
    One row for every decision, with how it ended: rewarded, expired, or open (null kind). The
    key is also the salt.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offers, schema = list(offers), _typed(events, key, RUN)
    K.create(bits, horizon, default_reward, epsilon, forgetfulness)  # refuses what is out of range

    def batches(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, known = to_arrow_schema(schema), {}
        own, learner = None, None
        sent = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), target)], schema=target)
        for batch in it:
            rows: list = []
            for key, t, context, delay, rewards in zip(*(c.to_pylist() for c in batch.columns)):
                if learner is None or own != key:
                    if learner is not None:
                        rows += [(own, *x) for x in learner.close()]
                    own = key
                    learner = Learner(str(key), offers, known, K.create(bits, horizon, default_reward, epsilon, forgetfulness), score, explore, train)
                rows += [(own, *x) for x in learner.decide(t, context, delay, rewards)]
            if rows:
                yield sent(rows)
        if learner is not None:
            yield sent([(own, *x) for x in learner.close()] or [])

    ordered = events.repartition(n, key).sortWithinPartitions(key, "t", "event_id")
    return ordered.select(key, "t", "context", "delay", "reward").mapInArrow(batches, schema)


def state_slots(states: DataFrame, key: str) -> DataFrame:
    """(key, slot, xx, xy): the true sums of serialised states as a table."""

    def rows(it):
        import pandas as pd

        for pdf in it:
            models = [(k, K.deserialize(s).model) for k, s in zip(pdf[key], pdf["state"])]
            found = [(k, j, m.scale * m.xx[j], m.scale * m.xy[j]) for k, m in models for j in m.xx]
            yield pd.DataFrame(found, columns=[key, "slot", "xx", "xy"])

    return states.select(key, "state").mapInPandas(rows, _typed(states, key, "slot int, xx double, xy double"))


class StateSlots:
    """Table function for SQL: ``state_slots(state)`` has slot, xx and xy, the true sums of a serialised state, row by row."""

    def eval(self, state: str):
        if state is not None:
            m = K.deserialize(state).model
            for j in sorted(m.xx):
                yield j, m.scale * m.xx[j], m.scale * m.xy[j]


def register(spark: SparkSession) -> None:
    """Make ``state_slots`` known to SQL."""
    spark.udtf.register("state_slots", F.udtf(StateSlots, returnType="slot int, xx double, xy double"))


def slates(states: DataFrame, key: str, context: dict, offers, k: int) -> DataFrame:
    """The top k offers of each key's state, in order, with conditional propensities. The states stay as they are."""
    offers = list(offers)

    def rows(it):
        import pandas as pd

        for pdf in it:
            found = [(own, place, offers[i][0], p) for own, s in zip(pdf[key], pdf["state"]) for place, (i, p) in enumerate(K.slate(K.deserialize(s), context, offers, 0.0, str(own), k))]
            yield pd.DataFrame(found, columns=[key, "place", "arm", "propensity"])

    return states.select(key, "state").mapInPandas(rows, _typed(states, key, "place int, arm string, propensity double"))


def previews(states: DataFrame, key: str, context: dict, offers) -> DataFrame:
    """(key, arm, estimate, probability) of a context by each key's state: what it would do, without doing it."""
    offers = list(offers)

    def rows(it):
        import pandas as pd

        for pdf in it:
            found = []
            for own, s in zip(pdf[key], pdf["state"]):
                b = K.deserialize(s)
                estimates = [b.model.predict(K.encode(context, arm, action, b.bits)) for arm, action in offers]
                found += [(own, arm, e, p) for (arm, _), e, p in zip(offers, estimates, K.probabilities(estimates, b.epsilon))]
            yield pd.DataFrame(found, columns=[key, "arm", "estimate", "probability"])

    return states.select(key, "state").mapInPandas(rows, _typed(states, key, "arm string, estimate double, probability double"))


def with_outcomes(made: DataFrame) -> DataFrame:
    """Events of the derived log with what each offer would have brought and after how long: what ``learn_keyed`` takes."""
    reward = F.array(*((F.col("event_id") * 7 + i * 3) % 4 / F.lit(4).cast("double") for i in range(3)))
    delay = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") * 37 % 5000).cast("double"))
    return made.select("user_id", "event_id", "t", F.to_json(F.struct("hour", "seg")).alias("context"), delay.alias("delay"), reward.alias("reward"))
