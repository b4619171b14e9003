"""The keyed learner over a stream, with timers and state that is touched event by event.

A key's state is spread over state variables: the model's slots, the open decisions, and a queue of what falls due, each
a map of which an event reads and writes its own entries only; a few numbers (``about``) go with them. A decision sets an
event-time timer at its horizon, so what is overdue expires when the watermark passes, without a sweep row in
the stream. Before each event what is due by its time expires too, so a key's model learns in the order in which
one process would learn, wherever micro-batches are cut.

Times of a key don't decrease from batch to batch (a log in which they do is one that ``verify`` reports);
within a batch a key's rows are put in order. Late rewards still resolve their decision, as expired, and a second
delivery changes nothing.

``state_of`` reads the state of a stream from its checkpoint, as blobs like those of ``replay``; ``learn_timed(initial=...)`` begins a
stream with them, so a running learner can be forked, whole or by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernel as K

#: What a stream carries: key, kind (decide or reward; others only move time on), time in seconds, context, and for rewards id and reward.
INPUT = "key string, kind string, t double, context string, decision_id string, reward double"
OUTPUT = "key string, event string, decision_id string, chosen int, propensity double, kind string, reward double, t double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ABOUT, SLOT, OPEN, DUE = "scale double, next_seq string, version bigint, head bigint, tail bigint", "xx double, xy double", "record string", "t double, decision_id string"


class _Sums(dict):
    """Sums of the slots that have been asked for; others are loaded when they are."""

    def __init__(self, load):
        super().__init__()
        self.load = load

    def get(self, j, default=0.0):
        if j not in self:
            self.load(j)
        return super().get(j, default)


def _packed(d: K.Decision) -> str:
    return json.dumps([d.t, d.candidate_hash, d.chosen, d.features, d.propensity, d.model_version, d.salt])


def _unpacked(name: str, record: str) -> K.Decision:
    t, h, chosen, features, propensity, version, salt = json.loads(record)
    return K.Decision(name, t, h, chosen, tuple((j, v) for j, v in features), propensity, version, salt)


class Learner(StatefulProcessor):
    """One bandit per key over state variables."""

    def __init__(self, offers, bits: int, horizon: float, epsilon: float, forgetfulness: float, default_reward: float):
        self.offers, self.args = list(offers), (bits, horizon, default_reward, epsilon, forgetfulness)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", ABOUT)
        self.slots = handle.getMapState("slots", "slot int", SLOT)
        self.open = handle.getMapState("open", "decision_id string", OPEN)
        self.due = handle.getMapState("due", "place bigint", DUE)

    def _begin(self) -> None:
        """The bandit with nothing loaded yet."""
        self.b = K.create(*self.args)
        self.head = self.tail = 0
        if self.about.exists():
            self.b.model.scale, seq, self.b.model_version, self.head, self.tail = self.about.get()
            self.b.next_seq = int(seq)
        self.loaded: dict[int, tuple[float, float]] = {}
        self.b.model.xx, self.b.model.xy = _Sums(self._load), _Sums(self._load)

    def _load(self, j: int) -> None:
        found = self.slots.getValue((j,)) if self.slots.containsKey((j,)) else (0.0, 0.0)
        self.loaded[j] = found[0], found[1]
        self.b.model.xx[j], self.b.model.xy[j] = self.loaded[j]

    def _end(self) -> None:
        for j, before in self.loaded.items():
            now = self.b.model.xx[j], self.b.model.xy[j]
            if now != before:
                self.slots.updateValue((j,), now)
        self.about.update((self.b.model.scale, str(self.b.next_seq), self.b.model_version, self.head, self.tail))

    def _room(self) -> None:
        """An update that renormalises takes all slots."""
        if self.b.model.scale * self.b.model.forgetting <= K.RENORM_AT:
            for (j,) in list(self.slots.keys()):
                self.b.model.xx.get(j)

    def _learn(self, name: str, reward: float, t: float) -> K.Resolution | None:
        if not self.open.containsKey((name,)):
            return None
        self.b.ledger[name] = _unpacked(name, self.open.getValue((name,))[0])
        self._room()
        told = self.b.learn(name, reward, t)
        self.open.removeKey((name,))
        return told

    def _expired(self, t: float) -> Iterator[K.Resolution]:
        """What is due by t and still open, in the order in which it was decided."""
        while self.head < self.tail:
            due, name = self.due.getValue((self.head,))
            if due > t:
                return
            self.due.removeKey((self.head,))
            self.head += 1
            if (told := self._learn(name, self.args[2], due)) is not None:
                yield told

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        self._begin()
        out: list[tuple] = []
        told = lambda x, t: out.append((key[0], "resolution", x.decision_id, None, None, x.kind, x.reward, t))
        for e in pd.concat(list(rows)).sort_values(["t", "kind", "decision_id"]).itertuples():
            for x in self._expired(e.t):
                told(x, e.t)
            if e.kind == "decide":
                d = self.b.decide(json.loads(e.context), self.offers, e.t, key[0])
                self.open.updateValue((d.decision_id,), (_packed(self.b.ledger.pop(d.decision_id)),))
                self._falls_due(d.decision_id, e.t)
                out.append((key[0], "decision", d.decision_id, d.chosen, d.propensity, None, None, e.t))
            elif e.kind == "reward" and (x := self._learn(e.decision_id, e.reward, e.t)) is not None:
                told(x, e.t)
        self._end()
        yield self._frame(out)

    def _falls_due(self, name: str, t: float) -> None:
        due = t + self.args[1]
        self.due.updateValue((self.tail,), (due, name))
        self.tail += 1
        self.handle.registerTimer(int(-(-due * 1000 // 1)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self._begin()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        out = [(key[0], "resolution", x.decision_id, None, None, x.kind, x.reward, at) for x in self._expired(at)]
        self._end()
        if out:
            yield self._frame(out)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        b = K.deserialize(initialState["state"].iloc[0])
        for j in b.model.xx.keys() | b.model.xy.keys():
            self.slots.updateValue((j,), (b.model.xx.get(j, 0.0), b.model.xy.get(j, 0.0)))
        self._begin()
        self.b.model.scale, self.b.next_seq, self.b.model_version = b.model.scale, b.next_seq, b.model_version
        for d in b.ledger.values():
            self.open.updateValue((d.decision_id,), (_packed(d),))
            self._falls_due(d.decision_id, d.t)
        self._end()

    @staticmethod
    def _frame(rows: list[tuple]):
        import pandas as pd

        return pd.DataFrame(rows, columns=[f.split()[0] for f in OUTPUT.split(", ")]).astype({"chosen": "Int32"})

    def close(self) -> None:
        pass


def learn_timed(rows: DataFrame, offers, *, bits: int, horizon: float, delay: str = "0 seconds", epsilon: float = K.DEFAULTS["epsilon"], forgetfulness: float = K.DEFAULTS["forgetting"], default_reward: float = 0.0, initial: DataFrame | None = None) -> DataFrame:
    """Decisions and resolutions of a stream of ``INPUT`` rows; ``delay`` is how far its times may lag behind. ``initial`` (key, state) are states to begin with."""
    K.create(bits, horizon, default_reward, epsilon, forgetfulness)  # refuses what is out of range
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint"))).withWatermark("ts", delay)
    learner = Learner(offers, bits, horizon, epsilon, forgetfulness, default_reward)
    state = initial.select("key", "state").groupBy("key") if initial is not None else None
    return timed.groupBy("key").transformWithStateInPandas(learner, OUTPUT, "append", "EventTime", initialState=state)


def state_of(spark: SparkSession, checkpoint: str, *, bits: int, horizon: float, epsilon: float = K.DEFAULTS["epsilon"], forgetfulness: float = K.DEFAULTS["forgetting"], default_reward: float = 0.0) -> DataFrame:
    """(key, state): each key's state after the last finished batch of a stream, read from its checkpoint."""
    def read(name: str) -> DataFrame:
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()

    slots = read("slots").groupBy(F.col("key.key").alias("key")).agg(F.collect_list(F.struct(F.col("user_map_key.slot").alias("slot"), F.col("user_map_value.xx").alias("xx"), F.col("user_map_value.xy").alias("xy"))).alias("slots"))
    due = read("due").select(F.col("key.key").alias("key"), F.col("user_map_key.place").alias("place"), F.col("user_map_value.decision_id").alias("decision_id"))
    records = read("open").select(F.col("key.key").alias("key"), F.col("user_map_key.decision_id").alias("decision_id"), F.col("user_map_value.record").alias("record"))
    opened = records.join(due, ["key", "decision_id"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "decision_id", "record"))).alias("open"))
    about = read("about").select(F.col("key.key").alias("key"), "value.*")

    def blobs(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                b = K.create(bits, horizon, default_reward, epsilon, forgetfulness)
                b.model.scale, b.next_seq, b.model_version = r.scale, int(r.next_seq), r.version
                for s in r.slots if r.slots is not None else ():
                    b.model.xx[s["slot"]], b.model.xy[s["slot"]] = s["xx"], s["xy"]
                for d in r.open if r.open is not None else ():
                    b.ledger[d["decision_id"]] = _unpacked(d["decision_id"], d["record"])
                rows.append((r.key, K.serialize(b)))
            yield pd.DataFrame(rows, columns=["key", "state"])

    return about.join(slots, "key", "left").join(opened, "key", "left").mapInPandas(blobs, "key string, state string")
