"""The keyed learner over a stream: exactly-once resolutions under repeated and late delivery.

State is the serialised bandit, so it can be read, forked and restored like any
other. A reward row resolves its decision if that is still open; at or past the
horizon it resolves as expired, and a second delivery changes nothing. Late rows must
still produce a resolution, so no watermark drops them: a sweep row expires what is due.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions import kernel as K

#: What a stream carries: key, kind (decide, reward, sweep), t, context, and for rewards id and reward.
INPUT = "key string, kind string, t double, seg string, hour double, decision_id string, reward double"
OUTPUT = "key string, event string, decision_id string, chosen int, propensity double, kind string, reward double, t double"


def learn_stream(rows: DataFrame, offers, *, bits: int, horizon: float, epsilon: float = 0.05, forgetfulness: float = 0.999, default_reward: float = 0.0) -> DataFrame:
    """Decisions and resolutions of a stream of ``INPUT`` rows. Rows of a key within a batch are taken by time."""
    offers = list(offers)

    def step(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        bandit = K.deserialize(state.get[0]) if state.exists else K.create(bits, horizon, default_reward, epsilon, forgetfulness)
        out = []
        told = lambda x, t: out.append((key[0], "resolution", x.decision_id, None, None, x.kind, x.reward, t))
        for e in pd.concat(list(frames)).sort_values(["t", "kind", "decision_id"]).itertuples():
            if e.kind == "decide":
                d = bandit.decide({"seg": e.seg, "hour": e.hour}, offers, e.t, key[0])
                out.append((key[0], "decision", d.decision_id, d.chosen, d.propensity, None, None, e.t))
            elif e.kind == "sweep":
                for x in bandit.expire(e.t):
                    told(x, e.t)
            elif (x := bandit.learn(e.decision_id, e.reward, e.t)) is not None:
                told(x, e.t)
        state.update((K.serialize(bandit),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")]).astype({"chosen": "Int32"})

    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, "state string", "append", "NoTimeout")
