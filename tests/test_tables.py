"""Batch decisions, the prefix-state index, rolling means over a whole log, bootstrap, states from SQL: against one process."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestep.functions import kernel as K
from lodestep.operators import compose, decide, evaluate, fold, index, online
from lodestep.plans import catalog
from lodestep.sources import derived


@pytest.fixture(scope="module")
def state():
    rng = random.Random(3)
    b = K.create(5, 100.0, epsilon=0.3, forgetfulness=0.9)
    for i in range(60):
        d = b.decide({"a": rng.choice("xyz"), "n": rng.random()}, [("p", {"c": rng.random()}), ("q", {}), ("r", {"f": True})], float(i), "s")
        b.learn(d.decision_id, rng.random(), i + 0.5)
    return b


ROWS = [
    ({"a": "x", "n": 0.1}, [["p", {"c": 0.7}], ["q", {}], ["r", {"f": True}]]),
    ({"n": "0.1", "a": None}, [["p", {"c": "0.7"}], ["q", {"f": False}]]),
    ({}, [["only", {}]]),
    ({"é|=": 3, "big": 1e300, "small": 1e-7, "yes": True}, [["p", {}], ["p", {}], ["ü", {"c": -2}]]),
    ({"a": "y"}, [[str(i), {"c": i / 7}] for i in range(9)]),
]


def by_kernel(b, epsilon):
    out = {}
    for i in range(40):
        context, offers = ROWS[i % len(ROWS)]
        encoded = [K.encode(context, arm, action, b.bits) for arm, action in offers]
        estimates = [b.model.predict(x) for x in encoded]
        weights = K.probabilities(estimates, epsilon)
        chosen = K.sample_index(weights, K.random_unit(K.derive_key(f"id:{i}", "sa"), 0))
        out[f"id:{i}"] = (chosen, offers[chosen][0], weights[chosen], estimates)
    return out


@pytest.mark.parametrize("epsilon, broadcast", [(0.3, 100_000), (1.0, 0), (0.0, 0)])
def test_batch_decisions_equal_the_kernel_bit_for_bit(spark, state, epsilon, broadcast, monkeypatch):
    monkeypatch.setattr(decide, "BROADCAST", broadcast)
    slots = spark.createDataFrame([(j, state.model.scale * state.model.xx[j], state.model.scale * state.model.xy[j]) for j in state.model.xx], "slot int, xx double, xy double")
    rows = spark.createDataFrame([(f"id:{i}", json.dumps(ROWS[i % len(ROWS)][0]), json.dumps(ROWS[i % len(ROWS)][1]), i) for i in range(40)], "decision_id string, context string, offers string, chosen_before int")
    out = decide.decide(rows, slots, bits=5, epsilon=epsilon, salt="sa")
    assert {r.decision_id: (r.chosen, r.arm, r.propensity, r.estimates) for r in out.collect()} == by_kernel(state, epsilon)
    assert out.columns[:4] == rows.columns and "Python" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("context, offers, message", [('{"a": []}', '[["p", {}]]', "unsupported type"), ("{}", "[]", "at least one candidate")])
def test_what_cannot_be_decided(spark, context, offers, message):
    slots = spark.createDataFrame([], "slot int, xx double, xy double")
    rows = spark.createDataFrame([("i", context, offers)], "decision_id string, context string, offers string")
    with pytest.raises(Exception, match=message):
        decide.decide(rows, slots, bits=5).collect()


def by_fold(lines, place, forgetting):
    m = K.Model(1 << 5, forgetting)
    for r in lines:
        if r.pos < place and r.effective:
            m.update(K.encode(json.loads(r.context), *json.loads(r.offers)[0], 5), r.reward)
    return {j: (m.scale * m.xx[j], m.scale * m.xy[j]) for j in m.xx}


@pytest.mark.parametrize("forgetting", [1.0, 0.99])
def test_states_as_of_lines_and_after_appending(spark, sf, forgetting):
    log = derived.log(spark, sf)
    whole = evaluate.Timeline(log, derived.ORDER, chunk=64)
    rows = sorted(whole.rows.collect(), key=lambda r: r.pos)
    cut = rows[int(len(rows) * 0.95)]
    early = evaluate.Timeline(log.join(whole.rows.where(F.col("pos") < cut.pos).select("event", "decision_id", F.col("kind").alias("_k")).distinct(), ["event", "decision_id"], "left_semi"), derived.ORDER, chunk=64)
    built = index.PrefixIndex(spark, 5, forgetting, chunk=64).update(early)
    first = built.folded
    built.update(whole)
    assert first > 0.9 * sum(r.effective for r in rows) > 10 * built.folded
    asked = [0, 1, 63, 64, 65, 700, len(rows) - 1, len(rows), len(rows) + 500]
    got = {p: {} for p in asked}
    for r in built.states_as_of(whole, spark.createDataFrame([(p,) for p in [*asked, 64]], "pos long")).collect():
        got[r.pos][r.slot] = (r.xx, r.xy)
    for p in asked:
        want = by_fold(rows, p, forgetting)
        assert {j: pytest.approx(v, rel=1e-9) for j, v in want.items()} == {j: v for j, v in got[p].items() if j in want or v != (0.0, 0.0)}


def test_rolling_mean_over_ranges(spark):
    rng = random.Random(1)
    values = [rng.randrange(8) / 4 for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "at int, x double").repartition(5)
    for size, chunk in ((7, 20), (20, 20), (100, 30), (1, 10)):
        out = evaluate.rolling_mean(df, ["at"], "x", size, chunk=chunk)
        assert {r.at: r.mean for r in out.collect()} == {i: sum(values[max(0, i - size + 1) : i + 1]) / min(size, i + 1) for i in range(500)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan


def test_bootstrap_does_not_depend_on_chunks(spark, sf):
    log = derived.log(spark, sf)
    runs = [sorted(map(tuple, evaluate.bootstrap(log, derived.ORDER, bits=5, epsilon=0.2, forgetting=1.0, replicates=40, chunk=c).collect())) for c in (64, 8192)]
    assert runs[0] == runs[1]
    (row,) = evaluate.evaluate(log, derived.ORDER, bits=[5], epsilons=[0.2], forgetting=[1.0]).collect()
    ips = sorted(x[2] for x in runs[0])
    assert ips[2] < row.ips < ips[-3] and abs(sum(ips) / 40 - row.ips) < 0.05
    import numpy as np

    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(K.GOLDEN)
    counts = np.bincount(fold.poisson(keys, 3), minlength=8)[:8] / 20_000
    assert all(abs(c - math.exp(-1) / math.factorial(i)) < 0.012 for i, c in enumerate(counts))


def test_states_from_sql(spark, state):
    online.register(spark)
    df = spark.createDataFrame([("k", K.serialize(state)), ("none", None)], "key string, state string")
    got = [tuple(r) for r in spark.sql("select key, s.* from {t}, lateral state_slots(state) s order by slot", t=df).collect()]
    assert got == [("k", j, state.model.scale * state.model.xx[j], state.model.scale * state.model.xy[j]) for j in sorted(state.model.xx)]


def test_composed_policies_equal_a_plain_fold(spark, sf):
    router_log, leaf_log = catalog.composed_logs(spark, sf)
    (row,) = compose.evaluate(router_log, leaf_log, derived.ORDER, arm="arm", bits=5, epsilons=(0.2, 0.1), forgetting=0.99).collect()
    types = sorted({r.arm for r in leaf_log.select("arm").distinct().collect()})
    router, leaves, pending, told = K.Model(1 << 5, 0.99), {t: K.Model(1 << 5, 0.99) for t in types}, {}, []
    for r in sorted(leaf_log.collect(), key=lambda r: (r.t, r.kind_order, r.event_id, r.report)):
        if r.event == "decision":
            arms = [K.encode({"hour": r.hour}, t, {}, 5) for t in types]
            offers = [K.encode(json.loads(r.context), arm, action, 5) for arm, action in json.loads(r.offers)]
            place, model = types.index(r.arm), leaves[r.arm]
            w2 = K.probabilities([model.predict(x) for x in offers], 0.1)[r.chosen] / r.propensity
            pending[r.decision_id] = (K.probabilities([router.predict(x) for x in arms], 0.2)[place] / (1.0 / len(types))) * w2, arms[place], model, offers[r.chosen]
        elif r.decision_id in pending:
            w, arm, model, offer = pending.pop(r.decision_id)
            told.append((w, r.reward))
            router.update(arm, r.reward)
            model.update(offer, r.reward)
    s, sr = math.fsum(w for w, _ in told), math.fsum(w * r for w, r in told)
    assert row.resolved == len(told) and row.max_weight == max(w for w, _ in told)
    assert (row.ips, row.snips) == pytest.approx((sr / len(told), sr / s), rel=1e-12)


def test_two_levels_decide(spark, state):
    slots = [(j, state.model.scale * state.model.xx[j], state.model.scale * state.model.xy[j]) for j in state.model.xx]
    router = spark.createDataFrame(slots, "slot int, xx double, xy double")
    leaves = spark.createDataFrame([("p", j, xx, -xy) for j, xx, xy in slots], "model string, slot int, xx double, xy double")
    rows = spark.createDataFrame([(f"i:{i}", json.dumps({"a": "xyz"[i % 3]}), '[["p", {}], ["q", {}]]', '[["m", {"c": 0.5}], ["n", {}]]') for i in range(30)], "decision_id string, context string, arms string, offers string")
    got = {r.decision_id: r for r in compose.decide(rows, router, leaves, bits=5, epsilons=(0.4, 0.2), salt="s").collect()}
    below = {"p": K.Model(32, 1.0, xx={j: x for j, x, _ in slots}, xy={j: -y for j, _, y in slots}), "q": K.Model(32, 1.0)}
    for i in range(30):
        context, key = {"a": "xyz"[i % 3]}, K.derive_key(f"i:{i}", "s")
        one = K.probabilities([state.model.predict(K.encode(context, arm, {}, 5)) for arm in "pq"], 0.4)
        arm = K.sample_index(one, K.random_unit(key, 0))
        two = K.probabilities([below["pq"[arm]].predict(K.encode(context, o, action, 5)) for o, action in (("m", {"c": 0.5}), ("n", {}))], 0.2)
        offer = K.sample_index(two, K.random_unit(key, 1))
        r = got[f"i:{i}"]
        assert (r.arm, r.offer, r.router_propensity, r.leaf_propensity, r.propensity) == ("pq"[arm], "mn"[offer], one[arm], two[offer], one[arm] * two[offer])


def test_written_tables_go_with_their_scope(spark, tmp_path):
    from pathlib import Path

    from lodestep.plans import shared

    folder = Path(shared.shared_dir(spark).removeprefix("file://")) / "lodestep"
    kept = shared.written(spark.range(3), "kept")
    before = set(folder.iterdir())
    with shared.scope():
        made = shared.written(spark.range(5), "made")
        made.write.parquet(str(tmp_path / "out"))
        assert len(set(folder.iterdir()) - before) == 1
    assert set(folder.iterdir()) == before and kept.count() == 3 and spark.read.parquet(str(tmp_path / "out")).count() == 5
