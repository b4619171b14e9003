"""Streams against one process: timers, state that is read and forked, interval join, train sink."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestep.functions import kernel as K
from lodestep.sources.derived import OFFERS
from lodestep.sources import derived
from lodestep.streaming import intervals, timers, training

ARGS = {"bits": 4, "horizon": 100.0}


def history(key, n, skip):
    """Events of a key: decisions, and for some a reward, twice or late. What one process makes of them comes along."""
    b, rows, told = K.create(4, 100.0), [], []
    plan = []
    for i in range(n):
        plan.append((1000.0 + 10.0 * i, 0, i))
        if i % skip:
            delay = 5.0 if i % 4 or i > n - 10 else 130.0
            plan += [(1000.0 + 10.0 * i + delay, 1, i), (1000.0 + 10.0 * i + delay + 1, 1, i)]
    made = {}
    for t, kind, i in sorted(plan):
        told += b.expire(t)
        if kind == 0:
            context = {"seg": key, "hour": float(i % 5)}
            made[i] = b.decide(context, OFFERS, t, key)
            rows.append((key, "decide", t, json.dumps(context), "", None))
        else:
            rows.append((key, "reward", t, None, made[i].decision_id, 0.25 * (i % 4)))
            if (x := b.learn(made[i].decision_id, 0.25 * (i % 4), t)) is not None:
                told.append(x)
    return b, rows, told, made


def run(spark, tmp_path, batches, name="a", **more):
    """The output of the learner over the batches so far, a file each."""
    folder = tmp_path / name
    (folder / "in").mkdir(parents=True, exist_ok=True)
    for i, rows in enumerate(batches, len(list((folder / "in").iterdir()))):
        spark.createDataFrame(rows, timers.INPUT).coalesce(1).write.parquet(str(folder / "in" / f"{i:03d}"))
    stream = spark.readStream.schema(timers.INPUT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "*"))
    out = timers.learn_timed(stream, OFFERS, delay="5 seconds", **ARGS, **more)
    query = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(str(folder / "out")), str(folder / "at")


@pytest.fixture(scope="module")
def stopped(spark, tmp_path_factory):
    """Two keys' histories in three batches; the query stops after the first two and starts again."""
    tmp = tmp_path_factory.mktemp("timed")
    whole = {k: history(k, 24, skip) for k, skip in (("a", 3), ("b", 2))}
    rows = sorted((r for _, own, _, _ in whole.values() for r in own), key=lambda r: r[2])
    end = [(k, "tick", 10_000.0, None, "", None) for k in ("z",)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    run(spark, tmp, [rows[:30], rows[30:55]])
    out, at = run(spark, tmp, [rows[55:]])
    middle = {r.key: r.state for r in timers.state_of(spark, at, **ARGS).collect()}
    out, at = run(spark, tmp, [end])
    yield tmp, whole, out.collect(), middle, at
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_timers_give_the_expiries_of_one_process(stopped):
    _, whole, rows, _, _ = stopped
    for key, (b, _, told, made) in whole.items():
        own = [r for r in rows if r.key == key]
        assert {(r.decision_id, r.chosen, r.propensity) for r in own if r.event == "decision"} == {(d.decision_id, d.chosen, d.propensity) for d in made.values()}
        rest = K.fork(b).expire(10_000.0)
        assert rest and sorted((r.decision_id, r.kind, r.reward) for r in own if r.event == "resolution") == sorted((x.decision_id, x.kind, x.reward) for x in told + rest)


def test_state_is_read_back(spark, stopped):
    _, whole, _, middle, at = stopped
    for key, (b, *_) in whole.items():
        assert K.deserialize(middle[key]) == b
        ended = K.fork(b)
        ended.expire(10_000.0)
        (last,) = [r.state for r in timers.state_of(spark, at, **ARGS).where(F.col("key") == key).collect()]
        assert K.deserialize(last) == ended


def test_a_fork_goes_its_own_way(spark, stopped):
    tmp, whole, _, middle, at = stopped
    b = K.fork(whole["a"][0])
    initial = spark.createDataFrame([("a", middle["a"])], "key string, state string")
    name = next(iter(b.ledger))
    rows = [("a", "reward", 1240.0, None, name, 0.75), ("a", "decide", 1241.0, json.dumps({"seg": "a", "hour": 1.0}), "", None)]
    out, forked = run(spark, tmp, [rows], name="fork", initial=initial)
    told, d = [*b.expire(1240.0), b.learn(name, 0.75, 1240.0), *b.expire(1241.0)], b.decide({"seg": "a", "hour": 1.0}, OFFERS, 1241.0, "a")
    got = out.collect()
    assert [(r.decision_id, r.chosen, r.propensity) for r in got if r.event == "decision"] == [(d.decision_id, d.chosen, d.propensity)]
    assert {(r.decision_id, r.kind) for r in got if r.event == "resolution"} == {(x.decision_id, x.kind) for x in told if x}
    (own,) = timers.state_of(spark, forked, **ARGS).collect()
    (first,) = timers.state_of(spark, at, **ARGS).where("key = 'a'").collect()
    assert K.deserialize(own.state) == b and own.state != first.state


def files(spark, folder, schema, batches):
    """A stream of the batches, one file each, in shuffled order of rows."""
    for i, rows in enumerate(batches):
        rows = list(rows)
        random.Random(i).shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


def test_interval_join_of_shuffled_streams(spark, sf, tmp_path):
    made = derived.decisions(spark, sf)
    reports = derived.resolutions(made).select("decision_id", "report", "t", "reward")
    decisions = made.select("decision_id", "t")
    horizon, day = derived.HORIZON, 86_400.0
    first = min(r.t for r in decisions.collect())

    def batches(rows, last):
        cut = collections.defaultdict(list)
        for r in rows:
            cut[int((r.t - first) // (6 * day))].append(tuple(r))
        return [cut[i] for i in sorted(cut)] + [[last]]

    far = first + 400 * day
    left = files(spark, tmp_path / "d", "decision_id string, t double", batches(decisions.collect(), ("end", far)))
    right = files(spark, tmp_path / "r", "decision_id string, report int, t double, reward double", batches(reports.collect(), ("none", 0, far, 0.0)))
    out = intervals.resolved(left, right, horizon=horizon, delay="7 days")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = collections.Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("decision_id <> 'end'").collect())
    assert got == collections.Counter(tuple(r) for r in intervals.resolved(decisions, reports, horizon=horizon).collect())
    classes = {r.report: (r.n, r.reward) for r in derived.classified(derived.resolutions(made)).where("kind = 'rewarded'").groupBy("report").agg(F.count("*").alias("n"), F.sum("reward").alias("reward")).collect()}
    own = collections.defaultdict(lambda: [0, 0.0])
    for (_, report, kind, reward), n in got.items():
        if kind == "rewarded":
            own[report][0] += n
            own[report][1] += n * reward
    assert {k: tuple(v) for k, v in own.items()} == classes


def test_examples_are_trained_once(spark, tmp_path):
    """A batch fails after its examples were written, another in its callback; after restarts every example but the failed one has been trained once."""
    schema = "decision_id string, reward double"
    folder = tmp_path / "in"
    files(spark, folder, schema, [[(f"d{b}:{i}", 1.0) for i in range(5)] * 2 for b in range(3)])
    seen: collections.Counter = collections.Counter()

    def train(row):
        if row.decision_id == "d2:3":
            raise RuntimeError("no")
        seen[row.decision_id] += 1

    class Fails(training.TrainSink):
        def commit(self, batch):
            if batch == 1 and not (tmp_path / "failed").exists():
                (tmp_path / "failed").touch()
                raise RuntimeError("lost after the write")
            super().commit(batch)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
        query = stream.writeStream.foreachBatch(Fails(spark, str(tmp_path / "sink"), train)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception as error:  # noqa: BLE001
            return str(error)
        return ""

    assert "lost after the write" in run() and sum(seen.values()) == 5
    assert "no" in run()
    assert run() == ""
    every = {f"d{b}:{i}" for b in range(3) for i in range(5)}
    assert set(seen) == every - {"d2:3"} and set(seen.values()) == {1}
    assert sorted(r.decision_id for r in training.TrainSink(spark, str(tmp_path / "sink"), train).examples().collect()) == sorted(every)
