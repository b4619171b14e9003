"""Plans over logs: identity and replay properties, tampering, error rules, learners, streams, files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import plainfold
from lodestep.functions import kernel as K
from lodestep.operators import evaluate, fold, online, verify
from lodestep.plans import catalog
from lodestep.plans.ranking import in_order
from lodestep.sources import derived, logfile
from lodestep.streaming import learner

OFFERS = list(derived.OFFERS)
MENU = [("soup", {"spicy": True}), ("salad", {"weight": 0.75, "origin": "farm"}), ("stew", {})]


def sample_log():
    """A day of a canteen: lines of ten choices with a dish missing now and then, ratings that come late or never, and the bandit that made them."""
    b, lines, made = K.create(5, 5400.0, epsilon=0.25, forgetfulness=0.8), [], []
    for i in range(10):
        if i in (4, 7, 8):
            lines.append(logfile.resolution_line(b.learn(made[i - 3].decision_id, 0.125 * i, 900.0 * i)))
        context, menu = {"guests": i * i, "rain": i % 4 == 1, "day": None}, [d for j, d in enumerate(MENU) if (i + j) % 5]
        made.append(b.decide(context, menu, 900.0 * i, "canteen"))
        lines.append(logfile.decision_line(made[-1], 5, context, menu))
    lines += [logfile.resolution_line(x) for x in b.expire(5400.0 + 900.0 * 2)]
    return lines, b


def as_lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string")


def findings(spark, lines):
    return [r.problem for r in verify.verify(as_lines(spark, lines)).orderBy("line", "at").collect()]


def test_a_true_log_has_no_findings(spark):
    assert findings(spark, sample_log()[0]) == []


def test_tampering_is_found(spark):
    lines, _ = sample_log()
    x = json.loads(lines[0])
    x["candidates"][1 - x["record"]["chosen"]][1]["weight"] = 4.0
    told = next(i for i, text in enumerate(lines) if "resolution" in text)
    of = json.loads(lines[told])["decision_id"]
    bad = [json.dumps(x), *lines[1:], lines[told], "", '{"event":"resolution","decision_id":"canteen:99","kind":"rewarded","reward":1.0}', lines[0]]
    n = len(lines)
    assert findings(spark, bad) == [
        "line 1: decision canteen:0: candidates do not match the logged candidate_hash",
        f"line {n + 1}: second resolution for decision '{of}'",
        f"line {n + 3}: resolution for unknown decision 'canteen:99'",
        f"line {n + 4}: duplicate decision id 'canteen:0'",
        f"line {n + 4}: decision canteen:0: t decreases within salt 'canteen'",
    ]


def changed(line, path, value):
    x = json.loads(line)
    (x if path in x else x["record"])[path] = value
    return json.dumps(x)


def test_field_findings(spark):
    lines, _ = sample_log()
    first = changed(lines[0], "t", 0.0)
    of = lambda name: changed(first, "decision_id", f"canteen:{name}")
    decisions = [changed(of(i), *x) for i, x in enumerate([("bits", 25), ("chosen", 9), ("chosen", -1), ("propensity", 0.0), ("propensity", 1.5)])]
    told = lambda name, kind, reward: json.dumps({"event": "resolution", "decision_id": f"canteen:{name}", "kind": kind, "reward": reward})
    broken = ["[]", '{"event":3}', '{"event":"x"}', changed(first, "bits", True), changed(first, "candidates", [["a"]]), changed(first, "features", [[0.5, 1]]), '{"event":"resolution","kind":"rewarded","reward":1}', '{"event":"resolution","decision_id":"a","kind":"rewarded","reward":NaN}', told(0, "rewarded", "1")]
    kind = "each event must be a JSON object with an 'event' kind"
    assert [p.split(": ", 1)[1] for p in findings(spark, [*decisions, told(0, "rewarded", None), told(1, "lost", None), *broken])] == [
        "decision canteen:0: bits must be between 1 and 24", "decision canteen:1: chosen index out of range", "decision canteen:2: chosen index out of range", "decision canteen:3: propensity must be in (0, 1]",
        "decision canteen:4: propensity must be in (0, 1]", "resolution for canteen:0: reward must be a finite number", "resolution for canteen:1: unknown kind 'lost'",
        kind, kind, "unknown event kind", *["malformed decision event"] * 3, "malformed resolution event", "not valid JSON", "malformed resolution event",
    ]


def findings_by_hand(lines):
    """The rules of the log, one line after the other; what one line shows by itself is told by the batch parser."""
    known, taken, latest, out = set(), set(), {}, []
    for n, text in lines:
        try:
            x = logfile.parse_line(text)
        except ValueError as error:
            out.append(f"line {n}: {error}")
            continue
        if x["event"] == "decision":
            r, id = x["record"], x["record"]["decision_id"]
            of = f"line {n}: decision {id}: "
            if id in known:
                out.append(f"line {n}: duplicate decision id '{id}'")
            known.add(id)
            if not 1 <= x["bits"] <= 24:
                out.append(of + "bits must be between 1 and 24")
                continue
            if not 0 <= r["chosen"] < len(x["candidates"]):
                out.append(of + "chosen index out of range")
                continue
            if not 0 < r["propensity"] <= 1:
                out.append(of + "propensity must be in (0, 1]")
            try:
                made = [K.encode(x["context"], arm, action, x["bits"]) for arm, action in x["candidates"]]
            except ValueError:
                out.append(of + "candidates failed to encode")
                continue
            if K.candidate_hash(made, 1 << x["bits"]) != r["candidate_hash"]:
                out.append(of + "candidates do not match the logged candidate_hash")
            if [list(f) for f in made[r["chosen"]]] != r["features"]:
                out.append(of + "chosen features do not match the logged candidates")
            if r["t"] < latest.get(r["salt"], r["t"]):
                out.append(of + f"t decreases within salt '{r['salt']}'")
            latest[r["salt"]] = max(r["t"], latest.get(r["salt"], r["t"]))
        elif (id := x["decision_id"]) not in known:
            out.append(f"line {n}: resolution for unknown decision '{id}'")
        elif id in taken:
            out.append(f"line {n}: second resolution for decision '{id}'")
        else:
            taken.add(id)
            if x["kind"] not in ("rewarded", "expired"):
                out.append(f"line {n}: resolution for {id}: unknown kind '{x['kind']}'")
            elif x["reward"] is None:
                out.append(f"line {n}: resolution for {id}: reward must be a finite number")
    return out


def test_whole_log_is_verified(spark, sf):
    """Decisions and resolutions, with damage of every kind: each rule finds something, and all findings are those of a plain fold."""
    lines = derived.damaged_lines(derived.log(spark, sf), catalog.BITS).collect()
    expected = findings_by_hand(sorted((r.line, r.value) for r in lines))
    assert len(lines) == derived.log(spark, sf).count() + sum(i % derived.DAMAGED == 9 for i in (r.event_id for r in derived.decisions(spark, sf).collect()))
    got = [r.problem for r in entry.queries()["verify_log"](spark, sf).orderBy("line", "at").collect()]
    assert got == expected
    rules = ("not valid JSON", "each event must be", "unknown event kind", "malformed resolution event", "malformed decision event", "duplicate decision id", "bits must", "chosen index", "propensity must", "failed to encode",
        "logged candidate_hash", "chosen features", "t decreases", "unknown decision", "second resolution", "unknown kind", "reward must")
    assert [x for x in rules if not any(x in p for p in got)] == []


@pytest.mark.parametrize("chunk", [1, 7, 65_536])
def test_latest_time_is_carried_over_chunks(spark, sf, chunk):
    lines = derived.damaged_lines(derived.log(spark, sf), catalog.BITS)
    found = verify.verify(lines, chunk)
    assert [r.problem for r in found.orderBy("line", "at").collect()] == findings_by_hand(sorted((r.line, r.value) for r in lines.collect()))


@pytest.mark.parametrize("packed", [False, True])
def test_files(spark, tmp_path, packed):
    lines = [f"line {i}" if i % 7 else "" for i in range(5000)]
    data = ("\n".join(lines) + "\n").encode()
    path = tmp_path / "log.jsonl"  # the content decides, not the name
    path.write_bytes(gzip.compress(data) if packed else data)
    rows = logfile.read_log(spark, str(path)).orderBy("line").collect()
    assert [(r.line, r.value) for r in rows] == list(enumerate(lines, 1))


def events_of(spark, sf, by=None):
    """The derived log as plain events, by ``by`` if given."""
    out = {}
    for r in derived.log(spark, sf).orderBy(*derived.ORDER).collect():
        told = ("decision", r.decision_id, json.loads(r.context), OFFERS, r.chosen, r.propensity) if r.event == "decision" else ("resolution", r.decision_id, r.reward)
        out.setdefault(r[by] if by else None, []).append(told)
    return out if by else out[None]


def report(row):
    return {k: v for k, v in row.asDict().items() if k not in ("bits", "epsilon", "forgetfulness", "user_id")}


@pytest.mark.parametrize("bits, epsilon, forgetting", [(4, 0.2, 1.0), (6, 0.1, 0.999), (8, 0.05, 0.5)])
def test_evaluation_equals_the_fold_bit_for_bit(spark, sf, bits, epsilon, forgetting):
    """Within a chunk every sum is taken in log order; 0.5 forgets so fast that the sums are renormalised on the way."""
    (row,) = evaluate.evaluate(derived.log(spark, sf), derived.ORDER, bits=[bits], epsilons=[epsilon], forgetting=[forgetting]).collect()
    assert report(row) == plainfold.evaluate(events_of(spark, sf), bits, epsilon, forgetting)


@pytest.mark.parametrize("chunk", [1, 7, 300])
def test_chunks_carry_what_came_before(spark, sf, chunk):
    expected = [plainfold.evaluate(events_of(spark, sf), 5, 0.2, f) for f in (1.0, 0.99)]
    rows = evaluate.evaluate(derived.log(spark, sf), derived.ORDER, bits=[5], epsilons=[0.2], forgetting=[1.0, 0.99], chunk=chunk).orderBy(F.desc("forgetfulness")).collect()
    assert [report(r) for r in rows] == [pytest.approx(e, rel=1e-9) for e in expected]


def test_each_key_has_its_own_log(spark, sf):
    rows = evaluate.evaluate(derived.log(spark, sf), derived.ORDER, bits=[6], epsilons=[0.1], forgetting=[0.999], key="user_id", chunk=40).collect()
    by_user = events_of(spark, sf, "user_id")
    assert {r.user_id for r in rows} == set(by_user)
    for r in rows:
        assert report(r) == pytest.approx(plainfold.evaluate(by_user[r.user_id], 6, 0.1, 0.999), rel=1e-9)


def test_nothing_resolved_still_has_a_row(spark, sf):
    log = derived.log(spark, sf).where("event = 'decision'")
    (row,) = evaluate.evaluate(log, derived.ORDER, bits=[4], epsilons=[0.1], forgetting=[1.0]).collect()
    assert report(row) == {"decisions": 1000, "resolved": 0, "unresolved": 1000, **dict.fromkeys(("logged_mean", "ips", "snips", "ess", "max_weight"))}
    (row,) = evaluate.evaluate(log.where("false"), derived.ORDER, bits=[4], epsilons=[0.1], forgetting=[1.0]).collect()
    assert (row.decisions, row.resolved, row.unresolved, row.ips) == (0, 0, 0, None)


def test_identity(spark, sf):
    """The logging configuration has weight 1 everywhere."""
    (row,) = evaluate.evaluate(derived.log(spark, sf), derived.ORDER, bits=[6], epsilons=[1.0], forgetting=[0.999]).collect()
    assert row.ips == row.snips == row.logged_mean and row.ess == row.resolved and row.max_weight == 1.0


def test_a_read_log_is_evaluated_and_rebuilt(spark):
    """Contexts, menus and forgetting of a real log: weight 1 under the logging configuration, and the logger's own model."""
    lines, made = sample_log()
    events = logfile.parse_log(as_lines(spark, lines))
    (row,) = evaluate.evaluate(events, ["line"], bits=[5], epsilons=[0.25], forgetting=[0.8], strict=True).collect()
    assert row.ips == row.snips == row.logged_mean and row.ess == row.resolved == made.model_version and row.unresolved == len(made.ledger)
    state = evaluate.replay(events, ["line"], bits=5, horizon=5400.0, forgetting=0.8, epsilon=0.25, strict=True).first()
    rebuilt = K.deserialize(state.state)
    assert (rebuilt.model, rebuilt.next_seq, rebuilt.model_version) == (made.model, made.next_seq, made.model_version)
    assert {r.event: r.n for r in logfile.log_counts(events).collect()} == {"decision": 10, "resolution": len(lines) - 10}


def test_what_cannot_be_evaluated_is_refused(spark):
    lines, _ = sample_log()
    told = next(i for i, text in enumerate(lines) if "resolution" in text)

    def refused(number, *change, run=None):
        bad = [changed(x, *change) if i == number else x for i, x in enumerate(lines)]
        run = run or (lambda events: evaluate.evaluate(events, ["line"], bits=[5], epsilons=[0.1], forgetting=[1.0], strict=True))
        with pytest.raises(Exception) as error:
            run(logfile.parse_log(as_lines(spark, bad))).collect()
        return str(error.value).split("SQLSTATE")[0].strip()

    again = lambda events: evaluate.replay(events, ["line"], bits=5, horizon=1.0, strict=True)
    assert refused(1, "chosen", 5) == refused(1, "chosen", 5, run=again) == "line 2: chosen index out of range"
    assert refused(1, "propensity", 0) == "line 2: propensity must be in (0, 1]"
    assert refused(1, "candidates", []) == "line 2: need at least one candidate"
    assert refused(2, "context", {"x": [1]}) == "line 3: feature 'x' has unsupported type list"
    assert refused(told, "kind", "lost") == refused(told, "kind", "lost", run=again) == f"line {told + 1}: unknown resolution kind"
    assert refused(told, "reward", None) == f"line {told + 1}: reward must be a finite number"
    assert refused(told, "decision_id", 4) == f"line {told + 1}: malformed resolution event"
    assert "malformed decision id 'canteen:+1'" in refused(1, "decision_id", "canteen:+1", run=again)
    for bad in ({"bits": [25]}, {"epsilons": [1.5]}, {"forgetting": [0.0]}):
        with pytest.raises(ValueError):
            evaluate.evaluate(logfile.parse_log(as_lines(spark, lines)), ["line"], **{"bits": [5], "epsilons": [0.1], "forgetting": [1.0], **bad})


def test_draws_follow_the_kernel(spark, sf):
    for r in derived.decisions(spark, sf).collect():
        assert r.chosen == K.sample_index([1 / 3] * 3, K.random_unit(K.derive_key(r.decision_id, derived.SALT), 0))


@pytest.mark.parametrize("chunk", [100, fold.CHUNK])
def test_replay_equals_the_fold(spark, sf, chunk):
    expected = plainfold.replay(events_of(spark, sf), 6, 60.0, 0.99)
    row = evaluate.replay(derived.log(spark, sf), derived.ORDER, bits=6, horizon=60.0, forgetting=0.99, chunk=chunk).first()
    got = K.deserialize(row.state)
    assert (got.next_seq, got.model_version, got.horizon, got.ledger) == (expected.next_seq, expected.model_version, 60.0, {})
    true = lambda m: {j: (m.scale * m.xx[j], m.scale * m.xy[j]) for j in m.xx}
    assert true(got.model) == {j: pytest.approx(x, rel=1e-9) for j, x in true(expected.model).items()}
    if chunk > 1000:
        assert row.state == K.serialize(expected)


def test_states_and_slates_of_keys(spark, sf):
    by_user = events_of(spark, sf, "user_id")
    states = {r.user_id: r for r in catalog.queries()["per_user_replay"](spark, sf).collect()}
    expected = {u: plainfold.replay(events, catalog.BITS, derived.HORIZON, 0.999) for u, events in by_user.items()}
    assert {u: (r.state, int(r.next_seq), r.model_version) for u, r in states.items()} == {u: (K.serialize(b), b.next_seq, b.model_version) for u, b in expected.items()}
    slots = {(r.user_id, r.slot): (r.xx, r.xy) for r in catalog.queries()["replay_states"](spark, sf).collect()}
    assert slots == {(u, j): pytest.approx((b.model.scale * b.model.xx[j], b.model.scale * b.model.xy[j]), abs=1e-6) for u, b in expected.items() for j in b.model.xx}
    context, places = {"seg": "click", "hour": 12.0}, {}
    for u, b in expected.items():
        names = list(OFFERS)
        for place in range(2):
            d = b.decide(context, names, 0.0, str(u))
            places[u, place] = names.pop(d.chosen)[0], d.propensity
    assert {(r.user_id, r.place): (r.arm, r.propensity) for r in catalog.queries()["slate_topk"](spark, sf).collect()} == places


def learned_by_hand(rows, explore=None):
    """One key's run: an agenda of decisions and rewards by time, the bandit asked for each."""
    b, ends, agenda = K.create(catalog.BITS, derived.HORIZON, 0.0, *([catalog.EPSILON] if explore is None else [])), {}, []
    made = {}
    for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
        agenda.append((r.t, 1, r.event_id, r))
        if r.delay is not None:
            agenda.append((r.t + r.delay, 0, r.event_id, r))
    for t, decides, _, r in sorted(agenda, key=lambda x: x[:3]):
        for told in b.expire(t):
            ends[told.decision_id] = told
        if decides:
            made[r.event_id] = b.decide(json.loads(r.context), OFFERS, t, str(r.user_id), explore=explore)
        elif r.event_id in made and (told := b.learn(made[r.event_id].decision_id, r.reward[made[r.event_id].chosen], t)):
            ends[told.decision_id] = told
    return {d.decision_id: (d.chosen, d.propensity, *((ends[d.decision_id].kind, ends[d.decision_id].reward) if d.decision_id in ends else (None, None))) for d in made.values()}


@pytest.mark.parametrize("query, explore", [("online_learner", None), ("byo_explore", catalog.softmax)])
def test_keyed_learners_equal_one_process(spark, sf, query, explore):
    users = {}
    for r in online.with_outcomes(derived.decisions(spark, sf)).collect():
        users.setdefault(r.user_id, []).append(r)
    got = {}
    for r in catalog.queries()[query](spark, sf).collect():
        got.setdefault(r.user_id, {})[r.decision_id] = (r.chosen, r.propensity, r.kind, r.reward)
    assert got == {u: learned_by_hand(rows, explore) for u, rows in users.items()}


def test_rewards_after_the_last_decision_count(spark):
    rows = [("u", i, float(i), "{}", 100.0, [1.0, 0.5, 0.0]) for i in range(4)] + [("u", 9, 9.0, "{}", None, [0.0] * 3)]
    df = spark.createDataFrame(rows, "user string, event_id long, t double, context string, delay double, reward array<double>")
    got = online.learn_keyed(df, "user", OFFERS, bits=4, horizon=1000.0).collect()
    assert sorted(str(r.kind) for r in got) == ["None", *["rewarded"] * 4]
    assert {r.kind for r in online.learn_keyed(df, "user", OFFERS, bits=4, horizon=50.0).collect()} == {"expired"}
    assert online.learn_keyed(df.where("false"), "user", OFFERS, bits=4, horizon=1.0).count() == 0


def test_stream_equals_one_process(spark, tmp_path):
    b, rows, told = K.create(4, 100.0), [], []
    for i in range(12):
        d = b.decide({"seg": "a", "hour": float(i)}, OFFERS, 10.0 * i, "k")
        rows.append(("k", "decide", 10.0 * i, "a", float(i), "", None))
        if i % 3:
            rows += [("k", "reward", 10.0 * i + 5, None, None, d.decision_id, 1.0)] * 2
            told.append(b.learn(d.decision_id, 1.0, 10.0 * i + 5))
    rows.append(("k", "sweep", 150.0, None, None, "", None))
    told += b.expire(150.0)
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows[:9], rows[9:])):
        spark.createDataFrame(part, learner.INPUT).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(learner.INPUT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = learner.learn_stream(stream, OFFERS, bits=4, horizon=100.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("event = 'decision'").count() == 12
    assert sorted((r.decision_id, r.kind, r.reward) for r in got.where("event = 'resolution'").collect()) == sorted((x.decision_id, x.kind, x.reward) for x in told)


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3 == 0).alias("third"))
    rows = in_order(df, ["x"], "place", {"before": F.col("third")}).orderBy("place").collect()
    assert [r.x for r in rows] == list(range(1000)) == [r.place for r in rows]
    seen = 0
    for r in rows:
        assert r.before == seen
        seen += r.third


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cli(spark, tmp_path, capsys):
    from lodestep import cli

    lines, made = sample_log()
    path, bad = tmp_path / "log.jsonl", tmp_path / "bad.jsonl"
    path.write_text("\n".join(lines) + "\n")
    bad.write_text("\n".join([lines[0], "{", lines[1]]))
    assert cli.main(["eval", str(path), "--bits", "5", "--epsilon", "0.25", "--forgetfulness", "0.8"]) == 0
    told = dict(x.split(": ") for x in capsys.readouterr().out.splitlines())
    assert told["ips"] == told["snips"] == told["logged_mean"] and float(told["ess"]) == int(told["resolved"]) == made.model_version
    assert cli.main(["sweep", str(path), "--bits", "4,5", "--epsilon", "0.5,0.25", "--hard-fail"]) == 0
    assert [x.split("|")[1:3] for x in capsys.readouterr().out.replace(" ", "").splitlines()[2:]] == [["4", "0.5000"], ["4", "0.2500"], ["5", "0.5000"], ["5", "0.2500"]]
    assert cli.main(["replay", str(path), "--bits", "5", "--horizon", "5400", "--forgetfulness", "0.8", "--epsilon", "0.25"]) == 0
    out = capsys.readouterr()
    assert K.deserialize(out.out.strip()).model == made.model and f"{made.model_version} resolutions" in out.err
    assert cli.main(["verify", str(path)]) == 0 and "10 decisions" in capsys.readouterr().out
    assert cli.main(["verify", str(bad)]) == 1 and "line 2: not valid JSON" in capsys.readouterr().out
    assert cli.main(["eval", str(bad), "--bits", "4", "--hard-fail"]) == 1 and "line 2: not valid JSON" in capsys.readouterr().err
    assert cli.main(["eval", str(bad), "--bits", "4"]) == 1 and "line 2: not valid JSON" in capsys.readouterr().err
    assert cli.main(["eval", str(path)]) == cli.main(["eval", str(path), "--bits", "x"]) == cli.main(["verify", str(path), "--no"]) == cli.main([]) == 2
    assert "missing --bits" in capsys.readouterr().err


def test_log_stream(spark, tmp_path):
    """Lines are typed as they arrive; a bad one is a row with an error."""
    lines, _ = sample_log()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*lines[:4], "{", "", *lines[4:]]) + "\n")
    query = logfile.read_log_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("typed_lines").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("typed_lines").collect()
    assert len(rows) == len(lines) + 1 and sum(r.error is not None for r in rows) == 1 and sum(r.event == "decision" for r in rows) == 10
