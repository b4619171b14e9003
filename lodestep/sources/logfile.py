"""JSON-lines decision logs: reading with stable line numbers, typed events, and canonical writing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..plans.ranking import in_order
from ..plans.shared import written
from . import lines


def _is_gzip(spark: SparkSession, path: str) -> bool:
    """By the first two bytes, never by the name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return stream.read() == 0x1F and stream.read() == 0x8B
    finally:
        stream.close()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of one log file, 1-based and counting blank lines.

    Plain text is split over tasks, whose order is that of their places in the
    file. A compressed file is inflated by one task as it goes.
    """
    if _is_gzip(spark, path):
        return lines.numbered(spark, path).select("line", "value")
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    return in_order(text, ["_start", "_id"], "_place").select((F.col("_place") + 1).alias("line"), "value")


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _list_of(test: Callable) -> Callable:
    return lambda x: isinstance(x, list) and all(map(test, x))


def _text(x) -> bool:
    return isinstance(x, str)


def _map(x) -> bool:
    return isinstance(x, dict)


def _pair(first: Callable, second: Callable) -> Callable:
    return lambda x: isinstance(x, list) and len(x) == 2 and first(x[0]) and second(x[1])


#: What the fields of each kind of event must be.
RECORD = {"decision_id": _text, "t": _number, "candidate_hash": _whole, "chosen": _whole, "features": _list_of(_pair(_whole, _number)), "propensity": _number, "model_version": _whole, "salt": _text}
SHAPES = {
    "decision": {"bits": _whole, "context": _map, "candidates": _list_of(_pair(_text, _map)), "record": lambda x: _fits(x, RECORD)},
    "resolution": {"decision_id": _text, "kind": _text, "reward": lambda x: x is None or _number(x)},
}


def _fits(x, shape: dict[str, Callable]) -> bool:
    return isinstance(x, dict) and all(name in x and test(x[name]) for name, test in shape.items())


def _refused(literal: str):
    raise ValueError(f"{literal} is no JSON")


def parse_line(text: str) -> dict:
    """A log line as fields; ValueError says what is malformed. NaN and infinities are not JSON. Fields that nobody asks for may be there."""
    try:
        x = json.loads(text, parse_constant=_refused)
    except ValueError:
        raise ValueError("not valid JSON") from None
    if not _fits(x, {"event": _text}):
        raise ValueError("each event must be a JSON object with an 'event' kind")
    if x["event"] not in SHAPES:
        raise ValueError("unknown event kind")
    if not _fits(x, SHAPES[x["event"]]):
        raise ValueError(f"malformed {x['event']} event")
    return x


#: A log line as a row, as ``operators.evaluate`` takes it; ``error`` says why a line has none.
EVENTS = "line bigint, event string, decision_id string, salt string, t double, context string, offers string, taken string, chosen int, propensity double, kind string, reward double, unsupported string, error string"


def _unsupported(x: dict) -> str | None:
    """Why an event's features can't be encoded."""
    try:
        for features in (x["context"], *(action for _, action in x["candidates"])):
            K.tokens("", features)
    except ValueError as error:
        return str(error)
    return None


def _event(line: int, text: str) -> tuple:
    try:
        x = parse_line(text)
    except ValueError as error:
        return line, *[None] * 12, f"line {line}: {error}"
    if x["event"] == "resolution":
        return line, "resolution", x["decision_id"], *[None] * 7, x["kind"], None if x["reward"] is None else float(x["reward"]), None, None
    r, candidates = x["record"], x["candidates"]
    chosen = r["chosen"] if 0 <= r["chosen"] < len(candidates) else None
    taken = None if chosen is None else json.dumps([candidates[chosen]])
    return line, "decision", r["decision_id"], r["salt"], float(r["t"]), json.dumps(x["context"]), json.dumps(candidates), taken, chosen, float(r["propensity"]), None, None, _unsupported(x), None


def typed(lines: DataFrame) -> DataFrame:
    """Rows of EVENTS of the lines (line, value) that aren't blank. Also for a stream of lines."""

    def batches(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            rows = [_event(int(n), v) for n, v in zip(pdf["line"], pdf["value"]) if v.strip()]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in EVENTS.split(", ")]).astype({"chosen": "Int32"})

    return lines.select("line", "value").mapInPandas(batches, EVENTS)


def parse_log(lines: DataFrame) -> DataFrame:
    """The events of a log, written once. Raises what is malformed in the first line that is."""
    rows = written(typed(lines), "events")
    first = rows.where("error is not null").agg(F.min_by("error", "line").alias("x")).first()["x"]
    if first is not None:
        raise ValueError(first)
    return rows.drop("error")


def log_counts(events: DataFrame) -> DataFrame:
    """(event, n): how many decisions and resolutions a log has."""
    return events.groupBy("event").agg(F.count("*").alias("n"))


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of log files as they arrive, with their lines' numbers; ``error`` stays a column, so a bad line fails nobody before it is reached."""
    return typed(lines.stream(spark, path).select("line", "value"))


def decision_line(made: K.Decision, bits: int, context: dict, candidates: list) -> str:
    """A decision with its inputs as one compact line, fields in fixed order. A record that has lost its inputs can't be logged."""
    if bits is None or context is None or candidates is None:
        raise ValueError("record has no inputs; log it where it was made")
    record = {
        "decision_id": made.decision_id, "t": made.t, "candidate_hash": made.candidate_hash, "chosen": made.chosen,
        "features": [list(f) for f in made.features], "propensity": made.propensity, "model_version": made.model_version, "salt": made.salt,
    }
    return json.dumps({"event": "decision", "bits": bits, "context": context, "candidates": [[arm, action] for arm, action in candidates], "record": record}, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def resolution_line(told: K.Resolution) -> str:
    return json.dumps({"event": "resolution", "decision_id": told.decision_id, "kind": told.kind, "reward": told.reward}, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
