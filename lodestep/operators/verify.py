"""Integrity findings of a decision log, as rows.

The rules that need other lines (duplicates, unknown decisions, times that go back)
are windows over ids and salts; those within a line are predicates. A log may have one
salt, so the latest time of a salt is taken by chunks of lines, with chunk totals carried. What
needs the exact candidate encoding runs in Arrow batches, line by line, without state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernel as K
from ..plans.shared import written
from ..sources.logfile import parse_line

CHUNK = 65_536
_PARSED = "line bigint, event string, decision_id string, salt string, t double, kind string, reward double, bad_bits boolean, bad_chosen boolean, bad_propensity boolean, unencodable boolean, bad_hash boolean, bad_features boolean, error string"


def _checked(line: int, text: str) -> tuple:
    try:
        x = parse_line(text)
    except ValueError as error:
        return (line, *[None] * 12, f"line {line}: {error}")
    if x["event"] == "resolution":
        reward = x["reward"]
        return line, "resolution", x["decision_id"], None, None, x["kind"], None if reward is None else float(reward), *[None] * 6, None
    r = x["record"]
    bits, chosen, flags = x["bits"], r["chosen"], [False] * 6
    flags[0] = not 1 <= bits <= K.MAX_BITS
    flags[1] = not flags[0] and not 0 <= chosen < len(x["candidates"])
    flags[2] = not 0.0 < r["propensity"] <= 1.0
    if not flags[0] and not flags[1]:
        try:
            encoded = [K.encode(x["context"], arm, action, bits) for arm, action in x["candidates"]]
        except ValueError:
            flags[3] = True
        else:
            flags[4] = K.candidate_hash(encoded, 1 << bits) != r["candidate_hash"]
            flags[5] = encoded[chosen] != [(j, float(v)) for j, v in r["features"]]
    return line, "decision", r["decision_id"], r["salt"], float(r["t"]), None, None, *flags, None


def parsed(lines: DataFrame) -> DataFrame:
    """Typed lines with what each shows by itself, from (line, value)."""

    def batches(it: Iterator) -> Iterator:
        import pandas as pd

        for pdf in it:
            rows = [_checked(int(n), v) for n, v in zip(pdf["line"], pdf["value"]) if v.strip()]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PARSED.split(", ")])

    return lines.select("line", "value").mapInPandas(batches, _PARSED)


def _with_latest(rows: DataFrame, counts, chunk: int) -> DataFrame:
    """``rows`` with latest: the greatest t of the earlier lines of their salt that count."""
    dealt = rows.withColumns({"chunk": F.floor(F.col("line") / chunk), "own": F.when(counts, F.col("t"))})
    within = Window.partitionBy("salt", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("salt").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.where("salt is not null").groupBy("salt", "chunk").agg(F.max("own").alias("most"))
    carried = totals.select("salt", "chunk", F.max("most").over(before).alias("carried"))
    seen = dealt.withColumn("within", F.max("own").over(within)).join(carried, ["salt", "chunk"], "left")
    return seen.withColumn("latest", F.greatest("within", "carried")).drop("chunk", "own", "within", "carried")


def verify(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(line, at, problem) of every violation; ``at`` orders those of one line. Malformed lines are findings too."""
    rows = written(parsed(lines), "parsed")
    ids = Window.partitionBy("decision_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    decided = F.coalesce(F.max(F.when(F.col("event") == "decision", True)).over(ids), F.lit(False))
    stops = F.col("bad_bits") | F.col("bad_chosen") | F.col("unencodable")
    seen = _with_latest(rows, ~stops, chunk).withColumn("known", decided)
    taken = F.coalesce(F.max(F.when((F.col("event") == "resolution") & F.col("known"), True)).over(ids), F.lit(False))
    seen = seen.withColumn("taken", taken)
    where = F.concat(F.lit("line "), F.col("line"))
    of, at = F.concat(where, F.lit(": decision "), F.col("decision_id"), F.lit(": ")), F.col("event") == "decision"
    told = F.concat(where, F.lit(": resolution for "))
    finite = F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") != float("inf"))
    counts = ~at & F.col("known") & ~F.col("taken")
    kinds = F.col("kind").isin("rewarded", "expired")
    problems = [
        F.col("error"),
        F.when(at & F.col("known"), F.concat(where, F.lit(": duplicate decision id '"), F.col("decision_id"), F.lit("'"))),
        F.when(F.col("bad_bits"), F.concat(of, F.lit("bits must be between 1 and 24"))),
        F.when(F.col("bad_chosen"), F.concat(of, F.lit("chosen index out of range"))),
        F.when(F.col("bad_propensity") & ~F.col("bad_bits") & ~F.col("bad_chosen"), F.concat(of, F.lit("propensity must be in (0, 1]"))),
        F.when(F.col("unencodable"), F.concat(of, F.lit("candidates failed to encode"))),
        F.when(F.col("bad_hash"), F.concat(of, F.lit("candidates do not match the logged candidate_hash"))),
        F.when(F.col("bad_features"), F.concat(of, F.lit("chosen features do not match the logged candidates"))),
        F.when(at & ~stops & (F.col("t") < F.col("latest")), F.concat(of, F.lit("t decreases within salt '"), F.col("salt"), F.lit("'"))),
        F.when((F.col("event") == "resolution") & ~F.col("known"), F.concat(told, F.lit("unknown decision '"), F.col("decision_id"), F.lit("'"))),
        F.when((F.col("event") == "resolution") & F.col("known") & F.col("taken"), F.concat(where, F.lit(": second resolution for decision '"), F.col("decision_id"), F.lit("'"))),
        F.when(counts & ~kinds, F.concat(told, F.col("decision_id"), F.lit(": unknown kind '"), F.col("kind"), F.lit("'"))),
        F.when(counts & kinds & ~finite, F.concat(told, F.col("decision_id"), F.lit(": reward must be a finite number"))),
    ]
    return seen.select("line", F.posexplode(F.array_compact(F.array(*problems))).alias("at", "problem"))
