"""``python -m lodestep.cli``: verify, eval, sweep and replay of a JSON-lines log.

Exit codes: 0 done, 1 the log has problems, 2 the call is wrong. The log is read, checked and
folded by Spark; reports and findings come back, a sweep's configurations share one pass.
"""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .functions import kernel as K
from .operators import evaluate as E
from .operators import verify as V
from .sources import logfile

#: Flags of each command with their types; the first group is required.
FLAGS = {
    "verify": ({}, {}),
    "eval": ({"bits": int}, {"epsilon": float, "forgetfulness": float}),
    "sweep": ({"bits": int}, {"epsilon": float, "forgetfulness": float}),
    "replay": ({"bits": int, "horizon": float}, {"epsilon": float, "forgetfulness": float, "default-reward": float}),
}


class Usage(Exception):
    """A wrong call."""


def sweep(events: DataFrame, bits: list[int], epsilons: list[float], forgetting: list[float]) -> list[dict]:
    """The report of every configuration, in the order in which they are named."""
    rows = E.evaluate(events, ["line"], bits=bits, epsilons=epsilons, forgetting=forgetting, strict=True).collect()  # a row for each configuration
    return [r.asDict() for r in sorted(rows, key=lambda r: (bits.index(r.bits), epsilons.index(r.epsilon), forgetting.index(r.forgetfulness)))]


def parse(args: list[str]) -> tuple[str, str, dict, bool]:
    """(command, path, flags, hard): flags may be lists for a sweep, split by commas."""
    if len(args) < 2 or args[0] not in FLAGS:
        raise Usage(f"usage: {' | '.join(FLAGS)} LOG [--flag value ...] [--hard-fail]")
    command, path, rest = args[0], args[1], list(args[2:])
    required, optional = FLAGS[command]
    kinds, found, hard = required | optional, {}, False
    while rest:
        name = rest.pop(0)
        if name == "--hard-fail":
            hard = True
            continue
        if not name.startswith("--") or name[2:] not in kinds or not rest:
            raise Usage(f"unknown or incomplete flag {name}")
        try:
            values = [kinds[name[2:]](v) for v in rest.pop(0).split(",")]
        except ValueError as error:
            raise Usage(f"{name}: {error}") from error
        if len(values) > 1 and command != "sweep":
            raise Usage(f"{name} takes one value")
        found[name[2:]] = values
    if missing := [n for n in required if n not in found]:
        raise Usage(f"missing --{missing[0]}")
    return command, path, found, hard


def table(rows: list[dict]) -> str:
    """Right-aligned markdown; four decimals."""
    shown = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r.values()] for r in rows]
    heads = list(rows[0])
    widths = [max(len(h), *(len(r[i]) for r in shown)) for i, h in enumerate(heads)]
    line = lambda cells: "| " + " | ".join(c.rjust(w) for c, w in zip(cells, widths)) + " |"
    return "\n".join([line(heads), "|" + "|".join("-" * (w + 1) + ":" for w in widths) + "|", *map(line, shown)])


def main(args: list[str]) -> int:
    try:
        command, path, flags, hard = parse(args)
    except Usage as error:
        print(error, file=sys.stderr)
        return 2
    from .session import local_session

    lines = logfile.read_log(local_session(name="cli"), path)
    one = lambda name, default: flags.get(name, [default])
    epsilons, forgetting = one("epsilon", K.DEFAULTS["epsilon"]), one("forgetfulness", K.DEFAULTS["forgetting"])
    try:
        if command == "verify" or hard:
            problems = 0
            for r in V.verify(lines).orderBy("line", "at").toLocalIterator():  # printed as they come
                print(r.problem, file=sys.stdout if command == "verify" else sys.stderr)
                problems += 1
            if command == "verify":
                n = {r["event"]: r["n"] for r in logfile.log_counts(logfile.typed(lines)).collect()}  # two rows, three with bad lines
                print(f"{n.get('decision', 0)} decisions, {n.get('resolution', 0)} resolutions, {problems} problem(s)")
            if problems or command == "verify":
                return int(bool(problems))
        events = logfile.parse_log(lines)
        if command == "replay":
            state = E.replay(events, ["line"], bits=flags["bits"][0], horizon=flags["horizon"][0], forgetting=forgetting[0], default_reward=one("default-reward", 0.0)[0], epsilon=epsilons[0], strict=True).first()
            print(state.state)
            print(f"{state.model_version} resolutions absorbed", file=sys.stderr)
        else:
            rows = sweep(events, flags["bits"], epsilons, forgetting)
            print(table(rows) if command == "sweep" else "\n".join(f"{k}: {'n/a' if v is None else v}" for k, v in rows[0].items()))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    except PySparkException as error:  # what a plan itself refuses
        print(str(error).split("SQLSTATE")[0].strip(), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
