"""Progressive off-policy evaluation, sweeps and model rebuilding over any ordered log.

A log has the columns ``event`` ('decision' or 'resolution'), ``decision_id``, for decisions
``context`` (a JSON object), ``offers`` (a JSON list of [arm, action]), ``taken`` (the list of the
chosen one alone), ``chosen`` and ``propensity``, for resolutions ``kind`` and ``reward``, and columns
that order it. With a ``key`` each key's log is evaluated by itself.

Training data comes from the log, never from the evaluated policy's own choices, so the
model as of any place can be rebuilt independently (``fold``). All configurations of a grid
share one ordering, one pairing and one pass over the chunks. Estimates come from exact sums,
which don't depend on how the log is cut.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import kernel as K
from ..plans.ranking import in_order
from ..plans.shared import written
from . import fold
from .effective import paired

KINDS = ("rewarded", "expired")
EVENTS = ("chunk", "pos", "event", "context", "offers", "chosen", "propensity", "target", "reward")


class Timeline:
    """A log in order with each resolution paired to the decision it closes. Written once; everything else reads it."""

    def __init__(self, log: DataFrame, order: list[str], key: str | None = None, chunk: int = fold.CHUNK):
        keyed = log.withColumn("key", F.col(key) if key else F.lit(0))
        placed = in_order(keyed, (["key"] if key else []) + order, "pos")
        pairs = paired(placed, ["pos"], ["context", "taken"], ["key"])
        rows = pairs.select(
            "key", "pos", F.expr(f"pos div {chunk}").alias("chunk"), "event", "decision_id", "effective", "open", "chosen", "propensity", "kind",
            F.when(F.col("event") == "decision", F.when(F.col("next_event") == "resolution", F.col("next_pos"))).alias("target"),
            F.coalesce("context", F.when(F.col("effective"), F.col("d_context"))).alias("context"),
            F.coalesce("offers", F.when(F.col("effective"), F.col("d_taken"))).alias("offers"),
            F.when(F.col("event") == "decision", F.col("next_reward")).otherwise(F.col("reward")).alias("reward"),
            *(F.col(c) for c in ("line", "unsupported") if c in log.columns),
        )
        self.rows, self.chunk = written(rows, "timeline"), chunk

    def refuse(self, propensities: bool = True) -> None:
        """Raise what is wrong with the first line that can't be evaluated. ``parse_log`` has done so for malformed lines."""
        line = F.col("line") if "line" in self.rows.columns else F.col("pos") + 1
        finite = F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") != float("inf"))
        at = F.col("event") == "decision"
        none = F.get_json_object("offers", "$[0]").isNull()
        wrong = F.when(at & none & propensities, "need at least one candidate").when(at & F.col("chosen").isNull(), "chosen index out of range")
        if propensities:
            wrong = wrong.when(at & ~((F.col("propensity") > 0) & (F.col("propensity") <= 1)), "propensity must be in (0, 1]")
        if "unsupported" in self.rows.columns:
            wrong = wrong.when(F.col("unsupported").isNotNull(), F.col("unsupported"))
        wrong = wrong.when(F.col("effective") & ~F.col("kind").isin(*KINDS), "unknown resolution kind").when(F.col("effective") & ~finite, "reward must be a finite number")
        first = self.rows.select(line.alias("line"), wrong.alias("wrong")).where("wrong is not null").agg(F.min(F.struct("line", "wrong")).alias("x")).first()["x"]
        if first is not None:
            raise ValueError(f"line {first['line']}: {first['wrong']}")

    def events(self, decisions: bool) -> DataFrame:
        """Updates, and decisions that are resolved later: an open one weighs nothing."""
        kinds = F.when(F.col("effective"), "update").when(F.col("target").isNotNull() & F.lit(decisions), "decision")
        return self.rows.withColumn("event", kinds).where("event is not null").select("key", *EVENTS)


def _sums(per: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, x: n, r, s, sr, ss, top): the limbs of all chunks added up and rounded once."""
    parts = per.groupBy(*groups, "name", "k").agg(F.sum("s").alias("s"), F.max("top").alias("top"))
    own = lambda name: F.coalesce(exact.total(F.collect_list(F.when(F.col("name") == name, F.struct("k", "s")))), F.lit(0.0)).alias(name)
    found = parts.groupBy(*groups).agg(F.sum(F.when(F.col("name") == "n", F.col("s"))).alias("n"), F.max("top").alias("top"), *(own(name) for name in ("r", "s", "sr", "ss")))
    return found.select(*groups, F.struct("n", "r", "s", "sr", "ss", "top").alias("x"))


def evaluate(log: DataFrame, order: list[str], *, bits: list[int], epsilons: list[float], forgetting: list[float], key: str | None = None, digits: int | None = None, chunk: int = fold.CHUNK, strict: bool = False) -> DataFrame:
    """One row for each (key,) bits, epsilon and forgetfulness: counts and estimates; estimates are null without resolutions.

    ``strict`` raises at the first line that can't be evaluated; a log of one's own making needs no such pass.
    """
    for b in bits:
        K.check_bits(b)
    grid = list(product(bits, forgetting))
    configs = [(m, e) for m in range(len(grid)) for e in epsilons]
    for m, e in configs:
        K.Bandit(K.Model(1 << grid[m][0], grid[m][1]), 1.0, epsilon=e)  # refuses what is out of range
    lines = Timeline(log, order, key, chunk)
    if strict:
        lines.refuse()
    events = lines.events(True)
    carry = fold.carry_rows(events, fold.chunk_counts(events), grid)
    sums = _sums(fold.weights(events, carry, grid, configs), ["key", "config"])
    counts = lines.rows.groupBy("key").agg(F.sum((F.col("event") == "decision").cast("bigint")).alias("decisions"), F.sum(F.col("open").cast("bigint")).alias("unresolved"))
    if not key:  # an empty log has its row too
        counts = lines.rows.agg(F.lit(0).alias("key"), F.coalesce(F.sum((F.col("event") == "decision").cast("bigint")), F.lit(0)).alias("decisions"), F.coalesce(F.sum(F.col("open").cast("bigint")), F.lit(0)).alias("unresolved"))
    asked = [F.struct(F.lit(i).alias("config"), F.lit(grid[m][0]).alias("bits"), F.lit(e).alias("epsilon"), F.lit(grid[m][1]).alias("forgetfulness")) for i, (m, e) in enumerate(configs)]
    every = counts.select("key", "decisions", "unresolved", F.explode(F.array(*asked)).alias("c")).select("key", "decisions", "unresolved", "c.*")
    found = sums.select(F.col("key").alias("_key"), F.col("config").alias("_config"), "x.*")
    joined = every.join(found, every.key.eqNullSafe(found._key) & (F.col("config") == F.col("_config")), "left")
    shown = lambda c: c if digits is None else F.round(c, digits)
    n = F.col("n")
    return joined.select(
        *([F.col("key").alias(key)] if key else []), "bits", "epsilon", "forgetfulness", "decisions", F.coalesce(n, F.lit(0).cast("bigint")).alias("resolved"), "unresolved",
        shown(F.col("r") / n).alias("logged_mean"), shown(F.col("sr") / n).alias("ips"), shown(F.when(F.col("s") > 0, F.col("sr") / F.col("s"))).alias("snips"),
        shown(F.when(F.col("ss") > 0, F.col("s") * F.col("s") / F.col("ss"))).alias("ess"), shown(F.col("top")).alias("max_weight"),
    )


def replay(log: DataFrame, order: list[str], *, bits: int, horizon: float, forgetting: float = K.DEFAULTS["forgetting"], default_reward: float = 0.0, epsilon: float = K.DEFAULTS["epsilon"], key: str | None = None, chunk: int = fold.CHUNK, strict: bool = False) -> DataFrame:
    """One row for each key (or one): state as hex, next_seq, model_version. Logged choices and rewards, no draws, an empty ledger."""
    K.create(bits, horizon, default_reward, epsilon, forgetting)  # refuses what is out of range
    lines = Timeline(log, order, key, chunk)
    if strict:
        lines.refuse(propensities=False)
    events = lines.events(False)
    counts = fold.chunk_counts(events)
    model = bits, forgetting
    seq = F.regexp_extract("decision_id", "[^:]*$", 0)
    valid = seq.rlike("^[0-9]{1,20}$") & (F.when(seq.rlike("^[0-9]{1,20}$"), seq).cast("decimal(20,0)") < F.lit(str(K.MASK)).cast("decimal(20,0)"))
    after = F.when(valid, seq.cast("decimal(20,0)") + 1).otherwise(F.raise_error(F.concat(F.lit("malformed decision id '"), F.col("decision_id"), F.lit("'"))).cast("decimal(20,0)"))
    per = [F.max(F.when(F.col("event") == "decision", after)).alias("s"), F.sum(F.col("effective").cast("bigint")).alias("u")]
    heads = lines.rows.groupBy("key").agg(*per) if key else lines.rows.agg(F.lit(0).alias("key"), *per)
    heads = heads.select("key", F.coalesce(F.col("s").cast("decimal(20,0)").cast("string"), F.lit("0")).alias("next_seq"), F.coalesce("u", F.lit(0)).cast("bigint").alias("updates"))
    out = fold.states(events, fold.carry_rows(events, counts, [model]), counts, heads, model, horizon, default_reward, epsilon)
    return out.withColumnRenamed("key", key) if key else out.drop("key")


def bootstrap(log: DataFrame, order: list[str], *, bits: int, epsilon: float = K.DEFAULTS["epsilon"], forgetting: float = K.DEFAULTS["forgetting"], replicates: int = 200, salt: str = "bootstrap", chunk: int = fold.CHUNK) -> DataFrame:
    """(replicate, n, ips, snips): the estimates with each resolved decision taken a Poisson number of times, for so many replicates in one pass.

    The quantiles of the replicates are intervals of the estimates. The model learns from the log as it is.
    """
    K.Bandit(K.Model(1 << bits, forgetting), 1.0, epsilon=epsilon)  # refuses what is out of range
    lines = Timeline(log, order, chunk=chunk)
    events = lines.events(True)
    carry = fold.carry_rows(events, fold.chunk_counts(events), [(bits, forgetting)])
    names = lines.rows.where("event = 'decision' and target is not null").select("key", "chunk", "pos", F.lit("id").alias("event"), F.col("decision_id").alias("context"))
    rows = fold.with_defaults(events).unionByName(fold.with_defaults(names))
    parts = fold.resampled(rows, carry, (bits, forgetting), epsilon, replicates, salt).groupBy("replicate", "name", "k").agg(F.sum("s").alias("s"))
    own = lambda name: F.coalesce(exact.total(F.collect_list(F.when(F.col("name") == name, F.struct("k", "s")))), F.lit(0.0)).alias(name)
    found = parts.groupBy("replicate").agg(F.sum(F.when(F.col("name") == "n", F.col("s"))).alias("n"), own("s"), own("sr"))
    return found.select("replicate", "n", F.when(F.col("n") > 0, F.col("sr") / F.col("n")).alias("ips"), F.when(F.col("s") > 0, F.col("sr") / F.col("s")).alias("snips"))


def rolling_mean(rows: DataFrame, order: list[str], value: str, size: int, out: str = "mean", chunk: int = fold.CHUNK) -> DataFrame:
    """``rows`` with the mean of ``value`` over the last ``size`` rows of the whole table in order, this one included.

    Rows are cut into ranges of places; the last ``size`` - 1 rows of a range also go to the next one, as a halo. So no task sees more than a range and its halo.
    """
    chunk = max(chunk, size)
    placed = in_order(rows, order, "_place")
    itself, halo = F.expr(f"_place div {chunk}"), F.col("_place") % chunk > chunk - size
    both = placed.withColumn("_range", F.explode(F.when(halo, F.array(itself, itself + 1)).otherwise(F.array(itself))))
    mean = F.avg(value).over(Window.partitionBy("_range").orderBy("_place").rowsBetween(1 - size, 0))
    return both.withColumn(out, mean).where(F.col("_range") == itself).drop("_range", "_place")


def running_mean(rows: DataFrame, by: list[str], order: list[str], value: str, size: int) -> Column:
    """Column: mean of ``value`` over the last ``size`` rows of each group, this one included."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0))
