"""Exact sums of doubles that merge in any order: a superaccumulator as ordinary aggregation.

A double is a short row of whole numbers, ``limbs``: its part in units of 2^(20 k), for a few neighbouring k. Limbs with an
equal k are added as BIGINTs, with partial sums on the map side, and can't overflow below 2^43 rows. All limbs of a sum, at most
``MOST``, are put together at the end as one integer and rounded once. So a sum is that of the real
numbers, rounded: equal under any partitioning, order or merge of partial sums.

Nulls don't count. A sum of nothing is null. Infinite values and NaN give what adding them gives.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

WIDTH = 20
#: Limbs that the range of doubles can have.
MOST = 110
#: The limb that counts what isn't finite: by its amount 1 for infinity, -1 for its negative, both or more for NaN.
INFINITE, NEGATIVE, NAN = 1_000, 1_001, 1_002
LIMBS = "array<struct<k:int,s:bigint>>"


def limbs(x: Column) -> Column:
    """The limbs of a double as an array; empty for null and 0."""
    x = x.cast("double")
    # far below 1 units would be subnormal: such numbers are scaled up, exactly, and their limbs numbered down
    small = F.abs(x) < F.lit(2.0**-900)
    y = F.abs(x) * F.when(small, F.lit(2.0**300)).otherwise(F.lit(1.0))
    # the logarithm may be off by one at powers of two: a top limb that turns out to be 0 does no harm
    top = F.floor((F.floor(F.log2(y)) + 1) / WIDTH).cast("int")
    sign, shift = F.when(x < 0, -1).otherwise(1).cast("bigint"), F.when(small, 300 // WIDTH).otherwise(0)
    start = F.struct(y.alias("left"), F.array().cast(LIMBS).alias("found"))

    def split(state: Column, j: Column) -> Column:
        unit = F.pow(F.lit(2.0), (top - j) * WIDTH)
        whole = F.floor(state["left"] / unit)
        one = F.struct((top - j - shift).cast("int").alias("k"), (sign * whole.cast("bigint")).alias("s"))
        return F.struct((state["left"] - whole.cast("double") * unit).alias("left"), F.when(whole == 0, state["found"]).otherwise(F.concat(state["found"], F.array(one))).alias("found"))

    finite = F.aggregate(F.sequence(F.lit(0), F.lit(4)), start, split)["found"]
    odd = F.when(F.isnan(x), NAN).when(x == float("inf"), INFINITE).when(x == float("-inf"), NEGATIVE)
    told = F.array(F.struct(odd.cast("int").alias("k"), F.lit(1).cast("bigint").alias("s")))
    return F.when(odd.isNotNull(), told).when(x.isNull() | (x == 0), F.array().cast(LIMBS)).otherwise(finite)


def limbs_of(values) -> dict[int, int]:
    """The limbs of the sum of a numpy array of doubles."""
    import numpy as np

    finite = np.isfinite(values)
    odd = {k: int(n) for k, n in ((INFINITE, (values == np.inf).sum()), (NEGATIVE, (values == -np.inf).sum()), (NAN, np.isnan(values).sum())) if n}
    mantissa, exponent = np.frexp(values[finite])
    whole, low = np.ldexp(mantissa, 53).astype(np.int64), exponent.astype(np.int64) - 53
    k, shift = low // WIDTH, low % WIDTH
    out: dict[int, int] = {}
    sign, left = np.sign(whole), np.abs(whole)
    # the lowest limb takes what its unit leaves room for; the next ones WIDTH bits each
    for j in range(4):
        room = WIDTH - shift if j == 0 else np.full_like(shift, WIDTH)
        part = left & ((1 << room) - 1)
        left = left >> room
        part = part << shift if j == 0 else part
        for unit in np.unique(k):
            total = int((sign * part)[k == unit].sum())
            if total:
                out[int(unit) + j] = out.get(int(unit) + j, 0) + total
    return out | odd


def rounded(parts: list[tuple[int, int]]) -> float | None:
    """The double nearest to a sum of limbs (k, s); ties go to even."""
    odd = {k: s for k, s in parts if k >= INFINITE}
    if odd:
        return math.nan if len(odd) > 1 or NAN in odd else math.inf if INFINITE in odd else -math.inf
    if not parts:
        return 0.0
    low = min(k for k, _ in parts)
    whole = sum(s << WIDTH * (k - low) for k, s in parts)
    try:
        return float(whole << WIDTH * low) if low >= 0 else whole / (1 << -WIDTH * low)
    except OverflowError:
        return math.copysign(math.inf, whole)


@arrow_udf(DoubleType())
def total(parts: pa.Array) -> pa.Array:
    """Column function: ``rounded`` of an array of limbs."""
    return pa.array([None if own is None else rounded([(x["k"], x["s"]) for x in own]) for own in parts.to_pylist()], pa.float64())


def exact_sums(df: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, one exact sum for each of ``values``). Null where a group has no value."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("x")) for name, c in values.items()))
    rows = df.select(*by, F.explode(each).alias("v")).where("v.x is not null")
    # a limb 0 of nothing stands for each value, so that a sum of zeros isn't a sum of nothing
    nothing = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("s")))
    split = rows.select(*by, F.col("v.name").alias("_name"), F.explode(F.concat(limbs(F.col("v.x")), nothing)).alias("l"))
    return assembled(split.groupBy(*by, "_name", F.col("l.k").alias("k")).agg(F.sum("l.s").alias("s")), by, list(values))


def assembled(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, names) from summed limbs (by, _name, k, s). A group has at most MOST limbs for each name."""
    own = lambda name: F.collect_list(F.when(F.col("_name") == name, F.struct("k", "s")))
    found = parts.groupBy(*by).agg(*(own(name).alias(name) for name in names))
    return found.select(*by, *(total(F.when(F.size(name) > 0, F.col(name))).alias(name) for name in names))
