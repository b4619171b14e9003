"""Places and running counts over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def in_order(df: DataFrame, order: list[Column | str], place: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with its place from 0 in a total order, and for each of ``counts`` how many earlier rows satisfy it.

    The rows are range-partitioned and sorted; each partition is numbered by
    itself, and the totals of the partitions before it, a row for each, are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = counts or {}
    given = df.columns
    flags = {f"_f{i}": c.cast("long") for i, c in enumerate(counts.values())}
    sorted_ = df.withColumns(flags).repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbered = written(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(f).alias(f"{f}n") for f in flags))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *(F.coalesce(F.sum(f"{f}n").over(before), F.lit(0)).alias(f"{f}b") for f in flags))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    joined = numbered.join(F.broadcast(offsets), "_part")  # a row for each partition
    own = [(F.col("_b") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(place)]
    own += [(F.coalesce(F.sum(f).over(within), F.lit(0)) + F.col(f"{f}b")).alias(name) for f, name in zip(flags, counts)]
    return joined.select(*given, *own)
