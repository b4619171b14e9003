"""Metrics of series of rounds. Sums are exact and don't depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact


def normalized_regret(rounds: DataFrame, by: list[str]) -> DataFrame:
    """(by, normalized): regret as a share of what a uniform choice would have lost, both summed exactly; 0 where that is 0."""
    sums = exact.exact_sums(rounds, by, {"_r": F.col("regret"), "_n": F.col("normalizer")})
    return sums.select(*by, F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_r") / F.col("_n")).alias("normalized"))


def final_window(runs: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """The last max(1, floor(n * share)) rounds of each run."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    n = F.count("*").over(Window.partitionBy(*by))
    return runs.withColumn("_n", n).where(F.col("t") >= F.col("_n") - F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n")


def recovery_time(runs: DataFrame, by: list[str], event: int, window: int = 100, share: float = 0.9) -> DataFrame:
    """(by, recovered): rounds from ``event`` to the first whose forward window earns the share of the best; null if none does."""
    if window < 1:
        raise ValueError("window must be at least one round")
    ahead = Window.partitionBy(*by).orderBy("t").rowsBetween(0, window - 1)
    earned, best, full = F.avg(F.col("best") - F.col("regret")).over(ahead), F.avg("best").over(ahead), F.count("*").over(ahead) == window
    found = runs.select(*by, "t", (full & (F.col("t") >= event) & (earned >= share * best)).alias("ok"))
    return found.groupBy(*by).agg((F.min(F.when(F.col("ok"), F.col("t"))) - event).alias("recovered"))


def rmse(squared_error: Column) -> Column:
    """Aggregate: null where there is no error, that is without a model."""
    return F.sqrt(F.avg(squared_error))


def median_iqr(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, median, low, high): linear interpolation between neighbours."""
    return values.groupBy(*by).agg(F.percentile(column, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("q")).select(*by, F.col("q")[0].alias("median"), F.col("q")[1].alias("low"), F.col("q")[2].alias("high"))
