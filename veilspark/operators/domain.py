"""Running ranges, quantiles by nearest rank, stability and bounding of a value domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_range(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    so_far = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("lo", F.min(value).over(so_far)).withColumn("hi", F.max(value).over(so_far))


def nearest_rank(n: Column, p: float) -> Column:
    """Rank (from 1) nearest to p * (n - 1) + 1, the lower of two equally near."""
    return F.ceil(F.lit(p) * (n - F.lit(1)) + F.lit(1.0) - F.lit(0.5)).cast("long")


def quantile_rows(df: DataFrame, keys: list[str], value: str, tie: str, probabilities: dict[str, float]) -> DataFrame:
    """Rows with rank by (value, tie), n, and for each name the nearest rank of its probability."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(value, tie))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    for name, p in probabilities.items():
        ranked = ranked.withColumn(name, nearest_rank(F.col("n"), p))
    return ranked


def stability(df: DataFrame, keys: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Coefficient of variation (population) of the last window values; 0 mean gives null."""
    last = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    mean = F.avg(value).over(last)
    return df.withColumn("seen", F.count(value).over(last)).withColumn("cv", F.stddev_pop(value).over(last) / F.nullif(mean, F.lit(0.0)))


def bounded(df: DataFrame, keys: list[str], value: str, tie: str, delta: float) -> DataFrame:
    """Rows between the nearest ranks of (1 - delta) / 2 and (1 + delta) / 2."""
    ranked = quantile_rows(df, keys, value, tie, {"_lo": (1 - delta) / 2, "_hi": (1 + delta) / 2})
    return ranked.where(F.col("rank").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "n")
