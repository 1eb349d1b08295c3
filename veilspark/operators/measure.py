"""Utility and latency: differences, histograms, summaries, completion, throughput, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.operators.sequence import numbered


def difference(original: DataFrame, anonymised: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows of original with a match in anonymised, the first by order: key and noise = theirs - ours."""
    first = anonymised.groupBy(key).agg(F.min_by(value, order).alias("_theirs"))
    return original.join(first, key).select(key, (F.col("_theirs") - F.col(value)).alias("noise"))


def information_loss(original: DataFrame, anonymised: DataFrame, key: str, value: str) -> DataFrame:
    both = original.select(key, F.col(value).alias("_a")).join(anonymised.select(key, F.col(value).alias("_b")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("loss"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equi-width bins over [min, max]: bin, lo, hi, n; the maximum is in the last bin, equal values are one bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).cast("long")
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", place)
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return counted.select("bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + F.lit(1)) * width).alias("hi"), "n")


def fixed_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins of [lo, hi], the last closed; values outside are not counted."""
    place = F.least(F.floor((F.col("_v") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)), F.lit(bins - 1)).cast("long")
    return df.select(value.alias("_v")).where(F.col("_v").between(lo, hi)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stage_columns(df: DataFrame, key: str, stage: str, when: str, stages: list[str]) -> DataFrame:
    """One row a key with the latest time of each stage."""
    return df.groupBy(key).pivot(stage, stages).agg(F.max(when))


def complete(df: DataFrame, key: str, stage: str, stages: list[str], required: list[str], patience: int) -> DataFrame:
    """Keys that have all stages, or the required ones after at least patience observations."""
    has = lambda wanted: [F.max((F.col(stage) == s).cast("int")) for s in wanted]
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("seen"), F.coalesce(least(has(stages)), F.lit(0)).alias("_all"), F.coalesce(least(has(required)), F.lit(0)).alias("_required"))
    return out.where((F.col("_all") == 1) | ((F.col("_required") == 1) & (F.col("seen") >= patience))).select(key, "seen", (F.col("_all") == 1).alias("complete"))


def cumulative(df: DataFrame, tick: Column, slice_ticks: int = 4096) -> DataFrame:
    """tick (an integer), events up to and including it; every tick between the first and the last has a row.

    Ticks are summed up within slices of slice_ticks, and shifted by the totals of earlier slices:
    the one task that sums all sees a row a slice.
    """
    counted = df.groupBy(tick.cast("long").alias("tick")).agg(F.count(F.lit(1)).alias("_n"))
    cut = lambda c: F.floor(c / F.lit(slice_ticks)).cast("long")
    ends = counted.agg(F.min("tick").alias("_first"), F.max("tick").alias("_last"))
    slices = ends.select("_first", "_last", F.explode(F.sequence(cut(F.col("_first")), cut(F.col("_last")))).alias("_slice"))
    sums = counted.groupBy(cut(F.col("tick")).alias("_slice")).agg(F.sum("_n").alias("_all"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.join(sums, "_slice", "left").withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    lo, hi = F.greatest(F.col("_first"), F.col("_slice") * slice_ticks), F.least(F.col("_last"), (F.col("_slice") + 1) * slice_ticks - 1)
    axis = slices.repartition("_slice").select("_slice", "_before", F.explode(F.sequence(lo, hi)).alias("tick"))
    within = W.partitionBy("_slice").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    return axis.join(counted, "tick", "left").select("tick", (F.sum(F.coalesce("_n", F.lit(0))).over(within) + F.col("_before")).alias("total"))


def latencies(df: DataFrame, id: str, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Seconds between two stage times (epoch milliseconds) by name, for each id."""
    return df.select(id, *(((F.col(b) - F.col(a)) / F.lit(1000.0)).alias(name) for name, (a, b) in spans.items()))


def rate(seconds: Column) -> Column:
    """Messages in 1000 of the time that one takes; null for none."""
    return F.try_divide(F.lit(1000.0), seconds)


def attached(pipe: DataFrame, consumer: DataFrame, id: str, column: str) -> DataFrame:
    """pipe's rows with a column of the consumer's row of the same id, the first of several; null without one."""
    first = consumer.groupBy(id).agg(F.min(column).alias(column))
    return pipe.join(first, id, "left")


def automatic_histogram(df: DataFrame, value: str) -> DataFrame:
    """As histogram(), with ceil(log2 n) + 1 bins for n values."""
    n = df.where(F.col(value).isNotNull()).count()
    return histogram(df, value, max(1, math.ceil(math.log2(n)) + 1) if n else 1)


def bin_label(lo: Column, hi: Column) -> Column:
    """"lo - hi" with two decimals."""
    return F.format_string("%.2f - %.2f", lo, hi)


def resampled(df: DataFrame, seconds: Column, value: str, days: int = 20) -> DataFrame:
    """max, sum and mean by windows of days from the epoch; seconds: epoch seconds."""
    window = F.floor(seconds / F.lit(86400 * days)).cast("long").alias("window")
    return df.groupBy(window).agg(F.max(value).alias("most"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*keys).agg(p.alias("_p")).select(*keys, F.col("_p")[0].alias("q1"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("q3"))


def aligned(df: DataFrame, run: str, runs: list, order: list[str], value: str, slice_of: Column | None = None) -> DataFrame:
    """Several runs side by side: row number, one column a run. With slice_of runs are numbered slice by slice (sequence.numbered)."""
    return numbered(df, [run], order, "nth", slice_of).groupBy("nth").pivot(run, runs).agg(F.first(value))
