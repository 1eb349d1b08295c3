"""Losses and distances of value ranges. A range is a pair of columns (lo, hi)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[Column, Column]


def total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def range_loss(of: Range, whole: Range, weight: float = 1.0) -> Column:
    """weight * width / global width; 0 where the global width is 0."""
    width = F.abs(whole[1] - whole[0])
    return F.when(width == 0, F.lit(0.0)).otherwise(F.lit(float(weight)) * F.abs(of[1] - of[0]) / F.nullif(width, F.lit(0.0)))


def cluster_loss(of: Sequence[Range], whole: Sequence[Range], weights: Sequence[float] | None = None) -> Column:
    return total([range_loss(r, g, w) for r, g, w in zip(of, whole, weights or [1.0] * len(of), strict=True)])


def hull(a: Range, b: Range) -> Range:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def enlargement(of: Sequence[Range], more: Sequence[Range], whole: Sequence[Range], weights: Sequence[float] | None = None) -> Column:
    """Mean loss by header that joining more adds; a tuple is the range (t, t)."""
    grown = [hull(a, b) for a, b in zip(of, more, strict=True)]
    return (cluster_loss(grown, whole, weights) - cluster_loss(of, whole, weights)) / F.lit(float(len(of)))


def loss_with(of: Sequence[Range], more: Sequence[Range], whole: Sequence[Range], weights: Sequence[float] | None = None) -> Column:
    """Loss after joining a cluster's ranges or a tuple's (t, t)."""
    return cluster_loss([hull(a, b) for a, b in zip(of, more, strict=True)], whole, weights)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b by elements of two arrays; 0 where b is 0."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0)))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def raw_enlargement(of: Sequence[Range], values: Sequence[Column]) -> Column:
    """How far the values lie outside the ranges, neither weighted nor normalised."""
    zero = F.lit(0.0)
    return total([F.greatest(zero, v - hi) - F.least(zero, v - lo) for (lo, hi), v in zip(of, values, strict=True)])


def distance(of: Sequence[Range], values: Sequence[Column]) -> Column:
    """Sum of |value - range width|."""
    return total([F.abs(v - F.abs(hi - lo)) for (lo, hi), v in zip(of, values, strict=True)])


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def within(of: Sequence[Range], values: Sequence[Column]) -> Column:
    return every([v.between(lo, hi) for (lo, hi), v in zip(of, values, strict=True)])


def midpoint(of: Range) -> Column:
    return (of[0] + of[1]) / F.lit(2.0)


def sensitivity(of: Range) -> Column:
    """|hi - lo|, 1 where both are equal."""
    return F.when(of[0] == of[1], F.lit(1.0)).otherwise(F.abs(of[1] - of[0]))
