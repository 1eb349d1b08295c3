"""Random draws that depend on a seed and a row's id alone, so repeated tasks give equal rows.

Whoever knows seed and id can take the noise off again: choose the seed at random and keep it
secret where results are published.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_uniform(seed: object, *ids: Column) -> Column:
    """A number in (0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(x.cast("string") for x in ids)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace(0, scale) by the inverse of its distribution function."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.when(u < 0.5, scale * F.log(F.lit(2.0) * u)).otherwise(-scale * F.log(F.lit(2.0) * (F.lit(1.0) - u)))


def normal(u: Column, v: Column, mean: Column | float = 0.0, deviation: Column | float = 1.0) -> Column:
    """Normal draw from two uniform ones."""
    mean, deviation = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, deviation))
    return mean + deviation * F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def truncated_normal(draws: Sequence[tuple[Column, Column]], mean: Column | float, deviation: Column | float, least: float) -> Column:
    """The first of several normal draws that is least at least; least itself where none is."""
    tried = [normal(u, v, mean, deviation) for u, v in draws]
    return F.coalesce(*(F.when(x >= least, x) for x in tried), F.lit(float(least)))


def pick(u: Column, values: list) -> Column:
    """One of the values with equal odds."""
    return F.element_at(F.array(*(F.lit(x) for x in values)), (F.floor(u * F.lit(float(len(values)))) + F.lit(1)).cast("int"))


def integer(u: Column, lo: int, hi: int) -> Column:
    """An integer from lo to hi."""
    return (F.floor(u * F.lit(float(hi - lo + 1))) + F.lit(lo)).cast("int")
