"""Arrival order: sequence numbers by key, and blocks of rows by count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "seq", slice_of: Column | None = None) -> DataFrame:
    """Rows with their number (from 1) by key in the order given.

    With slice_of, a column that never falls along the order, rows are numbered within (key,
    slice) and shifted by the counts of earlier slices: a key that holds a large share of all
    rows, or no key at all, is then sorted slice by slice in many tasks. A null slice sorts first.
    """
    keys, columns = list(keys), df.columns
    if not keys:  # one row a slice is all that a single task sees
        df, keys = df.withColumn("_whole", F.lit(0)), ["_whole"]
    if slice_of is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).select(*columns, name)
    cut = df.withColumn("_slice", slice_of)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    right = sizes.toDF(*(f"_k{i}" for i in range(len(keys))), "_s", "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice").eqNullSafe(F.col("_s"))]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return cut.withColumn("_within", within).join(right, condition).withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).select(*columns, name)


def newest_first(df: DataFrame, keys: list[str], order: list[str], name: str = "back", slice_of: Column | None = None) -> DataFrame:
    """Rows numbered from the last one of a key; slice_of as in numbered()."""
    counted = numbered(df, keys, order, "_seq", slice_of)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    right = sizes.toDF(*(f"_b{i}" for i in range(len(keys))), "_size")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    return counted.join(right, same).withColumn(name, F.col("_size") - F.col("_seq") + 1).select(*df.columns, name)


def blocks(df: DataFrame, size: int, seq: str = "seq", name: str = "grp") -> DataFrame:
    """Rows with the number (from 0) of their block of size successive rows."""
    return df.withColumn(name, F.floor((F.col(seq) - 1) / F.lit(size)).cast("long"))


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
