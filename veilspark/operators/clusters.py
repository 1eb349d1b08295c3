"""Clusters of rows: generalisation, checks of privacy, losses, choice of the nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions import ranges

#: Clusters whose distances are held at a time for a tuple.
MAX_CLUSTERS = 1000


def summarised(df: DataFrame, keys: list[str], headers: list[str], pid: str | None = None, sensitive: str | None = None) -> DataFrame:
    """n, and lo_h, hi_h of each header; distinct pids (null counts as one) and sensitive values."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for h in headers:
        aggregates += [F.min(h).alias(f"lo_{h}"), F.max(h).alias(f"hi_{h}")]
    if pid:
        aggregates.append((F.countDistinct(pid) + F.max(F.col(pid).isNull().cast("int"))).cast("long").alias("k_size"))
    if sensitive:
        aggregates.append(F.countDistinct(sensitive).alias("diversity"))
    return df.groupBy(*keys).agg(*aggregates)


def pair(prefix_lo: str, prefix_hi: str) -> ranges.Range:
    return F.col(prefix_lo), F.col(prefix_hi)


def with_global(clusters: DataFrame, rows: DataFrame, headers: list[str]) -> DataFrame:
    """clusters with the range of each header over all rows (one row, broadcast)."""
    whole = rows.agg(*(x for h in headers for x in (F.min(h).alias(f"glo_{h}"), F.max(h).alias(f"ghi_{h}"))))
    return clusters.crossJoin(F.broadcast(whole))


def tumbling_clusters(df: DataFrame, keys: list[str], headers: list[str], size: int) -> DataFrame:
    """Full blocks of size rows (column grp) as clusters; an incomplete last block is withheld."""
    return summarised(df, [*keys, "grp"], headers).where(F.col("n") == size)


def ready(k: int, l: int, strict: bool = False) -> Column:  # noqa: E741
    """Enough tuples and enough sensitive values for release; strict: more than l."""
    return (F.col("n") >= k) & ((F.col("diversity") > l) if strict else (F.col("diversity") >= l))


def splittable(k: int, l: int) -> Column:  # noqa: E741
    return (F.col("k_size") >= 2 * k) & (F.col("diversity") >= l)


def outliers(sizes: DataFrame, size: str = "n") -> DataFrame:
    """sizes with larger (how many clusters are larger) and outlier (more than half are)."""
    spread = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("_same"))
    down = W.orderBy(F.col(size).desc())  # one row a distinct size
    spread = spread.withColumn("larger", F.coalesce(F.sum("_same").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    spread = spread.withColumn("_all", F.sum("_same").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return sizes.join(spread.select(size, "larger", (F.col("larger") > F.floor(F.col("_all") / 2)).alias("outlier")), size)


def nearest(tuples: DataFrame, clusters: DataFrame, headers: list[str], cluster_id: str, most: int | None = None) -> DataFrame:
    """tuples with the cluster of least distance (ties: least id) and that distance.

    The clusters travel as one broadcast row, in blocks of about MAX_CLUSTERS, and the least of each
    block is compared. With most, more clusters than that are an error and not a silent cut.
    """
    count = clusters.count()
    if most is not None and count > most:
        raise ValueError(f"more than {most} clusters")
    block = F.pmod(F.xxhash64(cluster_id), F.lit(max(1, -(-count // MAX_CLUSTERS))))
    blocks = clusters.groupBy(block.alias("_block")).agg(F.collect_list(F.struct(cluster_id, *(f"{p}_{h}" for h in headers for p in ("lo", "hi")))).alias("_clusters"))
    table = blocks.agg(F.collect_list("_clusters").alias("_blocks"))

    def measured(c: Column) -> Column:
        d = ranges.distance([(c[f"lo_{h}"], c[f"hi_{h}"]) for h in headers], [F.col(h) for h in headers])
        return F.struct(d.alias("distance"), c[cluster_id].alias(cluster_id))

    best = F.array_min(F.transform("_blocks", lambda b: F.array_min(F.transform(b, measured))))
    return tuples.crossJoin(F.broadcast(table)).withColumn("_best", best).select(*tuples.columns, F.col("_best")[cluster_id].alias("nearest"), F.col("_best.distance").alias("distance"))


def first_bounding(tuples: DataFrame, published: DataFrame, keys: list[str], headers: list[str], number: str, before: Column, id: str, name: str) -> DataFrame:
    """The least number of a published cluster of the same keys whose ranges hold the tuple; tuples without one are left out.

    A range join on keys; published clusters are bounded by configuration or calendar, so Spark
    broadcasts them where they are small and splits hot keys where they are not. A cluster inside
    an earlier one of its keys is never first and is left out before the join.
    """
    first = W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
    held = [F.collect_list(F.struct(*(f"{p}_{h}" for h in headers for p in ("lo", "hi")))).over(first).alias("_earlier")]
    inside = F.exists("_earlier", lambda c: ranges.every([(c[f"lo_{h}"] <= F.col(f"lo_{h}")) & (F.col(f"hi_{h}") <= c[f"hi_{h}"]) for h in headers]))
    published = published.select("*", *held).where(~inside).drop("_earlier")
    joined = tuples.join(published, keys).where(before & ranges.within([(F.col(f"lo_{h}"), F.col(f"hi_{h}")) for h in headers], [F.col(h) for h in headers]))
    return joined.groupBy(id).agg(F.min(number).alias(name))


def quota_sample(df: DataFrame, bucket: str, order: list[Column], k: int) -> DataFrame:
    """The first rows of each bucket: max(trunc(k * size / all), 1) of them."""
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = df.agg(F.count(F.lit(1)).alias("_all"))
    quota = sizes.crossJoin(F.broadcast(whole)).select(bucket, F.greatest(F.floor(F.lit(k) * F.col("_n") / F.col("_all")), F.lit(1)).alias("quota"))
    # No quota is above k, so Spark keeps k rows a bucket in each task before it shuffles.
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where(F.col("rank") <= max(k, 1))
    return ranked.join(quota, bucket).where("rank <= quota")
