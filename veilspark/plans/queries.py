"""Queries over the sample tables, one for each operator, and the same in SQL.

events: value is the anonymised field, user_id the individual and key, event_type the sensitive
value, (ts, event_id) the arrival order. Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.config import CastleConfig, DocaConfig, PipelineConfig
from veilspark.functions import noise, ranges
from veilspark.operators import clusters, domain, forecast, measure, messages, sequence
from veilspark.sources import generators, tables
from veilspark.sources.tables import table
from veilspark.streaming import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K, L, BLOCK, EPS, PHI, SEED = 3, 3, 11, 200.0, 0.693148, 42
ORDER = ["ts", "event_id"]

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
_GROUPED = _NUMBERED + f", grouped AS (SELECT *, (seq - 1) // {BLOCK} AS grp FROM numbered)"
_CLUSTERS = _GROUPED + f", cl AS (SELECT user_id, grp, min(value) AS lo, max(value) AS hi, count(*) AS n, count(DISTINCT event_type) AS diversity FROM grouped GROUP BY user_id, grp HAVING count(*) = {BLOCK})"
_WHOLE = "whole AS (SELECT min(value) AS glo, max(value) AS ghi FROM events)"
_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


def _u_sql(what: str, *ids: str) -> str:
    return f"((CAST(('0x' || substr(md5('{what}|' || {" || '|' || ".join(f'CAST({i} AS VARCHAR)' for i in ids)}), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)"


def _laplace_sql(u: str, scale: str) -> str:
    return f"CASE WHEN {u} < 0.5 THEN {scale} * ln(2.0 * {u}) ELSE -({scale}) * ln(2.0 * (1.0 - {u})) END"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def seconds(column: str) -> Column:
    """Epoch seconds of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def r6(column: Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with seq by user; a user with very many rows is numbered day by day."""
    return sequence.numbered(events(spark, d), ["user_id"], ORDER, slice_of=F.to_date("ts"))


def grouped_events(spark: SparkSession, d: str) -> DataFrame:
    return sequence.blocks(numbered_events(spark, d), BLOCK)


def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    made = clusters.summarised(grouped_events(spark, d), ["user_id", "grp"], ["value"], sensitive="event_type")
    return made.where(F.col("n") == BLOCK).withColumnsRenamed({"lo_value": "lo", "hi_value": "hi"})


def with_whole(made: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return made.crossJoin(F.broadcast(events(spark, d).agg(F.min("value").alias("glo"), F.max("value").alias("ghi"))))



def _of() -> list[ranges.Range]:
    return [(F.col("lo"), F.col("hi"))]


def _whole() -> list[ranges.Range]:
    return [(F.col("glo"), F.col("ghi"))]


# Generalisation and checks of privacy.


@query(f"WITH {_CLUSTERS} SELECT user_id, grp, n, round((lo + hi) / 2, 6) AS mid FROM cl")
def castleguard_default(spark: SparkSession, d: str) -> DataFrame:
    return event_clusters(spark, d).select("user_id", "grp", "n", r6(ranges.midpoint((F.col("lo"), F.col("hi"))), "mid"))


@query(f"WITH {_CLUSTERS} SELECT event_id, user_id, grp, lo, hi, round((lo + hi) / 2, 6) AS mid FROM grouped JOIN cl USING (user_id, grp)")
def generalise_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_events(spark, d).select("event_id", "user_id", "grp")
    return rows.join(event_clusters(spark, d).select("user_id", "grp", "lo", "hi"), ["user_id", "grp"]).select("event_id", "user_id", "grp", "lo", "hi", r6((F.col("lo") + F.col("hi")) / 2, "mid"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("hour", F.floor(seconds("ts") / 3600).cast("long"))
    return clusters.summarised(rows, ["hour"], ["value"], pid="user_id", sensitive="event_type")


_HOURS = f"hours AS (SELECT {_EPOCH} // 3600 AS hour, count(*) AS n, count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS k_size, count(DISTINCT event_type) AS diversity FROM events GROUP BY 1)"


@query(f"WITH {_HOURS} SELECT hour, CAST(k_size AS BIGINT) AS k_size FROM hours WHERE k_size >= {K}")
def k_size(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).where(F.col("k_size") >= K).select("hour", "k_size")


@query(f"WITH {_HOURS} SELECT hour, diversity FROM hours WHERE diversity >= {L}")
def l_diversity(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).where(F.col("diversity") >= L).select("hour", "diversity")


@query(f"WITH {_CLUSTERS} SELECT user_id, grp, n, diversity, n >= {K} AND diversity >= {L} AS ready FROM cl")
def cluster_ready(spark: SparkSession, d: str) -> DataFrame:
    return event_clusters(spark, d).select("user_id", "grp", "n", "diversity", clusters.ready(K, L).alias("ready"))


@query(f"WITH {_HOURS} SELECT hour, CAST(k_size AS BIGINT) AS k_size, diversity, k_size >= {2 * K} AND diversity >= {L} AS splittable FROM hours")
def cluster_splittable(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select("hour", "k_size", "diversity", clusters.splittable(K, L).alias("splittable"))


@query(f"WITH {_HOURS} SELECT a.hour, a.n, count(b.hour) AS larger, count(b.hour) > (SELECT count(*) FROM hours) // 2 AS outlier FROM hours a LEFT JOIN hours b ON b.n > a.n GROUP BY a.hour, a.n")
def cluster_outlier(spark: SparkSession, d: str) -> DataFrame:
    return clusters.outliers(hourly(spark, d).select("hour", "n")).select("hour", "n", "larger", "outlier")


# Losses and distances.


@query(f"WITH {_CLUSTERS}, {_WHOLE} SELECT user_id, grp, round((hi - lo) / (ghi - glo), 6) AS loss FROM cl, whole")
def range_loss(spark: SparkSession, d: str) -> DataFrame:
    return with_whole(event_clusters(spark, d), spark, d).select("user_id", "grp", r6(ranges.cluster_loss(_of(), _whole()), "loss"))


def following_tuple(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with the tuple that comes after it."""
    first = numbered_events(spark, d).where(f"(seq - 1) % {BLOCK} = 0").select("user_id", (F.floor((F.col("seq") - 1) / BLOCK) - 1).cast("long").alias("grp"), F.col("value").alias("v"))
    return event_clusters(spark, d).join(first, ["user_id", "grp"])


_NEXT = f"nxt AS (SELECT user_id, (seq - 1) // {BLOCK} - 1 AS grp, value AS v FROM numbered WHERE (seq - 1) % {BLOCK} = 0)"


@query(f"WITH {_CLUSTERS}, {_WHOLE}, {_NEXT} SELECT user_id, grp, v, round((greatest(hi, v) - least(lo, v) - (hi - lo)) / (ghi - glo), 6) AS enlargement FROM cl JOIN nxt USING (user_id, grp), whole")
def tuple_enlargement(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return with_whole(following_tuple(spark, d), spark, d).select("user_id", "grp", "v", r6(ranges.enlargement(_of(), [(v, v)], _whole()), "enlargement"))


@query(f"""WITH {_CLUSTERS}, {_WHOLE}, {_NEXT} SELECT user_id, grp, round((greatest(hi, v) - least(lo, v)) / (ghi - glo), 6) AS loss, round((2.0 * (greatest(hi, v) - least(lo, v)) / (ghi - glo) + 0.5 * n / n), 6) AS weighted,
  CAST(CASE WHEN n - {BLOCK} = 0 THEN 0.0 ELSE n / (n - {BLOCK}) END AS DOUBLE) AS divided, CAST(n + diversity AS DOUBLE) AS total FROM cl JOIN nxt USING (user_id, grp), whole""")
def loss_given_tuple(spark: SparkSession, d: str) -> DataFrame:
    """Loss of a cluster with the tuple that follows it; the same by weight with a second header; division by 0 is 0."""
    v, whole = F.col("v"), (F.lit(0.0), F.lit(1.0))
    rows = with_whole(following_tuple(spark, d), spark, d)
    two = [*_of(), (F.lit(0.0), F.lit(0.5))], [(v, v), (F.lit(0.25), F.lit(0.25))], [*_whole(), whole]
    divided = ranges.safe_divide(F.array("n"), F.array(F.col("n") - BLOCK))[0]
    return rows.select("user_id", "grp", r6(ranges.loss_with(_of(), [(v, v)], _whole()), "loss"), r6(ranges.loss_with(*two, weights=[2.0, 1.0]), "weighted"), divided.alias("divided"), ranges.array_total(F.array("n", "diversity")).alias("total"))


@query(f"WITH {_CLUSTERS}, {_WHOLE} SELECT a.user_id, a.grp, round((greatest(a.hi, b.hi) - least(a.lo, b.lo) - (a.hi - a.lo)) / (ghi - glo), 6) AS enlargement FROM cl a JOIN cl b ON a.user_id = b.user_id AND b.grp = a.grp + 1, whole")
def cluster_enlargement(spark: SparkSession, d: str) -> DataFrame:
    made = event_clusters(spark, d)
    after = made.select("user_id", (F.col("grp") - 1).alias("grp"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = with_whole(made.join(after, ["user_id", "grp"]), spark, d)
    return both.select("user_id", "grp", r6(ranges.enlargement(_of(), [(F.col("lo2"), F.col("hi2"))], _whole()), "enlargement"))


@query(f"WITH {_CLUSTERS}, {_NEXT} SELECT user_id, grp, round(abs(v - abs(hi - lo)), 6) AS distance FROM cl JOIN nxt USING (user_id, grp)")
def cluster_distance(spark: SparkSession, d: str) -> DataFrame:
    return following_tuple(spark, d).select("user_id", "grp", r6(ranges.distance(_of(), [F.col("v")]), "distance"))


@query(f"WITH {_CLUSTERS} SELECT g.event_id, g.value BETWEEN c.lo AND c.hi AS within FROM grouped g JOIN cl c ON c.user_id = g.user_id AND c.grp = g.grp - 1")
def within_bounds(spark: SparkSession, d: str) -> DataFrame:
    before = event_clusters(spark, d).select("user_id", (F.col("grp") + 1).alias("grp"), "lo", "hi")
    return grouped_events(spark, d).join(before, ["user_id", "grp"]).select("event_id", ranges.within(_of(), [F.col("value")]).alias("within"))


_DAILY = f"daily AS (SELECT event_type, {_EPOCH} // 86400 AS day, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2)"


@query(f"""WITH {_DAILY}, e AS (SELECT event_id, event_type, value, {_EPOCH} // 86400 AS today FROM events)
SELECT event_id, min(day) AS reused FROM e JOIN daily USING (event_type) WHERE day < today AND value BETWEEN lo AND hi GROUP BY event_id""")
def bounds_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first published cluster (a day and type) before a tuple's day whose range holds the tuple."""
    rows = events(spark, d).withColumn("day", F.floor(seconds("ts") / 86400).cast("long"))
    published = clusters.summarised(rows, ["event_type", "day"], ["value"])
    return clusters.first_bounding(rows.withColumnRenamed("day", "today"), published, ["event_type"], ["value"], "day", F.col("day") < F.col("today"), "event_id", "reused")


@query("SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def available_pids(spark: SparkSession, d: str) -> DataFrame:
    used = events(spark, d).where("event_type = 'error' and value > 100").select("user_id").distinct()
    return events(spark, d).join(used, "user_id", "left_anti").select("event_id", "user_id", "value")


@query("""WITH cl AS (SELECT l_suppkey AS c, min(l_quantity) AS lo1, max(l_quantity) AS hi1, min(l_tax) AS lo2, max(l_tax) AS hi2 FROM lineitem GROUP BY 1),
t AS (SELECT DISTINCT l_quantity AS q, l_tax AS x FROM lineitem),
m AS (SELECT q, x, c, abs(q - abs(hi1 - lo1)) + abs(x - abs(hi2 - lo2)) AS dist, row_number() OVER (PARTITION BY q, x ORDER BY abs(q - abs(hi1 - lo1)) + abs(x - abs(hi2 - lo2)), c) AS nth FROM t, cl)
SELECT l_orderkey, l_linenumber, c AS nearest, round(dist, 6) AS distance FROM lineitem JOIN m ON q = l_quantity AND x = l_tax WHERE nth = 1""")
def nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Every order line's nearest of the suppliers' ranges; equal values are measured once."""
    rows = table(spark, d, "lineitem")
    made = clusters.summarised(rows, ["l_suppkey"], ["l_quantity", "l_tax"])
    found = clusters.nearest(rows.select("l_quantity", "l_tax").distinct(), made, ["l_quantity", "l_tax"], "l_suppkey")
    found = rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").join(found, ["l_quantity", "l_tax"])
    return found.select("l_orderkey", "l_linenumber", "nearest", r6(F.col("distance"), "distance"))


# Running ranges, quantiles, domains.

_SO_FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, min(value) {_SO_FAR} AS lo, max(value) {_SO_FAR} AS hi FROM events")
def running_ranges(spark: SparkSession, d: str) -> DataFrame:
    return domain.running_range(events(spark, d), ["user_id"], ORDER, "value").select("event_id", "lo", "hi")


@query(f"SELECT event_id, round(CASE WHEN min(value) {_SO_FAR} = max(value) {_SO_FAR} THEN 1.0 ELSE max(value) {_SO_FAR} - min(value) {_SO_FAR} END, 6) AS sensitivity FROM events")
def running_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return domain.running_range(events(spark, d), ["user_id"], ORDER, "value").select("event_id", r6(ranges.sensitivity((F.col("lo"), F.col("hi"))), "sensitivity"))


@query(f"WITH {_CLUSTERS}, {_WHOLE}, l AS (SELECT user_id, grp, (hi - lo) / (ghi - glo) AS loss FROM cl, whole) SELECT user_id, grp, round(avg(loss) OVER (PARTITION BY user_id ORDER BY grp ROWS BETWEEN 79 PRECEDING AND CURRENT ROW), 6) AS tau FROM l")
def tau_last80(spark: SparkSession, d: str) -> DataFrame:
    lost = with_whole(event_clusters(spark, d), spark, d).withColumn("loss", ranges.cluster_loss(_of(), _whole()))
    return lost.select("user_id", "grp", r6(F.avg("loss").over(W.partitionBy("user_id").orderBy("grp").rowsBetween(-79, 0)), "tau"))


@query(f"WITH {_CLUSTERS}, {_WHOLE}, l AS (SELECT user_id, grp, (hi - lo) / (ghi - glo) AS loss FROM cl, whole) SELECT user_id, grp, round(sum(loss) OVER (PARTITION BY user_id ORDER BY grp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS total FROM l")
def tau_sum_last5(spark: SparkSession, d: str) -> DataFrame:
    lost = with_whole(event_clusters(spark, d), spark, d).withColumn("loss", ranges.cluster_loss(_of(), _whole()))
    return lost.select("user_id", "grp", r6(F.sum("loss").over(W.partitionBy("user_id").orderBy("grp").rowsBetween(-4, 0)), "total"))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@query(f"WITH {_RANKED} SELECT user_id, n, value AS p10 FROM ranked WHERE rank = CAST(ceil(0.1 * (n - 1) + 1.0 - 0.5) AS BIGINT)")
def nearest_rank_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.quantile_rows(events(spark, d), ["user_id"], "value", "event_id", {"p": 0.1})
    return rows.where("rank = p").select("user_id", "n", F.col("value").alias("p10"))


_LAST = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, count(value) {_LAST} AS seen, round(stddev_pop(value) {_LAST} / nullif(avg(value) {_LAST}, 0), 6) AS cv FROM events")
def domain_stability_cv(spark: SparkSession, d: str) -> DataFrame:
    return domain.stability(events(spark, d), ["user_id"], ORDER, "value", 200).select("event_id", "seen", r6(F.col("cv"), "cv"))


@query(f"WITH {_RANKED} SELECT event_id, user_id, value, rank FROM ranked WHERE rank BETWEEN CAST(ceil(0.125 * (n - 1) + 1.0 - 0.5) AS BIGINT) AND CAST(ceil(0.875 * (n - 1) + 1.0 - 0.5) AS BIGINT)")
def domain_bounding(spark: SparkSession, d: str) -> DataFrame:
    return domain.bounded(events(spark, d), ["user_id"], "value", "event_id", 0.75).select("event_id", "user_id", "value", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CLUSTERS}, m AS (SELECT user_id, grp, avg(value) AS mean FROM grouped GROUP BY user_id, grp HAVING count(*) = {BLOCK}) SELECT event_id, round(mean, 6) AS value FROM grouped JOIN m USING (user_id, grp)")
def microaggregate_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_events(spark, d)
    means = rows.groupBy("user_id", "grp").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).where(F.col("n") == BLOCK)
    return rows.select("event_id", "user_id", "grp").join(means, ["user_id", "grp"]).select("event_id", r6(F.col("mean"), "value"))


# Noise and sampling.


def _u(what: str, *ids: str) -> Column:
    return noise.hashed_uniform(f"{SEED}|{what}", *(F.col(i) for i in ids))


_NOISED = f"value + ({_laplace_sql(_u_sql(f'{SEED}|laplace', 'event_id'), f'(1.0 / {PHI})')})"


@query(f"SELECT event_id, round({_NOISED}, 6) AS value FROM events")
def laplace_noise(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(F.col("value") + noise.laplace(_u("laplace", "event_id"), 1.0 / PHI), "value"))


@query(f"SELECT event_id, round(value + {_u_sql(f'{SEED}|uniform', 'event_id')} - 0.5, 6) AS value FROM events")
def uniform_noise(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(F.col("value") + _u("uniform", "event_id") - 0.5, "value"))


@query(f"SELECT event_id, value FROM events WHERE {_u_sql(f'{SEED}|keep', 'event_id')} <= 0.7")
def beta_sampling(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(_u("keep", "event_id") <= 0.7).select("event_id", "value")


@query(f"SELECT event_id, round(value + ({_u_sql(f'{SEED}|alt', 'event_id')} - 0.5) / {EPS}, 6) AS value FROM events")
def doca_alternative(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", r6(F.col("value") + (_u("alt", "event_id") - 0.5) / EPS, "value"))


@query(f"""WITH {_CLUSTERS}, m AS (SELECT user_id, grp, avg(value) AS mean, CASE WHEN min(value) = max(value) THEN 1.0 ELSE max(value) - min(value) END AS sens FROM grouped GROUP BY user_id, grp HAVING count(*) = {BLOCK})
SELECT user_id, grp, round(mean + ({_laplace_sql(_u_sql(f'{SEED}|release', 'user_id', 'grp'), f'(sens / {BLOCK}.0 / {EPS})')}), 6) AS value FROM m""")
def doca_release_noised(spark: SparkSession, d: str) -> DataFrame:
    made = grouped_events(spark, d).groupBy("user_id", "grp").agg(F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") == BLOCK)
    scale = ranges.sensitivity((F.col("lo"), F.col("hi"))) / F.col("n") / EPS
    return made.select("user_id", "grp", r6(F.col("mean") + noise.laplace(_u("release", "user_id", "grp"), scale), "value"))


@query(f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_u_sql(f'{SEED}|pid', 'event_id')}, event_id) AS nth FROM events) WHERE nth = 1")
def sample_per_pid(spark: SparkSession, d: str) -> DataFrame:
    best = events(spark, d).groupBy("user_id").agg(F.min(F.struct(_u("pid", "event_id").alias("u"), "event_id", "value")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query("""WITH s AS (SELECT event_type, greatest(floor(10 * count(*) / (SELECT count(*) FROM events)), 1) AS quota FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events)
SELECT event_type, event_id, value, rank FROM r JOIN s USING (event_type) WHERE rank <= quota""")
def bucket_quota_topk(spark: SparkSession, d: str) -> DataFrame:
    return clusters.quota_sample(events(spark, d), "event_type", [F.col("value"), F.col("event_id")], 10).select("event_type", "event_id", "value", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT event_id, value FROM events ORDER BY {_u_sql(f'{SEED}|some', 'event_id')}, event_id LIMIT 50")
def sample_without_replacement(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).orderBy(_u("some", "event_id"), "event_id").limit(50).select("event_id", "value")


# Utility, histograms, latency.


@query(f"WITH {_CLUSTERS} SELECT count(*) AS n, round(sum(abs(value - (lo + hi) / 2)), 4) AS loss FROM grouped JOIN cl USING (user_id, grp)")
def info_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_events(spark, d).select("event_id", "user_id", "grp")
    theirs = rows.join(event_clusters(spark, d), ["user_id", "grp"]).select("event_id", ((F.col("lo") + F.col("hi")) / 2).alias("value"))
    return measure.information_loss(events(spark, d), theirs, "event_id", "value").select("n", F.round("loss", 4).alias("loss"))


def _noised(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("value", F.col("value") + noise.laplace(_u("laplace", "event_id"), 1.0 / PHI))


@query(f"""WITH b AS (SELECT event_id, {_NOISED} - value AS noise FROM events), e AS (SELECT min(noise) AS lo, max(noise) AS hi FROM b)
SELECT least(CAST(floor((noise - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin, count(*) AS n FROM b, e GROUP BY 1""")
def compare_noise_hist(spark: SparkSession, d: str) -> DataFrame:
    compared = measure.difference(events(spark, d), _noised(spark, d), "event_id", "value", "ts")
    return measure.histogram(compared, "noise").select("bin", "n")


_PAIR = _laplace_sql(_u_sql("42|pair", "md5('42|id|' || event_id)"), "1.0")


@query(f"SELECT md5('42|id|' || event_id) AS ae_session_id, round(value, 6) AS input, round(value + ({_PAIR}), 6) AS output FROM events")
def dual_topics(spark: SparkSession, d: str) -> DataFrame:
    """Every row sent to two topics, one with noise, and brought together again by id."""
    rows = events(spark, d).select(F.md5(F.concat_ws("|", F.lit(f"{SEED}|id"), F.col("event_id").cast("string"))).alias("ae_session_id"), F.col("value").alias("kwh"), "ts")
    one, two = generators.noised_pair(rows, SEED)
    both = measure.difference(one, two, "ae_session_id", "kwh", "ts").join(one.select("ae_session_id", "kwh"), "ae_session_id")
    return both.select("ae_session_id", r6(F.col("kwh"), "input"), r6(F.col("kwh") + F.col("noise"), "output"))


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT bin, round(lo + bin * ((hi - lo) / 10), 4) AS lo, round(lo + (bin + 1) * ((hi - lo) / 10), 4) AS hi, n FROM c, e""")
def value_histogram10(spark: SparkSession, d: str) -> DataFrame:
    return measure.histogram(table(spark, d, "lineitem"), "l_extendedprice").select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


def _latency(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to ship date, by order line; may be negative."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = F.datediff("l_shipdate", "o_orderdate").cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "o_orderpriority", days.alias("days"))


_LATENCY = "lat AS (SELECT o_orderkey, l_linenumber, o_orderpriority, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_LATENCY} SELECT least(CAST(floor(days / 250.0 * 9.0 / 10.0) AS BIGINT), 8) AS bin, count(*) AS n FROM lat WHERE days / 250.0 BETWEEN 0 AND 10 GROUP BY 1")
def latency_histogram9(spark: SparkSession, d: str) -> DataFrame:
    return measure.fixed_histogram(_latency(spark, d), F.col("days") / F.lit(250.0), 0.0, 10.0, 9)


STAGES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"max(CASE WHEN event_type = '{s}' THEN {_EPOCH} END) AS {s}" for s in STAGES) + " FROM events GROUP BY user_id")
def latency_stages(spark: SparkSession, d: str) -> DataFrame:
    return measure.stage_columns(events(spark, d).withColumn("at", seconds("ts")), "user_id", "event_type", "at", STAGES)


@query(f"WITH {_LATENCY} SELECT o_orderpriority, count(*) AS n, round(median(days), 6) AS median, round(stddev_samp(days), 6) AS deviation FROM lat GROUP BY 1")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return _latency(spark, d).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("days", 0.5), 6).alias("median"), F.round(F.stddev_samp("days"), 6).alias("deviation"))


@query(f"WITH {_LATENCY} SELECT o_orderpriority, round(quantile_cont(days, 0.25), 6) AS q1, round(quantile_cont(days, 0.5), 6) AS median, round(quantile_cont(days, 0.75), 6) AS q3 FROM (SELECT * FROM lat ORDER BY o_orderkey, l_linenumber, days LIMIT 8000) GROUP BY 1")
def latency_quartiles(spark: SparkSession, d: str) -> DataFrame:
    head = _latency(spark, d).orderBy("o_orderkey", "l_linenumber", "days").limit(8000)
    return measure.quartiles(head, ["o_orderpriority"], "days").select("o_orderpriority", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3")))


_MOMENTS = "moments AS (SELECT l_orderkey AS id, l_linenumber AS line, epoch_ms(o_orderdate) AS producer, epoch_ms(o_orderdate) + 60000 * l_linenumber AS pipe_entry, epoch_ms(l_shipdate) AS pipe_exit, min(epoch_ms(l_shipdate) + CAST(1000 * l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_linenumber) AS consumer FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_MOMENTS} SELECT id, line, round((pipe_exit - pipe_entry) / 1000.0, 6) AS pipe, round((consumer - producer) / 1000.0, 6) AS e2e, round(1000.0::DOUBLE / nullif((pipe_exit - pipe_entry) / 1000.0::DOUBLE, 0), 12) AS throughput FROM moments")
def stage_latencies(spark: SparkSession, d: str) -> DataFrame:
    """Seconds in the pipe and from end to end, and the throughput they stand for; the consumer's times come from a table of their own, the first of an id."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = table(spark, d, "lineitem").join(orders, "l_orderkey").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    ms = lambda c: seconds(c) * 1000
    pipe = rows.select("id", F.col("l_orderkey"), F.col("l_linenumber"), ms("o_orderdate").alias("producer"), (ms("o_orderdate") + 60000 * F.col("l_linenumber")).alias("pipe_entry"), ms("l_shipdate").alias("pipe_exit"))
    consumer = rows.select("id", (ms("l_shipdate") + (1000 * F.col("l_quantity")).cast("long")).alias("consumer"))
    whole = measure.attached(pipe, consumer, "id", "consumer")
    took = measure.latencies(whole, "id", {"pipe": ("pipe_entry", "pipe_exit"), "e2e": ("producer", "consumer")})
    parts = F.split("id", "-")
    return took.select(parts[0].cast("long").alias("id"), parts[1].cast("int").alias("line"), r6(F.col("pipe"), "pipe"), r6(F.col("e2e"), "e2e"), F.round(measure.rate(F.col("pipe")), 12).alias("throughput"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, CAST(ceil(log2(count(value))) + 1 AS BIGINT) AS bins FROM events),
c AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / bins)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT bin, format('{:.2f} - {:.2f}', lo + bin * ((hi - lo) / bins), lo + (bin + 1) * ((hi - lo) / bins)) AS label, n FROM c, e""")
def automatic_bins(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of all values in as many bins as their number asks for, labelled."""
    return measure.automatic_histogram(events(spark, d), "value").select("bin", measure.bin_label(F.col("lo"), F.col("hi")).alias("label"), "n")


@query(f"WITH {_LATENCY} SELECT count(*) AS n, CAST(sum(CASE WHEN days < 0 THEN 1 ELSE 0 END) AS BIGINT) AS lossy, bool_or(days < 0) AS violated FROM lat")
def lossy_rows(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("days") < 0
    return _latency(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("lossy"), F.bool_or(bad).alias("violated"))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id OFFSET 500")
def skip_warm_up(spark: SparkSession, d: str) -> DataFrame:
    """All but the first 500 events."""
    return sequence.numbered(events(spark, d), [], ORDER, slice_of=F.to_date("ts")).where("seq > 500").select("event_id", "value")


@query(f"SELECT user_id, event_id, {_EPOCH} - first_value({_EPOCH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rebased FROM events")
def rebase_times(spark: SparkSession, d: str) -> DataFrame:
    at = seconds("ts")
    return events(spark, d).select("user_id", "event_id", (at - F.first(at).over(W.partitionBy("user_id").orderBy(*ORDER))).alias("rebased"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events) SELECT nth, " + ", ".join(f"max(CASE WHEN event_type = '{s}' THEN value END) AS {s}" for s in STAGES) + " FROM r GROUP BY nth")
def align_runs(spark: SparkSession, d: str) -> DataFrame:
    return measure.aligned(events(spark, d), "event_type", STAGES, ORDER, "value", slice_of=F.to_date("ts"))


@query("""WITH c AS (SELECT user_id, count(*) AS seen, count(DISTINCT event_type) AS kinds, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) + max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS required FROM events GROUP BY 1)
SELECT user_id, seen, kinds = 5 AS complete FROM c WHERE kinds = 5 OR (required = 2 AND seen >= 50)""")
def metrics_completion(spark: SparkSession, d: str) -> DataFrame:
    return measure.complete(events(spark, d), "user_id", "event_type", STAGES, ["click", "view"], 50)


@query(f"WITH c AS (SELECT {_EPOCH} // 3600 AS tick, count(*) AS n FROM events GROUP BY 1), a AS (SELECT unnest(range((SELECT min(tick) FROM c), (SELECT max(tick) FROM c) + 1)) AS tick) SELECT tick, CAST(sum(coalesce(n, 0)) OVER (ORDER BY tick) AS BIGINT) AS total FROM a LEFT JOIN c USING (tick)")
def cumulative_throughput(spark: SparkSession, d: str) -> DataFrame:
    return measure.cumulative(events(spark, d), F.floor(seconds("ts") / 3600))


# Forecast.

_START = f"CAST({_EPOCH} % 86400 // 60 AS INTEGER)"
_PLANS = f"plans AS (SELECT {_EPOCH} // 86400 AS day, {_START} AS start, 1 + CAST(json_extract(props, '$.k') AS INTEGER) AS minutes, value FROM events)"


def _plans(spark: SparkSession, d: str) -> DataFrame:
    at = seconds("ts")
    return events(spark, d).select(F.floor(at / 86400).cast("long").alias("day"), F.floor(at % 86400 / 60).cast("int").alias("start"), (F.get_json_object("props", "$.k").cast("int") + 1).alias("minutes"), "value")


@query(f"WITH {_PLANS} SELECT min(start) AS min_start, max(start) AS max_start, min(minutes) AS min_minutes, max(minutes) AS max_minutes, min(value) AS min_value, max(value) AS max_value FROM plans")
def forecast_params(spark: SparkSession, d: str) -> DataFrame:
    return forecast.parameters(_plans(spark, d), "start", "minutes", "value")


@query(f"SELECT {_EPOCH} // 1728000 AS window, max(value) AS most, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def resample_20d(spark: SparkSession, d: str) -> DataFrame:
    return measure.resampled(events(spark, d), seconds("ts"), "value").select("window", "most", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query(f"""WITH {_PLANS}, m AS (SELECT day, unnest(range(start, start + minutes)) AS m FROM plans), g AS (SELECT day + m // 1440 AS day, m % 1440 AS minute, m >= 1440 AS carried FROM m)
SELECT day, count(*) AS used, count(DISTINCT minute) AS minutes, CAST(sum(CASE WHEN carried THEN 1 ELSE 0 END) AS BIGINT) AS carried FROM g GROUP BY day""")
def overnight_carry(spark: SparkSession, d: str) -> DataFrame:
    grid = forecast.minute_grid(_plans(spark, d), "day", "start", "minutes", F.col("value"))
    return grid.groupBy("day").agg(F.count(F.lit(1)).alias("used"), F.countDistinct("minute").alias("minutes"), F.sum(F.col("carried").cast("long")).alias("carried"))


def _normal_sql(what: str, mean: str, deviation: str) -> str:
    u, v = (_u_sql(f"{SEED}|{what}|{x}", "day", "session") for x in "uv")
    return f"({mean} + {deviation} * sqrt(-2.0 * ln({u})) * cos(2 * pi() * {v}))"


def _about(c: str) -> tuple[str, str]:
    return f"(min_{c} + (max_{c} - min_{c}) * 0.5)", f"((max_{c} - min_{c}) * 0.15)"


_TRIED = ", ".join(f"CASE WHEN {x} >= 0 THEN {x} END" for x in (_normal_sql(f"demand{k}", *_about("demand")) for k in range(4)))
_DRAWN = f"""{_PLANS}, params AS (SELECT min(start) AS min_start, max(start) AS max_start, min(minutes) AS min_duration, max(minutes) AS max_duration, min(value) AS min_demand, max(value) AS max_demand FROM plans),
drawn AS (
  SELECT day, session, {_normal_sql('charge', '0.5', '0.1')} <= 0.8 AS charge, CAST(trunc(greatest({_normal_sql('start', *_about('start'))}, 0)) AS INTEGER) AS start,
    CAST(trunc(greatest({_normal_sql('duration', *_about('duration'))}, 0)) AS INTEGER) AS duration, coalesce({_TRIED}, 0.0) AS demand,
    CASE WHEN floor({_u_sql('42|power', 'day', 'session')} * 2) = 0 THEN 11.0 ELSE 22.0 END AS power
  FROM (SELECT unnest(range(60)) AS day), (SELECT unnest(range(10)) AS session), params)"""


@query(f"WITH {_DRAWN} SELECT day, session, charge, CASE WHEN charge THEN start ELSE 0 END AS start, CASE WHEN charge THEN duration ELSE 0 END AS duration, round(CASE WHEN charge THEN demand ELSE 0 END, 4) AS demand, CAST(CASE WHEN charge THEN power ELSE 0 END AS DOUBLE) AS power FROM drawn")
def forecast_draws(spark: SparkSession, d: str) -> DataFrame:
    """Decisions to charge, starts, durations, demands and powers of each day's sessions."""
    plans = _plans(spark, d).select("start", F.col("minutes").alias("duration"), F.col("value").alias("demand"))
    drawn = forecast.drawn(spark, forecast.parameters(plans, "start", "duration", "demand"), days=60, seed=SEED)
    return drawn.select("day", F.col("session").cast("long").alias("session"), "charge", "start", "duration", F.round("demand", 4).alias("demand"), F.col("power").cast("double").alias("power"))


@query(f"""WITH {_DRAWN}, sized AS (SELECT day, start, power, least(CAST(ceil(demand / power * 60.0) AS INTEGER), duration) AS minutes FROM drawn WHERE charge),
m AS (SELECT day, power, unnest(range(start, start + minutes)) AS m FROM sized WHERE minutes > 0),
busy AS (SELECT day + m // 1440 AS day, m % 1440 AS minute, count(*) AS pipo, sum(power) AS power FROM m GROUP BY 1, 2)
SELECT CAST(day // 20 AS BIGINT) AS window, max(pipo) AS pipo, round(sum(power / 60), 4) AS demand, round(avg(power), 6) AS power FROM busy GROUP BY 1""")
def ev_forecast(spark: SparkSession, d: str) -> DataFrame:
    plans = _plans(spark, d).select("start", F.col("minutes").alias("duration"), F.col("value").alias("demand"))
    made = forecast.simulate(spark, forecast.parameters(plans, "start", "duration", "demand"), days=60, seed=SEED)
    return made.select("window", "pipo", F.round("demand", 4).alias("demand"), r6(F.col("power"), "power"))


# Messages.


def _message() -> Column:
    return F.to_json(F.struct("event_id", "user_id", "event_type", F.col("value").alias("kwh")))


@query("SELECT event_id, value AS kwh, CAST(user_id AS VARCHAR) AS user_id, event_type, 3 AS others FROM events")
def passthrough_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", _message().alias("m"))
    rows = rows.select("event_id", *messages.numeric_fields(F.col("m"), ["kwh"]), messages.passed_through(F.col("m"), ["kwh"]).alias("p"))
    return rows.select("event_id", "kwh", F.col("p")["user_id"].alias("user_id"), F.col("p")["event_type"].alias("event_type"), F.size("p").alias("others"))


@query("""SELECT event_id, '{"id":"' || event_id || '","kwh":' || CAST(CAST(value AS FLOAT) AS VARCHAR) || ',"event_type":"' || event_type || '"}' AS item FROM events""")
def to_json_item(spark: SparkSession, d: str) -> DataFrame:
    """Items with their value as a 32-bit float."""
    passed = F.create_map(F.lit("event_type"), F.col("event_type"))
    return events(spark, d).select("event_id", messages.item_json(F.col("event_id"), {"kwh": F.col("value")}, passed).alias("item"))


@query("SELECT event_id, round(value, 6) AS kwh, CAST(0.0 AS DOUBLE) AS power, event_type = 'click' AS clicked, 3 AS fields FROM events")
def output_headers(spark: SparkSession, d: str) -> DataFrame:
    """Items by headers: a header that is missing is 0; one dropped, one set, one added."""
    item = F.create_map(F.lit("kwh"), F.col("value").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("pid"), F.col("user_id").cast("string"))
    changed = messages.edited(item, drop=["pid"], put={"kind": F.upper("event_type"), "sent": F.lit("1")})
    rows = events(spark, d).select("event_id", changed.alias("item"))
    return rows.select("event_id", *messages.projected(F.col("item"), ["kwh", "power"]), (F.col("item")["kind"] == "CLICK").alias("clicked"), F.size("item").alias("fields")).withColumn("kwh", F.round("kwh", 6))


@query("SELECT event_id AS id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def without_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id has not been removed; the user's choice of id and value columns."""
    rows = events(spark, d)
    return messages.chosen(messages.without_ids(rows, rows.where("event_type = 'error'"), "event_id"), "event_id", "value")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def payload_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are empty (errors), an array of two objects (purchases), or one object."""
    p = F.col("props")
    payload = F.when(F.col("event_type") == "error", F.lit("[]")).when(F.col("event_type") == "purchase", F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).otherwise(p)
    rows = events(spark, d).select("event_id", payload.alias("payload"))
    return messages.payload_items(rows, "payload", "k:bigint").select("event_id", "item.k")


@query("""WITH o AS (SELECT event_id, value, event_type, row_number() OVER (ORDER BY event_type <> 'click' AND event_type <> 'view', ts, event_id) AS seq FROM events)
SELECT event_id, seq, value AS kwh, event_type FROM o""")
def history_append(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and views as a history that is written, then all others appended to it; read back by number."""
    rows, at = events(spark, d), tables.scratch(spark, "history")
    early = "event_type in ('click', 'view')"
    append = lambda old, new: tables.append_history(old, new, ORDER, slice_of=F.to_date("ts")).select("event_id", "seq", F.col("value").alias("kwh"), "event_type")
    tables.write(append(None, rows.where(early)), "parquet", at)
    tables.write(append(spark.read.parquet(at), rows.where(f"not {early}")), "parquet", at)
    return tables.read_history(spark, at)


@query("SELECT p_partkey, replace(replace(p_name, 'e', '3'), 'o', '0') || ' X' AS sent FROM part")
def interceptor_produce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", messages.produced(F.col("p_name")).alias("sent"))


@query("SELECT event_id, replace(replace(event_type || props, 'e', '3'), '4', 'x') AS got FROM events")
def interceptor_consume(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", messages.consumed(F.concat("event_type", "props")).alias("got"))


@query("SELECT c_custkey, CASE WHEN regexp_full_match(regexp_replace(CAST(c_acctbal AS VARCHAR), '[.,]', '', 'g'), '[0-9]+') THEN c_acctbal END AS number, CASE WHEN NOT regexp_full_match(regexp_replace(CAST(c_acctbal AS VARCHAR), '[.,]', '', 'g'), '[0-9]+') THEN CAST(c_acctbal AS VARCHAR) END AS text FROM customer")
def csv_coercion(spark: SparkSession, d: str) -> DataFrame:
    number, text = messages.number_or_text(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", number.alias("number"), text.alias("text"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 100")
def latest_100(spark: SparkSession, d: str) -> DataFrame:
    return sequence.last_rows(events(spark, d), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 100).select("user_id", "event_id", "value")


@query(f"WITH {_NUMBERED} SELECT user_id, (seq - 1) // 4 AS grp, min(value) AS lo, max(value) AS hi FROM numbered GROUP BY 1, 2 HAVING count(*) = 4")
def batch_of_4(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.blocks(numbered_events(spark, d), 4)
    return clusters.tumbling_clusters(rows, ["user_id"], ["value"], 4).select("user_id", "grp", F.col("lo_value").alias("lo"), F.col("hi_value").alias("hi"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered from a user's last one, the order in which they are shown."""
    return sequence.newest_first(events(spark, d), ["user_id"], ORDER, slice_of=F.to_date("ts")).select("user_id", "event_id", "back")


@query("SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 10")
def first_messages(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_messages(events(spark, d), ORDER).select("event_id", "user_id", "value")


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase' GROUP BY 1")
def topic_average(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'purchase'").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH ids AS (SELECT o_orderkey AS id FROM orders), s AS (SELECT id, 1 + CAST(floor({_u_sql('42|start', 'id')} * 720.0) AS INTEGER) AS st FROM ids)
SELECT md5('42|id|' || id) AS ae_session_id, 1 + CAST(floor({_u_sql('42|stations', 'id')} * 50.0) AS INTEGER) AS number_loading_stations, st AS start_time_loading,
  CAST(st + floor({_u_sql('42|end', 'id')} * (1441 - st)) AS INTEGER) AS end_time_loading, round(10.0 + 90.0 * {_u_sql('42|kwh', 'id')}, 6) AS kwh FROM s""")
def generate_ev_sessions(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return generators.ev_sessions(ids, SEED).select("ae_session_id", "number_loading_stations", "start_time_loading", "end_time_loading", r6(F.col("kwh"), "kwh"))


# Stateful algorithms.


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumnRenamed("value", "kwh")


def _castle(spark: SparkSession, d: str, config: CastleConfig, key: str = "user_id", pid: str | None = None, sensitive: str = "event_type", flush: bool = False) -> DataFrame:
    return adapters.anonymise_batch(adapters.prepared(_arrivals(spark, d), config, key, "event_id", "ts", sensitive, pid), config, flush)


@query()
def castleguard(spark: SparkSession, d: str) -> DataFrame:
    return _castle(spark, d, CastleConfig(k=5, l=2, delta=20))


@query(f"WITH {_CLUSTERS} SELECT CAST(event_id AS VARCHAR) AS id, round((lo + hi) / 2, 6) AS kwh FROM grouped JOIN cl USING (user_id, grp)")
def castleguard_shipped(spark: SparkSession, d: str) -> DataFrame:
    """Observed behaviour of the default configuration: equals castleguard_default, row by row."""
    return _castle(spark, d, CastleConfig(shipped=True), sensitive="kwh").select("id", r6(F.col("kwh"), "kwh"))


@query()
def castleguard_split(spark: SparkSession, d: str) -> DataFrame:
    return _castle(spark, d, CastleConfig(k=3, l=2, delta=60, beta=2), key="event_type", pid="user_id", sensitive="user_id")


@query()
def castleguard_dp(spark: SparkSession, d: str) -> DataFrame:
    return _castle(spark, d, CastleConfig(k=5, l=2, delta=20, noise=True, sample=0.8, seed=SEED))


@query()
def doca(spark: SparkSession, d: str) -> DataFrame:
    config = DocaConfig(delay=30, seed=SEED)
    return adapters.anonymise_batch(adapters.prepared(_arrivals(spark, d), config, "user_id", "event_id", "ts"), config)


@query()
def doca_bounded(spark: SparkSession, d: str) -> DataFrame:
    config = DocaConfig(delay=30, delta=0.8, seed=SEED)
    return adapters.anonymise_batch(adapters.prepared(_arrivals(spark, d), config, "event_type", "event_id", "ts"), config)


def _streamed(spark: SparkSession, d: str, config: CastleConfig | DocaConfig, name: str, sensitive: str | None) -> DataFrame:
    """Runs a file stream to its end and returns what it wrote, from the shared folder."""
    at = tables.scratch(spark, name)
    schema = events(spark, d).schema
    rows = tables.stream(spark, "parquet", f"{d}/events.parquet", schema).withColumnRenamed("value", "kwh")
    released = adapters.anonymise_stream(adapters.prepared(rows, config, "user_id", "event_id", "ts", sensitive), config)
    running = tables.write_stream(released, "parquet", f"{at}/rows", f"{at}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(released.schema).parquet(f"{at}/rows")


@query()
def castleguard_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, CastleConfig(k=5, l=2, delta=20), "castleguard", "event_type")


@query()
def doca_stream(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, DocaConfig(delay=30, seed=SEED), "doca", None)


# From messages to items, and what holds of all that is released.


@query(f"""WITH {_CLUSTERS} SELECT CAST(event_id AS VARCHAR) AS id, '{{"id":"' || event_id || '","kwh":' || CAST(CAST((lo + hi) / 2 AS FLOAT) AS VARCHAR) || ',"at":"' || CAST({_EPOCH} * 1000000 + event_id AS VARCHAR) || '","user_id":"' || user_id || '","event_type":"' || event_type || '"}}' AS value
FROM grouped JOIN cl USING (user_id, grp)""")
def piped_items(spark: SparkSession, d: str) -> DataFrame:
    """From end to end: JSON messages in a topic, parsed, anonymised as configured, written as items to a sink and read back."""
    config = PipelineConfig.from_properties("input-topic=events\noutput-topic=items\nalgorithm=castleguard\nanonymized_fields=kwh\nid=event_id\nkey=user_id\norder=at")
    rows = events(spark, d).select("event_id", F.col("value").alias("kwh"), (seconds("ts") * 1000000 + F.col("event_id")).alias("at"), "user_id", "event_type")
    at = tables.scratch(spark, config.sink)
    sent = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    done = adapters.piped(sent, "value", config, CastleConfig(shipped=True), sensitive="kwh")
    tables.write(done, "parquet", at)
    return spark.read.schema(done.schema).parquet(at).select("id", "value")


@query(f"SELECT CAST(event_id AS VARCHAR) AS id, round(value + ({_u_sql(f'{SEED}|alt|kwh', 'event_id')} - 0.5) / {EPS}, 6) AS kwh FROM events")
def doca_alt_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The algorithm that a pipeline names: the alternative for histories that are given as a whole."""
    config = dataclasses.replace(adapters.by_name(PipelineConfig(algorithm="doca-alt")), seed=SEED)
    return adapters.anonymise(adapters.prepared(_arrivals(spark, d), config, "user_id", "event_id", "ts"), config).select("id", r6(F.col("kwh"), "kwh"))


def _held(spark: SparkSession, d: str, released: DataFrame, k: int, l: int, pid: str | None, sensitive: str, exact: bool) -> DataFrame:  # noqa: E741
    """One row of what must hold of released tuples: individuals and sensitive values of each cluster, ranges, each tuple once."""
    given = events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("_given"), F.col(pid or "event_id").alias("_pid"), F.col(sensitive).alias("_sensitive"))
    rows = released.join(given, "id", "left")
    inside = F.col("_given").between(F.col("lo_kwh") - 1e-9, F.col("hi_kwh") + 1e-9) if exact else F.lit(True)
    fine = inside & (F.abs(F.col("kwh") - (F.col("lo_kwh") + F.col("hi_kwh")) / 2) < 1e-9) & F.col("spc_kwh").between(F.col("lo_kwh"), F.col("hi_kwh")) & F.col("_given").isNotNull()
    made = rows.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("_pid").alias("k"), F.countDistinct("_sensitive").alias("l"), F.bool_and(fine).alias("fine"), F.max("size").alias("size"))
    return made.agg(F.bool_and(F.col("k") >= k).alias("k_held"), F.bool_and(F.col("l") >= l).alias("l_held"), F.bool_and("fine").alias("contained"), F.bool_and((F.col("n") >= F.col("size")) & (F.col("n") == F.col("ids"))).alias("once"), (F.sum("n") > 0).alias("released"))


_HELD = "SELECT true AS k_held, true AS l_held, true AS contained, true AS once, true AS released"


@query(_HELD)
def castleguard_holds(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, castleguard(spark, d), 5, 2, None, "event_type", True)


@query(_HELD)
def castleguard_split_holds(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, castleguard_split(spark, d), 3, 2, "user_id", "user_id", True)


@query(_HELD)
def castleguard_dp_holds(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, castleguard_dp(spark, d), 5, 2, None, "event_type", False)


@query(_HELD)
def castleguard_stream_holds(spark: SparkSession, d: str) -> DataFrame:
    return _held(spark, d, castleguard_stream(spark, d), 5, 2, None, "event_type", True)


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(count(*) AS BIGINT) AS once, true AS alike FROM events GROUP BY 1")
def doca_holds(spark: SparkSession, d: str) -> DataFrame:
    """With flush every tuple of a key is released once, and all of a cluster with one value."""
    config = DocaConfig(delay=30, seed=SEED)
    made = adapters.anonymise_batch(adapters.prepared(_arrivals(spark, d), config, "user_id", "event_id", "ts"), config, flush=True)
    of_cluster = made.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), ((F.min("kwh") == F.max("kwh")) & (F.max("size") == F.count(F.lit(1)))).alias("alike"))
    return of_cluster.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ids").alias("once"), F.bool_and("alike").alias("alike"))


@query("SELECT count(DISTINCT event_type) AS keys, true AS inside, true AS alike, true AS once FROM events")
def doca_bounded_holds(spark: SparkSession, d: str) -> DataFrame:
    """Bounded domains release at most what came, each tuple once, a cluster with one value."""
    given = events(spark, d).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("given"))
    made = doca_bounded(spark, d).groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), (F.min("kwh") == F.max("kwh")).alias("alike"))
    by_key = given.join(made.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.bool_and("alike").alias("alike")), "key", "left")
    return by_key.agg(F.count(F.lit(1)).alias("keys"), F.bool_and(F.coalesce("n", F.lit(0)) <= F.col("given")).alias("inside"), F.bool_and(F.coalesce("alike", F.lit(True))).alias("alike"), F.bool_and(F.coalesce(F.col("n") == F.col("ids"), F.lit(True))).alias("once"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id, true AS equal FROM events")
def doca_stream_holds(spark: SparkSession, d: str) -> DataFrame:
    """The stream releases what the batch does; tuples that neither has released count as equal."""
    batch = doca(spark, d).select("id", F.col("kwh").alias("_batch"))
    live = doca_stream(spark, d).select("id", F.col("kwh").alias("_live"))
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("id"))
    return rows.join(batch, "id", "left").join(live, "id", "left").select("key", "id", F.col("_batch").eqNullSafe(F.col("_live")).alias("equal"))
