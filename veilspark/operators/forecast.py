"""Charging demand forecast: per-day draws, a minute grid with overnight carry, resampling."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import noise

# Charging powers in kW, minutes of a day.
POWERS = (11.0, 22.0)
DAY = 1440


def parameters(rows: DataFrame, start: str, duration: str, demand: str) -> DataFrame:
    """One row: least and greatest start, duration and demand."""
    return rows.agg(*(f(c).alias(f"{n}_{c}") for c in (start, duration, demand) for n, f in (("min", F.min), ("max", F.max))))


def minute_grid(plans: DataFrame, day: str, start: str, minutes: str, amount: Column) -> DataFrame:
    """day, minute, amount, carried: every minute of every plan; minutes past midnight belong to the next day."""
    each = plans.select(F.col(day).alias("_d"), amount.alias("amount"), F.explode(F.sequence(F.col(start), F.col(start) + F.col(minutes) - F.lit(1))).alias("_m"))
    over = F.floor(F.col("_m") / DAY).cast("long")
    return each.select((F.col("_d") + over).alias("day"), (F.col("_m") - over * DAY).cast("int").alias("minute"), "amount", (over > 0).alias("carried"))


# Mean, deviation and threshold of the decision to charge; share of a range that is a draw's deviation.
CHARGE, SPREAD, TRIES = (0.5, 0.1, 0.8), 0.15, 4


def drawn(spark: SparkSession, params: DataFrame, days: int = 6, sessions: int = 10, seed: int = 0) -> DataFrame:
    """day, session, charge, start, duration, demand, power, minutes of each plan; a plan that does not charge has zeros.

    Start and duration are normal about the middle of their ranges, demand is so too, but not
    below 0 (the first of TRIES draws that is not). params: as from parameters() with columns
    start, duration, demand.
    """
    ids = [F.col("day"), F.col("session")]
    u = lambda what: noise.hashed_uniform(f"{seed}|{what}", *ids)
    pair = lambda what: (u(f"{what}|u"), u(f"{what}|v"))
    middle = lambda c: F.col(f"min_{c}") + (F.col(f"max_{c}") - F.col(f"min_{c}")) * F.lit(0.5)
    spread = lambda c: (F.col(f"max_{c}") - F.col(f"min_{c}")) * F.lit(SPREAD)
    plans = spark.range(days).select(F.col("id").alias("day"), F.explode(F.sequence(F.lit(0), F.lit(sessions - 1))).alias("session"))
    plans = plans.crossJoin(F.broadcast(params.limit(1))).select(
        "day", "session", (noise.normal(*pair("charge"), *CHARGE[:2]) <= CHARGE[2]).alias("charge"),
        F.greatest(noise.normal(*pair("start"), middle("start"), spread("start")), F.lit(0.0)).cast("int").alias("start"),
        F.greatest(noise.normal(*pair("duration"), middle("duration"), spread("duration")), F.lit(0.0)).cast("int").alias("duration"),
        noise.truncated_normal([pair(f"demand{k}") for k in range(TRIES)], middle("demand"), spread("demand"), 0.0).alias("demand"), noise.pick(u("power"), list(POWERS)).alias("power"),
    )
    plans = plans.select("day", "session", "charge", *(F.when(F.col("charge"), F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("start", "duration", "demand", "power")))
    needed = F.ceil(F.col("demand") / F.nullif("power", F.lit(0.0)) * F.lit(60.0)).cast("int")
    return plans.withColumn("minutes", F.coalesce(F.least(needed, F.col("duration")), F.lit(0)))


def simulate(spark: SparkSession, params: DataFrame, days: int = 6, sessions: int = 10, seed: int = 0, window_days: int = 20) -> DataFrame:
    """window, pipo (most charging at once), demand (kWh), power (mean of minutes in use) of the plans of drawn()."""
    plans = drawn(spark, params, days, sessions, seed).where("minutes > 0")
    grid = minute_grid(plans, "day", "start", "minutes", F.col("power"))
    busy = grid.groupBy("day", "minute").agg(F.count(F.lit(1)).alias("pipo"), F.sum("amount").alias("power"))
    window = F.floor(F.col("day") / window_days).cast("long").alias("window")
    return busy.groupBy(window).agg(F.max("pipo").alias("pipo"), F.sum(F.col("power") / 60).alias("demand"), F.avg("power").alias("power"))


def day_seed(now: datetime.datetime | None = None) -> int:
    """Day of the year (UTC): forecasts of one day are alike."""
    return (now or datetime.datetime.now(datetime.UTC)).timetuple().tm_yday


def answer(spark: SparkSession, messages: DataFrame, start: str, duration: str, demand: str, order: str, days: int = 6, seed: int | None = None) -> list[str]:
    """The forecast of a topic as JSON rows, from the parameters of its first ten messages; seeded by the day unless told otherwise."""
    seed = day_seed() if seed is None else seed
    head = messages.orderBy(order).limit(10).select(F.col(start).alias("start"), F.col(duration).alias("duration"), F.col(demand).cast("double").alias("demand"))
    return simulate(spark, parameters(head, "start", "duration", "demand"), days=days, seed=seed).orderBy("window").toJSON().collect()


def utility(original: DataFrame, anonymised: DataFrame) -> DataFrame:
    """Absolute difference of forecast demand by window."""
    return original.select("window", F.col("demand").alias("_a")).join(anonymised.select("window", F.col("demand").alias("_b")), "window").select("window", F.abs(F.col("_a") - F.col("_b")).alias("difference"))
