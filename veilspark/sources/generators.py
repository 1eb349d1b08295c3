"""Synthetic streams whose rows depend on a seed and the row number alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.noise import hashed_uniform, integer, laplace, pick

# Fixed values, spelt as in the data.
BUILDINGS = ["Residental", "Commercial", "Healthcare", "Educational"]


def _u(seed: int, what: str):
    return hashed_uniform(f"{seed}|{what}", F.col("id"))


def _name(seed: int, what: str = "id"):
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{what}"), F.col("id").cast("string")))


def ev_sessions(ids: DataFrame, seed: int = 0) -> DataFrame:
    """Charging sessions for rows with a long id."""
    drawn = ids.select(
        "id", _name(seed).alias("ae_session_id"), pick(_u(seed, "building"), BUILDINGS).alias("building_type"), _u(seed, "urban").alias("urbanisation_level"),
        integer(_u(seed, "stations"), 1, 50).alias("number_loading_stations"), integer(_u(seed, "spaces"), 1, 50).alias("number_parking_spaces"),
        integer(_u(seed, "start"), 1, 720).alias("start_time_loading"), _u(seed, "end").alias("_end"),
        (F.lit(10.0) + F.lit(90.0) * _u(seed, "kwh")).alias("kwh"), integer(_u(seed, "potential"), 1000, 10000).alias("loading_potential"),
    )
    end = (F.col("start_time_loading") + F.floor(F.col("_end") * (F.lit(1441) - F.col("start_time_loading")))).cast("int")
    drawn = drawn.withColumn("end_time_loading", end).withColumn("loading_time", F.col("end_time_loading") - F.col("start_time_loading"))
    return drawn.drop("_end", "id")


def ev_usage(ids: DataFrame, seed: int = 0) -> DataFrame:
    scale = F.lit(100.0) + F.lit(900.0) * _u(seed, "scale")
    return ids.select(_name(seed).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("Timestamp"), F.concat(integer(_u(seed, "series"), 0, 99).cast("string"), F.lit("EMobility")).alias("timeseries_id"), F.round(scale * _u(seed, "usage"), 2).alias("evUsage"))


def tenant_power(ids: DataFrame, seed: int = 0, renovated: bool = False) -> DataFrame:
    columns = [_name(seed).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("Datetime"), F.round(F.lit(1000.0) * _u(seed, "power"), 2).alias("Seconds_EnergyConsumption"), integer(_u(seed, "flat"), 1, 40).alias("apartment_number"), pick(_u(seed, "place"), ["north", "east", "south", "west"]).alias("location"), integer(_u(seed, "people"), 1, 6).alias("inhabitants")]
    return ids.select(*columns, *([pick(_u(seed, "state"), ["old", "partly", "renovated"]).alias("development")] if renovated else []))


def renovation(ids: DataFrame, seed: int = 0) -> DataFrame:
    return tenant_power(ids, seed, renovated=True)


def noised_pair(sessions: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Sessions, and the same with Laplace(0, 1) on kwh."""
    u = hashed_uniform(f"{seed}|pair", F.col("ae_session_id"))
    return sessions, sessions.withColumn("kwh", F.col("kwh") + laplace(u, 1.0))


GENERATORS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"ev_sessions": ev_sessions, "ev_usage": ev_usage, "tenant_power": tenant_power, "renovation": renovation}


def generated(name: str, ids: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of a named generator; ids may be spark.range(n) or a rate stream with its value as id."""
    if name not in GENERATORS:
        raise ValueError(f"no generator {name}")
    return GENERATORS[name](ids, seed)
