"""Batch and streaming adapters of the stateful cores.

Both keep one core a key. The batch adapter deals rows by key, sorts them in arrival order and
streams through the sorted batches, so memory holds one key's state and not its rows. The
streaming adapter keeps the pickled state in Spark's state store; rows of a micro-batch are
taken in arrival order. A key's tail that cannot be released stays withheld unless flush is set.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.config import CastleConfig, DocaAltConfig, DocaConfig, PipelineConfig
from veilspark.functions.noise import hashed_uniform
from veilspark.operators.messages import item_json, numeric_fields
from veilspark.streaming.castle import Castle, Item
from veilspark.streaming.doca import Doca

Core = Castle | Doca


def large_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB instead of executors' heaps; for streams with very many keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def registered(config: CastleConfig | DocaConfig) -> Callable[[object], Core]:
    """Core of a configuration, given a state or None."""
    kinds = {CastleConfig: Castle, DocaConfig: Doca}
    if type(config) not in kinds:
        raise ValueError(f"no algorithm for {type(config).__name__}")
    return lambda state: kinds[type(config)](config, state)


def by_name(pipeline: PipelineConfig) -> CastleConfig | DocaConfig | DocaAltConfig:
    """Default configuration of the algorithm that a pipeline names."""
    if pipeline.algorithm == "castleguard":
        return CastleConfig(headers=pipeline.anonymized_fields, sensitive=pipeline.anonymized_fields[0], weights=pipeline.weights)
    kind = DocaAltConfig if pipeline.algorithm == "doca-alt" else DocaConfig
    return kind(headers=pipeline.anonymized_fields, weights=pipeline.weights)


def output_schema(config: CastleConfig | DocaConfig, key_type: str = "string") -> str:
    """key, id, the headers, with CASTLEGUARD the range and a random member's value of each, cluster, size, what was passed through."""
    values = ", ".join(f"{h} double" for h in config.headers)
    ranges = "".join(f", lo_{h} double, spc_{h} double, hi_{h} double" for h in config.headers) if isinstance(config, CastleConfig) else ""
    return f"key {key_type}, id string, {values}{ranges}, cluster long, size long, passed string"


def _items(rows: pd.DataFrame, config: CastleConfig | DocaConfig) -> Iterator[Item]:
    columns = ["id", *config.headers, "sensitive", "pid", "passed"]
    for record in rows[columns].itertuples(index=False, name=None):
        values = {h: float(v) for h, v in zip(config.headers, record[1:-3], strict=True)}
        yield Item(str(record[0]), values, *record[-3:])


def _frame(key: object, released: list, config: CastleConfig | DocaConfig) -> pd.DataFrame:
    rows = []
    for r in released:
        row = [key, r.id, *(r.values[h] for h in config.headers)]
        if isinstance(config, CastleConfig):
            row += [x for h in config.headers for x in (r.ranges[h][0], r.sample[h], r.ranges[h][1])]
        rows.append((*row, r.cluster, r.size, r.passed))
    names = [x.split()[0] for x in output_schema(config).split(", ")]
    return pd.DataFrame(rows, columns=names)


def prepared(df: DataFrame, config: CastleConfig | DocaConfig, key: str, id: str, order: str, sensitive: str | None = None, pid: str | None = None, passed: Column | None = None) -> DataFrame:
    """Columns key, id, order_, the headers (null: 0), sensitive, pid, and what is passed through unchanged (a string)."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.col(id).cast("string").alias("id"), F.col(order).alias("order_"), F.col(id).alias("tie_"),
        *(F.coalesce(F.col(h).cast("double"), F.lit(0.0)).alias(h) for h in config.headers),
        (F.col(sensitive) if sensitive else F.lit(None)).cast("string").alias("sensitive"), (F.col(pid) if pid else F.lit(None)).cast("string").alias("pid"), (F.lit(None) if passed is None else passed).cast("string").alias("passed"),
    )


def uniformly_noised(df: DataFrame, config: DocaAltConfig) -> DataFrame:
    """df as from prepared(); every tuple with uniform noise on each header, row by row."""
    noised = [(F.col(h) + (hashed_uniform(f"{config.seed}|alt|{h}", F.col("id")) - F.lit(0.5)) / F.lit(config.eps)).alias(h) for h in config.headers]
    return df.select("key", "id", *noised, F.lit(0).cast("long").alias("cluster"), F.lit(1).cast("long").alias("size"), "passed")


def anonymise(df: DataFrame, config: CastleConfig | DocaConfig | DocaAltConfig, flush: bool = False) -> DataFrame:
    """By whatever algorithm the configuration is of; a streaming df is anonymised as a stream."""
    if isinstance(config, DocaAltConfig):
        return uniformly_noised(df, config)
    return anonymise_stream(df, config) if df.isStreaming else anonymise_batch(df, config, flush)


def piped(messages: DataFrame, message: str, pipeline: PipelineConfig, config: CastleConfig | DocaConfig | DocaAltConfig | None = None, sensitive: str | None = None, pid: str | None = None, flush: bool = False) -> DataFrame:
    """JSON messages to JSON items: parse, anonymise the configured fields, write id, these and all other fields.

    key string (of the message), id string, value string (the item). Messages that are no JSON
    object are left out; one without an anonymised field is an error.
    """
    config = config or by_name(pipeline)
    text = F.col(message)
    whole = F.from_json(text, "map<string,string>")
    field = lambda name: F.try_element_at(F.col("_whole"), F.lit(name))
    rows = messages.where(whole.isNotNull()).withColumn("_whole", whole)
    rows = rows.select(
        *numeric_fields(text, list(config.headers)), field(pipeline.id).alias("_id"), (field(pipeline.key) if pipeline.key else F.lit("")).alias("_key"),
        field(pipeline.order).cast("long").alias("_order"), (field(sensitive) if sensitive else F.lit(None)).alias("_sensitive"), (field(pid) if pid else F.lit(None)).alias("_pid"),
        F.to_json(F.map_filter("_whole", lambda k, _: ~k.isin(pipeline.id, *config.headers))).alias("_passed"),
    )
    done = anonymise(prepared(rows, config, "_key", "_id", "_order", "_sensitive" if sensitive else None, "_pid" if pid else None, F.col("_passed")), config, flush)
    item = item_json(F.col("id"), {h: F.col(h) for h in config.headers}, F.from_json("passed", "map<string,string>"))
    return done.select("key", "id", item.alias("value"))


def anonymise_batch(df: DataFrame, config: CastleConfig | DocaConfig, flush: bool = False) -> DataFrame:
    """df as from prepared(); released tuples of all keys. A key is one task's work: choose keys so fine that the largest fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, core, now = registered(config), None, None
        for batch in batches:
            for key, rows in batch.groupby("key", sort=False, dropna=False):
                out = []
                if core is None or key != now:
                    if core is not None and flush and (rest := core.flush()):
                        yield _frame(now, rest, config)
                    core, now = make(None), key
                for item in _items(rows, config):
                    out += core.push(item)
                if out:
                    yield _frame(key, out, config)
        if core is not None and flush and (rest := core.flush()):
            yield _frame(now, rest, config)

    keyed = df.withColumn("key", F.coalesce("key", F.lit("")))
    return keyed.repartition("key").sortWithinPartitions("key", "order_", "tie_").mapInPandas(run, output_schema(config))


def anonymise_stream(df: DataFrame, config: CastleConfig | DocaConfig) -> DataFrame:
    """As anonymise_batch() for a streaming df, without flush; rows late by a micro-batch are taken when they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        core = registered(config)(pickle.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["order_", "tie_"], kind="stable")
        out = []
        for item in _items(rows, config):
            out += core.push(item)
        state.update((pickle.dumps(core.s),))
        if out:
            yield _frame(key[0], out, config)

    keyed = df.withColumn("key", F.coalesce("key", F.lit("")))
    return keyed.groupBy("key").applyInPandasWithState(run, output_schema(config), "blob binary", "append", "NoTimeout")


def complete_stream(df: DataFrame, stages: list[str], required: list[str], patience: int) -> DataFrame:
    """Rows (id, stage, at) to one row an id once all stages came, or the required ones and patience observations.

    An id leaves the state when its row is written; observations after that begin anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, times = pickle.loads(state.get[0]) if state.exists else (0, {})
        for batch in batches:
            for stage, at in zip(batch["stage"], batch["at"], strict=True):
                seen += 1
                times[stage] = max(at, times.get(stage, at))
        whole = all(s in times for s in stages)
        if whole or (all(s in times for s in required) and seen >= patience):
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], seen, whole, *(times.get(s) for s in stages))], columns=["id", "seen", "complete", *stages])
        else:
            state.update((pickle.dumps((seen, times)),))

    schema = "id string, seen long, complete boolean, " + ", ".join(f"{s} long" for s in stages)
    return df.selectExpr("cast(id as string) id", "stage", "cast(at as long) at").groupBy("id").applyInPandasWithState(run, schema, "blob binary", "append", "NoTimeout")
