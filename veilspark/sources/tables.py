"""Sources and sinks behind one interface; Kafka where its connector is present."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilspark.operators.sequence import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalogue(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables (topics) in a folder, as Spark's file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName().removesuffix(".parquet") for x in found if x.getPath().getName().endswith(".parquet"))


def runs(spark: SparkSession, pattern: str, schema: str | StructType) -> DataFrame:
    """CSV files of several benchmark runs, each row with its file's name as run."""
    return read(spark, "csv", pattern, schema).withColumn("run", F.regexp_extract(F.input_file_name(), "([^/]+)[.]csv$", 1))


def sample_csv(df: DataFrame, path: str, n: int) -> None:
    """The first n rows with a header."""
    write(df.limit(n).coalesce(1), "csv", path, "overwrite")


def read(spark: SparkSession, kind: str, path: str, schema: str | StructType | None = None, **options: str) -> DataFrame:
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


def stream(spark: SparkSession, kind: str, path: str, schema: str | StructType | None = None, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Kafka: path is the topic; `kafka.bootstrap.servers` among the options."""
    reader = spark.readStream.format(kind).options(**options)
    if kind == "kafka":
        return reader.option("subscribe", path).load().selectExpr("cast(key as string) key", "cast(value as string) value", "timestamp")
    if kind == "csv":
        reader = reader.option("header", True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isFile():  # a file stream reads folders
        reader, path = reader.option("pathGlobFilter", folder.getName()), folder.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, kind: str, path: str, mode: str = "append", **options: str) -> None:
    writer = df.write.mode(mode).options(**options)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def write_stream(df: DataFrame, kind: str, path: str, checkpoint: str, mode: str = "append", **options: str):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True)
    if kind == "kafka":
        return writer.format("kafka").option("topic", path).start()
    if kind == "memory":
        return writer.format("memory").queryName(path).start()
    return writer.format(kind).option("path", path).start()


def write_stream_csv(df: DataFrame, path: str, checkpoint: str):
    """Completed metrics as CSV files with a header, one folder a micro-batch, written once each."""

    def put(batch: DataFrame, number: int) -> None:
        write(batch, "csv", f"{path}/batch={number}", "overwrite")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name that all machines share; it is deleted when the driver ends.

    It lies in spark.checkpoint.dir. Where that is unset a folder of this machine serves a local
    master; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    at = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def first_messages(df: DataFrame, offset: str | list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*([offset] if isinstance(offset, str) else offset)).limit(n)


def tagged(df: DataFrame, stage: str) -> DataFrame:
    """df with the time a row passes a stage, in epoch milliseconds."""
    return df.withColumn(stage, F.unix_millis(F.current_timestamp()))


def produced(rows: DataFrame, key: str) -> DataFrame:
    """Rows as messages: key, and value as a JSON object that has the time of sending as producer_timestamp."""
    sent = tagged(rows, "producer_timestamp")
    return sent.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sent.columns)).alias("value"))


def observed(df: DataFrame, name: str, headers: list[str]) -> tuple[DataFrame, Observation]:
    """df, and the range of each header as it is measured while df is used."""
    seen = Observation(name)
    return df.observe(seen, *(x for h in headers for x in (F.min(h).alias(f"lo_{h}"), F.max(h).alias(f"hi_{h}")))), seen


def append_history(history: DataFrame | None, rows: DataFrame, order: str | list[str], slice_of: Column | None = None) -> DataFrame:
    """rows with sequence numbers that go on from the history's greatest.

    slice_of as in sequence.numbered(): a column of few values (a day) that never falls along the
    order, so that each slice is a task's work.
    """
    start = 0 if history is None else (history.agg(F.max("seq")).first()[0] or 0)
    return numbered(rows, [], [order] if isinstance(order, str) else order, slice_of=slice_of).withColumn("seq", F.col("seq") + F.lit(start))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A history table in the order of its numbers."""
    return spark.read.parquet(path).orderBy("seq")
