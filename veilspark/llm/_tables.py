"""Written intermediate tables in the folder that all machines share, and size-bounded semi-joins."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset and the master local (tests) a new folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the first round drops what Python held, the second what that held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as Parquet in the shared folder: cuts lineage and outlives executors.

    Callers pass df as an expression where they can, so that free() finds its plan unused. What
    dropped() has not deleted goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._veil_path = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and let Spark clean shuffle files."""
    for table in tables:
        spark, at = table.sparkSession, getattr(table, "_veil_path", None)
        if at:
            path, files = _path(spark, at)
            files.delete(path, True)
    if tables:
        free(tables[0].sparkSession)


#: Text of a bucket of packed rows: what a task of a second pass holds in memory at a time.
BUCKET_BYTES = 16 << 20


def buckets(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Hash buckets of packed rows: so many that each gets about bucket_bytes of the column text, 8 at least.

    The number follows the input alone; a bucket is a task (dealt()), so no task grows with the input.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, math.ceil(total / bucket_bytes))


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """rows with one shuffle partition a bucket; two tables dealt alike are grouped together without a further shuffle."""
    return rows.repartition(n, "bucket")


def sampled(df: DataFrame, rows: int, salt: int, *columns: str) -> DataFrame:
    """At most rows rows of the columns doc_id and columns: in each of rows slots of the hashed doc_id, the row of least hash.

    Tasks send one row a slot to a shuffle, so nothing that grows with df reaches the driver.
    """
    h = F.xxhash64("doc_id", F.lit(salt))
    least = df.groupBy(F.pmod(h, F.lit(rows)).alias("__veil_slot")).agg(F.min(F.struct(h.alias("__veil_hash"), "doc_id", *columns)).alias("r"))
    return least.select("r.__veil_hash", "r.doc_id", *(f"r.{c}" for c in columns))


#: The bitmap of likely() has at most 2**22 bits in 65,536 rows of 64: 1 MB, whatever the input.
BITMAP_BITS = 1 << 22


def _bitmap(wanted: DataFrame, key: str) -> DataFrame:
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITMAP_BITS))
    return (
        wanted.select(slot.alias("__veil_slot"))
        .groupBy(F.shiftright("__veil_slot", 6).alias("__veil_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(__veil_slot & 63 as int)))").alias("__veil_bits"))
    )


def _looked_up(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BITMAP_BITS))
    return rows.withColumn("__veil_slot", slot).withColumn("__veil_word", F.shiftright("__veil_slot", 6)).join(F.broadcast(_bitmap(wanted, key)), "__veil_word", "left")


_MAYBE = "coalesce(shiftright(__veil_bits, cast(__veil_slot & 63 as int)) & 1 = 1, false)"


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose key may be among wanted's: a bitmap of fixed size, broadcast, keeps most others from a shuffle.

    It passes too many rows when it fills up, never too few; an exact join has to follow.
    """
    return _looked_up(rows, key, wanted).where(_MAYBE).select(*rows.columns)


def parted(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among wanted's, and the others."""
    marked = _looked_up(rows, key, wanted)
    return marked.where(_MAYBE).select(*rows.columns), marked.where(f"not {_MAYBE}").select(*rows.columns)


def without(rows: DataFrame, key: str, unwanted: DataFrame) -> DataFrame:
    """rows whose key is null or not among unwanted's; only those the bitmap cannot clear are shuffled."""
    maybe, clear = parted(rows, key, unwanted)
    return clear.unionAll(maybe.join(unwanted.hint("merge"), key, "left_anti").select(*rows.columns))
