"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes
what a stage returns as Parquet in the shared folder and reads it again as the next one's docs.
All stages but the last return the columns of documents.

Documents that the quality rules reject go, line dedup changes text and n_chars, of each group
of near-copies the document of least doc_id stays, documents that hold a benchmark window go,
and the last stage returns doc_id, the SentencePiece ids of each text, the bytes of the text that
each spans, and the digest of what the ids decode to. Rows that share a doc_id go together. Rows without doc_id pass the near-copy stage uncompared, and the
decontamination stage uncut. A null text is rejected by the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _tables
from veilspark.llm.leaks import find_leaks
from veilspark.llm.lines import remove_repeated_chunks
from veilspark.llm.nearcopies import near_copies
from veilspark.llm.pieces import tokenise
from veilspark.llm.quality import filter_quality
from veilspark.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    left = remove_repeated_chunks(docs).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    copies = _tables.written(near_copies(docs).where("not kept").select("doc_id").distinct(), "copies")
    return _tables.without(docs, "doc_id", copies)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = _tables.written(found.where("n_hit > 0 and doc_id is not null").select("doc_id").distinct(), "leaks")
    return _tables.without(docs, "doc_id", hit)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return tokenise(docs, spans=True, decoded=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("tokens", tokens)]
#: The forest of the first stage is not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _tables.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
