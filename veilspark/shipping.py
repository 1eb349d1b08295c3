"""Prepares a session: the package on its executors, and Arrow batches that suit long texts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip file, once a Spark context.

    Arrow batches are set to 1,000 rows where the session has Spark's 10,000: that many long
    texts would stand in memory twice, in the JVM and in Python.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if getattr(context, "_veilspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="veilspark-"), "veilspark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("veilspark", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._veilspark_shipped = True
