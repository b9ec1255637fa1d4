"""Cutting lineage on storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: a temporary folder in local mode, refused on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame, key: str, rows: int = 50_000) -> DataFrame:
    """`df`, a table of few narrow columns, dealt over tasks of about `rows` rows by `key`, for column work that outweighs a shuffle.

    The partitions of a file say nothing about its rows: one row group is read by one task,
    however many splits the file has. So rows are counted, which reads footers alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, -(-df.count() // rows)), key)
