"""Readers of the Parquet tables and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder, through Spark's own reader (any store that Spark can open)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: spark.checkpoint.dir, or one of our own in a single-JVM local session where that is unset.

    On a cluster it must be set: no folder is known there that driver and executors share, so RuntimeError is raised.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            configured = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Checkpoints made inside go to a folder of their own, which is deleted at the end: what is to stay is written by then."""
    outer = checkpoint_dir(spark).rstrip("/")
    own = f"{outer}/scratch-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(own)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(outer)
        discard(spark, own)


@contextmanager
def fleeting(df: DataFrame) -> Iterator[DataFrame]:
    """`df` with its lineage cut for the block alone: its checkpoint has a folder of its own, deleted at the end. Checkpoints made inside stay."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    checkpoint_dir(spark)
    outer = context.getCheckpointDir().rpartition("/")[0]  # Spark adds a folder of its own to what is set
    own = f"{outer}/fleeting-{uuid.uuid4().hex}"
    context.setCheckpointDir(own)
    try:
        held = df.checkpoint()
        context.setCheckpointDir(outer)
        yield held
    finally:
        context.setCheckpointDir(outer)
        discard(spark, own)
