"""Streaming forms, an extension of the batch operators: windowed counts, the latest status, and incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusloom.operators.merging import latest, merge


def events(spark: SparkSession, folder: str, schema: t.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of events; timestamps without a zone are read as UTC, because a watermark needs a zone."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n): events in tumbling windows; what comes later than `late` is left out."""
    counted = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def upsert_latest(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str):
    """Starts the upkeep of a Parquet table of latest rows by key: each batch is reduced, merged and written beside the last version.

    A version is a folder of its own and the newest is the table, so a batch that is run again writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, order)
        if number:
            old = batch.sparkSession.read.parquet(f"{target}/version={number - 1}")
            both = old.unionByName(new.select(*old.columns))
            new = latest(both, keys, order)
        new.write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_paper(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A record table with all rows of the papers in `rows` replaced."""
    kept = table.join(rows.select("paper_id").distinct(), "paper_id", "left_anti")
    return merge(kept, rows, ["record_id"])
