"""Numbering inside groups of any size: a group that holds a third of all rows is numbered by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """`rows` with their place from 1 inside each group, ascending by `order`, which must tell the rows of a group apart.

    Rows are dealt to ranges of (group, order) by sampled splitters, so a large group spans several ranges. The
    rows of each group in each range are counted, the counts added up over the ranges of a group, and rows are
    numbered inside their range only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", *by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_inside", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)))
    same = [inside[c].eqNullSafe(offsets[c]) for c in ("_range", *by)]
    return inside.join(offsets, same).select(*(inside[c] for c in rows.columns), (F.col("_before") + F.col("_inside")).cast("long").alias(name))
