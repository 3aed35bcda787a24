"""Keyed merges, patches, work lists, latest rows and coalesced sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new`, and those of `old` whose keys it does not have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`. An aggregate, so a key with a third of all rows is reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def todo(wanted: DataFrame, status: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Wanted rows that are not done yet, nor failed unless those are tried again. `status` has a latest row for each key."""
    closed = ["done"] if retry_failed else ["done", "failed", "no_pdf"]
    return wanted.join(status.where(F.col("status").isin(closed)).select(key), key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """`rows` with those of `patch` in their place where the key is in scope; what is out of scope stays as it is."""
    inside = patch.join(scope.select(key).distinct(), key, "left_semi")
    replaced = inside.join(rows.select(key), key, "left_semi")
    return merge(rows, replaced, [key])


def out_of_scope(patch: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """The keys that a patch touches without leave."""
    return patch.select(key).distinct().join(scope.select(key), key, "left_anti")


def invalidated(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """`pairs` (target, paper) with whether a mark names the pair, its paper or its target alone (nulls in a mark name all)."""
    both = marks.where("target is not null and paper is not null").select("target", "paper").distinct().withColumn("_b", F.lit(True))
    paper = marks.where("target is null and paper is not null").select("paper").distinct().withColumn("_p", F.lit(True))
    target = marks.where("target is not null and paper is null").select("target").distinct().withColumn("_t", F.lit(True))
    told = pairs.join(both, ["target", "paper"], "left").join(paper, "paper", "left").join(target, "target", "left")
    return told.withColumn("invalidated", F.coalesce("_b", "_p", "_t", F.lit(False))).drop("_b", "_p", "_t")


def reusable(vectors: DataFrame, records: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(vectors that stay, records still without one)."""
    return vectors.join(records.select(key), key, "left_semi"), records.join(vectors.select(key), key, "left_anti")


def bibliography(metadata: DataFrame, fields: list[str], key: str = "paper_id") -> DataFrame:
    """One row for each paper: of every field the first value that is not null by source priority, and the fields on which sources differ."""
    aggregates = []
    for f in fields:
        aggregates += [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("priority"))).alias(f), (F.countDistinct(f) > 1).alias(f"_{f}")]
    told = metadata.groupBy(key).agg(*aggregates)
    conflicts = F.array_compact(F.array(*(F.when(F.col(f"_{f}"), F.lit(f)) for f in fields)))
    missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))
    return told.select(key, *fields, conflicts.alias("conflicts"), missing.alias("missing"))


def usage_ledger(calls: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Calls and sums of the metrics by model."""
    return calls.groupBy(by).agg(F.count("*").alias("calls"), *(F.sum(m).alias(m) for m in metrics))


def usage_delta(before: DataFrame, after: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """What the ledger gained between two snapshots; a model that was not there before starts at 0."""
    old = before.select(by, *(F.col(m).alias(f"_{m}") for m in metrics))
    return after.join(old, by, "left").select(by, *((F.col(m) - F.coalesce(F.col(f"_{m}"), F.lit(0))).alias(m) for m in metrics))
