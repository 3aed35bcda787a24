"""Integrity rules as constraint queries. Each gives violations (rule, key, detail); a gate passes when it has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rule: str, broken: Column, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which `broken` holds; null is no violation."""
    return rows.where(broken).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def dangling(rows: DataFrame, column: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """References without a target: one violation for each missing value."""
    used = rows.select(F.col(column).alias("_ref")).where("_ref is not null").distinct()
    return violations(used.join(targets.select(F.col(target).alias("_ref")).distinct(), "_ref", "left_anti"), rule, F.lit(True), F.col("_ref"))


def repeated(rows: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Keys that occur twice or more, with their counts."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return violations(counts, rule, F.lit(True), F.concat_ws("|", *columns), F.col("_n"))


def mismatched(expected: DataFrame, actual: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Keys of one side only: `missing` from the actual rows or `unexpected` in them."""
    a, b = expected.select(*columns).distinct(), actual.select(*columns).distinct()
    key = F.concat_ws("|", *columns)
    return violations(a.join(b, columns, "left_anti"), rule, F.lit(True), key, F.lit("missing")).unionByName(violations(b.join(a, columns, "left_anti"), rule, F.lit(True), key, F.lit("unexpected")))


def gate(*found: DataFrame) -> DataFrame:
    """All violations together."""
    return reduce(DataFrame.unionByName, found)


def passed(found: DataFrame) -> bool:
    return found.isEmpty()


def coverage(shortlist: DataFrame, by: list[str], threshold: float = 0.8) -> DataFrame:
    """Per target: total, accepted (reviewed without a missing page), coverage and whether it reaches the threshold; with an incomplete retrieval it never does.

    `shortlist` carries status, n_missing and retrieved (boolean).
    """
    good = (F.col("status") == "reviewed") & (F.col("n_missing") == 0)
    told = shortlist.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(good).alias("accepted"), F.bool_and("retrieved").alias("retrieved"))
    share = F.col("accepted") / F.col("total")
    return told.select(*by, "total", "accepted", share.alias("coverage"), (F.col("retrieved") & (share >= threshold)).alias("met"))


def sequence_gaps(rounds: DataFrame, by: str, number: str, rule: str = "round_sequence") -> DataFrame:
    """Groups whose numbers are not 0, 1, 2 and so on. Three aggregates say it; no group is sorted."""
    told = rounds.groupBy(by).agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.count("*").alias("_n"), F.countDistinct(number).alias("_d"))
    return violations(told, rule, (F.col("_low") != 0) | (F.col("_high") + 1 != F.col("_n")) | (F.col("_d") != F.col("_n")), F.col(by), F.concat_ws("/", "_low", "_high", "_n"))


def unquoted(quotes: DataFrame, rule: str = "quote") -> DataFrame:
    """Quotes that are not in their text once white space is collapsed. `quotes` carries key, quote, text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return violations(quotes, rule, ~F.contains(flat("text"), flat("quote")), F.col("key"))


def chain_breaks(stages: DataFrame, run: str, position: str, parent: str, result: str, rule: str = "lineage") -> DataFrame:
    """Stages whose parent digest is not the result digest of the stage before, and gaps in their positions; the first stage has no parent."""
    before = stages.select(F.col(run), (F.col(position) + 1).alias(position), F.col(result).alias("_before"))
    told = stages.join(before, [run, position], "left")
    broken = F.when(F.col(position) == 0, F.col(parent).isNotNull()).otherwise(~F.col(parent).eqNullSafe(F.col("_before")) | F.col("_before").isNull())
    return violations(told, rule, broken, F.concat_ws("|", run, position), F.coalesce("_before", F.lit("gap")))
