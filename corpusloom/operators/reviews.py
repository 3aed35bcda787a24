"""What reviews and searches leave behind: hints, concerns, inventories, transport without repeats, controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens


def hint_tokens(matches: DataFrame) -> DataFrame:
    """(paper_id, hints): the distinct tokens of each paper's matched records."""
    own = matches.select("paper_id", F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return own.groupBy("paper_id").agg(F.array_sort(F.collect_list("token")).alias("hints"))


def concerns(found: DataFrame) -> DataFrame:
    """Per (direction, paper): all targets and passages that concerns name, sorted, and their distinct reasons by position."""
    reasons = F.transform(F.array_sort(F.collect_set(F.struct("pos", "reason"))), lambda x: x.reason)
    return found.groupBy("direction", "paper").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("passages")))).alias("passages"),
        F.array_join(F.array_distinct(reasons), "\n").alias("reasons"),
    )


def inventory(*uses: tuple[str, DataFrame]) -> DataFrame:
    """(paper_id, roles, candidates, pages) over tables (role, rows of paper_id, candidate, page): how each paper is used."""
    union = None
    for role, rows in uses:
        own = rows.select("paper_id", F.lit(role).alias("role"), "candidate", "page").distinct()
        union = own if union is None else union.unionByName(own)
    sets = (F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("role", "candidate", "page"))
    return union.groupBy("paper_id").agg(*sets)


def without_repeats(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each paper and claim, the pairs whose rows disagree), by digests of the contents."""
    told = claims.groupBy("paper", "claim").agg(F.min("content").alias("content"), F.countDistinct(F.sha2("content", 256)).alias("n"))
    return told.where("n = 1").drop("n"), told.where("n > 1").select("paper", "claim")


def control_coverage(pools: DataFrame, controls: DataFrame, shortlist: int) -> DataFrame:
    """(target, paper, rank, in_pool, in_shortlist) for known prior papers; `pools` carries target, paper, rank."""
    told = controls.select("target", "paper").join(pools.select("target", "paper", "rank"), ["target", "paper"], "left")
    return told.select("target", "paper", "rank", F.col("rank").isNotNull().alias("in_pool"), F.coalesce(F.col("rank") <= shortlist, F.lit(False)).alias("in_shortlist"))


def scientific_changes(old: DataFrame, new: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """(key, change): added, removed, changed or same, by a digest of all fields but those that only explain."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*(c for c in sorted(df.columns) if c not in ignored and c != key)), {"ignoreNullFields": "false"}), 256)
    a, b = old.select(key, digest(old).alias("_a")), new.select(key, digest(new).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))
