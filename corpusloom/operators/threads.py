"""Threads of work: items of a landscape with the papers, sides and ids that a review of each is to read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import packing
from corpusloom.operators.ranking import numbered
from corpusloom.sources.tables import cut

#: The order in which kinds are scheduled: fixed values.
KINDS = ("relationship", "aggregated_finding", "recurring_limitation", "common_assumption", "underexplored_regime", "contradiction")


def candidates(supporting: DataFrame, groups: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """(thread, paper, supporting, shared): the papers that an item may read.

    `supporting` (thread, paper), `groups` (thread, concept) of the item, `members` (concept, paper). Papers of its
    groups are needed, by how many of them share one, only where fewer than `cap` support it. Threads
    with the same groups share one pool, and only the first `2 * cap` papers of a pool, by sharing and id, can be read
    by any of them: no more meet its threads, however many papers a concept has and threads it is in.
    """
    own = supporting.select("thread", "paper").distinct().withColumn("supporting", F.lit(True))
    full = own.groupBy("thread").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("thread")
    open_groups = groups.select("thread", "concept").distinct().join(full, "thread", "left_anti")
    pools = cut(open_groups.groupBy("thread").agg(F.array_sort(F.collect_set("concept")).alias("pool")))
    single = pools.select("pool").distinct().select("pool", F.explode("pool").alias("concept"))
    shares = single.join(members.select("concept", "paper").distinct(), "concept").groupBy("pool", "paper").agg(F.count("*").alias("shared"))
    first = Window.partitionBy("pool").orderBy(F.desc("shared"), F.asc("paper"))
    best = cut(shares.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= 2 * cap).drop("_place"))
    told = pools.join(best, "pool").select("thread", "paper", "shared").join(own, ["thread", "paper"], "full")
    return told.select("thread", "paper", F.coalesce("supporting", F.lit(False)).alias("supporting"), F.coalesce("shared", F.lit(0)).alias("shared"))


def chosen(found: DataFrame, cap: int) -> DataFrame:
    """(thread, papers, omitted): up to `cap` papers of each item in order, and how many supporting ones are left out."""
    told = packing.supporting_first(found, cap).join(found.select("thread", "paper", "supporting"), ["thread", "paper"])
    first = F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct("place", "paper"))))  # `cap` rows at most, nulls are not collected
    return told.groupBy("thread").agg(F.transform(first, lambda x: x.paper).alias("papers"), F.count_if(F.col("supporting") & ~F.col("chosen")).alias("omitted"))


def contradictory(opposed: DataFrame, papers: DataFrame, cap: int) -> DataFrame:
    """(thread, papers, omitted, side_a, side_b, status) of contradictions (thread, a, b), whose sides share one cap.

    `papers` (thread, papers, omitted) has the choice of each side by itself. A thread with an empty side or fewer
    than two papers can't be decided.
    """
    side = lambda name: papers.select(F.col("thread").alias(name), F.col("papers").alias(f"_{name}"), F.col("omitted").alias(f"_omitted_{name}"))
    told = opposed.join(side("a"), "a", "left").join(side("b"), "b", "left")
    none = F.array().cast(papers.schema["papers"].dataType)
    left, right = F.coalesce("_a", none), F.coalesce("_b", none)
    told = told.withColumn("papers", packing.allocate_sides(left, right, cap))
    inside = lambda c: F.filter("papers", lambda p: F.array_contains(c, p))
    told = told.withColumn("side_a", inside(left)).withColumn("side_b", inside(right))
    weak = (F.size("side_a") == 0) | (F.size("side_b") == 0) | (F.size("papers") < 2)
    return told.select("thread", "papers", (F.coalesce("_omitted_a", F.lit(0)) + F.coalesce("_omitted_b", F.lit(0))).alias("omitted"), "side_a", "side_b", F.when(weak, "insufficient_for_adjudication").otherwise("scheduled").alias("status"))


def schedule(*parts: tuple[str, DataFrame], max_threads: int) -> DataFrame:
    """(thread_id, kind, thread, papers, omitted, status) of the parts (kind, rows of thread, papers, omitted and perhaps status), numbered by kind and key.

    Threads beyond `max_threads` are kept and labelled.
    """
    rows = []
    for kind, df in parts:
        status: Column = F.col("status") if "status" in df.columns else F.lit("scheduled")
        rows.append(df.select(F.lit(KINDS.index(kind)).alias("_kind"), F.lit(kind).alias("kind"), F.col("thread").cast("string").alias("thread"), "papers", F.col("omitted").cast("long").alias("omitted"), status.alias("status")))
    told = numbered(reduce(DataFrame.unionByName, rows), [], ["_kind", "thread"], "_number")
    return told.select(F.format_string("t%03d", "_number").alias("thread_id"), "kind", "thread", "papers", "omitted", F.when(F.col("_number") > max_threads, "budget_skipped").otherwise(F.col("status")).alias("status"))


def counters(threads: DataFrame, cited: DataFrame) -> DataFrame:
    """(kind, threads, completed, skipped, insufficient, papers, cited_papers) of scheduled threads and the papers (thread_id, paper) that were cited."""
    used = threads.select("kind", "thread_id", F.explode("papers").alias("paper"))
    per_kind = used.groupBy("kind").agg(F.countDistinct("paper").alias("papers"))
    per_cited = used.join(cited.select("thread_id", "paper").distinct(), ["thread_id", "paper"], "left_semi").groupBy("kind").agg(F.countDistinct("paper").alias("cited_papers"))
    state = lambda s: F.count_if(F.col("status") == s)
    told = threads.groupBy("kind").agg(F.count("*").alias("threads"), state("scheduled").alias("scheduled"), state("budget_skipped").alias("skipped"), state("insufficient_for_adjudication").alias("insufficient"))
    return told.join(per_kind, "kind", "left").join(per_cited, "kind", "left").select("kind", "threads", "scheduled", "skipped", "insufficient", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("papers", "cited_papers")))
