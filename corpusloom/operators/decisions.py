"""Decision tables, each one chain of conditions, and the rankings that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """Per thread: papers that support, qualify, contradict, are mixed, or are unknown.

    `evidence` carries thread, paper, stance. A paper that supports and contradicts is mixed; else contradicting goes
    before qualifying before supporting. A thread's papers without evidence are unknown.
    """
    has = lambda s: F.coalesce(F.bool_or(F.col("stance") == s), F.lit(False))
    told = papers.join(evidence, ["thread", "paper"], "left").groupBy("thread", "paper").agg(has("supports").alias("s"), has("qualifies").alias("q"), has("contradicts").alias("c"))
    kind = F.when(F.col("c") & F.col("s"), "mixed").when(F.col("c"), "contradicts").when(F.col("q"), "qualifies").when(F.col("s"), "supports").otherwise("unknown")
    return told.withColumn("kind", kind).groupBy("thread").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("supports", "qualifies", "contradicts", "mixed", "unknown")))


def confidence(comparability_note: Column | None = None, hypothetical: Column | None = None) -> Column:
    """low, medium or high from the columns of `agreement`."""
    total = F.col("supports") + F.col("qualifies") + F.col("contradicts") + F.col("mixed") + F.col("unknown")
    low = (F.col("unknown") * 2 > total) | (F.col("contradicts") > 0) | (F.col("mixed") > 0)
    for flag in (comparability_note, hypothetical):
        low = low | F.coalesce(flag, F.lit(False)) if flag is not None else low
    return F.when(low, "low").when((F.col("supports") + F.col("qualifies") == 2) | (F.col("qualifies") > 0), "medium").otherwise("high")


def candidate_kind(papers: Column, tension: Column, sides: Column) -> Column:
    """diagnostic, observation or finding by the number of papers; a tension needs two sides and two papers."""
    return F.when(tension, F.when((sides >= 2) & (papers >= 2), "tension").otherwise("diagnostic")).when(papers == 0, "diagnostic").when(papers == 1, "observation").otherwise("finding")


def location_problem(locations: Column, pages: Column) -> Column:
    """unverifiable without a location, unresolved if one has no page, else null."""
    return F.when(F.coalesce(F.size(locations), F.lit(0)) <= 0, "unverifiable").when(F.exists(pages, lambda p: p.isNull()), "unresolved")


def tested_status(conclusion: Column, sufficient: Column) -> Column:
    return F.when(~sufficient, "no_verdict").when(conclusion.isin("direct_empirical", "direct_theoretical"), "tested").when(conclusion == "inferred", "inferred").when(conclusion == "discussed", "discussed_only").otherwise("not_established")


def novelty_status(finding: Column, complete: Column, accepted: Column) -> Column:
    return F.when(~accepted, "unresolved").when(finding == "ALREADY_STUDIED", "overlap_found").when(finding == "LOW_PRIOR_OVERLAP", "low_overlap").when(~complete | (finding == "UNRESOLVED"), "unresolved").otherwise("partial_overlap")


def hypothesis_action(finding: Column, complete: Column) -> Column:
    return F.when(finding == "ALREADY_STUDIED", "reject").when(complete & (finding != "UNRESOLVED"), "retain").otherwise("defer")


def critic_route(action: Column, revisions: Column, removals: Column, in_merge: Column) -> Column:
    return F.when(in_merge, "merge").when(action == "DISCARD", "stop").when(revisions > 0, "revise").when(removals > 0, "narrow").otherwise("ranking")


def hypothesis_status(action: Column, eligible: Column) -> Column:
    return F.when(~eligible, "pending").when(action.isin("KEEP", "DOWNRANK"), "approved").when(action == "DISCARD", "discarded").otherwise("pending")


def publication_status(approved: Column, pending: Column) -> Column:
    return F.when((approved > 0) & (pending > 0), "partial").when(approved > 0, "ready").when(pending > 0, "blocked").otherwise("empty")


def support_label(supporting: Column) -> Column:
    return F.when(supporting >= 2, "multiple").otherwise("single")


def limitation_origin(path: Column) -> Column:
    """Who states a limitation, by its place in the document."""
    return F.when(path.rlike(r"^/limitations/author_stated/\d+"), "author_stated").when(path.rlike(r"^/limitations/inferred/\d+"), "model_inferred")


def accepted_targets(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """(target) that a review lets through. `reviews`: review, target, verdict; `issues`: review, target (null: not located).

    pass lets all through, revise all but those an issue names, any other verdict none; an issue that names no
    target blocks its whole review.
    """
    blocked = issues.groupBy("review").agg(F.bool_or(F.col("target").isNull()).alias("all"))
    named = issues.where("target is not null").select("review", "target").distinct().withColumn("named", F.lit(True))
    told = reviews.join(blocked, "review", "left").join(named, ["review", "target"], "left")
    passes = (F.col("verdict") == "pass") | ((F.col("verdict") == "revise") & ~F.coalesce("all", F.lit(False)) & F.col("named").isNull())
    return told.where(passes).select("review", "target")


def ranking_signals(findings: DataFrame, by: str = "candidate") -> DataFrame:
    """Per candidate: downranked, and the shares of concerns and uncertain findings among the applicable ones (0 without any)."""
    applicable = F.col("assessment") != "not_applicable"
    share = lambda kind: F.coalesce(F.avg(F.when(applicable, (F.col("assessment") == kind).cast("double"))), F.lit(0.0))
    return findings.groupBy(by).agg(F.bool_or(F.col("action") == "DOWNRANK").alias("downranked"), share("concern").alias("concern"), share("uncertain").alias("uncertain"))


def portfolio(signals: DataFrame, max_selected: int, by: str = "candidate") -> DataFrame:
    """Candidates by (downranked, concern, uncertain, novelty priority, id): place, and selected or reserve.

    The global place needs the whole order; Spark range-partitions it and only the selected few meet in one task.
    """
    keys = ["downranked", "concern", "uncertain", "novelty_priority", by]
    top = signals.orderBy(*keys).limit(max_selected).select(by)
    places = top.join(signals, by).withColumn("place", F.row_number().over(Window.orderBy(*keys))).select(by, "place")
    return signals.join(places, by, "left").select(by, F.col("place").cast("long").alias("place"), F.when(F.col("place").isNotNull(), "selected").otherwise("reserve").alias("disposition"))


def portfolio_status(selected: Column, pending: Column, minimum: int) -> Column:
    return F.when(selected > 0, F.when((pending > 0) | (selected < minimum), "partial").otherwise("ready")).when(pending > 0, "blocked").otherwise("empty")
