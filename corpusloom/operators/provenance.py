"""Where opportunities, directions and their reviews come from: inputs of one lineage, evidence that is as it was reviewed, drafts that cite what they have, packets of one hypothesis.

Tables are flat, for many runs, opportunities and directions at once; violations are rows (rule, key, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import gates


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns))


def unsafe_name(paper: Column) -> Column:
    """Whether an id is no plain name of a folder."""
    return paper.isin("", ".", "..") | paper.contains("/")


def lineage_violations(runs: DataFrame, opportunities: DataFrame, items: DataFrame) -> DataFrame:
    """A generation's landscape, reasoning and mining belong together: the same topic, digests that name each other, and ids that occur once.

    `runs` (run, landscape_sha256, reasoning_sha256, of_reasoning: the landscape that the reasoning names, of_mining,
    reasoning_of_mining, topics array of the three), `opportunities` (run, opportunity), `items` (run, source).
    """
    wrong = (F.col("of_reasoning") != F.col("landscape_sha256")) | (F.col("of_mining") != F.col("landscape_sha256")) | (F.col("reasoning_of_mining") != F.col("reasoning_sha256"))
    return gates.gate(
        gates.violations(runs, "lineage", F.coalesce(wrong, F.lit(True)), F.col("run")),
        gates.violations(runs, "topic", F.size(F.array_distinct("topics")) != 1, F.col("run")),
        gates.repeated(opportunities, ["run", "opportunity"], "repeated_opportunity"),
        gates.repeated(items, ["run", "source"], "repeated_source"),
    )


def mining_violations(runs: DataFrame, inventory: DataFrame, items: DataFrame, references: DataFrame, landscape: DataFrame, evidence: DataFrame, reviewed: DataFrame) -> DataFrame:
    """What enters mining is verified, refines known parts of its own landscape, and rests on papers of the inventory.

    `runs` (run, landscape_sha256, landscape_topic, reasoning_of, topic), `inventory` (run, paper), `items` (run, source,
    verification), `references` (run, source, item), `landscape` (run, item), `evidence` (run, source, evidence, paper,
    content), `reviewed` (run, source, paper): pages that a review read.
    """
    source = ["run", "source"]
    without = lambda rows, rule: gates.violations(items.join(rows.select(*source).distinct(), source, "left_anti"), rule, F.lit(True), _key(*source))
    outside = lambda rows, rule: gates.violations(rows.select(*source, "paper").distinct().join(inventory, ["run", "paper"], "left_anti"), rule, F.lit(True), _key(*source), F.col("paper"))
    unknown = references.join(landscape, ["run", "item"], "left_anti")
    twice = evidence.groupBy(*source, "evidence").agg(F.countDistinct("content").alias("n")).where("n > 1")
    return gates.gate(
        gates.violations(inventory, "unsafe_paper", unsafe_name(F.col("paper").cast("string")), _key("run", "paper")),
        gates.violations(runs, "lineage", ~F.col("reasoning_of").eqNullSafe(F.col("landscape_sha256")) | ~F.col("topic").eqNullSafe(F.col("landscape_topic")), F.col("run")),
        gates.repeated(items, source, "repeated_source"),
        without(references, "no_reference"),
        gates.violations(unknown, "unresolved_reference", F.lit(True), _key(*source), F.col("item")),
        gates.violations(items, "unverified", ~F.col("verification").eqNullSafe(F.lit("verified")), _key(*source), F.col("verification")),
        without(reviewed, "unreviewed"),
        without(evidence, "no_evidence"),
        gates.violations(twice, "conflicting_evidence", F.lit(True), _key(*source, "evidence")),
        outside(evidence, "evidence_outside"),
        outside(reviewed, "review_outside"),
    )


def context_violations(opportunities: DataFrame, inventory: DataFrame, papers: DataFrame, sources: DataFrame, chosen: tuple[DataFrame, DataFrame], reasoning: DataFrame, references: tuple[DataFrame, DataFrame, DataFrame], evidence: DataFrame, upstream: DataFrame, pages: DataFrame, prior: DataFrame, locations: DataFrame, roles: DataFrame, cites: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A direction's opportunity is what was reviewed: its papers and their roles, its sources and their references, its evidence, its pages, and the assessments of the roles.

    `opportunities` (opportunity, support), `inventory` (paper), `papers` (opportunity, paper, role), `sources`
    (opportunity, source, kind), `chosen`: (opportunity, source) and (opportunity, evidence) that the candidate names,
    `reasoning` (source, kind, verification), `references`: (opportunity, source, item) as recorded, (source, item) as
    reasoned, and the landscape's (item), `evidence` (opportunity, evidence, source, paper, content), `upstream` (source,
    evidence, content), `pages` (opportunity, paper, page, sha256), `prior` (source, paper, page, sha256), `locations`
    (opportunity, evidence, page), `roles` (opportunity, paper, role), `cites`: (opportunity, paper, evidence) and
    (opportunity, paper, cited_paper, page) of the assessments.
    """
    op, single = "opportunity", ["opportunity", "paper"]
    supporting = papers.where("role = 'supporting'").groupBy(op).agg(F.countDistinct("paper").alias("n"))
    label = opportunities.join(supporting, op, "left").withColumn("due", F.when(F.col("n") > 1, "multiple_papers").when(F.col("n") == 1, "single_paper"))
    named, asked, known = references
    reasoned = sources.select(op, "source").join(asked, "source").select(op, "source", "item")
    used = sources.join(reasoning.select("source", F.col("kind").alias("_kind"), "verification"), "source", "left")
    reviewed = reasoning.join(prior.select("source").distinct(), "source", "left_semi").select("source")
    selected = evidence.join(upstream.select("source", "evidence", F.col("content").alias("_content")), ["source", "evidence"], "left")
    due = sources.select(op, "source").join(prior, "source").select(op, "paper", "page", "sha256").distinct()
    twice = upstream.groupBy("source", "evidence").agg(F.countDistinct("content").alias("n")).where("n > 1")
    versions = due.groupBy(op, "paper", "page").agg(F.count("*").alias("n")).where("n > 1")
    placed = evidence.select(op, "evidence", "paper").join(locations, [op, "evidence"], "left")
    by_evidence, by_page = cites
    own = by_evidence.join(evidence.select(op, "evidence", F.col("paper").alias("_paper")), [op, "evidence"], "left")
    read = by_page.join(pages.select(op, F.col("paper").alias("cited_paper"), "page").withColumn("_there", F.lit(True)), [op, "cited_paper", "page"], "left")
    no = lambda rows, rule: gates.violations(opportunities.join(rows.select(op).distinct(), op, "left_anti"), rule, F.lit(True), F.col(op))
    return gates.gate(
        gates.violations(papers.join(inventory, "paper", "left_anti"), "paper_outside", F.lit(True), _key(*single)),
        gates.repeated(papers, single, "repeated_paper"),
        gates.mismatched(papers, evidence, single, "paper_inventory"),
        no(papers.where("role = 'supporting'"), "no_supporting_paper"),
        gates.violations(label, "support_label", F.col("n").isNotNull() & ~F.col("support").eqNullSafe(F.col("due")), F.col(op), F.col("support")),
        gates.repeated(sources, [op, "source"], "repeated_source"),
        gates.mismatched(chosen[0], sources, [op, "source"], "source_inventory"),
        gates.repeated(evidence, [op, "evidence"], "repeated_evidence"),
        gates.mismatched(chosen[1], evidence, [op, "evidence"], "evidence_inventory"),
        gates.violations(used, "unknown_source", F.col("_kind").isNull(), _key(op, "source")),
        gates.violations(used, "source_kind", F.col("kind") != F.col("_kind"), _key(op, "source")),
        gates.violations(used, "unverified_source", F.col("verification") != "verified", _key(op, "source")),
        gates.violations(used.where("_kind is not null").join(reviewed, "source", "left_anti"), "unreviewed_source", F.lit(True), _key(op, "source")),
        gates.mismatched(reasoned, named, [op, "source", "item"], "source_references"),
        gates.violations(named.join(known, "item", "left_anti"), "unknown_item", F.lit(True), _key(op, "source"), F.col("item")),
        gates.violations(twice, "conflicting_evidence", F.lit(True), _key("source", "evidence")),
        gates.violations(selected, "evidence_changed", ~F.col("content").eqNullSafe(F.col("_content")), _key(op, "evidence")),
        gates.violations(sources.select(op, "source").distinct().join(evidence.select(op, "source").distinct(), [op, "source"], "left_anti"), "source_unused", F.lit(True), _key(op, "source")),
        no(pages, "no_pages"),
        gates.repeated(pages, [op, "paper", "page"], "repeated_page"),
        gates.violations(pages.join(inventory, "paper", "left_anti"), "page_outside", F.lit(True), _key(op, "paper", "page")),
        gates.violations(due.join(pages, [op, "paper", "page", "sha256"], "left_anti"), "review_context", F.lit(True), _key(op, "paper", "page")),
        gates.violations(versions, "review_versions", F.lit(True), _key(op, "paper", "page")),
        gates.violations(placed.join(pages.select(op, "paper", "page"), [op, "paper", "page"], "left_anti"), "evidence_page", F.lit(True), _key(op, "evidence"), F.col("page")),
        gates.repeated(roles, single, "repeated_role"),
        gates.mismatched(papers, roles, [*single, "role"], "role"),
        gates.violations(own, "role_evidence", ~F.col("paper").eqNullSafe(F.col("_paper")), _key(*single), F.col("evidence")),
        gates.violations(read, "role_page", F.col("_there").isNull() | (F.col("paper") != F.col("cited_paper")), _key(*single), F.col("page")),
    )


def draft_violations(drafts: DataFrame, claims: DataFrame, hypotheses: DataFrame, evidence: DataFrame, pages: DataFrame, supporting: DataFrame, max_hypotheses: int = 6, max_experiments: int = 6) -> DataFrame:
    """A direction's draft is within its caps, cites evidence and pages that it has, each once, covers the papers of its evidence by pages, and cites a supporting paper.

    `drafts` (direction, n_hypotheses, n_experiments), `claims` (direction, claim, evidence array, pages array),
    `hypotheses` (direction, hypothesis, evidence array), `evidence` (direction, evidence, paper), `pages` (direction, page,
    paper), `supporting` (direction, paper).
    """
    cap = (F.col("n_hypotheses") > max_hypotheses) | (F.col("n_experiments") > max_experiments)
    rows = lambda df, key, column: df.select("direction", F.col(key).alias("name"), F.explode(column).alias("ref")).distinct()
    a, p, h = rows(claims, "claim", "evidence"), rows(claims, "claim", "pages"), rows(hypotheses, "hypothesis", "evidence")
    known = evidence.select("direction", F.col("evidence").alias("ref"), "paper")
    papers = pages.select("direction", F.col("page").alias("ref"), "paper")
    lost = lambda used, have, rule: gates.violations(used.join(have.select("direction", "ref").distinct(), ["direction", "ref"], "left_anti"), rule, F.lit(True), _key("direction", "name"), F.col("ref"))
    again = lambda df, key, *columns: reduce(Column.__or__, (F.size(c) != F.size(F.array_distinct(c)) for c in columns))
    cited, read = a.join(known, ["direction", "ref"]).select("direction", "name", "paper").distinct(), p.join(papers, ["direction", "ref"]).select("direction", "name", "paper").distinct()
    none = drafts.select("direction").join(cited.join(supporting, ["direction", "paper"], "left_semi").select("direction").distinct(), "direction", "left_anti")
    return gates.gate(
        gates.violations(drafts, "cap", cap, F.col("direction")),
        gates.violations(claims, "repeated_citation", again(claims, "claim", "evidence", "pages"), _key("direction", "claim")),
        gates.violations(hypotheses, "repeated_citation", again(hypotheses, "hypothesis", "evidence"), _key("direction", "hypothesis")),
        lost(a, known, "unknown_evidence"),
        lost(h, known, "unknown_evidence"),
        lost(p, papers, "unknown_page"),
        gates.violations(cited.join(read, ["direction", "name", "paper"], "left_anti"), "uncovered_paper", F.lit(True), _key("direction", "name"), F.col("paper")),
        gates.violations(none, "no_supporting_citation", F.lit(True), F.col("direction")),
    )


def review_violations(targets: DataFrame, checks: DataFrame, requests: DataFrame, pairs: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """A review of an assessment checks the scope of every target once, and asks to reassess only pairs, claims and passages that are there.

    `targets` and `checks` (direction, target); `requests` (direction, request, paper, targets, claims, passages arrays);
    `pairs` (direction, paper, target) accepted, `claims` (direction, paper, target, claim), `passages` (direction, passage).
    A claim counts if any of the request's pairs rests on it; a passage's id begins with its paper and `#`.
    """
    name = _key("direction", "request")
    asked = requests.select("direction", "request", "paper", F.explode("targets").alias("target"))
    named = requests.select("direction", "request", "paper", F.explode("claims").alias("claim"))
    has = asked.join(claims, ["direction", "paper", "target"]).select("direction", "request", "claim").distinct()
    shown = requests.select("direction", "request", "paper", F.explode("passages").alias("passage"))
    return gates.gate(
        gates.repeated(checks, ["direction", "target"], "checked_twice"),
        gates.mismatched(targets, checks, ["direction", "target"], "scope_checks"),
        gates.violations(asked.join(pairs, ["direction", "paper", "target"], "left_anti"), "unknown_pair", F.lit(True), name, F.col("target")),
        gates.violations(named.join(has, ["direction", "request", "claim"], "left_anti"), "unknown_claim", F.lit(True), name, F.col("claim")),
        gates.violations(shown.join(passages, ["direction", "passage"], "left_anti"), "unknown_passage", F.lit(True), name, F.col("passage")),
        gates.violations(shown, "foreign_passage", ~F.col("passage").startswith(F.concat(F.col("paper").cast("string"), F.lit("#"))), name, F.col("passage")),
    )


def hypothesis_packets(targets: DataFrame, evidence: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, passages) of a packet for each hypothesis: its own evidence, the passages it cites, and the rest of their pages.

    `targets` (direction, target, level), `evidence` (direction, target, paper, claim, passages array), `passages`
    (direction, passage, page or null); the results carry direction and target. A passage without a page stands alone.
    """
    scope = targets.where("level = 'hypothesis'").select("direction", "target")
    own = evidence.join(scope, ["direction", "target"])
    cited = own.select("direction", "target", F.explode("passages").alias("passage")).distinct().join(passages, ["direction", "passage"])
    pages = cited.where("page is not null").select("direction", "target", "page").distinct()
    whole = pages.join(passages, ["direction", "page"]).select("direction", "target", "passage", "page")
    alone = cited.where("page is null").select("direction", "target", "passage", "page")
    return own, whole.unionByName(alone)


def current_critics(results: DataFrame, key: str = "run") -> DataFrame:
    """(run, critic) of results (run, part, number, critic): that of the last cycle that has one, else of the last repair, else the original."""
    place = F.when((F.col("part") == "cycle") & F.col("critic").isNotNull(), 2).when(F.col("part") == "repair", 1).when(F.col("part") == "original", 0)
    return results.withColumn("_place", place).where("_place is not null").groupBy(key).agg(F.max_by("critic", F.struct("_place", "number")).alias("critic"))


def dispositions(directions: DataFrame, routes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(direction, next_stage, disposition, has_review): a route to ranking is a reserve, a stop discards, and all else, also no route, is pending."""
    told = directions.select("direction").join(routes.select("direction", "next_stage"), "direction", "left").join(reviews.select("direction").distinct().withColumn("_r", F.lit(True)), "direction", "left")
    kind = F.when(F.col("next_stage") == "ranking", "reserve").when(F.col("next_stage") == "stop", "discarded").otherwise("pending")
    return told.select("direction", "next_stage", kind.alias("disposition"), F.coalesce("_r", F.lit(False)).alias("has_review"))


def landscapes(parts: dict[str, DataFrame], key: str = "topic") -> DataFrame:
    """(topic, n of each part, sha256): the parts of each landscape, rows (topic, item, content), put together as counts and one digest.

    The digest is over two sums of the items' hashes of each part, so it names the content whatever the order of rows, and
    no part is gathered.
    """
    told = None
    for name, rows in parts.items():
        item = [F.xxhash64(F.lit(seed), F.col("item"), F.col("content")).cast("decimal(38,0)") for seed in (0, 1)]
        own = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"), *(F.sum(h).cast("string").alias(f"_{name}{k}") for k, h in enumerate(item)))
        told = own if told is None else told.join(own, key, "full")
    counts = [F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in parts]
    sums = [F.coalesce(f"_{name}{k}", F.lit("0")) for name in parts for k in (0, 1)]
    return told.select(key, *counts, F.sha2(F.concat_ws("|", *sums), 256).alias("sha256"))
