"""Rules that drafts and reviews of assessments, critiques, portfolios and publications must keep; each as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import gates
from corpusloom.operators.comparison import DIRECT
from corpusloom.operators.merging import first_rows

#: The criteria of a critique: fixed values.
CRITERIA = ("gap_support", "meaningful_distinction", "combination_justification", "mechanism_plausibility", "testability", "falsifiability", "negative_result_value", "research_contribution")
CLOSE = ("SAME", "VERY_CLOSE")
#: Fields of a proposal and of its hypotheses that an assessment may edit: fixed values.
SCIENTIFIC = ("research_direction", "proposed_mechanism", "scope", "assumptions", "what_would_falsify_it")
HYPOTHESIS_FIELDS = ("condition", "intervention", "expected_effect", "mechanism", "assumptions", "falsification_criterion")


def draft_citations(findings: DataFrame, citations: DataFrame, bundle: DataFrame) -> DataFrame:
    """Violations of drafts: STRUCTURAL spoils a draft, CITATION only the finding.

    findings (thread, finding), citations (thread, finding, evidence, stance or null, of: evidence or condition), bundle (thread, evidence).
    """
    key, cited = F.concat_ws("|", "thread", "finding"), citations.where("of = 'evidence'")
    none = findings.join(cited, ["thread", "finding"], "left_anti")
    unknown = cited.join(bundle.select("thread", "evidence").distinct(), ["thread", "evidence"], "left_anti")
    outside = citations.where("of = 'condition'").join(cited.select("thread", "finding", "evidence").distinct(), ["thread", "finding", "evidence"], "left_anti")
    return gates.gate(
        gates.violations(none, "STRUCTURAL:no_evidence", F.lit(True), key),
        gates.violations(cited, "STRUCTURAL:no_stance", F.col("stance").isNull(), key, F.col("evidence")),
        gates.violations(unknown, "CITATION:unknown", F.lit(True), key, F.col("evidence")),
        gates.violations(outside, "CITATION:condition_outside", F.lit(True), key, F.col("evidence")),
    )


def review_decisions(candidates: DataFrame, decisions: DataFrame, cited: DataFrame, pages: DataFrame, by: str = "thread") -> DataFrame:
    """Decisions must be one for each candidate (by, candidate), and cite only pages (by, page) that were supplied."""
    keys = [by, "candidate"]
    missing_page = cited.join(pages.select(by, "page").distinct(), [by, "page"], "left_anti")
    return gates.gate(
        gates.repeated(decisions, keys, "duplicate_decision"),
        gates.mismatched(candidates, decisions, keys, "decision_set"),
        gates.violations(missing_page, "unknown_page", F.lit(True), F.concat_ws("|", *keys), F.col("page")),
    )


def accepted_candidates(candidates: DataFrame, decisions: DataFrame, required: DataFrame, pages: DataFrame) -> DataFrame:
    """(thread, candidate, kind, route): accepted kinds by their papers; rejected, insufficient, or pages that were not supplied.

    candidates (thread, candidate, papers, tension, sides), decisions (thread, candidate, decision), required (thread, candidate, page).
    """
    from corpusloom.operators.decisions import candidate_kind

    keys = ["thread", "candidate"]
    short = required.join(pages.select("thread", "page").distinct(), ["thread", "page"], "left_anti").select(*keys).distinct().withColumn("_short", F.lit(True))
    told = candidates.join(decisions, keys, "left").join(short, keys, "left")
    kind = candidate_kind(F.col("papers"), F.col("tension"), F.col("sides"))
    route = F.when(kind == "diagnostic", "no_valid_evidence").when(F.col("_short"), "insufficient_pages").when(F.col("decision") == "accept", "accepted").when(F.col("decision") == "reject", "rejected").otherwise("insufficient")
    return told.select(*keys, kind.alias("kind"), route.alias("route"))


def paper_roles(roles: DataFrame, evidence: DataFrame, cited: DataFrame, by: str = "candidate") -> DataFrame:
    """A review gives each evidence paper one role, one at least supports, and roles cite their own paper's evidence.

    roles (by, paper, role), evidence (by, paper, evidence), cited (by, paper, evidence).
    """
    supporting = roles.where("role = 'supporting'").select(by).distinct()
    alone = evidence.select(by).distinct().join(supporting, by, "left_anti")
    foreign = cited.join(evidence.select(by, "paper", "evidence").distinct(), [by, "paper", "evidence"], "left_anti")
    return gates.gate(
        gates.repeated(roles, [by, "paper"], "duplicate_role"),
        gates.mismatched(evidence.select(by, "paper").distinct(), roles, [by, "paper"], "role_set"),
        gates.violations(alone, "no_supporting_paper", F.lit(True), F.col(by)),
        gates.violations(foreign, "foreign_evidence", F.lit(True), F.concat_ws("|", by, "paper"), F.col("evidence")),
    )


def latest_passing(directions: DataFrame, reviews: DataFrame) -> DataFrame:
    """A direction (direction, opportunity, review, digest) must be the exact proposal of a review (review, opportunity, round, decision, digest) that passed and is its opportunity's last."""
    last = reviews.groupBy("opportunity").agg(F.max("round").alias("_last"))
    own = reviews.select("review", F.col("opportunity").alias("_opportunity"), "round", "decision", F.col("digest").alias("_digest"))
    told = directions.join(own, "review", "left").join(last, "opportunity", "left")
    rule = (
        F.when(F.col("_opportunity").isNull(), "unknown_review")
        .when(F.col("_opportunity") != F.col("opportunity"), "other_opportunity")
        .when(F.coalesce("decision", F.lit("")) != "pass", "not_passed")
        .when(F.col("_digest") != F.col("digest"), "other_proposal")
        .when(F.col("_last") > F.col("round"), "superseded")
    )
    return gates.gate(gates.repeated(reviews, ["review"], "duplicate_review"), told.where(rule.isNotNull()).select(rule.alias("rule"), F.col("direction").cast("string").alias("key"), F.col("review").cast("string").alias("detail")))


def rankings(records: DataFrame, ranked: DataFrame, pool: DataFrame) -> DataFrame:
    """Retrieval records (target, status, diagnostic, restricted) and their rankings (target, paper) out of pools (target, paper)."""
    keys = ["target", "paper"]
    outside = ranked.join(pool.select(*keys).distinct(), keys, "left_anti")
    complete = F.col("status") == "complete"
    key = F.col("target")
    return gates.gate(
        gates.repeated(ranked, keys, "duplicate_paper"),
        gates.violations(outside, "not_retrieved", F.lit(True), F.concat_ws("|", *keys)),
        gates.violations(records, "restricted", F.col("restricted"), key),
        gates.violations(records, "hidden_error", complete & F.col("diagnostic").isNotNull(), key),
        gates.violations(records, "no_diagnostic", ~complete & F.col("diagnostic").isNull(), key),
    )


def assessment(findings: DataFrame, cited: DataFrame, evidence: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rules of an assessment's findings.

    findings (target, level, finding, difference), cited (target, of_target, paper), evidence (target, paper,
    classification, coverage) that was accepted, coverage (target, complete).
    """
    own = evidence.select(F.col("target").alias("of_target"), "paper", "classification", F.col("coverage").alias("_coverage"))
    known = cited.join(own, ["of_target", "paper"], "left")
    unknown = known.where("classification is null")
    same = known.where("of_target = target and classification is not null")
    direct = same.join(findings.select("target", "level"), "target")
    positive = F.when(F.col("level") == "hypothesis", F.col("_coverage").isin(*DIRECT)).otherwise(F.col("classification").isin(*CLOSE))
    matching = direct.where(positive).select("target").distinct().withColumn("_matching", F.lit(True))
    has_same = same.select("target").distinct().withColumn("_same", F.lit(True))
    near = evidence.where(F.col("classification").isin(*CLOSE) | F.col("coverage").isin(*DIRECT, "inferred_implication")).select("target").distinct().withColumn("_near", F.lit(True))
    told = findings.join(coverage.select("target", "complete"), "target", "left").join(matching, "target", "left").join(has_same, "target", "left").join(near, "target", "left")
    low, studied, key = F.col("finding") == "LOW_PRIOR_OVERLAP", F.col("finding") == "ALREADY_STUDIED", F.col("target")
    return gates.gate(
        gates.mismatched(coverage, findings, ["target"], "target_set"),
        gates.violations(unknown, "unavailable_evidence", F.lit(True), F.concat_ws("|", "target", "of_target", "paper")),
        gates.violations(told, "no_same_target_evidence", (F.col("finding") != "UNRESOLVED") & F.col("_same").isNull(), key),
        gates.violations(told, "low_overlap_incomplete", low & ~F.coalesce("complete", F.lit(False)), key),
        gates.violations(told, "low_overlap_no_difference", low & ~F.coalesce("difference", F.lit(False)), key),
        gates.violations(told, "low_overlap_near", low & F.col("_near").isNotNull(), key),
        gates.violations(told, "already_studied_indirect", studied & F.col("_matching").isNull(), key),
    )


def critique(targets: DataFrame, findings: DataFrame, revisions: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Rules of a critique: eight criteria for each target once, facts with evidence, actions that fit findings and revisions.

    targets (direction, target, level, action), findings (target, criterion, assessment, basis, n_passages), revisions (target, field_path).
    """
    expected = targets.select("target", F.explode(F.array(*map(F.lit, criteria))).alias("criterion"))
    concern = findings.where("assessment = 'concern'").select("target").distinct().withColumn("_concern", F.lit(True))
    revised = revisions.select("target").distinct().withColumn("_revised", F.lit(True))
    told = targets.join(concern, "target", "left").join(revised, "target", "left")
    survivors = targets.groupBy("direction").agg(F.bool_or((F.col("level") == "hypothesis") & (F.col("action") != "DISCARD")).alias("_some"), F.bool_or((F.col("level") == "direction") & (F.col("action") != "DISCARD")).alias("_lives"), F.bool_or(F.col("level") == "hypothesis").alias("_any"))
    key = F.col("target")
    frozen = F.col("field_path").rlike(r"^/rationale(/|$)|/(hypothesis_id|experiment_id|evidence_ids|hypothesis_ids)$")
    return gates.gate(
        gates.mismatched(expected, findings, ["target", "criterion"], "criteria"),
        gates.repeated(findings, ["target", "criterion"], "duplicate_criterion"),
        gates.violations(findings, "fact_without_evidence", (F.col("basis") == "source_fact") & (F.col("n_passages") == 0), F.concat_ws("|", "target", "criterion")),
        gates.violations(findings, "not_applicable", (F.col("assessment") == "not_applicable") & (F.col("criterion") != "combination_justification"), F.concat_ws("|", "target", "criterion")),
        gates.violations(told, "discard_without_concern", (F.col("action") == "DISCARD") & F.col("_concern").isNull(), key),
        gates.violations(told, "refine_and_revisions", (F.col("action") == "REFINE") != F.col("_revised").isNotNull(), key),
        gates.dangling(revisions, "target", targets, "target", "unknown_target"),
        gates.repeated(revisions, ["target", "field_path"], "duplicate_revision"),
        gates.violations(revisions, "immutable_field", frozen, F.concat_ws("|", "target", "field_path")),
        gates.violations(survivors, "no_surviving_hypothesis", F.col("_any") & ~F.col("_some") & F.col("_lives"), F.col("direction")),
    )


def link_checks(links: DataFrame, checks: DataFrame, requests: DataFrame) -> DataFrame:
    """A review checks each link (direction, hypothesis, experiment) once; a contradiction it finds needs a request (direction, target) for correction."""
    keys = ["direction", "hypothesis", "experiment"]
    asked = requests.select("direction", F.col("target").alias("hypothesis")).distinct()
    whole = requests.select("direction", "target").where(F.col("target") == F.col("direction").cast("string")).select("direction").distinct()
    bare = checks.where("decision = 'contradiction'").join(asked, ["direction", "hypothesis"], "left_anti").join(whole, "direction", "left_anti")
    return gates.gate(gates.repeated(checks, keys, "duplicate_check"), gates.mismatched(links, checks, keys, "link_set"), gates.violations(bare, "contradiction_without_request", F.lit(True), F.concat_ws("|", *keys)))


def portfolio_merges(members: DataFrame, hypotheses: DataFrame, cited: DataFrame, passages: DataFrame) -> DataFrame:
    """Merges (merge, direction): members are known and in one merge only, keep all their hypotheses, and each has a source among those cited.

    members (merge, direction, hypothesis), hypotheses (direction, hypothesis), cited (merge, passage), passages (direction, passage).
    """
    own = members.select("merge", "direction").distinct()
    overlapping = own.groupBy("direction").agg(F.count("*").alias("n")).where("n > 1")
    expected = own.join(hypotheses, "direction").select("direction", "hypothesis")
    sources = cited.join(own, "merge").join(passages, ["direction", "passage"]).select("merge", "direction").distinct()
    unsupported = own.join(sources, ["merge", "direction"], "left_anti")
    of_members = own.join(passages, "direction").select("merge", "passage").distinct()
    outside = cited.join(of_members, ["merge", "passage"], "left_anti")
    return gates.gate(
        gates.violations(overlapping, "overlapping_member", F.lit(True), F.col("direction")),
        gates.dangling(own, "direction", hypotheses, "direction", "unknown_member"),
        gates.mismatched(expected, members, ["direction", "hypothesis"], "hypotheses_preserved"),
        gates.violations(unsupported, "member_without_source", F.lit(True), F.concat_ws("|", "merge", "direction")),
        gates.violations(outside, "foreign_passage", F.lit(True), F.concat_ws("|", "merge", "passage")),
    )


def publication(original: DataFrame, published: DataFrame, actions: DataFrame, ineligible: DataFrame) -> DataFrame:
    """Published hypotheses (direction, hypothesis, digest, status) are the original ones unchanged, with the status of their reviewed action; none is ineligible.

    actions (direction, hypothesis, action), ineligible (direction, hypothesis, reason).
    """
    keys, key = ["direction", "hypothesis"], F.concat_ws("|", "direction", "hypothesis")
    told = published.join(original.select(*keys, F.col("digest").alias("_digest")), keys).join(actions, keys, "left").join(ineligible.withColumnRenamed("reason", "_reason"), keys, "left")
    decided = F.col("status").isin("approved", "discarded")
    due = F.when(F.col("action").isin("KEEP", "DOWNRANK"), "approved").when(F.col("action") == "DISCARD", "discarded").otherwise("pending")
    return gates.gate(
        gates.mismatched(original, published, keys, "hypotheses_preserved"),
        gates.repeated(published, keys, "duplicate_hypothesis"),
        gates.violations(told, "proposal_changed", F.col("_digest") != F.col("digest"), key),
        gates.violations(told, "status_of_action", decided & (F.col("status") != due), key, F.col("action")),
        gates.violations(told, "ineligible_published", decided & F.col("_reason").isNotNull(), key, F.col("_reason")),
    )


def eligibility(assessed: Column, complete: Column, novelty: Column, recheck: Column, removed: Column) -> Column:
    """The first reason why a hypothesis may not be reviewed by itself; null if it may."""
    return (
        F.when(~assessed, "no accepted assessment")
        .when(~complete | (novelty == "unresolved"), "incomplete evidence")
        .when(recheck, "changes need a fresh check")
        .when(removed, "removal requested")
    )


def upstream_route(next_stage: Column, unresolved: Column, recheck: Column) -> Column:
    """Why a direction may not be criticised yet; null if it may. `next_stage` is null without an accepted assessment."""
    return F.when(next_stage.isNull(), "no accepted assessment").when((next_stage != "research_critic") | (unresolved > 0) | (recheck > 0), "upstream work remains")


def routes(targets: DataFrame, revisions: DataFrame, links: DataFrame, merges: DataFrame) -> DataFrame:
    """(direction, next_stage, recheck): where each criticised direction goes, and which of its targets need a fresh novelty check.

    targets (direction, target, level, action), revisions (direction, target, experiment or null), links (direction,
    experiment, hypothesis), merges (direction). A revised experiment touches its hypotheses, a revised direction all
    that are kept.
    """
    kept = targets.where("level = 'hypothesis' and action <> 'DISCARD'").select("direction", "target")
    own = revisions.select("direction", "target")
    linked = revisions.where("experiment is not null").join(links, ["direction", "experiment"]).select("direction", F.col("hypothesis").alias("target"))
    whole = targets.where("level = 'direction'").select("direction", F.col("target").alias("_direction"))
    changed = own.unionByName(linked).distinct()
    all_kept = changed.join(whole, "direction").where("target = _direction").select("direction").distinct().join(kept, "direction")
    changed = changed.unionByName(all_kept).distinct()
    n_changed = changed.groupBy("direction").agg(F.array_sort(F.collect_set("target")).alias("changed"))  # the targets of one direction
    head = targets.where("level = 'direction'").select("direction", F.col("target").alias("_direction"), F.col("action").alias("_action"))
    removed = targets.where("level = 'hypothesis' and action = 'DISCARD'").groupBy("direction").agg(F.count("*").alias("removed"))
    told = head.join(n_changed, "direction", "left").join(removed, "direction", "left").join(merges.select("direction").distinct().withColumn("_merged", F.lit(True)), "direction", "left")
    some = F.col("changed").isNotNull()
    stage = F.when(F.col("_merged"), "merge").when(F.col("_action") == "DISCARD", "stop").when(some, "revise").when(F.col("removed") > 0, "narrow").otherwise("ranking")
    none = F.array().cast("array<string>")
    recheck = F.when(F.col("_action") == "DISCARD", none).when(some | (F.col("removed") > 0), F.array_sort(F.array_union(F.array("_direction"), F.coalesce("changed", none)))).otherwise(none)
    return told.select("direction", stage.alias("next_stage"), recheck.alias("recheck"))


def distinct_requests(requests: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Requests that say the same, by a digest of what they say, once: the first by `order`, so reruns agree."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return first_rows(requests.withColumn("digest", digest), ["digest"], order).select(*requests.columns, "digest")


def refinement(proposals: DataFrame, parts: DataFrame, findings: DataFrame, coverage: DataFrame, edits: DataFrame, isolated: bool = False) -> DataFrame:
    """What an assessment may do to a proposal: it parts the hypotheses once, its action fits what it removes and edits, removals rest on findings, and edits change scientific fields of what stays.

    `proposals` (direction, action), `parts` (direction, hypothesis, part: original, retained or removed), `findings`
    (direction, target, finding), `coverage` (direction, target, complete), `edits` (direction, field_path, hypothesis or
    null, changed: another value of the same type). `isolated`: what is not decided yet may be removed too.
    """
    key, both = F.col("direction"), ["direction", "hypothesis"]
    original, kept, gone = (parts.where(F.col("part") == p).select(*both) for p in ("original", "retained", "removed"))
    n = lambda df, name: df.groupBy("direction").agg(F.count("*").alias(name))
    told = proposals.join(n(kept, "_kept"), "direction", "left").join(n(gone, "_gone"), "direction", "left").join(n(edits, "_edits"), "direction", "left")
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    action, retained, removed, edited = F.col("action"), some("_kept"), some("_gone"), some("_edits")
    state = coverage.select("direction", F.col("target").alias("hypothesis"), "complete").join(findings.select("direction", F.col("target").alias("hypothesis"), "finding"), both, "left")
    allowed = F.coalesce(F.col("finding").isin(*(("ALREADY_STUDIED", "UNRESOLVED") if isolated else ("ALREADY_STUDIED",))), F.lit(False)) | (F.lit(isolated) & ~F.coalesce("complete", F.lit(False)))
    own = proposals.select("direction", key.cast("string").alias("hypothesis"))
    open_ = F.coalesce(~F.col("complete") | (F.col("finding") == "UNRESOLVED"), F.lit(True))
    scope = proposals.where("action = 'retain'").select("direction").join(kept.unionByName(own.join(coverage.select("direction", F.col("target").cast("string").alias("hypothesis")), both, "left_semi")), "direction")
    field, parts_of = F.element_at(F.split("field_path", "/"), -1), F.size(F.split("field_path", "/"))
    legal = ((parts_of == 2) & field.isin(*SCIENTIFIC)) | ((parts_of == 4) & F.col("field_path").rlike(r"^/hypotheses/\d+/") & field.isin(*HYPOTHESIS_FIELDS) & F.coalesce("_stays", F.lit(False)))
    placed = edits.join(kept.withColumn("_stays", F.lit(True)), both, "left")
    name = F.concat_ws("|", *both)
    return gates.gate(
        gates.repeated(kept.unionByName(gone), both, "partition"),
        gates.mismatched(original, kept.unionByName(gone), both, "partition"),
        gates.violations(told, "reject_and_retained", (action == "reject") == retained, key, action),
        gates.violations(told, "reject_with_edits", (action == "reject") & edited, key),
        gates.violations(told, "silent_change", action.isin("retain", "defer") & (removed | edited), key, action),
        gates.violations(told, "narrow_nothing", (action == "narrow") & ~removed & ~edited, key),
        gates.violations(told, "reframe_nothing", (action == "reframe") & ~edited, key),
        gates.violations(gone.join(state, both, "left"), "removal", ~allowed, name, F.col("finding")),
        gates.violations(scope.join(state, both, "left"), "unresolved_scope", open_, name, F.col("finding")),
        gates.repeated(edits, ["direction", "field_path"], "repeated_edit"),
        gates.violations(placed, "edit_field", ~legal, F.concat_ws("|", "direction", "field_path")),
        gates.violations(edits, "edit_value", ~F.coalesce("changed", F.lit(False)), F.concat_ws("|", "direction", "field_path")),
    )


def duplicates(rows: DataFrame, question: str, sources: str, key: str) -> DataFrame:
    """`rows` with whether an earlier one (by key) asks the same: white space and case aside, with the same set of sources."""
    same = F.struct(F.lower(F.trim(F.regexp_replace(question, r"[\s\p{Z}]+", " "))).alias("q"), F.array_sort(F.array_distinct(sources)).alias("s"))
    digest = F.sha2(F.to_json(same), 256)
    first = rows.groupBy(digest.alias("_d")).agg(F.min(key).alias("_first"))
    return rows.withColumn("_d", digest).join(first, "_d").select(*rows.columns, (F.col(key) > F.col("_first")).alias("duplicate"))


def experiment_links(experiments: DataFrame, statuses: DataFrame) -> DataFrame:
    """(direction, experiment, hypothesis, status) of experiments (direction, experiment, hypothesis_ids) and the statuses of hypotheses."""
    links = experiments.select("direction", "experiment", F.explode("hypothesis_ids").alias("hypothesis"))
    return links.join(statuses, ["direction", "hypothesis"], "left").select("direction", "experiment", "hypothesis", "status")


def assigned_ids(proposals: DataFrame) -> DataFrame:
    """Proposals (index, hypotheses, experiments as structs of id and hypothesis_ids) with ids by position, links rewritten."""
    head = F.format_string("dir-%03d", "index")
    numbered = lambda sign, place: F.format_string(f"%s-{sign}%02d", head, place.cast("int"))
    links = lambda e: F.transform(e["hypothesis_ids"], lambda h: numbered("h", F.array_position("hypotheses", h)))
    made = F.transform("experiments", lambda e, i: F.struct(numbered("e", i + 1).alias("id"), links(e).alias("hypothesis_ids")))
    told = proposals.select(head.alias("direction"), made.alias("experiments"), F.size("hypotheses").alias("_n"), F.col("index"))
    ids = F.transform(F.sequence(F.lit(1), "_n"), lambda i: numbered("h", i))
    return told.select("direction", F.when(F.col("_n") > 0, ids).otherwise(F.array().cast("array<string>")).alias("hypotheses"), "experiments")
