"""Closure of comparisons with prior papers: what a draft, an evidence record, its audit, a published comparison, the inputs of an assessment and a support packet may refer to.

Tables are flat. A paper here is one comparison with one prior paper; targets are a direction or its hypotheses. Every
rule is a join or an aggregate over all papers at once; violations are rows (rule, key, detail).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import gates

PAIR = ["paper", "target"]
#: Coverage that says that the proposed relationship is established, kinds of claim that need explicit scope, and findings on a test: fixed values.
ESTABLISHED = ("direct_empirical", "direct_theoretical", "inferred_implication")
SCOPED = ("result", "evaluation", "theoretical_result")
TESTED = ("tested", "inferred")


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *(F.col(c).cast("string") for c in columns))


def unknown_passages(uses: DataFrame, passages: DataFrame, name: list[str], rule: str = "unknown_passage") -> DataFrame:
    """Passages that rows (paper, name..., passages array) cite and their paper does not have."""
    cited = uses.select("paper", *name, F.explode("passages").alias("passage")).distinct()
    return gates.violations(cited.join(passages.select("paper", "passage").distinct(), ["paper", "passage"], "left_anti"), rule, F.lit(True), _key("paper", *name), F.col("passage"))


def draft_violations(targets: DataFrame, pairs: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """A comparison covers exactly its targets, cites passages of its own paper, and says of every hypothesis whether it was tested; SAME needs a test.

    `targets` (paper, target, level), `pairs` (paper, target, classification, tested), `claims` (paper, claim, passages).
    """
    told = pairs.join(targets.select(*PAIR, "level"), PAIR).where("level = 'hypothesis'")
    return gates.gate(
        gates.mismatched(targets, pairs, PAIR, "target_coverage"),
        unknown_passages(claims, passages, ["claim"]),
        gates.violations(told, "hypothesis_not_assessed", F.col("tested") == "not_applicable", _key(*PAIR)),
        gates.violations(told, "same_without_test", (F.col("classification") == "SAME") & ~F.coalesce(F.col("tested").isin(*TESTED), F.lit(False)), _key(*PAIR), F.col("tested")),
    )


def record_violations(targets: DataFrame, relationships: DataFrame, claims: DataFrame, passages: DataFrame, captions: DataFrame) -> DataFrame:
    """An evidence record covers exactly its targets, anchors known facets once, has all facets covered where the coverage says the relationship is established, and cites a table with what belongs to it.

    `targets` (paper, target, facets array: the paths that a match must cover), `relationships` (paper, target, coverage,
    matches array of (facet, match)), `claims` (paper, claim, passages), `captions` (paper, passage, context).
    """
    told = relationships.join(targets.select(*PAIR, F.array_distinct("facets").alias("facets")), PAIR)
    anchors = F.transform("matches", lambda m: m["facet"])
    wrong = (F.size(anchors) != F.size(F.array_distinct(anchors))) | (F.size(F.array_except(anchors, "facets")) > 0)
    covered = (F.size("facets") > 0) & (F.size(F.array_except("facets", anchors)) == 0) & F.forall("matches", lambda m: m["match"] == "covered")
    cited = claims.select("paper", "claim", F.explode("passages").alias("passage"))
    bare = cited.join(captions.select("paper", "passage", "context"), ["paper", "passage"]).join(cited.select("paper", "claim", F.col("passage").alias("context")).distinct(), ["paper", "claim", "context"], "left_anti")
    return gates.gate(
        gates.mismatched(targets, relationships, PAIR, "target_coverage"),
        gates.repeated(relationships, PAIR, "repeated_target"),
        gates.violations(told, "facet_anchor", wrong, _key(*PAIR)),
        gates.violations(told, "alignment", F.col("coverage").isin(*ESTABLISHED) & ~covered, _key(*PAIR), F.col("coverage")),
        unknown_passages(claims, passages, ["claim"]),
        gates.violations(bare.select("paper", "claim", "context").distinct(), "table_context", F.lit(True), _key("paper", "claim"), F.col("context")),
    )


def audit_violations(claims: DataFrame, targets: DataFrame, claim_checks: DataFrame, coverage_checks: DataFrame, passages: DataFrame) -> DataFrame:
    """An audit checks every claim and every target exactly once, cites passages of the paper, and supports nothing whose scope is open.

    `claims` (paper, claim, kind, passages), `claim_checks` (paper, claim, decision, passages, scope_summary, scopes array
    of (decision, passages)), `coverage_checks` (paper, target, passages).
    """
    told = claim_checks.join(claims.select("paper", "claim", "kind", F.col("passages").alias("_own")), ["paper", "claim"])
    key, supported = _key("paper", "claim"), F.col("decision") == "supported"
    scopes = F.coalesce("scopes", F.array().cast(claim_checks.schema["scopes"].dataType))
    inner = claim_checks.select("paper", "claim", F.flatten(F.transform(scopes, lambda s: s["passages"])).alias("passages"))
    return gates.gate(
        gates.mismatched(claims, claim_checks, ["paper", "claim"], "claim_checks"),
        gates.repeated(claim_checks, ["paper", "claim"], "claim_checked_twice"),
        gates.mismatched(targets, coverage_checks, PAIR, "coverage_checks"),
        gates.repeated(coverage_checks, PAIR, "target_checked_twice"),
        unknown_passages(claim_checks, passages, ["claim"], "check_passage"),
        unknown_passages(coverage_checks, passages, ["target"], "check_passage"),
        unknown_passages(inner, passages, ["claim"], "scope_passage"),
        gates.violations(told, "scope_missing", F.col("scopes").isNull() | F.col("scope_summary").isNull(), key),
        gates.violations(told, "scope_needed", F.col("kind").isin(*SCOPED) & (F.size(scopes) == 0), key, F.col("kind")),
        gates.violations(told, "scope_without_evidence", F.exists(scopes, lambda s: (s["decision"] == "supported") & (F.size(s["passages"]) == 0)), key),
        gates.violations(told, "open_scope", supported & F.exists(scopes, lambda s: s["decision"] != "supported"), key),
        gates.violations(told, "own_evidence", supported & ~F.arrays_overlap("passages", "_own"), key),
    )


def published_violations(papers: DataFrame, targets: DataFrame, pages: DataFrame, missing: DataFrame, passages: DataFrame, reviews: DataFrame, versions: DataFrame, accepted: DataFrame, published: DataFrame) -> DataFrame:
    """A published comparison has its pages in one version, evidence versions without gaps, and exactly the pairs that its last review accepted; what is incomplete says so.

    `papers` (paper, status, diagnostic), `targets` (paper, target), `pages` (paper, page, sha256), `missing` (paper,
    page), `passages` (paper, passage, page, page_sha256), `reviews` (paper, round, evidence_version), `versions` (paper,
    version, reported), `accepted` and `published` (paper, target, content): content is a digest of the pair.
    """
    loaded = pages.select("paper", "page").distinct()
    stale = passages.join(pages.select("paper", "page", F.col("sha256").alias("_sha")), ["paper", "page"], "left")
    last = reviews.groupBy("paper").agg(F.max_by("evidence_version", "round").alias("bound"))
    newest = versions.groupBy("paper").agg(F.max("version").alias("newest"))
    n = lambda df, name: df.groupBy("paper").agg(F.count("*").alias(name))
    told = papers
    for counts in (n(targets, "n_targets"), n(accepted, "n_accepted"), n(published, "n_published"), n(pages, "n_pages"), n(passages, "n_passages"), last, newest):
        told = told.join(counts, "paper", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    out, complete = count("n_published") > 0, count("n_accepted") == count("n_targets")
    unbound = reviews.join(versions.where("reported").select("paper", F.col("version").alias("evidence_version")), ["paper", "evidence_version"], "left_anti")
    content = [*PAIR, "content"]
    only = papers.join(published.select("paper").distinct(), "paper", "left_semi").select("paper")
    return gates.gate(
        gates.repeated(targets, PAIR, "repeated_target"),
        gates.repeated(pages, ["paper", "page"], "repeated_page"),
        gates.repeated(passages, ["paper", "passage"], "repeated_passage"),
        gates.violations(loaded.join(missing.select("paper", "page").distinct(), ["paper", "page"], "left_semi"), "loaded_and_missing", F.lit(True), _key("paper", "page")),
        gates.violations(stale, "page_version", ~F.col("page_sha256").eqNullSafe(F.col("_sha")), _key("paper", "passage"), F.col("page")),
        gates.sequence_gaps(versions, "paper", "version", "evidence_sequence"),
        gates.violations(unbound, "unbound_review", F.lit(True), _key("paper", "round"), F.col("evidence_version")),
        gates.violations(told, "superseded_evidence", out & (F.col("bound") != F.col("newest")), F.col("paper")),
        gates.violations(told, "without_evidence", out & (F.col("n_pages").isNull() | F.col("n_passages").isNull() | F.col("bound").isNull()), F.col("paper")),
        gates.mismatched(accepted.join(only, "paper", "left_semi"), published, content, "projection"),
        gates.violations(told, "published_status", out & ~F.col("status").isin("complete", "partial"), F.col("paper"), F.col("status")),
        gates.violations(told, "completeness", out & ((F.col("status") == "complete") != complete), F.col("paper"), F.col("status")),
        gates.violations(told, "diagnostic", F.when(out, F.col("diagnostic").isNull() != complete).otherwise(F.col("status").isin("complete", "partial") | F.col("diagnostic").isNull()), F.col("paper")),
    )


def lineage_violations(directions: DataFrame, searches: DataFrame, comparisons: DataFrame, target_sets: tuple[DataFrame, DataFrame], shortlists: tuple[DataFrame, DataFrame], retrievals: tuple[DataFrame, DataFrame], artifacts: tuple[DataFrame, DataFrame], marks: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """An assessment's inputs are of one lineage: every direction has one search and one comparison of the same snapshot and signature, targets and shortlists are unchanged, and prior papers have one version.

    `directions` (direction, sha256), `searches` and `comparisons` (direction, candidate_sha256, signature_sha256);
    `target_sets`: (direction, target, level) as proposed and as signed; `shortlists`: (direction, target, paper, rank) as
    ranked and as compared; `retrievals`: (direction, target, status) on both sides; `artifacts`: (direction, paper, sha256)
    of searches and of comparisons; `marks`: invalidations (direction, paper, target, claim; null for any), then the
    compared (direction, paper, target) and their last claims (direction, paper, claim).
    """
    one = lambda rows, rule: gates.gate(gates.repeated(rows, ["direction"], rule), gates.mismatched(directions, rows, ["direction"], rule))
    both = directions.join(searches.select("direction", F.col("candidate_sha256").alias("_s"), F.col("signature_sha256").alias("_sig")), "direction").join(comparisons.select("direction", F.col("candidate_sha256").alias("_c"), F.col("signature_sha256").alias("_csig")), "direction")
    proposed, signed = target_sets
    seen, expected = artifacts
    hashes = seen.groupBy("direction", "paper").agg(F.collect_set("sha256").alias("_seen")).join(expected, ["direction", "paper"], "right")
    invalid, compared, claims = marks
    lost = invalid.join(compared.select("direction", "paper").distinct(), ["direction", "paper"], "left_anti")
    target = invalid.where("target is not null").join(compared, ["direction", "paper", "target"], "left_anti")
    claim = invalid.where("claim is not null").join(claims, ["direction", "paper", "claim"], "left_anti")
    name = _key("direction", "paper")
    return gates.gate(
        one(searches, "search"),
        one(comparisons, "comparison"),
        gates.violations(both, "snapshot", (F.col("_s") != F.col("sha256")) | (F.col("_c") != F.col("sha256")), F.col("direction")),
        gates.violations(both, "signature", ~F.col("_sig").eqNullSafe(F.col("_csig")), F.col("direction")),
        gates.mismatched(proposed.join(signed.select("direction").distinct(), "direction", "left_semi"), signed, ["direction", "target", "level"], "targets"),
        gates.mismatched(*shortlists, ["direction", "target", "paper", "rank"], "shortlist"),
        gates.mismatched(*retrievals, ["direction", "target", "status"], "retrieval"),
        gates.violations(hashes, "artifact", ~F.coalesce((F.size("_seen") == 1) & (F.col("_seen")[0] == F.col("sha256")), F.lit(False)), name),
        gates.violations(lost, "unknown_mark", F.lit(True), name),
        gates.violations(target.join(lost.select("direction", "paper").distinct(), ["direction", "paper"], "left_anti"), "unknown_mark_target", F.lit(True), name, F.col("target")),
        gates.violations(claim.join(lost.select("direction", "paper").distinct(), ["direction", "paper"], "left_anti"), "unknown_mark_claim", F.lit(True), name, F.col("claim")),
    )


def support_violations(expected: DataFrame, artifacts: DataFrame, references: DataFrame, pages: DataFrame, evidence: DataFrame, values: DataFrame) -> DataFrame:
    """A support packet is exactly what its direction was made from: the papers in their versions, the pages with their texts, and evidence that still begins as it was quoted.

    `expected` and `artifacts` (direction, paper, sha256); `references` (direction, page, paper, sha256), `pages` (direction,
    page, paper, text); `evidence` (direction, paper, value_path, source_value, provenance_path), `values` (paper, value_path,
    source_value, provenance_path) of the artifacts.
    """
    version = ["direction", "paper", "sha256"]
    told = pages.join(references.select("direction", "page", F.col("paper").alias("_paper"), F.col("sha256").alias("_sha")), ["direction", "page"])
    changed = (F.col("paper") != F.col("_paper")) | (F.sha2("text", 256) != F.col("_sha"))
    now = values.select("paper", "value_path", F.col("source_value").alias("_value"), F.col("provenance_path").alias("_provenance"))
    quoted = evidence.join(now, ["paper", "value_path"], "left")
    same = F.col("_value").startswith(F.col("source_value")) & F.col("provenance_path").eqNullSafe(F.col("_provenance"))
    return gates.gate(
        gates.mismatched(expected, artifacts, version, "artifact"),
        gates.repeated(artifacts, ["direction", "paper"], "repeated_artifact"),
        gates.mismatched(references, pages, ["direction", "page"], "page"),
        gates.repeated(pages, ["direction", "page"], "repeated_page"),
        gates.violations(told, "page_content", changed, _key("direction", "page")),
        gates.violations(quoted, "evidence", ~F.coalesce(same, F.lit(False)), _key("direction", "paper", "value_path")),
    )
