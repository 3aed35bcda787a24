"""Comparisons of targets with prior papers: coverage, what may be accepted, what blocks it, and repairs that may change no more than they name.

Tables are flat: pairs (direction, target, paper, ...), claims of a pair (target, paper, claim), checks of a review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import gates
from corpusloom.operators.merging import merge

PAIR = ["target", "paper"]
#: Coverage that says something of the prior paper itself: fixed values.
DIRECT = ("direct_empirical", "direct_theoretical")


def coverage_rows(pairs: DataFrame, marks: DataFrame, claims: DataFrame) -> DataFrame:
    """`pairs` with `state`: invalidated, skipped, failed, reviewed or withheld, in that order.

    `pairs` carries target, paper, status, accepted (a comparison of the pair was accepted), coverage. `marks` (paper,
    target or null for all, claim or null for any) invalidate; a mark with a claim hits the pairs that rest on it.
    """
    whole = marks.where("claim is null")
    paper = whole.where("target is null").select("paper").distinct().withColumn("_p", F.lit(True))
    pair = whole.where("target is not null").select(*PAIR).distinct().withColumn("_t", F.lit(True))
    of_claim = marks.where("claim is not null").select("paper", "claim", F.col("target").alias("_target"))
    hit = claims.join(of_claim, ["paper", "claim"]).where("_target is null or _target = target").select(*PAIR).distinct().withColumn("_c", F.lit(True))
    told = pairs.join(paper, "paper", "left").join(pair, PAIR, "left").join(hit, PAIR, "left")
    state = (
        F.when(F.coalesce("_p", "_t", "_c", F.lit(False)), "invalidated")
        .when(F.col("status").isin("skipped", "failed"), F.col("status"))
        .when(F.col("accepted") & F.col("coverage").isNotNull() & (F.col("coverage") != "insufficient_evidence"), "reviewed")
        .otherwise("withheld")
    )
    return told.select(*pairs.columns, state.alias("state"))


def blockers(rows: DataFrame, targets: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(target, blocker): why the recorded comparisons of a target are not complete.

    `rows` carries target, paper, state, n_missing (referenced pages that are missing); `targets` target, retrieval.
    Gaps of single papers block only where the threshold is 1 or not reached; retrieval that is not complete always does.
    """
    good = (F.col("state") == "reviewed") & (F.col("n_missing") == 0)
    told = rows.groupBy("target").agg(F.count("*").alias("total"), F.count_if(good).alias("accepted"))
    per_target = targets.select("target", "retrieval").join(told, "target", "left").withColumn("short", (F.lit(threshold) >= 1.0) | (F.coalesce("total", F.lit(0)) == 0) | (F.col("accepted") / F.col("total") < threshold))
    whole = per_target.select("target", F.explode(F.array_compact(F.array(F.when(F.col("retrieval") != "complete", F.concat(F.lit("retrieval: "), "retrieval")), F.when(F.coalesce("total", F.lit(0)) == 0, "no shortlist")))).alias("blocker"))
    gaps = rows.join(per_target.where("short").select("target"), "target", "left_semi")
    paper = F.col("paper").cast("string")
    single = gaps.select("target", F.explode(F.array_compact(F.array(F.when(F.col("state") != "reviewed", F.concat(paper, F.lit(": "), "state")), F.when(F.col("n_missing") > 0, F.concat(paper, F.lit(": missing pages")))))).alias("blocker"))
    return whole.unionByName(single)


def coverage(rows: DataFrame, targets: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(target, total, accepted, n_blockers, complete) of every target."""
    good = (F.col("state") == "reviewed") & (F.col("n_missing") == 0)
    counted = rows.groupBy("target").agg(F.count("*").alias("total"), F.count_if(good).alias("accepted"))
    found = blockers(rows, targets, threshold).groupBy("target").agg(F.count("*").alias("n_blockers"))
    told = targets.select("target").join(counted, "target", "left").join(found, "target", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.select("target", zero("total"), zero("accepted"), zero("n_blockers"), F.col("n_blockers").isNull().alias("complete"))


def eligible(pairs: DataFrame, claims: DataFrame, checks: DataFrame) -> DataFrame:
    """`pairs` with whether they may be interpreted: their coverage check is adequate, and every claim they rest on is supported and has no citation missing.

    `pairs` carries adequate; `checks` (paper, claim, supported, gap).
    """
    told = claims.join(checks, ["paper", "claim"], "left")
    weak = told.where(~F.coalesce("supported", F.lit(False)) | F.coalesce("gap", F.lit(False))).select(*PAIR).distinct().withColumn("_weak", F.lit(True))
    return pairs.join(weak, PAIR, "left").select(*pairs.columns, (F.coalesce("adequate", F.lit(False)) & F.col("_weak").isNull()).alias("eligible"))


def issue_targets(issues: DataFrame, pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """(paper, target) that issues (paper, field_path) block; target null where the path says none.

    `/pairs/i` names the pair at position i of its paper, `/claims/i` every pair that rests on the claim at position
    i. `pairs` carries paper, target, pos; `claims` paper, target, claim, pos.
    """
    place = F.regexp_extract("field_path", r"^/(pairs|claims)/(\d+)", 1)
    told = issues.select("paper", place.alias("kind"), F.nullif(F.regexp_extract("field_path", r"^/(pairs|claims)/(\d+)", 2), F.lit("")).cast("long").alias("pos"))
    of_pair = told.where("kind = 'pairs'").join(pairs.select("paper", "pos", "target"), ["paper", "pos"], "left").select("paper", "target")
    of_claim = told.where("kind = 'claims'").join(claims.select("paper", "pos", "target"), ["paper", "pos"], "left").select("paper", "target")
    lost = told.where("kind = ''").select("paper", F.lit(None).cast(pairs.schema["target"].dataType).alias("target"))
    return of_pair.unionByName(of_claim).unionByName(lost).distinct()


def accepted_pairs(reports: DataFrame, pairs: DataFrame, claims: DataFrame, issues: DataFrame) -> DataFrame:
    """(paper, target) of the pairs that a review accepts: all where it passes, none where it abstains or there is no report, and else those that no issue names.

    `reports` (paper, decision), `pairs` (paper, target, pos), `claims` (paper, target, claim, pos), `issues` (paper,
    field_path). An issue that names neither a pair nor a claim of its paper blocks every pair of the paper.
    """
    named = issue_targets(issues, pairs, claims)
    veto = named.where("target is null").select("paper").distinct()
    told = pairs.select("paper", "target").join(reports.select("paper", "decision"), "paper")
    revised = told.where("decision = 'revise'").join(veto, "paper", "left_anti").join(named.where("target is not null"), ["paper", "target"], "left_anti")
    return told.where("decision = 'pass'").unionByName(revised).select("paper", "target")


def projected(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """The claims that accepted pairs (target, paper) use."""
    return claims.join(accepted.select(*PAIR).distinct(), PAIR, "left_semi")


def outcomes(pairs: DataFrame, claims: DataFrame, checks: DataFrame) -> DataFrame:
    """(target, paper, review_status, blockers): what a pair's review came to, and for pairs that are not accepted why, in order.

    `pairs` carries status, accepted, coverage, adequate, diagnostic (null: none), reviewed (evidence has a report).
    """
    told = claims.join(checks, ["paper", "claim"], "left").groupBy(*PAIR).agg(F.bool_or("gap").alias("_gap"), F.bool_or(~F.coalesce("supported", F.lit(False))).alias("_claim"))
    rows = pairs.join(told, PAIR, "left")
    some = F.array_compact(F.array(F.when(F.coalesce("_gap", F.lit(False)), "citation_repair"), F.when(F.coalesce("_claim", F.lit(False)), "claim_repair"), F.when(~F.coalesce("adequate", F.lit(False)), "coverage_review")))
    why = (
        F.when(F.col("status") == "skipped", F.array(F.lit("not_attempted")))
        .when(F.col("diagnostic").contains("abstained:"), F.array(F.lit("model_abstention")))
        .when(F.col("diagnostic").rlike(r"^(ValueError:|RuntimeError:|HTTP |input_budget:)"), F.array(F.lit("processing_error")))
        .when(~F.col("reviewed"), F.array(F.lit("evidence_review_error")))
        .when(F.size(some) > 0, some)
        .otherwise(F.array(F.lit("interpretation_review")))
    )
    status = (
        F.when(F.col("accepted"), F.when(F.col("coverage") == "insufficient_evidence", "insufficient_evidence").when(F.col("coverage") == "no_match_found", "no_matching_result_found").otherwise("reviewed"))
        .when(F.col("status") == "skipped", "not_assessed")
        .otherwise("review_unresolved")
    )
    return rows.select(*PAIR, status.alias("review_status"), F.when(F.col("accepted"), F.array().cast("array<string>")).otherwise(why).alias("blockers"))


def repair_scope(pairs: DataFrame, claims: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(disputed claims (paper, claim), targets (paper, target) that may change): claims that are not supported, pairs whose coverage is not adequate, and pairs that rest on a disputed claim. A claim whose only fault is a citation is attached, not rewritten."""
    disputed = checks.where(~F.col("supported") & ~F.col("gap")).select("paper", "claim").distinct()
    dependents = claims.join(disputed, ["paper", "claim"]).select("paper", "target")
    own = pairs.where(~F.coalesce("adequate", F.lit(False))).select("paper", "target")
    return disputed, own.unionByName(dependents).distinct()


def patch_violations(old: DataFrame, patch: DataFrame, scope: DataFrame, keys: list[str], allow_new: bool) -> DataFrame:
    """Rows of a patch that repeat a key, change what is out of scope, or are new without leave."""
    known, inside = old.select(*keys).distinct(), scope.select(*keys).distinct()
    changed = patch.join(known, keys, "left_semi").join(inside, keys, "left_anti")
    new = patch.join(known, keys, "left_anti")
    key = F.concat_ws("|", *keys)
    found = [gates.repeated(patch, keys, "duplicate_patch"), gates.violations(changed, "unaffected_changed", F.lit(True), key)]
    return gates.gate(*found) if allow_new else gates.gate(*found, gates.violations(new, "new_without_leave", F.lit(True), key))


def attached(citations: DataFrame, gaps: DataFrame, captions: DataFrame) -> DataFrame:
    """(claim, passages): a claim's passages in order, then those an audit named, then captions bound to any of them, each once.

    `citations` and `gaps` (claim, pos, passage); `captions` (passage, caption, pos).
    """
    own = citations.select("claim", F.lit(0).alias("turn"), "pos", "passage").unionByName(gaps.select("claim", F.lit(1).alias("turn"), "pos", "passage"))
    bound = own.join(captions.select("passage", "caption", F.col("pos").alias("_pos")), "passage").select("claim", F.lit(2).alias("turn"), F.col("_pos").alias("pos"), F.col("caption").alias("passage"))
    told = own.unionByName(bound).groupBy("claim", "passage").agg(F.min(F.struct("turn", "pos")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "passage")))
    return told.groupBy("claim").agg(F.transform(ordered, lambda x: x.passage).alias("passages"))


def reassessment_violations(parent: DataFrame, fresh: DataFrame, concerns: DataFrame, value: str) -> DataFrame:
    """What a reassessment may not do: name a pair that is not there, change one that no concern names, change nothing where one does, or lose a pair."""
    a, b = parent.select(*PAIR, F.col(value).alias("_old")), fresh.select(*PAIR, F.col(value).alias("_new"))
    named = concerns.select(*PAIR).distinct().withColumn("_named", F.lit(True))
    told = a.join(b, PAIR, "left").join(named, PAIR, "left")
    key, same = F.concat_ws("|", *PAIR), F.col("_old").eqNullSafe(F.col("_new"))
    unknown = named.join(parent.select(*PAIR), PAIR, "left_anti")
    rule = F.when(F.col("_named").isNull() & ~same, "unaffected_changed").when(F.col("_named") & same, "no_correction")
    return gates.gate(gates.violations(unknown, "unknown_pair", F.lit(True), key), told.where(rule.isNotNull()).select(rule.alias("rule"), key.alias("key"), F.lit("").alias("detail")))


def recovered(parent: DataFrame, fresh: DataFrame) -> DataFrame:
    """`parent` papers (direction, paper, status, accepted, ...) with those of `fresh` in their place that recovered.

    Complete papers stay. Another is replaced unless the fresh run skipped or failed, or lost an accepted target
    without any substantive review. `accepted` is an array of targets, `substantive` tells of a review with a report.
    """
    keys = ["direction", "paper"]
    new = fresh.select(*keys, F.struct(*(c for c in fresh.columns if c not in keys)).alias("_new"))
    told = parent.join(new, keys, "left")
    keeps = F.size(F.array_except("accepted", F.col("_new.accepted"))) == 0
    take = F.coalesce((F.col("status") != "complete") & ~F.col("_new.status").isin("skipped", "failed") & (keeps | F.col("_new.substantive")), F.lit(False))
    return told.select(*keys, *(F.when(take, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in parent.columns if c not in keys), take.alias("replaced"))


def reuse(old: DataFrame, new: DataFrame, certificates: DataFrame, key: str, explaining: list[str]) -> DataFrame:
    """(key, decision): same, reuse or recheck of proposals of two versions.

    A changed proposal reuses prior work only if nothing but its explaining fields changed and both decisions of its
    certificate (key, proposed, reviewed) are reuse.
    """
    from corpusloom.operators.reviews import scientific_changes

    all_of, science = scientific_changes(old, new, key, []), scientific_changes(old, new, key, explaining)
    told = all_of.join(science.withColumnRenamed("change", "_science"), key).join(certificates.select(key, "proposed", "reviewed"), key, "left")
    certified = F.coalesce((F.col("proposed") == "reuse") & (F.col("reviewed") == "reuse"), F.lit(False))
    decision = F.when(F.col("change").isin("added", "removed"), F.col("change")).when(F.col("change") == "same", "same").when((F.col("_science") == "same") & certified, "reuse").otherwise("recheck")
    return told.select(key, decision.alias("decision"))


def rebound(records: DataFrame, directions: DataFrame, certificates: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the new versions, violations): prior work of a revised set of directions, reused where that is certified and replaced where it was done again.

    `records` and `fresh` (direction, candidate_sha256, ...), `directions` (direction, old_sha256, new_sha256,
    same_science), `certificates` (direction, decision reuse or recheck, original_sha256, revised_sha256, agreed). An
    unchanged direction keeps its record, a reused one keeps it under the new digest, one to recheck takes the fresh
    one. Nothing is rebound of a direction with a violation.
    """
    told = directions.join(certificates.groupBy("direction").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in ("decision", "original_sha256", "revised_sha256", "agreed"))), "direction", "left")
    due = fresh.groupBy("direction").agg(F.count("*").alias("_fresh"), F.first("candidate_sha256").alias("_digest"))
    told = told.join(due, "direction", "left").withColumn("_changed", ~F.col("old_sha256").eqNullSafe(F.col("new_sha256")))
    again, reused = F.col("decision") == "recheck", F.col("decision") == "reuse"
    lineage = F.col("original_sha256").eqNullSafe(F.col("old_sha256")) & F.col("revised_sha256").eqNullSafe(F.col("new_sha256"))
    rule = (
        F.when(F.col("_changed") & F.col("_n").isNull(), "no_certificate")
        .when(~F.col("_changed") & F.col("_n").isNotNull(), "needless_certificate")
        .when(F.col("_n") > 1, "repeated_certificate")
        .when(F.col("_n").isNotNull() & ~lineage, "certificate_lineage")
        .when(again & F.col("_fresh").isNull(), "no_fresh_work")
        .when(again & (F.col("_digest") != F.col("new_sha256")), "fresh_work_of_another")
        .when(~F.coalesce(again, F.lit(False)) & F.col("_fresh").isNotNull(), "unrelated_refresh")
        .when(reused & ~F.coalesce(F.col("same_science") & F.col("agreed"), F.lit(False)), "reuse_not_borne_out")
    )
    told = told.withColumn("_rule", rule)
    lost = gates.gate(gates.mismatched(directions, records, ["direction"], "record"), gates.violations(fresh.join(directions, "direction", "left_anti"), "unknown_direction", F.lit(True), F.col("direction")))
    sound = told.where("_rule is null").select("direction", "new_sha256", F.coalesce(again & F.col("_changed"), F.lit(False)).alias("_again"))
    kept = records.join(sound.where("not _again"), "direction").withColumn("candidate_sha256", F.col("new_sha256")).select(*records.columns)
    out = kept.unionByName(fresh.join(sound.where("_again").select("direction"), "direction", "left_semi").select(*records.columns))
    return out, lost.unionByName(gates.violations(told, "rebind", F.col("_rule").isNotNull(), F.col("direction"), F.col("_rule")))


def locked(targets: DataFrame, judged: DataFrame, concerns: DataFrame, claims: DataFrame) -> DataFrame:
    """(target, finding): each target's own judgement, UNRESOLVED without one or where a concern (paper, claim or null) disputes evidence it rests on."""
    any_claim = concerns.where("claim is null").select("paper").distinct()
    one_claim = concerns.where("claim is not null").select("paper", "claim").distinct()
    shared = claims.join(any_claim, "paper", "left_semi").select("target").unionByName(claims.join(one_claim, ["paper", "claim"], "left_semi").select("target")).distinct().withColumn("_shared", F.lit(True))
    told = targets.select("target").join(judged.select("target", "finding"), "target", "left").join(shared, "target", "left")
    return told.select("target", F.when(F.col("_shared").isNotNull() | F.col("finding").isNull(), "UNRESOLVED").otherwise(F.col("finding")).alias("finding"))


def merged_pairs(parent: DataFrame, fresh: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(`parent` with the pairs of `fresh` in their place, violations): a patch of interpretations names affected pairs only, each once, or none of a paper's is taken."""
    wrong = gates.gate(gates.repeated(fresh, PAIR, "duplicate_patch"), gates.mismatched(fresh.join(scope.select(*PAIR), PAIR, "left_semi"), fresh, PAIR, "unaffected_changed"))
    bad = fresh.groupBy(*PAIR).agg(F.count("*").alias("_n")).join(scope.select(*PAIR).distinct().withColumn("_in", F.lit(True)), PAIR, "left").where("_n > 1 or _in is null").select("paper").distinct()
    inside = fresh.join(bad, "paper", "left_anti").join(parent.select(*PAIR), PAIR, "left_semi")
    return merge(parent, inside, PAIR), wrong


def needs_repair(scope_gaps: Column, claim_defects: Column, coverage_defects: Column, rounds: Column, repeated: Column, limit: int = 3) -> Column:
    """Whether another round of repair is due: any defect is left, fewer than `limit` rounds were made, and the last one changed something."""
    return (scope_gaps | claim_defects | coverage_defects) & (rounds < limit) & ~repeated
