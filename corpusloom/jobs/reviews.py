"""Queries of comparisons, assessments, critiques and repairs.

Suppliers stand for directions, four groups of parts for a direction and its three hypotheses, orders (modulo 97) for
prior papers; sums of quantities decide on the state of each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.jobs.registry import query
from corpusloom.operators import assessments, comparison
from corpusloom.sources.tables import cut, table

COVERAGE = ("insufficient_evidence", "direct_empirical", "direct_theoretical", "inferred_implication", "discussed", "no_match_found")
OVERLAP = ("SAME", "VERY_CLOSE", "PARTIAL", "DIFFERENT")
FINDINGS = ("ALREADY_STUDIED", "LOW_PRIOR_OVERLAP", "PARTIAL_OVERLAP", "UNRESOLVED")
ACTIONS = ("KEEP", "REFINE", "DOWNRANK", "DISCARD")
_SQL = f"""pr AS (SELECT l_suppkey AS direction, l_partkey % 4 AS k, l_suppkey || '-h' || (l_partkey % 4) AS target, l_orderkey % 97 AS paper, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
pa AS (SELECT *, CASE WHEN q % 11 = 0 THEN 'failed' WHEN q % 13 = 0 THEN 'skipped' ELSE 'complete' END AS status, q % 5 <> 0 AS accepted, ({list(COVERAGE)})[q % 6 + 1] AS coverage, CASE WHEN q % 7 = 0 THEN 2 ELSE 0 END AS n_missing,
({list(OVERLAP)})[q % 4 + 1] AS classification, q % 8 <> 3 AS adequate, CASE WHEN q % 17 = 0 THEN 'ValueError: x' WHEN q % 19 = 0 THEN 'run evidence_abstained: y' END AS diagnostic, q % 23 <> 0 AS reviewed FROM pr),
cl AS (SELECT target, paper, 'c' || unnest([q % 8, (q + 3) % 8]) AS claim FROM pa),
ck AS (SELECT DISTINCT paper, claim, (substr(claim, 2)::INT + paper) % 3 <> 0 AS supported, (substr(claim, 2)::INT + paper) % 5 = 0 AS gap FROM cl),
tg AS (SELECT direction, k, target, sum(q)::BIGINT AS total, CASE WHEN direction % 9 = 0 THEN 'partial' ELSE 'complete' END AS retrieval FROM pa GROUP BY ALL),
mk AS (SELECT DISTINCT paper, NULL::VARCHAR AS target, NULL::VARCHAR AS claim FROM pa WHERE paper % 17 = 3 UNION ALL SELECT DISTINCT paper, target, NULL FROM pa WHERE paper % 19 = 5 AND k = 2 UNION ALL SELECT DISTINCT paper, NULL, claim FROM cl WHERE paper % 23 = 7 AND claim = 'c1'),
cr AS (SELECT pa.*, CASE WHEN paper % 17 = 3 OR (paper % 19 = 5 AND k = 2) OR (paper % 23 = 7 AND (q % 8 = 1 OR (q + 3) % 8 = 1)) THEN 'invalidated' WHEN status <> 'complete' THEN status WHEN accepted AND coverage <> 'insufficient_evidence' THEN 'reviewed' ELSE 'withheld' END AS state FROM pa)"""


def _of(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("direction"), (F.col("l_partkey") % 4).alias("k"), (F.col("l_orderkey") % 97).alias("paper"), "l_quantity")
    pairs = line.groupBy("direction", "k", "paper").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
    q = F.col("q")
    return pairs.withColumns({
        "target": F.concat_ws("-h", F.col("direction").cast("string"), F.col("k").cast("string")),
        "status": F.when(q % 11 == 0, "failed").when(q % 13 == 0, "skipped").otherwise("complete"),
        "accepted": q % 5 != 0,
        "coverage": _of(COVERAGE, q),
        "n_missing": F.when(q % 7 == 0, 2).otherwise(0),
        "classification": _of(OVERLAP, q),
        "adequate": q % 8 != 3,
        "diagnostic": F.when(q % 17 == 0, "ValueError: x").when(q % 19 == 0, "run evidence_abstained: y"),
        "reviewed": q % 23 != 0,
    })


def _claims(pairs: DataFrame) -> DataFrame:
    name = lambda c: F.concat(F.lit("c"), (c % 8).cast("string"))
    return pairs.select("target", "paper", F.posexplode(F.array(name(F.col("q")), name(F.col("q") + 3))).alias("pos", "claim"))


def _checks(claims: DataFrame) -> DataFrame:
    number = F.substring("claim", 2, 1).cast("int") + F.col("paper")
    return claims.select("paper", "claim").distinct().select("paper", "claim", (number % 3 != 0).alias("supported"), (number % 5 == 0).alias("gap"))


def _targets(pairs: DataFrame) -> DataFrame:
    told = pairs.groupBy("direction", "k", "target").agg(F.sum("q").alias("total"))
    return told.withColumns({"retrieval": F.when(F.col("direction") % 9 == 0, "partial").otherwise("complete"), "level": F.when(F.col("k") == 0, "direction").otherwise("hypothesis")})


def _coverage_rows(pairs: DataFrame) -> DataFrame:
    none, claims = F.lit(None).cast("string"), _claims(pairs)
    marks = pairs.where("paper % 17 = 3").select("paper", none.alias("target"), none.alias("claim")).distinct()
    marks = marks.unionByName(pairs.where("paper % 19 = 5 and k = 2").select("paper", "target", none.alias("claim")))
    marks = marks.unionByName(claims.where("paper % 23 = 7 and claim = 'c1'").select("paper", none.alias("target"), "claim").distinct())
    return comparison.coverage_rows(pairs, marks, claims)


@query(f"WITH {_SQL} SELECT target, paper, state FROM cr")
def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of every pair: invalidated, skipped, failed, reviewed or withheld."""
    return _coverage_rows(_pairs(spark, d)).select("target", "paper", "state")


_GOOD = "state = 'reviewed' AND n_missing = 0"
_BLOCKED = f"""ct AS (SELECT target, count(*) AS total, count(*) FILTER (WHERE {_GOOD}) AS accepted FROM cr GROUP BY target),
bl AS (SELECT target, 'retrieval: partial' AS blocker FROM tg WHERE retrieval = 'partial'
UNION ALL SELECT target, paper || ': ' || state FROM cr JOIN ct USING (target) WHERE ct.accepted / ct.total < 0.5 AND state <> 'reviewed'
UNION ALL SELECT target, paper || ': missing pages' FROM cr JOIN ct USING (target) WHERE ct.accepted / ct.total < 0.5 AND n_missing > 0)"""


@query(f"WITH {_SQL}, {_BLOCKED} SELECT target, blocker FROM bl")
def coverage_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What blocks the targets whose coverage is below a half or whose retrieval is partial."""
    pairs = _pairs(spark, d)
    return comparison.blockers(_coverage_rows(pairs), _targets(pairs), 0.5)


@query(f"WITH {_SQL}, {_BLOCKED} SELECT target, total, accepted, coalesce(b, 0) AS n_blockers, b IS NULL AS complete FROM ct LEFT JOIN (SELECT target, count(*) AS b FROM bl GROUP BY target) USING (target)")
def comparison_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Accepted pairs of each target, and whether its coverage is complete."""
    pairs = _pairs(spark, d)
    return comparison.coverage(_coverage_rows(pairs), _targets(pairs), 0.5)


@query(f"WITH {_SQL}, w AS (SELECT target, paper, bool_or(NOT supported OR gap) AS weak FROM cl JOIN ck USING (paper, claim) GROUP BY ALL) SELECT target, paper, adequate AND NOT weak AS eligible FROM pa JOIN w USING (target, paper)")
def eligible_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose evidence review lets them be interpreted."""
    pairs = _pairs(spark, d)
    claims = _claims(pairs)
    return comparison.eligible(pairs, claims, _checks(claims)).select("target", "paper", "eligible")


@query(f"""WITH {_SQL}, po AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY target) - 1 AS pos FROM pa), iss AS (SELECT DISTINCT paper FROM pa)
SELECT DISTINCT i.paper, target FROM iss i JOIN po ON po.paper = i.paper AND pos = i.paper % 3
UNION SELECT i.paper, target FROM iss i JOIN cl ON cl.paper = i.paper AND claim = 'c' || (i.paper % 8)
UNION SELECT paper, NULL FROM iss WHERE paper % 10 = 4""")
def issue_targets(spark: SparkSession, d: str) -> DataFrame:
    """Which pairs of a paper the issues of a review name: by position, by a claim they rest on, or none."""
    from corpusloom.operators.ranking import numbered

    pairs = _pairs(spark, d)
    placed = numbered(pairs.select("paper", "target"), ["paper"], ["target"], "pos").withColumn("pos", F.col("pos") - 1)
    claims = _claims(pairs).select("paper", "target", "claim", F.substring("claim", 2, 1).cast("long").alias("pos"))
    papers = pairs.select("paper").distinct()
    path = lambda head, c: F.concat(F.lit(head), c.cast("string"), F.lit("/text"))
    issues = papers.select("paper", F.explode(F.array_compact(F.array(path("/pairs/", F.col("paper") % 3), path("/claims/", F.col("paper") % 8), F.when(F.col("paper") % 10 == 4, "/summary")))).alias("field_path"))
    return comparison.issue_targets(issues, placed, claims)


@query(f"WITH {_SQL} SELECT target, paper, claim FROM cl JOIN (SELECT target, paper FROM pa WHERE accepted) USING (target, paper)")
def accepted_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims that accepted pairs use."""
    pairs = _pairs(spark, d)
    return comparison.projected(_claims(pairs), pairs.where("accepted")).select("target", "paper", "claim")


@query(f"""WITH {_SQL}, w AS (SELECT target, paper, bool_or(gap) AS gap, bool_or(NOT supported) AS bad FROM cl JOIN ck USING (paper, claim) GROUP BY ALL)
SELECT target, paper, CASE WHEN accepted THEN CASE coverage WHEN 'insufficient_evidence' THEN coverage WHEN 'no_match_found' THEN 'no_matching_result_found' ELSE 'reviewed' END WHEN status = 'skipped' THEN 'not_assessed' ELSE 'review_unresolved' END AS review_status,
CASE WHEN accepted THEN '' WHEN status = 'skipped' THEN 'not_attempted' WHEN diagnostic LIKE '%abstained:%' THEN 'model_abstention' WHEN diagnostic LIKE 'ValueError:%' THEN 'processing_error' WHEN NOT reviewed THEN 'evidence_review_error'
WHEN gap OR bad OR NOT adequate THEN concat_ws('|', CASE WHEN gap THEN 'citation_repair' END, CASE WHEN bad THEN 'claim_repair' END, CASE WHEN NOT adequate THEN 'coverage_review' END) ELSE 'interpretation_review' END AS blockers FROM pa JOIN w USING (target, paper)""")
def pair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What the review of each pair came to, and what is to be repaired where it was not accepted."""
    pairs = _pairs(spark, d)
    claims = _claims(pairs)
    return comparison.outcomes(pairs, claims, _checks(claims)).withColumn("blockers", F.array_join("blockers", "|"))


@query(f"""WITH {_SQL}, di AS (SELECT paper, claim FROM ck WHERE NOT supported AND NOT gap)
SELECT paper, 'claim' AS kind, claim AS id FROM di UNION SELECT paper, 'target', target FROM pa WHERE NOT adequate UNION SELECT paper, 'target', target FROM cl JOIN di USING (paper, claim)""")
def repair_scope(spark: SparkSession, d: str) -> DataFrame:
    """Claims and targets that a repair of each paper may change."""
    pairs = _pairs(spark, d)
    claims = _claims(pairs)
    disputed, targets = comparison.repair_scope(pairs, claims, _checks(claims))
    return disputed.select("paper", F.lit("claim").alias("kind"), F.col("claim").alias("id")).unionByName(targets.select("paper", F.lit("target").alias("kind"), F.col("target").alias("id")))


@query(f"""WITH {_SQL} SELECT 'duplicate_patch' AS rule, target || '|' || paper AS key, '2' AS detail FROM pa WHERE q % 29 = 0
UNION ALL SELECT 'unaffected_changed', target || '|' || paper, '' FROM pa WHERE q % 3 = 0 AND adequate UNION ALL SELECT 'unaffected_changed', target || '|' || paper, '' FROM pa WHERE q % 29 = 0 AND adequate AND q % 3 = 0
UNION ALL SELECT 'unaffected_changed', x, '' FROM (SELECT target || '|' || paper AS x, unnest([1, 2]) FROM pa WHERE q % 29 = 0 AND q % 3 <> 0 AND adequate)
UNION ALL SELECT 'new_without_leave', target || '|' || (paper + 1000), '' FROM pa WHERE q % 31 = 0""")
def patch_violations(spark: SparkSession, d: str) -> DataFrame:
    """Patches that repeat pairs, touch pairs out of scope (adequate ones), or bring new ones."""
    pairs = _pairs(spark, d).select("target", "paper", "q", "adequate")
    twice = pairs.where("q % 29 = 0")
    patch = pairs.where("q % 3 = 0 or q % 29 = 0").unionByName(twice).unionByName(pairs.where("q % 31 = 0").withColumn("paper", F.col("paper") + 1000))
    return comparison.patch_violations(pairs, patch, pairs.where("not adequate"), comparison.PAIR, False)


@query(f"""WITH {_SQL}, c AS (SELECT paper || '/' || claim AS claim, min(target) AS t FROM cl GROUP BY paper, claim), p AS (SELECT claim, 0 AS turn, (('0x' || substr(md5(claim || j), 1, 4))::INT % 5)::BIGINT AS passage, j AS pos FROM c, range(3) r(j)
UNION ALL SELECT claim, 1, (length(t) + j) % 7, j FROM c, range(2) r(j)), b AS (SELECT * FROM p UNION ALL SELECT claim, 2, passage + 100, 0 FROM p WHERE passage % 2 = 0), f AS (SELECT claim, passage, min(turn * 1000 + pos) AS o FROM b GROUP BY ALL)
SELECT claim, string_agg(passage, ',' ORDER BY o, passage) AS passages FROM f GROUP BY claim""")
def attached_citations(spark: SparkSession, d: str) -> DataFrame:
    """Passages of claims with those that an audit named and the captions of their tables."""
    claims = _claims(_pairs(spark, d)).groupBy("paper", "claim").agg(F.min("target").alias("t")).select(F.concat_ws("/", F.col("paper").cast("string"), "claim").alias("claim"), "t")
    digit = lambda j: F.conv(F.substring(F.md5(F.concat("claim", j.cast("string"))), 1, 4), 16, 10).cast("long") % 5
    own = claims.select("claim", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).select("claim", "pos", digit(F.col("pos")).alias("passage"))
    gaps = claims.select("claim", "t", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("pos")).select("claim", "pos", ((F.length("t") + F.col("pos")) % 7).cast("long").alias("passage"))
    captions = own.unionByName(gaps).where("passage % 2 = 0").select("passage").distinct().select("passage", (F.col("passage") + 100).alias("caption"), F.lit(0).alias("pos"))
    return comparison.attached(own, gaps, captions).withColumn("passages", F.array_join(F.transform("passages", lambda x: x.cast("string")), ","))


@query(f"""WITH {_SQL} SELECT CASE WHEN q % 5 = 0 THEN 'no_correction' ELSE 'unaffected_changed' END AS rule, target || '|' || paper AS key, '' AS detail FROM pa WHERE (q % 5 = 0 AND q % 3 <> 0) OR (q % 5 <> 0 AND q % 3 = 0)
UNION ALL SELECT 'unknown_pair', target || '|' || (paper + 500), '' FROM pa WHERE q % 37 = 0""")
def reassessment_violations(spark: SparkSession, d: str) -> DataFrame:
    """A reassessment (every third pair changed) against its concerns (every fifth, some of unknown pairs)."""
    pairs = _pairs(spark, d).select("target", "paper", "q", "classification")
    fresh = pairs.withColumn("classification", F.when(F.col("q") % 3 == 0, F.concat(F.lit("new "), "classification")).otherwise(F.col("classification")))
    concerns = pairs.where("q % 5 = 0").unionByName(pairs.where("q % 37 = 0").withColumn("paper", F.col("paper") + 500))
    return comparison.reassessment_violations(pairs, fresh, concerns, "classification")


_PAPERS = "pp AS (SELECT direction, paper, sum(q) AS q, list_sort(list(target) FILTER (WHERE accepted)) AS accepted FROM pa GROUP BY ALL), ps AS (SELECT direction, paper, q, coalesce(accepted, []) AS accepted, CASE q % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'failed' END AS status, CASE (q + 1) % 5 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' ELSE 'complete' END AS new_status FROM pp), pn AS (SELECT *, CASE WHEN q % 3 = 0 THEN accepted[2:] ELSE accepted END AS new_accepted, q % 7 = 0 AS substantive FROM ps)"


@query(f"""WITH {_SQL}, {_PAPERS} SELECT direction, paper, CASE WHEN t THEN new_status ELSE status END AS status, CASE WHEN t THEN length(new_accepted) ELSE length(accepted) END::BIGINT AS n_accepted, t AS replaced
FROM (SELECT *, status <> 'complete' AND new_status NOT IN ('skipped', 'failed') AND (length(list_filter(accepted, lambda z: NOT list_contains(new_accepted, z))) = 0 OR substantive) AS t FROM pn)""")
def recovered_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers of a run that was cut short, with what a second run recovered."""
    q = F.col("q")
    own = _pairs(spark, d).groupBy("direction", "paper").agg(F.sum("q").alias("q"), F.array_sort(F.collect_list(F.when(F.col("accepted"), F.col("target")))).alias("accepted"))
    parent = own.select("direction", "paper", "accepted", F.when(q % 4 == 0, "complete").when(q % 4 == 1, "partial").otherwise("failed").alias("status"))
    status = F.when((q + 1) % 5 == 0, "skipped").when((q + 1) % 5 == 1, "failed").when((q + 1) % 5 == 2, "partial").otherwise("complete")
    fresh = own.select("direction", "paper", F.when(q % 3 == 0, F.expr("slice(accepted, 2, size(accepted))")).otherwise(F.col("accepted")).alias("accepted"), status.alias("status"), (q % 7 == 0).alias("substantive"))
    return comparison.recovered(parent, fresh).select("direction", "paper", "status", F.size("accepted").cast("long").alias("n_accepted"), "replaced")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' WHEN o_orderpriority = '5-LOW' THEN 'recheck' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'reuse' ELSE 'recheck' END ELSE 'same' END AS decision FROM orders""")
def reuse_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Revised proposals (orders): what may be reused by certificate, and what is to be checked again."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.lit("why").alias("rationale"))
    new = old.where("o_orderstatus <> 'P'").withColumns({"o_orderpriority": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), "rationale": F.when(F.col("o_orderkey") % 3 == 0, "other words").otherwise(F.col("rationale"))})
    decision = lambda n: F.when(F.col("o_orderkey") % n == 0, "reuse").otherwise("recheck")
    certificates = old.select("o_orderkey", decision(2).alias("proposed"), F.when(F.col("o_orderkey") % 5 == 0, "recheck").otherwise("reuse").alias("reviewed"))
    return comparison.reuse(old, new, certificates, "o_orderkey", ["rationale"])


_JUDGED = f"jt AS (SELECT *, ({list(FINDINGS)})[total % 4 + 1] AS finding, CASE WHEN k = 0 THEN 'direction' ELSE 'hypothesis' END AS level, total % 3 <> 0 AS difference FROM tg)"


def _judged(targets: DataFrame) -> DataFrame:
    return targets.withColumns({"finding": _of(FINDINGS, F.col("total")), "difference": F.col("total") % 3 != 0})


@query(f"WITH {_SQL}, {_JUDGED}, s AS (SELECT DISTINCT target FROM cl WHERE paper = 11 OR (paper = 12 AND claim = 'c2')) SELECT target, CASE WHEN total % 6 = 0 OR target IN (SELECT target FROM s) THEN 'UNRESOLVED' ELSE finding END AS finding FROM jt")
def locked_targets(spark: SparkSession, d: str) -> DataFrame:
    """Findings of single targets that a synthesis must keep; disputed evidence reopens them."""
    pairs = _pairs(spark, d)
    judged = _judged(_targets(pairs))
    claims = _claims(pairs)
    concerns = claims.where("paper = 11").select("paper", F.lit(None).cast("string").alias("claim")).unionByName(claims.where("paper = 12 and claim = 'c2'").select("paper", "claim")).distinct()
    return comparison.locked(judged, judged.where("total % 6 <> 0"), concerns, claims)


@query(f"""WITH {_SQL}, {_JUDGED}, {_BLOCKED}, cv AS (SELECT target, target NOT IN (SELECT target FROM bl) AS complete FROM tg), ev AS (SELECT target, paper, classification, coverage FROM cr WHERE state = 'reviewed'),
ci AS (SELECT target, target AS of_target, paper FROM pa WHERE q % 10 = 1 UNION ALL SELECT direction || '-h' || ((k + 1) % 4), target, paper FROM pa WHERE q % 31 = 2),
ke AS (SELECT ci.*, classification, coverage FROM ci LEFT JOIN ev ON ev.target = of_target AND ev.paper = ci.paper),
sa AS (SELECT DISTINCT target FROM ke WHERE of_target = target AND classification IS NOT NULL),
ma AS (SELECT DISTINCT ke.target FROM ke JOIN jt ON jt.target = ke.target WHERE of_target = ke.target AND CASE WHEN level = 'hypothesis' THEN coverage IN ('direct_empirical', 'direct_theoretical') ELSE classification IN ('SAME', 'VERY_CLOSE') END),
ne AS (SELECT DISTINCT target FROM ev WHERE classification IN ('SAME', 'VERY_CLOSE') OR coverage IN ('direct_empirical', 'direct_theoretical', 'inferred_implication'))
SELECT 'unavailable_evidence' AS rule, concat_ws('|', target, of_target, paper) AS key, '' AS detail FROM ke WHERE classification IS NULL
UNION ALL SELECT 'no_same_target_evidence', target, '' FROM jt WHERE finding <> 'UNRESOLVED' AND target NOT IN (SELECT target FROM sa)
UNION ALL SELECT 'low_overlap_incomplete', target, '' FROM jt WHERE finding = 'LOW_PRIOR_OVERLAP' AND target NOT IN (SELECT target FROM cv WHERE complete)
UNION ALL SELECT 'low_overlap_no_difference', target, '' FROM jt WHERE finding = 'LOW_PRIOR_OVERLAP' AND NOT difference
UNION ALL SELECT 'low_overlap_near', target, '' FROM jt WHERE finding = 'LOW_PRIOR_OVERLAP' AND target IN (SELECT target FROM ne)
UNION ALL SELECT 'already_studied_indirect', target, '' FROM jt WHERE finding = 'ALREADY_STUDIED' AND target NOT IN (SELECT target FROM ma)
UNION ALL SELECT 'target_set', target, 'missing' FROM tg WHERE total % 41 = 0""".replace("FROM jt WHERE", "FROM jt WHERE total % 41 <> 0 AND"))
def assessment_violations(spark: SparkSession, d: str) -> DataFrame:
    """Findings that their cited, accepted evidence does not bear."""
    pairs = cut(_pairs(spark, d))
    rows, targets = _coverage_rows(pairs), _targets(pairs)
    cited = pairs.where("q % 10 = 1").select("target", F.col("target").alias("of_target"), "paper").unionByName(pairs.where("q % 31 = 2").select(F.concat_ws("-h", F.col("direction").cast("string"), ((F.col("k") + 1) % 4).cast("string")).alias("target"), F.col("target").alias("of_target"), "paper"))
    evidence = rows.where("state = 'reviewed'").select("target", "paper", "classification", "coverage")
    return assessments.assessment(_judged(targets).where("total % 41 <> 0"), cited, evidence, comparison.coverage(rows, targets, 0.5))


_CRITIC = f"tc AS (SELECT *, ({list(ACTIONS)})[total % 4 + 1] AS action, CASE WHEN k = 0 THEN 'direction' ELSE 'hypothesis' END AS level FROM tg)"


def _criticised(targets: DataFrame) -> DataFrame:
    return targets.withColumn("action", _of(ACTIONS, F.col("total")))


@query(f"""WITH {_SQL}, {_CRITIC}, f0 AS (SELECT target, total, unnest({list(assessments.CRITERIA)}) AS criterion, unnest(range(8)) AS i FROM tc),
fi AS (SELECT target, criterion, ['adequate', 'concern', 'uncertain', 'not_applicable'][(total + i) % 4 + 1] AS assessment, CASE WHEN (total + i) % 3 = 0 THEN 'source_fact' ELSE 'proposal_analysis' END AS basis, (total + i * 5) % 4 AS n_passages, i, total FROM f0 WHERE (total + i) % 50 <> 7),
re AS (SELECT target, '/hypotheses/0/mechanism' AS field_path FROM tc WHERE total % 5 = 1 UNION ALL SELECT target, '/rationale/0/statement' FROM tc WHERE total % 25 = 1 UNION ALL SELECT target || 'x', '/scope' FROM tc WHERE total % 60 = 1)
SELECT 'criteria' AS rule, target || '|' || criterion AS key, 'missing' AS detail FROM f0 WHERE (total + i) % 50 = 7
UNION ALL SELECT 'fact_without_evidence', target || '|' || criterion, '' FROM fi WHERE basis = 'source_fact' AND n_passages = 0
UNION ALL SELECT 'not_applicable', target || '|' || criterion, '' FROM fi WHERE assessment = 'not_applicable' AND criterion <> 'combination_justification'
UNION ALL SELECT 'discard_without_concern', target, '' FROM tc WHERE action = 'DISCARD' AND target NOT IN (SELECT target FROM fi WHERE assessment = 'concern')
UNION ALL SELECT 'refine_and_revisions', target, '' FROM tc WHERE (action = 'REFINE') <> (target IN (SELECT target FROM re))
UNION ALL SELECT DISTINCT 'unknown_target', target, '' FROM re WHERE target LIKE '%x'
UNION ALL SELECT 'immutable_field', target || '|' || field_path, '' FROM re WHERE field_path LIKE '/rationale%'
UNION ALL SELECT 'no_surviving_hypothesis', direction::VARCHAR, '' FROM tc GROUP BY direction HAVING bool_or(level = 'hypothesis') AND NOT bool_or(level = 'hypothesis' AND action <> 'DISCARD') AND bool_or(level = 'direction' AND action <> 'DISCARD')""")
def critique_violations(spark: SparkSession, d: str) -> DataFrame:
    """Critiques that leave out criteria, cite nothing for facts, or act against their own findings and revisions."""
    targets = _criticised(_targets(_pairs(spark, d)))
    i, total = F.col("i"), F.col("total")
    findings = targets.select("target", "total", F.posexplode(F.array(*map(F.lit, assessments.CRITERIA))).alias("i", "criterion")).where((total + i) % 50 != 7)
    findings = findings.select("target", "criterion", _of(("adequate", "concern", "uncertain", "not_applicable"), total + i).alias("assessment"), F.when((total + i) % 3 == 0, "source_fact").otherwise("proposal_analysis").alias("basis"), ((total + i * 5) % 4).alias("n_passages"))
    one = lambda where, target, path: targets.where(where).select(target.alias("target"), F.lit(path).alias("field_path"))
    revisions = one("total % 5 = 1", F.col("target"), "/hypotheses/0/mechanism").unionByName(one("total % 25 = 1", F.col("target"), "/rationale/0/statement")).unionByName(one("total % 60 = 1", F.concat("target", F.lit("x")), "/scope"))
    return assessments.critique(targets, findings, revisions)


@query(f"""WITH {_SQL}, {_CRITIC}, re AS (SELECT direction, target, CASE WHEN total % 3 = 0 THEN 'e1' END AS experiment FROM tc WHERE total % 7 = 1),
li AS (SELECT direction, 'e1' AS experiment, target AS hypothesis FROM tc WHERE level = 'hypothesis' AND k <> 2),
ch AS (SELECT direction, target FROM re UNION SELECT direction, hypothesis FROM re JOIN li USING (direction, experiment)),
ca AS (SELECT * FROM ch UNION SELECT tc.direction, tc.target FROM tc WHERE level = 'hypothesis' AND action <> 'DISCARD' AND direction IN (SELECT ch.direction FROM ch JOIN tc x ON x.target = ch.target WHERE x.level = 'direction')),
hd AS (SELECT direction, target, action, (SELECT string_agg(target, ',' ORDER BY target) FROM (SELECT c.target FROM ca c WHERE c.direction = tc.direction UNION SELECT tc.target)) AS every, (SELECT count(*) FROM ca c WHERE c.direction = tc.direction) AS n, (SELECT count(*) FROM tc x WHERE x.direction = tc.direction AND x.level = 'hypothesis' AND x.action = 'DISCARD') AS removed FROM tc WHERE level = 'direction')
SELECT direction, CASE WHEN direction % 10 = 0 THEN 'merge' WHEN action = 'DISCARD' THEN 'stop' WHEN n > 0 THEN 'revise' WHEN removed > 0 THEN 'narrow' ELSE 'ranking' END AS next_stage, CASE WHEN action <> 'DISCARD' AND (n > 0 OR removed > 0) THEN every ELSE '' END AS recheck FROM hd""")
def critic_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where each criticised direction goes next, and what of it needs a fresh novelty check."""
    targets = _criticised(_targets(_pairs(spark, d)))
    revisions = targets.where("total % 7 = 1").select("direction", "target", F.when(F.col("total") % 3 == 0, "e1").alias("experiment"))
    links = targets.where("level = 'hypothesis' and k <> 2").select("direction", F.lit("e1").alias("experiment"), F.col("target").alias("hypothesis"))
    merges = targets.where("direction % 10 = 0").select("direction").distinct()
    return assessments.routes(targets, revisions, links, merges).withColumn("recheck", F.array_join("recheck", ","))


@query(f"""WITH {_SQL}, {_CRITIC}, h AS (SELECT direction, target AS hypothesis, action, total, k FROM tc WHERE level = 'hypothesis'),
p AS (SELECT *, CASE WHEN total % 13 = 0 THEN 'other' ELSE 'same' END AS digest, CASE WHEN total % 17 = 0 THEN 'approved' WHEN action IN ('KEEP', 'DOWNRANK') THEN 'approved' WHEN action = 'DISCARD' THEN 'discarded' ELSE 'pending' END AS status FROM h WHERE total % 19 <> 0)
SELECT 'hypotheses_preserved' AS rule, direction || '|' || hypothesis AS key, 'missing' AS detail FROM h WHERE total % 19 = 0
UNION ALL SELECT 'proposal_changed', direction || '|' || hypothesis, '' FROM p WHERE digest = 'other'
UNION ALL SELECT 'status_of_action', direction || '|' || hypothesis, action FROM p WHERE total % 17 = 0 AND action IN ('REFINE', 'DISCARD')
UNION ALL SELECT 'ineligible_published', direction || '|' || hypothesis, 'incomplete evidence' FROM p WHERE direction % 9 = 0 AND status <> 'pending'""")
def publication_violations(spark: SparkSession, d: str) -> DataFrame:
    """Published hypotheses against the original ones, their reviewed actions and their eligibility."""
    hypotheses = _criticised(_targets(_pairs(spark, d))).where("level = 'hypothesis'").withColumnRenamed("target", "hypothesis")
    total, action = F.col("total"), F.col("action")
    status = F.when(total % 17 == 0, "approved").when(action.isin("KEEP", "DOWNRANK"), "approved").when(action == "DISCARD", "discarded").otherwise("pending")
    published = hypotheses.where("total % 19 <> 0").select("direction", "hypothesis", F.when(total % 13 == 0, "other").otherwise("same").alias("digest"), status.alias("status"))
    reason = assessments.eligibility(F.lit(True), F.col("retrieval") == "complete", F.lit("partial_overlap"), F.lit(False), F.lit(False))
    ineligible = hypotheses.select("direction", "hypothesis", reason.alias("reason")).where("reason is not null")
    return assessments.publication(hypotheses.select("direction", "hypothesis", F.lit("same").alias("digest")), published, hypotheses.select("direction", "hypothesis", "action"), ineligible)


@query(f"""WITH {_SQL}, d AS (SELECT DISTINCT direction FROM tg), m0 AS (SELECT direction // 3 AS merge, direction FROM d UNION ALL SELECT direction // 3 + 1, direction FROM d WHERE direction % 30 = 2),
me AS (SELECT merge, m0.direction, target AS hypothesis FROM m0 JOIN tg USING (direction) WHERE k > 0 AND NOT (direction % 11 = 0 AND k = 2)),
sp AS (SELECT direction, 'p' || (direction * 10 + j) AS passage FROM d, range(2) r(j)), ci AS (SELECT DISTINCT merge, passage FROM m0 JOIN sp USING (direction) WHERE direction % 7 <> 0 UNION SELECT merge, 'q' || merge FROM m0 WHERE merge % 8 = 0)
SELECT 'overlapping_member' AS rule, direction::VARCHAR AS key, '' AS detail FROM d WHERE direction % 30 = 2
UNION ALL SELECT 'hypotheses_preserved', direction || '|' || target, 'missing' FROM tg WHERE direction % 11 = 0 AND k = 2
UNION ALL SELECT DISTINCT 'member_without_source', merge || '|' || direction, '' FROM m0 WHERE direction % 7 = 0
UNION ALL SELECT 'foreign_passage', merge || '|' || passage, '' FROM ci WHERE passage LIKE 'q%'""")
def portfolio_violations(spark: SparkSession, d: str) -> DataFrame:
    """Merges of three directions each, some overlapping, incomplete or badly sourced."""
    targets = _targets(_pairs(spark, d)).where("k > 0")
    own = targets.select("direction").distinct()
    merges = own.select(F.floor(F.col("direction") / 3).alias("merge"), "direction").unionByName(own.where("direction % 30 = 2").select((F.floor(F.col("direction") / 3) + 1).alias("merge"), "direction"))
    hypotheses = targets.select("direction", F.col("target").alias("hypothesis"))
    members = merges.join(targets, "direction").where("not (direction % 11 = 0 and k = 2)").select("merge", "direction", F.col("target").alias("hypothesis"))
    passages = own.select("direction", F.explode(F.array(F.lit(0), F.lit(1))).alias("j")).select("direction", F.concat(F.lit("p"), (F.col("direction") * 10 + F.col("j")).cast("string")).alias("passage"))
    cited = merges.where("direction % 7 <> 0").join(passages, "direction").select("merge", "passage").unionByName(merges.where("merge % 8 = 0").select("merge", F.concat(F.lit("q"), F.col("merge").cast("string")).alias("passage"))).distinct()
    return assessments.portfolio_merges(members, hypotheses, cited, passages)


@query("""WITH r AS (SELECT conv_id * 100 + turn AS review, conv_id AS opportunity, turn AS round, CASE WHEN length(text) % 3 = 0 THEN 'revise' ELSE 'pass' END AS decision, md5(text) AS digest FROM conversations),
d AS (SELECT conv_id AS direction, CASE WHEN conv_id % 13 = 0 THEN conv_id + 1 ELSE conv_id END AS opportunity, conv_id * 100 + (max(turn) - CASE WHEN conv_id % 4 = 0 AND max(turn) > 0 THEN 1 ELSE 0 END) + CASE WHEN conv_id % 17 = 0 THEN 90 ELSE 0 END AS review, conv_id % 11 = 0 AS changed FROM conversations GROUP BY conv_id)
SELECT * FROM (SELECT CASE WHEN r.review IS NULL THEN 'unknown_review' WHEN r.opportunity <> d.opportunity THEN 'other_opportunity' WHEN decision <> 'pass' THEN 'not_passed' WHEN changed THEN 'other_proposal' WHEN (SELECT max(round) FROM r x WHERE x.opportunity = d.opportunity) > r.round THEN 'superseded' END AS rule, d.direction::VARCHAR AS key, d.review::VARCHAR AS detail
FROM d LEFT JOIN r USING (review)) WHERE rule IS NOT NULL""")
def unreviewed_directions(spark: SparkSession, d: str) -> DataFrame:
    """Directions (conversations) that don't rest on the last review (turn) that passed their exact proposal."""
    turns = table(spark, d, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    reviews = turns.select(key.alias("review"), F.col("conv_id").alias("opportunity"), F.col("turn").alias("round"), F.when(F.length("text") % 3 == 0, "revise").otherwise("pass").alias("decision"), F.md5("text").alias("digest"))
    conv = F.col("conv_id")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    chosen = F.col("turn") - F.when((conv % 4 == 0) & (F.col("turn") > 0), 1).otherwise(0)
    picked = last.select(conv.alias("direction"), F.when(conv % 13 == 0, conv + 1).otherwise(conv).alias("opportunity"), (conv * 100 + chosen + F.when(conv % 17 == 0, 90).otherwise(0)).alias("review"))
    told = picked.join(reviews.select("review", F.col("digest").alias("_digest")), "review", "left")
    directions = told.select("direction", "opportunity", "review", F.when(F.col("direction") % 11 == 0, "changed").otherwise(F.col("_digest")).alias("digest"))
    return assessments.latest_passing(directions, reviews)


@query(f"""WITH {_SQL}, c AS (SELECT direction AS thread, target AS candidate, k FROM tg), de AS (SELECT thread, candidate FROM c WHERE k <> 3 OR thread % 5 <> 0 UNION ALL SELECT thread, candidate FROM c WHERE thread % 9 = 1 AND k = 1)
SELECT 'duplicate_decision' AS rule, thread || '|' || candidate AS key, '2' AS detail FROM c WHERE thread % 9 = 1 AND k = 1
UNION ALL SELECT 'decision_set', thread || '|' || candidate, 'missing' FROM c WHERE k = 3 AND thread % 5 = 0
UNION ALL SELECT 'unknown_page', direction || '|' || target, paper::VARCHAR FROM pa WHERE paper % 9 = 8""")
def review_violations(spark: SparkSession, d: str) -> DataFrame:
    """Review calls whose decisions are not one for each candidate, or that cite pages they were not given."""
    pairs = _pairs(spark, d)
    candidates = _targets(pairs).select(F.col("direction").alias("thread"), F.col("target").alias("candidate"), "k")
    decisions = candidates.where("k <> 3 or thread % 5 <> 0").unionByName(candidates.where("thread % 9 = 1 and k = 1"))
    cited = pairs.select(F.col("direction").alias("thread"), F.col("target").alias("candidate"), F.col("paper").alias("page"))
    pages = cited.where("page % 9 <> 8").select("thread", "page")
    return assessments.review_decisions(candidates, decisions, cited, pages)


@query(f"""WITH {_SQL}, f AS (SELECT direction AS thread, target AS finding, k FROM tg), c AS (SELECT direction AS thread, target AS finding, paper AS evidence, CASE WHEN q % 9 <> 0 THEN 'supports' END AS stance, CASE WHEN q % 4 = 0 THEN 'condition' ELSE 'evidence' END AS kind FROM pa WHERE NOT (k = 3 AND direction % 6 = 0))
SELECT 'STRUCTURAL:no_evidence' AS rule, thread || '|' || finding AS key, '' AS detail FROM f WHERE finding NOT IN (SELECT finding FROM c WHERE kind = 'evidence')
UNION ALL SELECT 'STRUCTURAL:no_stance', thread || '|' || finding, evidence::VARCHAR FROM c WHERE kind = 'evidence' AND stance IS NULL
UNION ALL SELECT 'CITATION:unknown', thread || '|' || finding, evidence::VARCHAR FROM c WHERE kind = 'evidence' AND evidence % 10 = 9
UNION ALL SELECT 'CITATION:condition_outside', thread || '|' || finding, evidence::VARCHAR FROM c WHERE kind = 'condition'""")
def citation_violations(spark: SparkSession, d: str) -> DataFrame:
    """Drafts that cite nothing, without a stance, what the bundle has not, or in conditions what the finding has not."""
    pairs = _pairs(spark, d)
    findings = _targets(pairs).select(F.col("direction").alias("thread"), F.col("target").alias("finding"))
    citations = pairs.where("not (k = 3 and direction % 6 = 0)").select(F.col("direction").alias("thread"), F.col("target").alias("finding"), F.col("paper").alias("evidence"), F.when(F.col("q") % 9 != 0, "supports").alias("stance"), F.when(F.col("q") % 4 == 0, "condition").otherwise("evidence").alias("of"))
    return assessments.draft_citations(findings, citations, citations.where("evidence % 10 <> 9").select("thread", "evidence"))


@query(f"""WITH {_SQL}, c AS (SELECT target, direction, count(DISTINCT paper) FILTER (WHERE q % 4 <> 0) AS papers, max(total) AS total FROM pa JOIN tg USING (target, direction) GROUP BY ALL)
SELECT direction AS thread, target AS candidate, CASE WHEN total % 5 = 0 THEN CASE WHEN total % 2 + 1 >= 2 AND papers >= 2 THEN 'tension' ELSE 'diagnostic' END WHEN papers = 0 THEN 'diagnostic' WHEN papers = 1 THEN 'observation' ELSE 'finding' END AS kind,
CASE WHEN (total % 5 = 0 AND NOT (total % 2 + 1 >= 2 AND papers >= 2)) OR (total % 5 <> 0 AND papers = 0) THEN 'no_valid_evidence' WHEN target IN (SELECT target FROM pa WHERE q % 97 = 8) THEN 'insufficient_pages' WHEN total % 3 = 0 THEN 'rejected' WHEN total % 3 = 1 THEN 'accepted' ELSE 'insufficient' END AS route FROM c""")
def accepted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each candidate: its kind by its papers, and its route by pages and decision."""
    pairs = _pairs(spark, d)
    told = pairs.groupBy(F.col("direction").alias("thread"), F.col("target").alias("candidate")).agg(F.countDistinct(F.when(F.col("q") % 4 != 0, F.col("paper"))).alias("papers"), F.sum("q").alias("total"))
    candidates = told.select("thread", "candidate", "papers", (F.col("total") % 5 == 0).alias("tension"), (F.col("total") % 2 + 1).alias("sides"))
    decisions = told.select("thread", "candidate", _of(("reject", "accept", "insufficient"), F.col("total")).alias("decision"))
    required = pairs.select(F.col("direction").alias("thread"), F.col("target").alias("candidate"), F.concat_ws("#", "target", F.col("paper").cast("string")).alias("page"), "q")
    return assessments.accepted_candidates(candidates, decisions, required.drop("q"), required.where("q % 97 <> 8").select("thread", "page"))


@query(f"""WITH {_SQL}, e AS (SELECT target AS candidate, paper, paper AS evidence FROM pa), r AS (SELECT target AS candidate, paper, CASE WHEN q % 3 = 0 AND direction % 8 <> 0 THEN 'supporting' ELSE 'context_only' END AS role FROM pa WHERE q % 43 <> 0 UNION ALL SELECT target, paper, 'context_only' FROM pa WHERE q % 47 = 1)
SELECT 'duplicate_role' AS rule, candidate || '|' || paper AS key, count(*)::VARCHAR AS detail FROM r GROUP BY candidate, paper HAVING count(*) > 1
UNION ALL SELECT 'role_set', target || '|' || paper, 'missing' FROM pa WHERE q % 43 = 0 AND q % 47 <> 1
UNION ALL SELECT 'no_supporting_paper', target, '' FROM tg WHERE target NOT IN (SELECT candidate FROM r WHERE role = 'supporting')
UNION ALL SELECT 'foreign_evidence', target || '|' || paper, (paper + 1)::VARCHAR FROM pa WHERE q % 53 = 2""")
def role_violations(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities whose papers have no role or two, none that supports, or evidence of another paper."""
    pairs = _pairs(spark, d)
    evidence = pairs.select(F.col("target").alias("candidate"), "paper", F.col("paper").alias("evidence"))
    role = F.when((F.col("q") % 3 == 0) & (F.col("direction") % 8 != 0), "supporting").otherwise("context_only")
    roles = pairs.where("q % 43 <> 0").select(F.col("target").alias("candidate"), "paper", role.alias("role")).unionByName(pairs.where("q % 47 = 1").select(F.col("target").alias("candidate"), "paper", F.lit("context_only").alias("role")))
    cited = evidence.unionByName(pairs.where("q % 53 = 2").select(F.col("target").alias("candidate"), "paper", (F.col("paper") + 1).alias("evidence")))
    return assessments.paper_roles(roles, evidence, cited)


@query(f"""WITH {_SQL} SELECT 'not_retrieved' AS rule, target || '|' || paper AS key, '' AS detail FROM pa WHERE q % 59 = 3 UNION ALL SELECT 'restricted', target, '' FROM tg WHERE total % 15 = 0
UNION ALL SELECT 'hidden_error', target, '' FROM tg WHERE retrieval = 'complete' AND total % 14 = 0 UNION ALL SELECT 'no_diagnostic', target, '' FROM tg WHERE retrieval = 'partial' AND total % 14 <> 0""")
def ranking_violations(spark: SparkSession, d: str) -> DataFrame:
    """Retrievals that rank what they did not find, were restricted, or hide their errors."""
    pairs = _pairs(spark, d)
    records = _targets(pairs).select("target", F.col("retrieval").alias("status"), F.when(F.col("total") % 14 == 0, "error").alias("diagnostic"), (F.col("total") % 15 == 0).alias("restricted"))
    return assessments.rankings(records, pairs, pairs.where("q % 59 <> 3"))


@query(f"""WITH {_SQL}, l AS (SELECT direction, target AS hypothesis, unnest(['e1', 'e2']) AS experiment, total FROM tg WHERE k > 0), ch AS (SELECT direction, hypothesis, experiment, total FROM l WHERE total % 6 <> 2 UNION ALL SELECT direction, hypothesis, experiment, total FROM l WHERE total % 23 = 1)
SELECT 'duplicate_check' AS rule, concat_ws('|', direction, hypothesis, experiment) AS key, count(*)::VARCHAR AS detail FROM ch GROUP BY direction, hypothesis, experiment HAVING count(*) > 1
UNION ALL SELECT 'link_set', concat_ws('|', direction, hypothesis, experiment), 'missing' FROM l WHERE total % 6 = 2 AND total % 23 <> 1
UNION ALL SELECT 'contradiction_without_request', concat_ws('|', direction, hypothesis, experiment), '' FROM ch WHERE total % 5 = 0 AND experiment = 'e1' AND total % 10 <> 0 AND direction % 6 <> 0""")
def link_violations(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that miss or repeat links of hypotheses and experiments, or find contradictions and ask for nothing."""
    links = _targets(_pairs(spark, d)).where("k > 0").select("direction", F.col("target").alias("hypothesis"), F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("experiment"), "total")
    told = links.withColumn("decision", F.when((F.col("total") % 5 == 0) & (F.col("experiment") == "e1"), "contradiction").otherwise("consistent"))
    checks = told.where("total % 6 <> 2").unionByName(told.where("total % 23 = 1"))
    requests = links.where("total % 10 = 0").select("direction", F.col("hypothesis").alias("target")).unionByName(links.where("direction % 6 = 0").select("direction", F.col("direction").cast("string").alias("target")))
    return assessments.link_checks(links, checks, requests)


@query("""WITH q AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]+', ' ', 'g'))) AS k, source AS s FROM documents)
SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY k, s) AS duplicate FROM q""")
def repeated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions (documents) that an earlier one of the same sources asks already."""
    own = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("question"), F.array("source", "source").alias("sources"))
    return assessments.duplicates(own, "question", "sources", "doc_id").select("doc_id", "duplicate")


@query("SELECT event_type, user_id, round(value)::BIGINT AS v, min(event_id) AS event_id FROM events GROUP BY event_type, user_id, round(value)::BIGINT")
def distinct_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests (events of a user with a value in whole numbers) that are not the same, the first of each."""
    own = table(spark, d, "events").select("event_id", "event_type", "user_id", F.round("value").cast("long").alias("v"))
    return assessments.distinct_requests(own, ["event_type", "user_id", "v"], ["event_id"]).drop("digest")


@query(f"""WITH {_SQL}, po AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY target) - 1 AS pos FROM pa),
re AS (SELECT DISTINCT paper, CASE WHEN paper % 5 = 0 THEN 'pass' WHEN paper % 5 = 1 THEN 'abstain' WHEN paper % 5 < 4 THEN 'revise' END AS decision FROM pa),
nm AS (SELECT po.paper, target FROM po WHERE pos = paper % 3 UNION SELECT paper, target FROM cl WHERE claim = 'c' || (paper % 8))
SELECT paper, target FROM po JOIN re USING (paper) WHERE decision = 'pass' OR (decision = 'revise' AND paper % 7 NOT IN (3, 4) AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.paper = po.paper AND nm.target = po.target))""")
def accepted_targets(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that reviews accept; an issue that names no pair, or one that is not there, blocks its whole paper."""
    from corpusloom.operators.ranking import numbered

    pairs = cut(_pairs(spark, d))
    placed = numbered(pairs.select("paper", "target"), ["paper"], ["target"], "pos").withColumn("pos", F.col("pos") - 1)
    claims = _claims(pairs).select("paper", "target", "claim", F.substring("claim", 2, 1).cast("long").alias("pos"))
    n = F.col("paper") % 5
    reports = pairs.select("paper").distinct().select("paper", F.when(n == 0, "pass").when(n == 1, "abstain").when(n < 4, "revise").alias("decision"))
    path = lambda head, c: F.concat(F.lit(head), c.cast("string"), F.lit("/text"))
    k = F.col("paper") % 7
    issues = reports.select("paper", F.explode(F.array_compact(F.array(path("/pairs/", F.col("paper") % 3), path("/claims/", F.col("paper") % 8), F.when(k == 3, "/summary"), F.when(k == 4, "/pairs/1000000/text")))).alias("field_path"))
    return comparison.accepted_pairs(reports, placed, claims, issues)


@query(f"""WITH {_SQL}, fr AS (SELECT target, paper FROM pa WHERE q % 4 = 1 UNION ALL SELECT target, paper FROM pa WHERE q % 4 = 1 AND paper % 10 = 3),
sc AS (SELECT target, paper FROM pa WHERE q % 4 = 1 AND NOT (paper % 10 = 4 AND q % 8 = 1)),
bd AS (SELECT paper FROM fr GROUP BY paper, target HAVING count(*) > 1 UNION SELECT fr.paper FROM fr WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.paper = fr.paper AND sc.target = fr.target))
SELECT target, paper, CASE WHEN q % 4 = 1 AND paper NOT IN (SELECT paper FROM bd) THEN 'new ' || q ELSE 'old' END AS text FROM pa""")
def patched_interpretations(spark: SparkSession, d: str) -> DataFrame:
    """Interpretations of pairs after patches; a paper whose patch repeats a pair or changes one that is not affected keeps all of its own."""
    pairs = cut(_pairs(spark, d))
    own = pairs.select("target", "paper", F.lit("old").alias("text"))
    fresh = pairs.where("q % 4 = 1").select("target", "paper", F.concat(F.lit("new "), F.col("q").cast("string")).alias("text"))
    scope = pairs.where("q % 4 = 1 and not (paper % 10 = 4 and q % 8 = 1)").select("target", "paper")
    return comparison.merged_pairs(own, fresh.unionByName(fresh.where("paper % 10 = 3")), scope)[0]


_ACTIONS = ("retain", "narrow", "reframe", "reject", "defer")


@query(f"""WITH {_SQL}, jt AS (SELECT direction, k, target, total, ({list(FINDINGS)})[total % 4 + 1] AS finding, total % 3 > 0 AS complete FROM tg),
di AS (SELECT direction, max(total) FILTER (WHERE k = 0) AS t0 FROM jt GROUP BY direction HAVING count(*) FILTER (WHERE k = 0) > 0), pr2 AS (SELECT direction, t0, ({list(_ACTIONS)})[t0 % 5 + 1] AS action FROM di),
hy AS (SELECT jt.*, action, t0, CASE WHEN total % 11 = 1 THEN NULL WHEN action = 'reject' OR total % 4 = 0 THEN 'removed' ELSE 'retained' END AS part FROM jt JOIN pr2 USING (direction) WHERE k > 0),
ed AS (SELECT direction, t0, '/scope' AS field_path, t0 % 7 <> 1 AS changed FROM pr2 WHERE t0 % 3 = 0 UNION ALL SELECT direction, t0, '/title', true FROM pr2 WHERE t0 % 6 = 0 UNION ALL SELECT direction, t0, '/scope', true FROM pr2 WHERE t0 % 12 = 0),
n AS (SELECT pr2.*, (SELECT count(*) FROM hy WHERE hy.direction = pr2.direction AND part = 'retained') AS kept, (SELECT count(*) FROM hy WHERE hy.direction = pr2.direction AND part = 'removed') AS gone, (SELECT count(*) FROM ed WHERE ed.direction = pr2.direction) AS edits FROM pr2)
SELECT 'partition' AS rule, direction || '|' || target AS key, 'missing' AS detail FROM hy WHERE part IS NULL
UNION ALL SELECT 'reject_and_retained', direction::VARCHAR, action FROM n WHERE (action = 'reject') = (kept > 0)
UNION ALL SELECT 'reject_with_edits', direction::VARCHAR, '' FROM n WHERE action = 'reject' AND edits > 0
UNION ALL SELECT 'silent_change', direction::VARCHAR, action FROM n WHERE action IN ('retain', 'defer') AND (gone > 0 OR edits > 0)
UNION ALL SELECT 'narrow_nothing', direction::VARCHAR, '' FROM n WHERE action = 'narrow' AND gone = 0 AND edits = 0
UNION ALL SELECT 'reframe_nothing', direction::VARCHAR, '' FROM n WHERE action = 'reframe' AND edits = 0
UNION ALL SELECT 'removal', direction || '|' || target, finding FROM hy WHERE part = 'removed' AND finding <> 'ALREADY_STUDIED'
UNION ALL SELECT 'unresolved_scope', direction || '|' || target, finding FROM hy WHERE action = 'retain' AND part = 'retained' AND (NOT complete OR finding = 'UNRESOLVED')
UNION ALL SELECT 'repeated_edit', direction || '|/scope', '2' FROM pr2 WHERE t0 % 12 = 0
UNION ALL SELECT 'edit_field', direction || '|/title', '' FROM pr2 WHERE t0 % 6 = 0
UNION ALL SELECT 'edit_value', direction || '|/scope', '' FROM pr2 WHERE t0 % 3 = 0 AND t0 % 7 = 1""")
def refinement_violations(spark: SparkSession, d: str) -> DataFrame:
    """Refinements whose action, removals or edits their findings do not bear."""
    targets = cut(_targets(_pairs(spark, d)))
    total, t0 = F.col("total"), F.col("t0")
    findings = targets.select("direction", "target", _of(FINDINGS, total).alias("finding"))
    coverage = targets.select("direction", "target", (total % 3 > 0).alias("complete"))
    first = targets.where("k = 0").select("direction", total.alias("t0"))
    proposals = first.select("direction", _of(_ACTIONS, t0).alias("action"), "t0")
    hypotheses = targets.where("k > 0").join(proposals, "direction")
    part = F.when(total % 11 == 1, None).when((F.col("action") == "reject") | (total % 4 == 0), "removed").otherwise("retained")
    parts = hypotheses.select("direction", F.col("target").alias("hypothesis"), F.explode(F.array_compact(F.array(F.lit("original"), part))).alias("part"))
    edit = lambda where, path, changed: proposals.where(where).select("direction", F.lit(path).alias("field_path"), F.lit(None).cast("string").alias("hypothesis"), changed.alias("changed"))
    edits = edit("t0 % 3 = 0", "/scope", t0 % 7 != 1).unionByName(edit("t0 % 6 = 0", "/title", F.lit(True))).unionByName(edit("t0 % 12 = 0", "/scope", F.lit(True)))
    return assessments.refinement(proposals.drop("t0"), parts, findings, coverage, edits)


@query(f"WITH {_SQL}, {_CRITIC} SELECT direction, e AS experiment, target AS hypothesis, CASE WHEN total % 3 <> 0 THEN action END AS status FROM (SELECT *, unnest(['e1', 'e2']) AS e FROM tc WHERE k > 0) WHERE NOT (e = 'e2' AND k = 1)")
def experiment_links(spark: SparkSession, d: str) -> DataFrame:
    """Experiments and their hypotheses, with the states of those that have one."""
    targets = _criticised(_targets(_pairs(spark, d))).where("k > 0")
    ids = lambda where: F.collect_list(F.when(F.expr(where), F.col("target")))
    both = targets.groupBy("direction").agg(ids("true").alias("e1"), ids("k <> 1").alias("e2"))
    experiments = both.select("direction", F.explode(F.array(*(F.struct(F.lit(e).alias("experiment"), F.col(e).alias("hypothesis_ids")) for e in ("e1", "e2")))).alias("x")).select("direction", "x.*")
    statuses = targets.where("total % 3 <> 0").select("direction", F.col("target").alias("hypothesis"), F.col("action").alias("status"))
    return assessments.experiment_links(experiments, statuses)


@query(f"""WITH {_SQL}, h AS (SELECT direction, list(target ORDER BY target) AS ids FROM tg GROUP BY direction)
SELECT printf('dir-%03d', direction) AS direction, array_to_string(list_transform(range(1, length(ids) + 1), lambda j: printf('dir-%03d-h%02d', direction, j)), ',') AS hypotheses, printf('dir-%03d-e01:dir-%03d-h%02d', direction, direction, length(ids)) AS experiment FROM h""")
def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Directions with ids by position, and the links of their experiments (each to the last hypothesis) rewritten."""
    told = _targets(_pairs(spark, d)).groupBy(F.col("direction").alias("index")).agg(F.array_sort(F.collect_list("target")).alias("hypotheses"))
    own = told.select("index", "hypotheses", F.array(F.struct(F.lit("x").alias("id"), F.array(F.element_at("hypotheses", -1)).alias("hypothesis_ids"))).alias("experiments"))
    made = assessments.assigned_ids(own)
    return made.select("direction", F.array_join("hypotheses", ",").alias("hypotheses"), F.concat_ws(":", F.col("experiments")[0]["id"], F.col("experiments")[0]["hypothesis_ids"][0]).alias("experiment"))


@query("""WITH c AS (SELECT c_custkey AS direction, c_custkey % 4 > 0 AS changed, c_custkey % 4 = 1 AS reuse, c_custkey % 4 >= 2 AS again FROM customer),
v AS (SELECT *, CASE WHEN changed AND direction % 11 = 1 THEN 'no_certificate' WHEN NOT changed AND direction % 13 = 0 THEN 'needless_certificate' WHEN changed AND direction % 17 = 2 THEN 'repeated_certificate' WHEN (changed OR direction % 13 = 0) AND direction % 19 = 3 THEN 'certificate_lineage'
WHEN again AND direction % 23 = 4 THEN 'no_fresh_work' WHEN again AND direction % 29 = 5 THEN 'fresh_work_of_another' WHEN NOT again AND direction % 31 = 6 THEN 'unrelated_refresh' WHEN reuse AND direction % 9 = 7 THEN 'reuse_not_borne_out' END AS rule FROM c)
SELECT direction, coalesce(rule, '') AS rule, CASE WHEN rule IS NULL THEN CASE WHEN changed THEN 'new' ELSE 'old' END || direction ELSE '' END AS digest, CASE WHEN rule IS NOT NULL THEN '' WHEN again THEN 'fresh' ELSE 'prior' END AS work FROM v""")
def rebound_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Prior work of directions (customers) after a revision: kept, certified for reuse, or done again; and why some is not rebound."""
    n = F.col("direction")
    text = n.cast("string")
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("direction"))
    old, new = F.concat(F.lit("old"), text), F.when(n % 4 > 0, F.concat(F.lit("new"), text)).otherwise(F.concat(F.lit("old"), text))
    directions = own.select("direction", old.alias("old_sha256"), new.alias("new_sha256"), (n % 9 != 7).alias("same_science"))
    records = own.select("direction", old.alias("candidate_sha256"), F.lit("prior").alias("work"))
    certified = ((n % 4 > 0) & (n % 11 != 1)) | ((n % 4 == 0) & (n % 13 == 0))
    certificates = own.where(certified).select("direction", F.when(n % 4 >= 2, "recheck").otherwise("reuse").alias("decision"), F.when(n % 19 == 3, "x").otherwise(old).alias("original_sha256"), new.alias("revised_sha256"), F.lit(True).alias("agreed"))
    certificates = certificates.unionByName(certificates.where("direction % 17 = 2 and direction % 4 > 0"))
    fresh = own.where(((n % 4 >= 2) & (n % 23 != 4)) | ((n % 4 < 2) & (n % 31 == 6))).select("direction", F.when(n % 29 == 5, "y").otherwise(new).alias("candidate_sha256"), F.lit("fresh").alias("work"))
    out, wrong = comparison.rebound(records, directions, certificates, fresh)
    told = own.join(wrong.where("rule = 'rebind'").select(F.col("key").cast("long").alias("direction"), F.col("detail").alias("rule")), "direction", "left").join(out, "direction", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return told.select("direction", empty("rule").alias("rule"), empty("candidate_sha256").alias("digest"), empty("work").alias("work"))
