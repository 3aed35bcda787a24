"""Queries of the closure of comparisons: suppliers stand for directions, parts (modulo 40) for prior papers, four groups of line numbers for a direction and its hypotheses.

A comparison is a direction with a paper, `direction|paper`. Sums of quantities decide what its tables say and which of
its rules are broken; the broken ones are a small share, of all kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.jobs.registry import query
from corpusloom.operators import integrity
from corpusloom.sources.tables import cut, table

_PAIRS = """pr AS (SELECT l_suppkey AS direction, l_partkey % 40 AS prior, l_suppkey || '|' || (l_partkey % 40) AS paper, l_linenumber % 4 AS k, 'h' || (l_linenumber % 4) AS target, sum(l_quantity)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey % 40, l_linenumber % 4),
pp AS (SELECT direction, prior, paper, sum(q)::BIGINT AS s, count(*) AS n FROM pr GROUP BY direction, prior, paper)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    pairs = line.groupBy(F.col("l_suppkey").alias("direction"), (F.col("l_partkey") % 40).alias("prior"), (F.col("l_linenumber") % 4).alias("k")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("n"))
    return cut(pairs.withColumn("paper", F.concat_ws("|", "direction", "prior")).withColumn("target", F.concat(F.lit("h"), F.col("k").cast("string"))))


def _papers(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("direction", "prior", "paper").agg(F.sum("q").cast("long").alias("s"), F.count("*").alias("n"))


def _passages(papers: DataFrame) -> DataFrame:
    """Three passages of each paper, a1 to a3."""
    return papers.select("paper", F.explode(F.array(*(F.lit(f"a{i}") for i in (1, 2, 3)))).alias("passage"))


def _one_of(number, *values):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


@query(f"""WITH {_PAIRS}
SELECT 'target_coverage' AS rule, paper || '|' || target AS key, 'missing' AS detail FROM pr WHERE q % 31 = 3
UNION ALL SELECT 'target_coverage', paper || '|x', 'unexpected' FROM pp WHERE s % 37 = 4
UNION ALL SELECT 'unknown_passage', paper || '|' || target, 'a4' FROM pr WHERE q % 4 = 3 AND q % 3 = 0
UNION ALL SELECT 'hypothesis_not_assessed', paper || '|' || target, '' FROM pr WHERE k > 0 AND q % 31 <> 3 AND q % 5 = 0
UNION ALL SELECT 'same_without_test', paper || '|' || target, ['not_applicable', 'tested', 'inferred', 'not_tested', 'tested'][q % 5 + 1] FROM pr WHERE k > 0 AND q % 31 <> 3 AND n % 4 = 0 AND q % 5 IN (0, 3)""")
def comparison_drafts(spark: SparkSession, d: str) -> DataFrame:
    """What drafts of comparisons refer to without leave."""
    pairs = _pairs(spark, d)
    papers = _papers(pairs)
    targets = pairs.select("paper", "target", F.when(F.col("k") == 0, "direction").otherwise("hypothesis").alias("level"))
    said = pairs.where("q % 31 <> 3").select("paper", "target", _one_of(F.col("n"), "SAME", "VERY_CLOSE", "PARTIAL", "DIFFERENT").alias("classification"), _one_of(F.col("q"), "not_applicable", "tested", "inferred", "not_tested", "tested").alias("tested"))
    strange = papers.where("s % 37 = 4").select("paper", F.lit("x").alias("target"), F.lit("DIFFERENT").alias("classification"), F.lit("tested").alias("tested"))
    claims = pairs.select("paper", F.col("target").alias("claim"), F.array(_one_of(F.col("q"), "a1", "a2", "a3", "a4"), F.when(F.col("q") % 3 == 0, _one_of(F.col("q"), "a1", "a2", "a3", "a4")).otherwise("a1")).alias("passages"))
    claims = claims.withColumn("passages", F.when(F.col("passages")[0] == F.col("passages")[1], F.col("passages")).otherwise(F.array(F.lit("a1"))))
    return integrity.draft_violations(targets, said.unionByName(strange), claims, _passages(papers))


@query(f"""WITH {_PAIRS}
SELECT 'target_coverage' AS rule, paper || '|' || target AS key, 'missing' AS detail FROM pr WHERE q % 29 = 3
UNION ALL SELECT 'repeated_target', paper || '|' || target, '2' FROM pr WHERE q % 23 = 5 AND q % 29 <> 3
UNION ALL SELECT 'facet_anchor', paper || '|' || target, '' FROM (SELECT *, unnest([1, 2]) AS i FROM pr) WHERE (i = 1 OR q % 23 = 5) AND q % 29 <> 3 AND q % 11 IN (1, 2)
UNION ALL SELECT 'alignment', paper || '|' || target, ['direct_empirical', 'direct_theoretical', 'inferred_implication', 'related', 'insufficient_evidence'][n % 5 + 1] FROM (SELECT *, unnest([1, 2]) AS i FROM pr) WHERE (i = 1 OR q % 23 = 5) AND q % 29 <> 3 AND n % 5 < 3 AND (k = 3 OR q % 11 IN (3, 4))
UNION ALL SELECT 'unknown_passage', paper || '|' || target, 'a9' FROM pr WHERE q % 19 = 1
UNION ALL SELECT 'table_context', paper || '|' || target, 'a3' FROM pr WHERE q % 7 = 2 AND q % 19 <> 1""")
def evidence_records(spark: SparkSession, d: str) -> DataFrame:
    """What evidence records leave out or anchor wrongly; the third group of hypotheses has no facets, and passage a2 is a table with its caption in a3."""
    pairs = _pairs(spark, d)
    q, facets = F.col("q"), F.when(F.col("k") == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("/i/0"), F.lit("/e/0")))
    targets = pairs.select("paper", "target", facets.alias("facets"))
    match = lambda f, m="covered": F.struct(F.lit(f).alias("facet"), F.lit(m).alias("match"))
    whole = F.when(F.col("k") == 3, F.array().cast("array<struct<facet:string,match:string>>")).otherwise(F.array(match("/i/0"), match("/e/0")))
    matches = F.when(q % 11 == 1, F.concat(whole, F.array(match("/strange")))).when((q % 11 == 2) & (F.col("k") != 3), F.array(match("/i/0"), match("/e/0"), match("/i/0"))).when(q % 11 == 2, F.array(match("/x"))).when((q % 11 == 3) & (F.col("k") != 3), F.array(match("/i/0"))).when((q % 11 == 4) & (F.col("k") != 3), F.array(match("/i/0"), match("/e/0", "partial"))).otherwise(whole)
    said = pairs.where("q % 29 <> 3").select("paper", "target", _one_of(F.col("n"), *integrity.ESTABLISHED, "related", "insufficient_evidence").alias("coverage"), matches.alias("matches"), q.alias("q"))
    said = said.unionByName(said.where("q % 23 = 5")).drop("q")
    cited = F.when(q % 19 == 1, F.array(F.lit("a9"))).when(q % 7 == 2, F.array(F.lit("a2"))).when(q % 7 == 3, F.array(F.lit("a2"), F.lit("a3"))).otherwise(F.array(F.lit("a1")))
    claims = pairs.select("paper", F.col("target").alias("claim"), cited.alias("passages"))
    papers = _papers(pairs)
    captions = papers.select("paper", F.lit("a2").alias("passage"), F.lit("a3").alias("context"))
    return integrity.record_violations(targets, said, claims, _passages(papers), captions)


@query(f"""WITH {_PAIRS},
c AS (SELECT *, ['result', 'method', 'evaluation', 'setup'][n % 4 + 1] AS kind, ['supported', 'citation_repair', 'supported', 'unsupported', 'supported'][q % 5 + 1] AS decision FROM pr WHERE q % 41 <> 7),
x AS (SELECT *, unnest([1, 2]) AS i FROM c), t AS (SELECT * FROM x WHERE i = 1 OR q % 43 = 8)
SELECT 'claim_checks' AS rule, paper || '|' || target AS key, 'missing' AS detail FROM pr WHERE q % 41 = 7
UNION ALL SELECT 'claim_checked_twice', paper || '|' || target, '2' FROM c WHERE q % 43 = 8
UNION ALL SELECT 'coverage_checks', paper || '|' || target, 'missing' FROM pr WHERE q % 47 = 9
UNION ALL SELECT 'coverage_checks', paper || '|y', 'unexpected' FROM pp WHERE s % 53 = 10
UNION ALL SELECT 'check_passage', paper || '|' || target, 'a8' FROM c WHERE q % 13 = 1
UNION ALL SELECT 'check_passage', paper || '|' || target, 'a7' FROM pr WHERE q % 47 <> 9 AND q % 17 = 2
UNION ALL SELECT 'scope_passage', paper || '|' || target, 'a6' FROM c WHERE q % 19 = 3 AND q % 11 <> 5
UNION ALL SELECT 'scope_missing', paper || '|' || target, '' FROM t WHERE q % 11 IN (5, 6)
UNION ALL SELECT 'scope_needed', paper || '|' || target, kind FROM t WHERE kind IN ('result', 'evaluation') AND (q % 11 = 5 OR (q % 19 <> 3 AND q % 7 = 0))
UNION ALL SELECT 'scope_without_evidence', paper || '|' || target, '' FROM t WHERE q % 11 <> 5 AND q % 19 <> 3 AND q % 7 = 1
UNION ALL SELECT 'open_scope', paper || '|' || target, '' FROM t WHERE decision = 'supported' AND q % 11 <> 5 AND q % 19 <> 3 AND q % 7 = 2
UNION ALL SELECT 'own_evidence', paper || '|' || target, '' FROM t WHERE decision = 'supported' AND (q % 13 = 1 OR q % 13 = 2)""")
def evidence_audits(spark: SparkSession, d: str) -> DataFrame:
    """What audits of evidence check not at all, twice, or against their own scopes."""
    pairs = _pairs(spark, d)
    papers, q = _papers(pairs), F.col("q")
    claims = pairs.select("paper", F.col("target").alias("claim"), _one_of(F.col("n"), "result", "method", "evaluation", "setup").alias("kind"), F.array(F.lit("a1")).alias("passages"))
    scope = lambda decision, *p: F.array(F.struct(F.lit(decision).alias("decision"), F.array(*map(F.lit, p)).cast("array<string>").alias("passages")))
    none = F.array().cast("array<struct<decision:string,passages:array<string>>>")
    scopes = F.when(q % 11 == 5, F.lit(None)).when(q % 19 == 3, scope("supported", "a6")).when(q % 7 == 0, none).when(q % 7 == 1, scope("supported")).when(q % 7 == 2, scope("unresolved", "a1")).otherwise(scope("supported", "a1"))
    cited = F.when(q % 13 == 1, F.array(F.lit("a8"))).when(q % 13 == 2, F.array(F.lit("a2"))).otherwise(F.array(F.lit("a1"), F.lit("a2")))
    checks = pairs.where("q % 41 <> 7").select("paper", F.col("target").alias("claim"), _one_of(q, "supported", "citation_repair", "supported", "unsupported", "supported").alias("decision"), cited.alias("passages"), F.when(q % 11 != 6, "all").alias("scope_summary"), scopes.alias("scopes"), q.alias("q"))
    checks = checks.unionByName(checks.where("q % 43 = 8")).drop("q")
    covered = pairs.where("q % 47 <> 9").select("paper", "target", F.when(q % 17 == 2, F.array(F.lit("a7"))).otherwise(F.array(F.lit("a3"))).alias("passages"))
    covered = covered.unionByName(papers.where("s % 53 = 10").select("paper", F.lit("y").alias("target"), F.array(F.lit("a1")).alias("passages")))
    return integrity.audit_violations(claims, pairs.select("paper", "target"), checks, covered, _passages(papers))


@query(f"""WITH {_PAIRS},
a AS (SELECT paper, target, q FROM pr WHERE q % 3 > 0), ac AS (SELECT paper, count(*) AS na FROM a GROUP BY paper),
p AS (SELECT pp.*, coalesce(na, 0) AS na, s % 6 > 0 AND coalesce(na, 0) > 0 AS out, coalesce(na, 0) = n AS full_ FROM pp LEFT JOIN ac USING (paper)),
st AS (SELECT *, CASE WHEN s % 59 = 1 THEN 'failed' WHEN out AND s % 61 <> 2 THEN CASE WHEN full_ THEN 'complete' ELSE 'partial' END WHEN out THEN CASE WHEN full_ THEN 'partial' ELSE 'complete' END ELSE 'unresolved' END AS status FROM p)
SELECT 'loaded_and_missing' AS rule, paper || '|2' AS key, '' AS detail FROM pp WHERE s % 31 = 4
UNION ALL SELECT 'repeated_page', paper || '|1', '2' FROM pp WHERE s % 37 = 5
UNION ALL SELECT 'page_version', paper || '|a2', '2' FROM pp WHERE s % 29 = 3 AND s % 43 <> 9
UNION ALL SELECT 'evidence_sequence', paper, '0/3/3' FROM pp WHERE s % 23 = 6
UNION ALL SELECT 'unbound_review', paper || '|1', '7' FROM pp WHERE s % 41 = 7
UNION ALL SELECT 'superseded_evidence', paper, '' FROM st WHERE out AND (s % 23 = 6 OR s % 41 = 7 OR s % 19 = 8)
UNION ALL SELECT 'without_evidence', paper, '' FROM st WHERE out AND s % 43 = 9
UNION ALL SELECT 'projection', a.paper || '|' || target || '|' || q, 'missing' FROM a JOIN st USING (paper) WHERE out AND q % 17 = 0
UNION ALL SELECT 'projection', a.paper || '|' || target || '|changed', 'unexpected' FROM a JOIN st USING (paper) WHERE out AND q % 17 = 0
UNION ALL SELECT 'published_status', paper, status FROM st WHERE out AND status = 'failed'
UNION ALL SELECT 'completeness', paper, status FROM st WHERE out AND (status = 'complete') <> full_
UNION ALL SELECT 'diagnostic', paper, '' FROM st WHERE CASE WHEN out THEN (s % 47 = 11 OR (s % 47 <> 10 AND full_)) <> full_ ELSE s % 47 = 11 END""")
def published_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Published comparisons that are not what their evidence and last review bear out."""
    pairs = _pairs(spark, d)
    q, s = F.col("q"), F.col("s")
    accepted = pairs.where("q % 3 > 0").select("paper", "target", q.cast("string").alias("content"), "q")
    papers = _papers(pairs).join(accepted.groupBy("paper").agg(F.count("*").alias("na")), "paper", "left").withColumn("na", F.coalesce("na", F.lit(0)))
    papers = papers.withColumn("out", (s % 6 > 0) & (F.col("na") > 0)).withColumn("full", F.col("na") == F.col("n"))
    good, bad = F.when(F.col("full"), "complete").otherwise("partial"), F.when(F.col("full"), "partial").otherwise("complete")
    status = F.when(s % 59 == 1, "failed").when(F.col("out"), F.when(s % 61 == 2, bad).otherwise(good)).otherwise("unresolved")
    silent = (s % 47 == 11) | (F.col("out") & F.col("full") & (s % 47 != 10))
    told = cut(papers.withColumn("status", status).withColumn("diagnostic", F.when(~silent, "why")))
    pages = told.select("paper", "s", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.lit("v1").alias("sha256"))
    pages = pages.unionByName(pages.where("s % 37 = 5 and page = 1"))
    passages = told.where("s % 43 <> 9").select("paper", F.explode(F.array(*(F.struct(F.lit(p).alias("passage"), F.lit(n).alias("page"), (F.when(s % 29 == 3, "v0").otherwise("v1") if p == "a2" else F.lit("v1")).alias("page_sha256")) for p, n in (("a1", 1), ("a2", 2))))).alias("x")).select("paper", "x.*")
    versions = told.select("paper", F.explode(F.when(s % 23 == 6, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("version"), F.lit(True).alias("reported"))
    reviews = told.select("paper", F.explode(F.array(F.struct(F.lit(0).alias("round"), F.lit(0).alias("evidence_version")), F.struct(F.lit(1).alias("round"), F.when(s % 41 == 7, 7).when(s % 19 == 8, 0).otherwise(1).alias("evidence_version")))).alias("r")).select("paper", "r.*")
    published = accepted.join(told.where("out").select("paper"), "paper", "left_semi").select("paper", "target", F.when(q % 17 == 0, "changed").otherwise(F.col("content")).alias("content"))
    return integrity.published_violations(told.select("paper", "status", "diagnostic"), pairs.select("paper", "target"), pages.select("paper", "page", "sha256"), told.where("s % 31 = 4").select("paper", F.lit(2).alias("page")), passages, reviews, versions, accepted.select("paper", "target", "content"), published)


@query("""WITH o AS (SELECT l_suppkey AS direction, l_partkey % 30 AS paper, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_suppkey, l_partkey % 30),
d AS (SELECT direction, sum(q)::BIGINT AS s FROM o GROUP BY direction),
r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY q DESC, paper) AS rank FROM o), top AS (SELECT * FROM r WHERE rank <= 5)
SELECT 'search' AS rule, direction::VARCHAR AS key, 'missing' AS detail FROM d WHERE s % 19 = 1
UNION ALL SELECT 'comparison', direction::VARCHAR, '2' FROM d WHERE s % 17 = 2
UNION ALL SELECT 'snapshot', direction::VARCHAR, '' FROM (SELECT *, unnest([1, 2]) AS i FROM d) WHERE (i = 1 OR s % 17 = 2) AND s % 19 <> 1 AND s % 13 = 3
UNION ALL SELECT 'signature', direction::VARCHAR, '' FROM (SELECT *, unnest([1, 2]) AS i FROM d) WHERE (i = 1 OR s % 17 = 2) AND s % 19 <> 1 AND s % 11 = 4
UNION ALL SELECT 'targets', direction || '|t1|hypothesis', 'missing' FROM d WHERE s % 7 = 5
UNION ALL SELECT 'targets', direction || '|t1|direction', 'unexpected' FROM d WHERE s % 7 = 5
UNION ALL SELECT 'shortlist', direction || '|t0|' || paper || '|' || rank, 'missing' FROM top WHERE q % 23 = 6
UNION ALL SELECT 'shortlist', direction || '|t0|' || paper || '|' || (rank + 100), 'unexpected' FROM top WHERE q % 23 = 6
UNION ALL SELECT 'retrieval', direction || '|t0|complete', 'missing' FROM d WHERE s % 9 = 7
UNION ALL SELECT 'retrieval', direction || '|t0|partial', 'unexpected' FROM d WHERE s % 9 = 7
UNION ALL SELECT 'artifact', direction || '|' || paper, '' FROM top WHERE q % 21 IN (1, 2)
UNION ALL SELECT 'unknown_mark', direction || '|99', '' FROM d WHERE s % 5 = 0
UNION ALL SELECT 'unknown_mark_target', direction || '|' || paper, 't9' FROM top WHERE rank = 1 AND q % 4 = 1
UNION ALL SELECT 'unknown_mark_claim', direction || '|' || paper, 'c9' FROM top WHERE rank = 2 AND q % 4 = 2""")
def assessment_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of assessments that are not of one lineage."""
    from corpusloom.operators.search import ranked

    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("direction"), (F.col("l_partkey") % 30).alias("paper")).agg(F.sum("l_quantity").cast("long").alias("q"))
    top = cut(ranked(own, 5, ["direction"], score="q", key="paper"))
    s, q = F.col("s"), F.col("q")
    all_ = cut(own.groupBy("direction").agg(F.sum("q").cast("long").alias("s")))
    digest = F.sha2(F.col("direction").cast("string"), 256)
    directions = all_.select("direction", digest.alias("sha256"))
    searches = all_.where("s % 19 <> 1").select("direction", digest.alias("candidate_sha256"), F.lit("g").alias("signature_sha256"))
    comparisons = all_.select("direction", F.when(s % 13 == 3, "other").otherwise(digest).alias("candidate_sha256"), F.when(s % 11 == 4, None).otherwise("g").alias("signature_sha256"), "s")
    comparisons = comparisons.unionByName(comparisons.where("s % 17 = 2")).drop("s")
    level = lambda changed: F.explode(F.array(F.struct(F.lit("t0").alias("target"), F.lit("direction").alias("level")), F.struct(F.lit("t1").alias("target"), (F.when(s % 7 == 5, "direction").otherwise("hypothesis") if changed else F.lit("hypothesis")).alias("level")))).alias("t")
    proposed, signed = (all_.select("direction", level(c)).select("direction", "t.*") for c in (False, True))
    kept = top.select("direction", F.lit("t0").alias("target"), "paper", "rank")
    shown = top.select("direction", F.lit("t0").alias("target"), "paper", F.when(q % 23 == 6, F.col("rank") + 100).otherwise(F.col("rank")).alias("rank"))
    status = lambda c: all_.select("direction", F.lit("t0").alias("target"), c.alias("status"))
    seen = top.select("direction", "paper", F.explode(F.when(q % 21 == 1, F.array(F.lit("v1"), F.lit("v2"))).when(q % 21 == 2, F.array(F.lit("v2"))).otherwise(F.array(F.lit("v1"), F.lit("v1")))).alias("sha256"))
    expected = top.select("direction", "paper", F.lit("v1").alias("sha256"))
    none = F.lit(None).cast("string")
    marks = all_.where("s % 5 = 0").select("direction", F.lit(99).cast("long").alias("paper"), F.lit("t9").alias("target"), F.lit("c9").alias("claim"))
    marks = marks.unionByName(top.where("rank = 1").select("direction", "paper", F.when(q % 4 == 1, "t9").otherwise("t0").alias("target"), none.alias("claim")))
    marks = marks.unionByName(top.where("rank = 2").select("direction", "paper", none.alias("target"), F.when(q % 4 == 2, "c9").otherwise("c1").alias("claim")))
    claims = top.select("direction", "paper", F.lit("c1").alias("claim"))
    return integrity.lineage_violations(directions, searches, comparisons, (proposed, signed), (kept, shown), (status(F.lit("complete")), status(F.when(s % 9 == 7, "partial").otherwise("complete"))), (seen, expected), (marks, kept.select("direction", "paper", "target"), claims))


@query("""WITH o AS (SELECT o_custkey AS direction, o_orderkey AS paper, o_orderpriority AS value FROM orders), c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT 'artifact' AS rule, direction || '|' || paper || '|v1' AS key, 'missing' AS detail FROM o WHERE paper % 41 IN (1, 2)
UNION ALL SELECT 'artifact', direction || '|' || paper || '|v2', 'unexpected' FROM o WHERE paper % 41 = 2
UNION ALL SELECT 'repeated_artifact', direction || '|' || paper, '2' FROM o WHERE paper % 43 = 3 AND paper % 41 <> 1
UNION ALL SELECT 'page', conv_id || '|' || turn, 'missing' FROM c WHERE (conv_id + turn) % 11 = 4
UNION ALL SELECT 'page_content', conv_id || '|' || turn, '' FROM c WHERE (conv_id + turn) % 11 = 5 OR ((conv_id + turn) % 11 = 6)
UNION ALL SELECT 'evidence', direction || '|' || paper || '|/v', '' FROM o WHERE paper % 29 IN (7, 8) OR (paper % 29 = 9) OR (paper % 29 = 10)""")
def support_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Support packets that differ from what their directions were made from."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("direction"), F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("value"))
    n = F.col("paper")
    expected = orders.select("direction", "paper", F.lit("v1").alias("sha256"))
    held = orders.where("paper % 41 <> 1").select("direction", "paper", F.when(n % 41 == 2, "v2").otherwise("v1").alias("sha256"))
    held = held.unionByName(held.where("paper % 43 = 3"))
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("direction"), F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", (F.col("direction") + F.col("page")) % 11)
    references = turns.select("direction", "page", F.col("direction").alias("paper"), F.sha2("text", 256).alias("sha256"))
    pages = turns.where("k <> 4").select("direction", "page", (F.col("direction") + F.when(F.col("k") == 6, 1).otherwise(0)).alias("paper"), F.when(F.col("k") == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    path = F.lit("/v")
    evidence = orders.select("direction", "paper", path.alias("value_path"), F.substring("value", 1, 3).alias("source_value"), F.lit("/p").alias("provenance_path"))
    values = orders.where("paper % 29 <> 7").select("paper", F.when(n % 29 == 8, "/w").otherwise(path).alias("value_path"), F.when(n % 29 == 9, F.concat(F.lit("x"), F.col("value"))).otherwise(F.col("value")).alias("source_value"), F.when(n % 29 == 10, None).otherwise("/p").alias("provenance_path"))
    return integrity.support_violations(expected, held, references, pages, evidence, values)
