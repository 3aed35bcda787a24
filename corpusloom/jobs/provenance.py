"""Queries of provenance: customers stand for opportunities and directions, their orders for evidence and hypotheses, orders modulo 50 for papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.jobs.registry import query
from corpusloom.operators import provenance
from corpusloom.sources.tables import cut, table

_O = "o AS (SELECT o_custkey AS op, o_orderkey AS ev, o_orderkey % 50 AS paper, o_orderkey % 3 AS src, o_orderpriority AS content, o_orderkey % 7 AS page FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("opportunity"), key.alias("evidence"), (key % 50).alias("paper"), (key % 3).alias("source"), F.col("o_orderpriority").alias("content"), (key % 7).alias("page"))


@query(f"""WITH {_O}, r AS (SELECT DISTINCT op FROM o)
SELECT 'lineage' AS rule, op::VARCHAR AS key, '' AS detail FROM r WHERE op % 11 IN (1, 2, 3) UNION ALL SELECT 'topic', op::VARCHAR, '' FROM r WHERE op % 13 = 4
UNION ALL SELECT 'repeated_opportunity', op || '|a', '2' FROM r WHERE op % 17 = 5 UNION ALL SELECT 'repeated_source', op || '|' || src, count(*)::VARCHAR FROM o WHERE op % 19 = 6 GROUP BY op, src HAVING count(*) > 1""")
def generation_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Generations (customers) whose inputs are not of one lineage."""
    orders, op = _orders(spark, d), F.col("run")
    runs = orders.select(F.col("opportunity").alias("run")).distinct()
    of = lambda k, good, bad="x": F.when(op % 11 == k, None if bad is None else bad).otherwise(good)
    told = runs.select("run", F.lit("l").alias("landscape_sha256"), F.lit("r").alias("reasoning_sha256"), of(1, "l").alias("of_reasoning"), of(2, "l", None).alias("of_mining"), of(3, "r").alias("reasoning_of_mining"), F.array(F.lit("t"), F.lit("t"), F.when(op % 13 == 4, "u").otherwise("t")).alias("topics"))
    named = runs.select("run", F.explode(F.when(op % 17 == 5, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("opportunity"))
    items = orders.select(F.col("opportunity").alias("run"), "source")
    return provenance.lineage_violations(told, named, items.where("run % 19 = 6").unionByName(items.where("run % 19 <> 6").distinct()))


@query(f"""WITH {_O}, i AS (SELECT DISTINCT op, src FROM o), r AS (SELECT DISTINCT op FROM o)
SELECT 'unsafe_paper' AS rule, op || '|../p' AS key, '' AS detail FROM r WHERE op % 23 = 1
UNION ALL SELECT 'lineage', op::VARCHAR, '' FROM r WHERE op % 29 IN (2, 3)
UNION ALL SELECT 'repeated_source', op || '|' || src, '2' FROM i WHERE op % 31 = 4
UNION ALL SELECT 'no_reference', op || '|' || src, '' FROM (SELECT *, unnest([1, 2]) AS n FROM i) WHERE (n = 1 OR op % 31 = 4) AND op % 7 = 5 AND src = 1
UNION ALL SELECT 'unresolved_reference', op || '|' || src, 'i9' FROM i WHERE op % 5 = 1 AND src = 2
UNION ALL SELECT 'unverified', op || '|' || src, 'plausible' FROM (SELECT *, unnest([1, 2]) AS n FROM i) WHERE (n = 1 OR op % 31 = 4) AND op % 9 = 2 AND src = 0
UNION ALL SELECT 'unreviewed', op || '|' || src, '' FROM (SELECT *, unnest([1, 2]) AS n FROM i) WHERE (n = 1 OR op % 31 = 4) AND op % 8 = 3 AND src = 1
UNION ALL SELECT 'no_evidence', op || '|' || src, '' FROM (SELECT *, unnest([1, 2]) AS n FROM i) WHERE (n = 1 OR op % 31 = 4) AND op % 6 = 4 AND src = 2
UNION ALL SELECT 'conflicting_evidence', op || '|' || src || '|' || ev, '' FROM o WHERE ev % 37 = 5 AND NOT (op % 6 = 4 AND src = 2)
UNION ALL SELECT DISTINCT 'evidence_outside', op || '|' || src, '49' FROM o WHERE paper = 49 AND NOT (op % 6 = 4 AND src = 2)
UNION ALL SELECT DISTINCT 'review_outside', op || '|' || src, '49' FROM o WHERE paper = 49 AND NOT (op % 8 = 3 AND src = 1)""")
def mining_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed sources that may not enter mining; paper 49 is outside every inventory."""
    orders = _orders(spark, d).withColumnRenamed("opportunity", "run")
    run, s = F.col("run"), F.col("source")
    ids = cut(orders.select("run", "source").distinct())
    runs = ids.select("run").distinct()
    told = runs.select("run", F.lit("l").alias("landscape_sha256"), F.lit("t").alias("landscape_topic"), F.when(run % 29 == 2, "x").otherwise("l").alias("reasoning_of"), F.when(run % 29 == 3, None).otherwise("t").alias("topic"))
    inventory = orders.where("paper <> 49").select("run", F.col("paper").cast("string").alias("paper")).distinct().unionByName(runs.where("run % 23 = 1").select("run", F.lit("../p").alias("paper")))
    items = ids.select("run", "source", F.when((run % 9 == 2) & (s == 0), "plausible").otherwise("verified").alias("verification"))
    items = items.unionByName(items.where("run % 31 = 4"))
    references = ids.where(~((run % 7 == 5) & (s == 1))).select("run", "source", F.when((run % 5 == 1) & (s == 2), "i9").otherwise("i1").alias("item"))
    landscape = runs.select("run", F.lit("i1").alias("item"))
    evidence = orders.where(~((run % 6 == 4) & (s == 2))).select("run", "source", "evidence", F.col("paper").cast("string").alias("paper"), "content")
    evidence = evidence.unionByName(evidence.where("evidence % 37 = 5").withColumn("content", F.lit("other")))
    reviewed = orders.where(~((run % 8 == 3) & (s == 1))).select("run", "source", F.col("paper").cast("string").alias("paper"))
    return provenance.mining_violations(told, inventory, items, references, landscape, evidence, reviewed)


@query(f"""WITH {_O}, pa AS (SELECT op, paper, min(ev) AS first FROM o GROUP BY op, paper), ro AS (SELECT *, CASE WHEN first % 2 = 0 THEN 'supporting' ELSE 'context' END AS role FROM pa),
so AS (SELECT DISTINCT op, src FROM o), oo AS (SELECT op, count(*) FILTER (WHERE role = 'supporting') AS n FROM ro GROUP BY op)
SELECT 'paper_outside' AS rule, op || '|' || paper AS key, '' AS detail FROM pa WHERE paper = 48
UNION ALL SELECT 'paper_inventory', op || '|77', 'missing' FROM oo WHERE op % 7 = 1 UNION ALL SELECT 'paper_outside', op || '|77', '' FROM oo WHERE op % 7 = 1
UNION ALL SELECT 'role', op || '|77|context', 'missing' FROM oo WHERE op % 7 = 1
UNION ALL SELECT 'no_supporting_paper', op::VARCHAR, '' FROM oo WHERE n = 0
UNION ALL SELECT 'support_label', op::VARCHAR, 'single_paper' FROM oo WHERE n > 1 AND op % 11 = 2
UNION ALL SELECT 'source_inventory', op || '|' || src, 'missing' FROM so WHERE op % 13 = 3 AND src = 0
UNION ALL SELECT 'evidence_inventory', op || '|' || ev, 'unexpected' FROM o WHERE ev % 41 = 4 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'evidence_inventory', op || '|' || ev, 'missing' FROM o WHERE op % 13 = 3 AND src = 0 AND ev % 41 <> 4
UNION ALL SELECT 'unknown_source', op || '|' || 9, '' FROM oo WHERE op % 17 = 5 UNION ALL SELECT 'source_unused', op || '|9', '' FROM oo WHERE op % 17 = 5
UNION ALL SELECT 'source_inventory', op || '|9', 'unexpected' FROM oo WHERE op % 17 = 5
UNION ALL SELECT 'source_kind', op || '|' || src, '' FROM so WHERE op % 19 = 6 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'source_references', op || '|' || src || '|i' || src, 'missing' FROM so WHERE op % 23 = 7 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'source_references', op || '|' || src || '|i8', 'unexpected' FROM so WHERE op % 23 = 7 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'unknown_item', op || '|' || src, 'i8' FROM so WHERE op % 23 = 7 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'evidence_changed', op || '|' || ev, '' FROM o WHERE ev % 43 = 8 AND NOT (op % 13 = 3 AND src = 0)
UNION ALL SELECT 'page_outside', op || '|' || paper || '|' || page, '' FROM (SELECT DISTINCT op, paper, page FROM o WHERE paper = 48 AND ev % 47 <> 9)
UNION ALL SELECT 'no_pages', op::VARCHAR, '' FROM (SELECT op FROM o GROUP BY op HAVING count(*) FILTER (WHERE ev % 47 <> 9) = 0)
UNION ALL SELECT DISTINCT 'evidence_page', op || '|' || ev, page::VARCHAR FROM o WHERE NOT (op % 13 = 3 AND src = 0) AND NOT EXISTS (SELECT 1 FROM o b WHERE b.op = o.op AND b.paper = o.paper AND b.page = o.page AND b.ev % 47 <> 9)
UNION ALL SELECT 'review_context', op || '|-5|0', '' FROM (SELECT op FROM o GROUP BY op HAVING count(*) FILTER (WHERE ev % 47 <> 9) = 0 AND count(*) FILTER (WHERE NOT (op % 13 = 3 AND src = 0)) > 0)
UNION ALL SELECT 'role_evidence', op || '|' || paper, '-1' FROM pa WHERE first % 53 = 10
UNION ALL SELECT 'role_page', op || '|' || paper, '99' FROM pa WHERE first % 59 = 11
UNION ALL SELECT 'paper_inventory', op || '|' || paper, 'missing' FROM pa WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.op = pa.op AND b.paper = pa.paper AND NOT (b.op % 13 = 3 AND b.src = 0))""")
def source_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Opportunities that are not what was reviewed: papers, roles, sources, references, evidence and pages; paper 48 is outside the inventory."""
    orders = cut(_orders(spark, d))
    op, s, ev = F.col("opportunity"), F.col("source"), F.col("evidence")
    first = cut(orders.groupBy("opportunity", "paper").agg(F.min("evidence").alias("first")).withColumn("role", F.when(F.col("first") % 2 == 0, "supporting").otherwise("context")))
    all_ = orders.select("opportunity").distinct()
    papers = first.select("opportunity", "paper", "role").unionByName(all_.where("opportunity % 7 = 1").select("opportunity", F.lit(77).cast("long").alias("paper"), F.lit("context").alias("role")))
    n = first.where("role = 'supporting'").groupBy("opportunity").agg(F.count("*").alias("n"))
    opportunities = all_.join(n, "opportunity", "left").select("opportunity", F.when((F.col("n") > 1) & (op % 11 != 2), "multiple_papers").otherwise("single_paper").alias("support"))
    inventory = orders.where("paper <> 48").select("paper").distinct()
    lost = (op % 13 == 3) & (s == 0)
    ids = orders.select("opportunity", "source").distinct()
    kind = F.concat(F.lit("k"), s.cast("string"))
    sources = ids.where(~lost).select("opportunity", "source", F.when(op % 19 == 6, "other").otherwise(kind).alias("kind"))
    sources = sources.unionByName(all_.where("opportunity % 17 = 5").select("opportunity", F.lit(9).cast("long").alias("source"), F.lit("k9").alias("kind")))
    three = orders.select("source").distinct()
    reasoning = three.select("source", kind.alias("kind"), F.lit("verified").alias("verification"))
    named = sources.where("source < 9").select("opportunity", "source", F.when(op % 23 == 7, "i8").otherwise(F.concat(F.lit("i"), s.cast("string"))).alias("item"))
    reasoned = three.select("source", F.concat(F.lit("i"), s.cast("string")).alias("item"))
    evidence = orders.where(~lost).select("opportunity", "evidence", "source", "paper", F.when(ev % 43 == 8, "changed").otherwise(F.col("content")).alias("content"))
    upstream = orders.select("source", "evidence", "content")
    pages = orders.where("evidence % 47 <> 9").select("opportunity", "paper", "page", F.lit("v").alias("sha256")).distinct()
    prior = three.select("source", F.lit(-5).cast("long").alias("paper"), F.lit(0).cast("long").alias("page"), F.lit("v").alias("sha256"))
    # What every source's review read is context of each opportunity that uses it: page 0 of a paper of its own.
    read = all_.select("opportunity", F.lit(-5).cast("long").alias("paper"), F.lit(0).cast("long").alias("page"), F.lit("v").alias("sha256"))
    known = inventory.unionByName(spark.createDataFrame([(-5,)], "paper long"))
    with_pages = orders.where("evidence % 47 <> 9").select("opportunity").distinct()
    pages = pages.unionByName(read.join(with_pages, "opportunity", "left_semi"))
    locations = orders.select("opportunity", "evidence", "page")
    cites_evidence = first.select("opportunity", "paper", F.when(F.col("first") % 53 == 10, -1).otherwise(F.col("first")).cast("long").alias("evidence"))
    cites_evidence = cites_evidence.join(evidence.select("opportunity", "evidence"), ["opportunity", "evidence"], "left_semi").unionByName(cites_evidence.where("evidence = -1"))
    cites_page = first.where("first % 59 = 11").select("opportunity", "paper", F.col("paper").alias("cited_paper"), F.lit(99).cast("long").alias("page"))
    chosen_evidence = orders.where("evidence % 41 <> 4").select("opportunity", "evidence")
    return provenance.context_violations(opportunities, known, papers, sources, (ids, chosen_evidence), reasoning, (named, reasoned, reasoned.select("item").distinct()), evidence, upstream, pages, prior, locations, first.select("opportunity", "paper", "role"), (cites_evidence, cites_page))


@query(f"""WITH {_O}, pl AS (SELECT op, count(*) AS n FROM o GROUP BY op)
SELECT 'cap' AS rule, op::VARCHAR AS key, '' AS detail FROM pl WHERE n > 12
UNION ALL SELECT 'repeated_citation', op || '|' || ev, '' FROM o WHERE ev % 31 = 1 UNION ALL SELECT 'repeated_citation', op || '|' || ev, '' FROM o WHERE ev % 29 = 2
UNION ALL SELECT 'unknown_evidence', op || '|' || ev, '-1' FROM o WHERE ev % 23 = 3 UNION ALL SELECT 'unknown_evidence', op || '|' || ev, '-2' FROM o WHERE ev % 19 = 4
UNION ALL SELECT 'unknown_page', op || '|' || ev, '-7' FROM o WHERE ev % 17 = 5
UNION ALL SELECT 'uncovered_paper', op || '|' || ev, paper::VARCHAR FROM o WHERE ev % 17 = 5 AND ev % 23 <> 3
UNION ALL SELECT 'no_supporting_citation', op::VARCHAR, '' FROM o GROUP BY op HAVING count(*) FILTER (WHERE paper % 2 = 0 AND ev % 23 <> 3) = 0""")
def direction_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of directions beyond their caps, with citations unknown, repeated or not covered by pages; even papers support."""
    orders = _orders(spark, d).withColumnRenamed("opportunity", "direction")
    ev = F.col("evidence")
    drafts = orders.groupBy("direction").agg(F.count("*").alias("n_hypotheses"), F.lit(1).alias("n_experiments"))
    cited = F.when(ev % 23 == 3, -1).otherwise(ev).cast("long")
    own = F.when(ev % 31 == 1, F.array(cited, cited)).otherwise(F.array(cited))
    claims = orders.select("direction", ev.alias("claim"), own.alias("evidence"), F.array(F.when(ev % 17 == 5, -7).otherwise(ev).cast("long")).alias("pages"))
    named = F.when(ev % 19 == 4, -2).otherwise(ev).cast("long")
    hypotheses = orders.select("direction", ev.alias("hypothesis"), F.when(ev % 29 == 2, F.array(named, named)).otherwise(F.array(named)).alias("evidence"))
    return provenance.draft_violations(drafts, claims, hypotheses, orders.select("direction", "evidence", "paper"), orders.select("direction", ev.alias("page"), "paper"), orders.where("paper % 2 = 0").select("direction", "paper").distinct(), 12)


@query(f"""WITH {_O}
SELECT 'checked_twice' AS rule, op || '|' || ev AS key, '2' AS detail FROM o WHERE ev % 31 = 1
UNION ALL SELECT 'scope_checks', op || '|' || ev, 'missing' FROM o WHERE ev % 37 = 2 AND ev % 31 <> 1
UNION ALL SELECT 'unknown_pair', op || '|' || ev, ev::VARCHAR FROM o WHERE ev % 9 = 0 AND ev % 7 = 3
UNION ALL SELECT 'unknown_claim', op || '|' || ev, 'c1' FROM o WHERE ev % 9 = 0 AND ev % 7 = 3
UNION ALL SELECT 'unknown_claim', op || '|' || ev, 'c8' FROM o WHERE ev % 9 = 0 AND ev % 5 = 1
UNION ALL SELECT 'unknown_passage', op || '|' || ev, paper || '#9' FROM o WHERE ev % 9 = 0 AND ev % 4 = 2
UNION ALL SELECT 'foreign_passage', op || '|' || ev, '1000#1' FROM o WHERE ev % 9 = 0 AND ev % 8 = 5 AND ev % 4 <> 2""")
def assessment_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of assessments that miss or repeat a target, or ask to reassess what is not there."""
    orders = _orders(spark, d).withColumnRenamed("opportunity", "direction")
    ev, passage = F.col("evidence"), F.concat(F.col("paper").cast("string"), F.lit("#1"))
    targets = orders.select("direction", ev.alias("target"))
    checks = targets.where("target % 37 <> 2 or target % 31 = 1").unionByName(targets.where("target % 31 = 1"))
    said = F.when(ev % 4 == 2, F.concat(F.col("paper").cast("string"), F.lit("#9"))).when(ev % 8 == 5, "1000#1").otherwise(passage)
    requests = orders.where("evidence % 9 = 0").select("direction", ev.alias("request"), "paper", F.array(ev).alias("targets"), F.when(ev % 5 == 1, F.array(F.lit("c1"), F.lit("c8"))).otherwise(F.array(F.lit("c1"))).alias("claims"), F.array(said).alias("passages"))
    pairs = orders.where("evidence % 7 <> 3").select("direction", "paper", ev.alias("target"))
    passages = orders.select("direction", passage.alias("passage")).unionByName(orders.select("direction", F.lit("1000#1").alias("passage"))).distinct()
    return provenance.review_violations(targets, checks, requests, pairs, pairs.withColumn("claim", F.lit("c1")), passages)


@query(f"""WITH {_O}, p AS (SELECT DISTINCT op, paper AS passage, CASE WHEN paper % 5 > 0 THEN paper // 10 END AS page FROM o),
c AS (SELECT DISTINCT o.op, src, paper AS passage, page FROM (SELECT op, src, paper FROM o WHERE src > 0) o JOIN p ON p.op = o.op AND p.passage = o.paper),
w AS (SELECT c.op, c.src, p.passage FROM (SELECT DISTINCT op, src, page FROM c WHERE page IS NOT NULL) c JOIN p ON p.op = c.op AND p.page = c.page UNION SELECT op, src, passage FROM c WHERE page IS NULL)
SELECT op AS direction, src AS target, (SELECT count(*) FROM o WHERE o.op = w.op AND o.src = w.src) AS n_evidence, count(*) AS n_passages, sum(passage)::BIGINT AS passages FROM w GROUP BY op, src""")
def hypothesis_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets of single hypotheses: their evidence, what it cites, and the rest of the cited pages; source 0 is the direction itself."""
    orders = _orders(spark, d).withColumnRenamed("opportunity", "direction").withColumn("target", F.col("source"))
    targets = orders.select("direction", "target", F.when(F.col("target") == 0, "direction").otherwise("hypothesis").alias("level")).distinct()
    evidence = orders.select("direction", "target", "paper", F.col("evidence").alias("claim"), F.array("paper").alias("passages"))
    passages = orders.select("direction", F.col("paper").alias("passage"), F.when(F.col("paper") % 5 > 0, F.floor(F.col("paper") / 10)).alias("page")).distinct()
    own, shown = provenance.hypothesis_packets(targets, evidence, passages)
    counts = own.groupBy("direction", "target").agg(F.count("*").alias("n_evidence"))
    return shown.groupBy("direction", "target").agg(F.count("*").alias("n_passages"), F.sum("passage").alias("passages")).join(counts, ["direction", "target"]).select("direction", "target", "n_evidence", "n_passages", "passages")


@query("""WITH c AS (SELECT user_id AS run, event_id AS number, CASE WHEN event_type = 'error' THEN 'cycle' WHEN event_id % 2 = 0 THEN 'repair' ELSE 'original' END AS part, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN NULL ELSE 'critic ' || event_id END AS critic FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE part WHEN 'cycle' THEN 0 WHEN 'repair' THEN 1 ELSE 2 END, number DESC) AS i FROM c WHERE NOT (part = 'cycle' AND critic IS NULL)),
w AS (SELECT DISTINCT run FROM c),
t AS (SELECT w.run, critic, CASE WHEN w.run % 4 = 0 THEN 'ranking' WHEN w.run % 4 = 1 THEN 'stop' WHEN w.run % 4 = 2 THEN 'repair' END AS next_stage FROM w LEFT JOIN r ON r.run = w.run AND i = 1)
SELECT run, coalesce(critic, '') AS critic, coalesce(next_stage, '') AS next_stage, CASE next_stage WHEN 'ranking' THEN 'reserve' WHEN 'stop' THEN 'discarded' ELSE 'pending' END AS disposition, critic IS NOT NULL AS has_review FROM t""")
def routed_directions(spark: SparkSession, d: str) -> DataFrame:
    """The critic that counts for each run (user) and where its route leads."""
    events = table(spark, d, "events")
    n, error = F.col("event_id"), F.col("event_type") == "error"
    part = F.when(error, "cycle").when(n % 2 == 0, "repair").otherwise("original")
    results = events.select(F.col("user_id").alias("run"), part.alias("part"), n.alias("number"), F.when(~(error & (n % 3 == 0)), F.concat(F.lit("critic "), n.cast("string"))).alias("critic"))
    critics = provenance.current_critics(results).withColumnRenamed("run", "direction")
    directions = results.select(F.col("run").alias("direction")).distinct()
    k = F.col("direction") % 4
    routes = directions.where(k < 3).select("direction", F.when(k == 0, "ranking").when(k == 1, "stop").otherwise("repair").alias("next_stage"))
    told = provenance.dispositions(directions, routes, critics).join(critics, "direction", "left")
    return told.select(F.col("direction").alias("run"), F.coalesce("critic", F.lit("")).alias("critic"), F.coalesce("next_stage", F.lit("")).alias("next_stage"), "disposition", "has_review")


@query("""SELECT l_suppkey AS topic, count(*) FILTER (WHERE l_returnflag = 'A') AS n_findings, count(*) FILTER (WHERE l_returnflag = 'N') AS n_relationships, count(*) FILTER (WHERE l_returnflag = 'R') AS n_limitations, l_suppkey % 3 = 1 AND count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber = 1) > 0 AS changed FROM lineitem GROUP BY l_suppkey""")
def assembled_landscapes(spark: SparkSession, d: str) -> DataFrame:
    """Landscapes (suppliers) put together from three parts, and whether another version of the parts, in another order, differs."""
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("l_quantity").cast("string").alias("content"), "l_returnflag", "l_linenumber")
    names = {"findings": "A", "relationships": "N", "limitations": "R"}
    parts = lambda rows: {name: rows.where(F.col("l_returnflag") == flag) for name, flag in names.items()}
    edited = F.when((F.col("topic") % 3 == 1) & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "edited").otherwise(F.col("content"))
    one = provenance.landscapes(parts(line))
    two = provenance.landscapes(parts(line.withColumn("content", edited).repartition(5, "item"))).select("topic", F.col("sha256").alias("_other"))
    return one.join(two, "topic").select("topic", *(f"n_{n}" for n in names), (F.col("sha256") != F.col("_other")).alias("changed"))
