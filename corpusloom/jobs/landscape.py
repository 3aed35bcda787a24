"""Queries of the concept graph: embeddings stand for statements (label: kind), lineitem for triples of brands and nations, suppliers for their papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs.registry import query
from corpusloom.operators import graph, threads
from corpusloom.sources.tables import cut, table

#: The driver's vectors have no pairs from 0.8 on; 0.4 has some of every size of table.
THRESHOLD = 0.4


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vector"))


_CLASSES = "c AS (SELECT label, embedding, min(vec_id) AS vec_id FROM embeddings GROUP BY label, embedding)"
_PAIRS = f"{_CLASSES}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM c a JOIN c b ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD})"
_CLUSTERS = f"""{_PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
r AS (SELECT vec_id AS id, vec_id AS k FROM c UNION SELECT e.v, r.k FROM r JOIN e ON e.u = r.id WHERE r.k < e.v),
m AS (SELECT id, min(k) AS cluster FROM r GROUP BY id), g AS (SELECT x.vec_id AS id, m.cluster FROM embeddings x JOIN c ON x.label IS NOT DISTINCT FROM c.label AND x.embedding = c.embedding JOIN m ON m.id = c.vec_id)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM p")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different vectors of one label."""
    return graph.similar_pairs(_items(spark, d), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    return graph.clusters(items, graph.similar_pairs(items, THRESHOLD), graph.classes(items))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM g")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Single linkage within labels."""
    return _clusters(spark, d)


@query(rf"""WITH RECURSIVE {_CLUSTERS}, s AS (SELECT vec_id AS id, label AS kind, source AS paper_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1))[1] AS text FROM embeddings JOIN documents ON vec_id = doc_id)
SELECT cluster, count(DISTINCT paper_id) AS n_papers, count(*) AS n_statements, (arg_min(text, length(text)::BIGINT * 1000000000 + id)) AS statement FROM s JOIN g USING (id) GROUP BY cluster""")
def aggregated_findings(spark: SparkSession, d: str) -> DataFrame:
    """What each cluster of statements says (first sentences of documents), and how many papers (sources) are behind it."""
    first = F.element_at(T.sentences(F.coalesce("text", F.lit(""))), 1)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), first.alias("text"))
    statements = docs.join(_items(spark, d).select("id", F.col("key").alias("kind")), "id")
    return graph.aggregated_statements(statements, _clusters(spark, d)).select("cluster", "n_papers", "n_statements", "statement")


#: Relations of brands to nations; the papers are suppliers.
_RELATION = ("A", "INTRODUCES", "R", "HURTS", "N", "REDUCES")
_TRIPLES = "t AS (SELECT DISTINCT p_brand AS source, CASE l_returnflag WHEN 'A' THEN 'INTRODUCES' WHEN 'R' THEN 'HURTS' WHEN 'N' THEN 'REDUCES' END AS relation, n_name AS target, l_suppkey AS paper_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), r AS (SELECT source, relation, target, count(*) AS support FROM t GROUP BY ALL)"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    line, part, supplier, nation = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    own = line.select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    joined = own.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("p_brand").alias("source"), F.create_map(*map(F.lit, _RELATION))[F.col("l_returnflag")].alias("relation"), F.col("n_name").alias("target"), F.col("l_suppkey").alias("paper_id")).distinct()


def _mentions(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("source", "target")).alias("concept"), "paper_id").distinct()


@query(f"""WITH {_TRIPLES}, n AS (SELECT concept, count(DISTINCT paper_id) AS n_mentions FROM (SELECT source AS concept, paper_id FROM t UNION ALL SELECT target, paper_id FROM t) GROUP BY concept),
b AS (SELECT concept, max(support) AS best_support FROM (SELECT source AS concept, support FROM r UNION ALL SELECT target, support FROM r) GROUP BY concept)
SELECT concept, n_mentions, best_support FROM n JOIN b USING (concept) WHERE n_mentions < (SELECT median(n_mentions) FROM n) AND best_support < (SELECT median(n_mentions) FROM n)""")
def sparse_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts that fewer papers mention than the median, with no relation of that many."""
    triples = _triples(spark, d)
    mentions = _mentions(triples)
    middle = mentions.groupBy("concept").count().agg(F.median("count")).first()[0]  # one number
    return graph.sparse_concepts(mentions, graph.relationships(triples), middle)


_FIRST = r"string_split(regexp_replace(text, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1))[1]"


@query(f"""WITH d AS (SELECT doc_id, text, {_FIRST} AS quote FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, replace(lower(trim(quote)), 'ß', 'ss') AS quote FROM d WHERE trim(quote) <> ''),
r AS (SELECT doc_id, unnest([0, 1, 2]) AS k, unnest([text, substr(trim(quote), 1, 10), 'nothing of it']) AS text FROM d), t AS (SELECT doc_id, k, replace(lower(trim(text)), 'ß', 'ss') AS text FROM r WHERE trim(text) <> '')
SELECT doc_id AS quote_id, doc_id * 10 + k AS record_id FROM q JOIN t USING (doc_id) WHERE contains(text, quote) OR contains(quote, text)""")
def resolved_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes (first sentences) and records of one paper of which one contains the other."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.element_at(T.sentences(F.col("text")), 1).alias("quote"))
    texts = F.array(F.col("text"), F.substring(F.trim("quote"), 1, 10), F.lit("nothing of it"))
    records = docs.select("doc_id", F.posexplode(texts).alias("k", "record")).select((F.col("doc_id") * 10 + F.col("k")).alias("record_id"), F.col("doc_id").alias("paper_id"), F.col("record").alias("text"), F.array(F.lit(1)).alias("pages"))
    return graph.resolved_quotes(docs.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("paper_id"), "quote"), records).select("quote_id", "record_id")


@query("""WITH q AS (SELECT item_id AS quote_id, doc_id AS record_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))
SELECT DISTINCT 'item' || (quote_id % 7) AS source, 'SOLVES' AS relation, 'item' || (quote_id % 3) AS target, quote_id AS paper_id, record_id, (record_id % 5)::INT AS page FROM q""")
def relationship_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The records and pages that relations rest on, by the quotes that documents contain."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    matches = graph.quote_matches(quotes, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    number = lambda n: F.concat(F.lit("item"), (F.col("quote_id") % n).cast("string"))
    triples = quotes.select("quote_id", number(7).alias("source"), F.lit("SOLVES").alias("relation"), number(3).alias("target"), F.col("quote_id").alias("paper_id"))
    return graph.relationship_evidence(triples, matches.select("quote_id", F.col("text_id").alias("record_id"), F.array((F.col("text_id") % 5).cast("int")).alias("pages")))


@query(f"WITH {_TRIPLES} SELECT source, relation, target, 'relationship-' || substr(sha256(to_json([source, relation, target])), 1, 24) AS item_id FROM r")
def relationship_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that follow from what a relation is."""
    return graph.relationships(_triples(spark, d)).select("source", "relation", "target", graph.stable_id("relationship", F.col("source"), F.col("relation"), F.col("target")).alias("item_id"))


@query(f"""WITH {_TRIPLES}, m AS (SELECT source AS concept, paper_id FROM t UNION SELECT target, paper_id FROM t), g AS (SELECT concept, count(*) AS n FROM m GROUP BY concept),
b AS (SELECT concept, max(support) AS best FROM (SELECT source AS concept, support FROM r UNION ALL SELECT target, support FROM r) GROUP BY concept)
SELECT 'unknown_concept' AS rule, concept AS key, '' AS detail FROM g WHERE concept LIKE 'A%'
UNION ALL SELECT 'unknown_paper', s_suppkey::VARCHAR, '' FROM supplier WHERE s_suppkey % 7 = 3 AND s_suppkey IN (SELECT paper_id FROM t)
UNION ALL SELECT 'support_count', concat_ws('|', source, relation, target), '' FROM r WHERE relation = 'HURTS' AND source LIKE '%1'
UNION ALL SELECT 'contradiction_side', concat_ws('|', source, relation, target), '' FROM r WHERE relation = 'HURTS' AND source LIKE '%1' AND (source, target) IN (SELECT (source, target) FROM r WHERE relation = 'REDUCES')
UNION ALL SELECT 'sparse_counts', concept, '' FROM g WHERE n % 2 = 1 OR concept LIKE 'A%'""")
def landscape_violations(spark: SparkSession, d: str) -> DataFrame:
    """A landscape tampered with: concepts and papers that are not there, wrong counts, contradictions of other relations."""
    triples = _triples(spark, d)
    found, mentions = graph.relationships(triples), _mentions(triples)
    counted = graph.concept_groups(mentions).select("concept", "n_papers")
    groups = counted.where("concept not like 'A%'")
    papers = table(spark, d, "supplier").where("s_suppkey % 7 <> 3").select(F.col("s_suppkey").alias("paper_id"))
    wrong = found.withColumn("support", F.when((F.col("relation") == "HURTS") & F.col("source").endswith("1"), F.col("support") + 1).otherwise(F.col("support")))
    best = wrong.select(F.explode(F.array("source", "target")).alias("concept"), "support").groupBy("concept").agg(F.max("support").alias("best_support"))
    sparse = counted.join(best, "concept").select("concept", (F.col("n_papers") + F.col("n_papers") % 2).alias("n_mentions"), "best_support")
    return graph.landscape_violations(papers, groups, wrong, triples, graph.contradictions(found).where("relation_a = 'HURTS'"), sparse)


_CAP = 6
_ORDERED = lambda supporting, groups: f"""SELECT thread, paper, supporting, row_number() OVER (PARTITION BY thread ORDER BY supporting DESC, CASE WHEN supporting THEN 0 ELSE -shared END, paper) AS i FROM (
SELECT thread, paper, max(s) = 1 AS supporting, sum(h) AS shared FROM (SELECT thread, paper, 1 AS s, 0 AS h FROM {supporting} UNION ALL SELECT thread, paper_id, 0, 1 FROM {groups} JOIN m USING (concept) WHERE thread NOT IN (SELECT thread FROM {supporting} GROUP BY thread HAVING count(*) >= {_CAP})) GROUP BY ALL)"""  # noqa: E731
_THREADS = f"""{_TRIPLES}, m AS (SELECT source AS concept, paper_id FROM t UNION SELECT target, paper_id FROM t),
rs AS (SELECT concat_ws('|', source, relation, target) AS thread, paper_id AS paper FROM t), rg AS (SELECT DISTINCT concat_ws('|', source, relation, target) AS thread, unnest([source, target]) AS concept FROM r),
ro AS ({_ORDERED('rs', 'rg')}), rc AS (SELECT thread, list(paper ORDER BY i) FILTER (WHERE i <= {_CAP}) AS papers, count(*) FILTER (WHERE supporting AND i > {_CAP}) AS omitted FROM ro GROUP BY thread),
us AS (SELECT concept AS thread, paper_id AS paper FROM m), uo AS (SELECT thread, paper, row_number() OVER (PARTITION BY thread ORDER BY paper) AS i FROM us),
uc AS (SELECT thread, list(paper ORDER BY i) FILTER (WHERE i <= {_CAP}) AS papers, count(*) FILTER (WHERE i > {_CAP}) AS omitted FROM uo GROUP BY thread),
op AS (SELECT x.source || '|' || x.target AS thread, concat_ws('|', x.source, x.relation, x.target) AS a, concat_ws('|', y.source, y.relation, y.target) AS b FROM r x JOIN r y ON x.source = y.source AND x.target = y.target WHERE x.relation = 'HURTS' AND y.relation = 'REDUCES'),
o1 AS (SELECT op.thread, ca.papers AS pa, cb.papers AS pb, ca.omitted + cb.omitted AS omitted FROM op JOIN rc ca ON ca.thread = a JOIN rc cb ON cb.thread = b),
o2 AS (SELECT *, pa[1:{_CAP // 2}] AS f1 FROM o1), o3 AS (SELECT *, list_concat(f1, list_filter(pb, lambda z: NOT list_contains(f1, z))[1:{_CAP - _CAP // 2}]) AS f2 FROM o2),
o4 AS (SELECT *, list_concat(f2, list_filter(pa, lambda z: NOT list_contains(f2, z))[1:({_CAP} - length(f2))]) AS f3 FROM o3), oc AS (SELECT *, list_concat(f3, list_filter(pb, lambda z: NOT list_contains(f3, z))[1:({_CAP} - length(f3))]) AS papers FROM o4),
every AS (SELECT 0 AS k, 'relationship' AS kind, thread, papers, omitted, 'scheduled' AS status FROM rc UNION ALL SELECT 4, 'underexplored_regime', thread, papers, omitted, 'scheduled' FROM uc
UNION ALL SELECT 5, 'contradiction', thread, papers, omitted, CASE WHEN len(list_intersect(papers, pa)) = 0 OR len(list_intersect(papers, pb)) = 0 OR len(papers) < 2 THEN 'insufficient_for_adjudication' ELSE 'scheduled' END FROM oc),
th AS (SELECT printf('t%03d', row_number() OVER (ORDER BY k, thread)) AS thread_id, kind, thread, papers, omitted, CASE WHEN row_number() OVER (ORDER BY k, thread) > 1900 THEN 'budget_skipped' ELSE status END AS status FROM every)"""


def _threads(spark: SparkSession, d: str) -> DataFrame:
    triples = _triples(spark, d)
    found, members = graph.relationships(triples), _mentions(triples).withColumnRenamed("paper_id", "paper")
    key = F.concat_ws("|", "source", "relation", "target").alias("thread")
    supporting = triples.select(key, F.col("paper_id").alias("paper"))
    groups = found.select(key, F.explode(F.array("source", "target")).alias("concept"))
    related = threads.chosen(threads.candidates(supporting, groups, members, _CAP), _CAP)
    own = members.withColumnRenamed("concept", "thread")
    sparse = threads.chosen(own.select("thread", "paper", F.lit(True).alias("supporting"), F.lit(0).alias("shared")), _CAP)
    both = graph.contradictions(found).where("relation_a = 'HURTS' and relation_b = 'REDUCES'")
    side = lambda r: F.concat_ws("|", "source", r, "target")
    opposed = both.select(F.concat_ws("|", "source", "target").alias("thread"), side("relation_a").alias("a"), side("relation_b").alias("b"))
    return threads.schedule(("relationship", related), ("underexplored_regime", sparse), ("contradiction", threads.contradictory(opposed, related, _CAP)), max_threads=1900)


@query(f"WITH {_THREADS} SELECT thread_id, kind, thread, array_to_string(papers, ',') AS papers, omitted, status FROM th")
def thread_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Relations, concepts and contradictions as numbered threads with the six papers each reads."""
    return _threads(spark, d).withColumn("papers", F.array_join("papers", ","))


@query(f"""WITH {_THREADS}, u AS (SELECT kind, thread_id, unnest(papers) AS paper FROM th)
SELECT kind, count(*) AS threads, count(*) FILTER (WHERE status = 'scheduled') AS scheduled, count(*) FILTER (WHERE status = 'budget_skipped') AS skipped, count(*) FILTER (WHERE status = 'insufficient_for_adjudication') AS insufficient,
(SELECT count(DISTINCT paper) FROM u WHERE u.kind = th.kind) AS papers, (SELECT count(DISTINCT paper) FROM u WHERE u.kind = th.kind AND u.paper % 3 = 0) AS cited_papers FROM th GROUP BY kind""")
def thread_counters(spark: SparkSession, d: str) -> DataFrame:
    """Threads by kind and state, and the papers that they read and cite (every third)."""
    told = cut(_threads(spark, d))
    return threads.counters(told, told.select("thread_id", F.explode("papers").alias("paper")).where("paper % 3 = 0"))


_LABEL = "CASE vec_id % 5 WHEN 0 THEN 'Host-side Loading' WHEN 1 THEN 'host side loadings' WHEN 2 THEN 'Expert ' || label WHEN 3 THEN 'expert ' || label || 's' ELSE 'Other ' || vec_id END"


@query(f"""WITH RECURSIVE {_PAIRS}, n AS (SELECT vec_id AS id, {_LABEL} AS label FROM embeddings),
j AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE regexp_replace(regexp_replace(lower(x.label), '[^a-z0-9]', '', 'g'), 's$', '') = regexp_replace(regexp_replace(lower(y.label), '[^a-z0-9]', '', 'g'), 's$', '')),
e AS (SELECT a AS u, b AS v FROM j UNION SELECT b, a FROM j),
r AS (SELECT id, id AS k FROM n UNION SELECT e.v, r.k FROM r JOIN e ON e.u = r.id WHERE r.k < e.v),
g AS (SELECT id, min(k) AS grp FROM r GROUP BY id),
o AS (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY length(label), id) AS i FROM g JOIN n USING (id))
SELECT g.id, regexp_replace(regexp_replace(lower(o.label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS concept_id FROM g JOIN o ON o.grp = g.grp AND o.i = 1""")
def normalized_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts of labels: similar vectors of one facet whose spelling a judge holds for equal."""
    from corpusloom.operators.extraction import normalized_labels

    number, facet = F.col("id") % 5, F.col("key").cast("string")
    label = F.when(number == 0, "Host-side Loading").when(number == 1, "host side loadings").when(number == 2, F.concat(F.lit("Expert "), facet)).when(number == 3, F.concat(F.lit("expert "), facet, F.lit("s"))).otherwise(F.concat(F.lit("Other "), F.col("id").cast("string")))
    items = _items(spark, d)
    labels = items.select("id", label.alias("label"), F.col("key").alias("facet"))
    return normalized_labels(labels, graph.similar_pairs(items, THRESHOLD))
