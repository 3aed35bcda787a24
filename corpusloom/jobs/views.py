"""Queries of views: facets, claims with sources, records of hypotheses, labels, a deep search, loops and a landscape made from a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.jobs import batches
from corpusloom.jobs.registry import query
from corpusloom.operators import batch_search, extraction, graph, search, views
from corpusloom.sources.tables import table

_FACETS = f"f AS (SELECT l_orderkey AS target, ({list(views.FACETS)})[l_linenumber % 7 + 1] AS facet, l_partkey AS pos, l_shipdate::DATE::VARCHAR AS text, CASE WHEN l_returnflag = 'R' THEN 'unknown' ELSE 'candidate_proposal' END AS basis FROM lineitem)"
_DIMENSIONS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{f}' AS facet, {i} AS turn" for d, keys in views.DIMENSION_FACETS.items() for i, f in enumerate(keys))


@query(f"""WITH {_FACETS}, m AS ({_DIMENSIONS}), b AS (SELECT f.*, dimension, turn FROM f JOIN m USING (facet) UNION ALL SELECT f.*, 'unknown', list_position({list(views.FACETS)}, facet) FROM f WHERE basis = 'unknown')
SELECT target, dimension, text, basis, count(*) AS n, min(place) AS first FROM (SELECT *, row_number() OVER (PARTITION BY target, dimension ORDER BY turn, facet, pos, text, basis) AS place FROM b) GROUP BY ALL""")
def facet_views(spark: SparkSession, d: str) -> DataFrame:
    """Facets of targets (orders) in the dimensions of a comparison, unknown ones apart."""
    line = table(spark, d, "lineitem")
    facet = F.element_at(F.array(*map(F.lit, views.FACETS)), F.col("l_linenumber") % 7 + 1)
    facets = line.select(F.col("l_orderkey").alias("target"), facet.alias("facet"), F.col("l_partkey").alias("pos"), F.col("l_shipdate").cast("date").cast("string").alias("text"), F.when(F.col("l_returnflag") == "R", "unknown").otherwise("candidate_proposal").alias("basis"))
    return views.facet_views(facets).groupBy("target", "dimension", "text", "basis").agg(F.count("*").alias("n"), F.min("place").cast("long").alias("first"))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT a.conv_id AS paper, a.turn AS claim, count(b.turn) AS n_sources, coalesce(string_agg(md5(b.text), ',' ORDER BY pos), '') AS sources FROM (SELECT conv_id, turn, unnest([turn + 1, turn, turn + 50]) AS cited, unnest([0, 1, 2]) AS pos FROM c) a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = cited GROUP BY a.conv_id, a.turn""")
def rendered_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims (turns) with the texts that they cite: the next turn, their own, and one that isn't there."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("paper"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    claims = turns.select("paper", F.col("turn").alias("claim"), "text", F.array(F.col("turn") + 1, F.col("turn"), F.col("turn") + 50).alias("passages"))
    told = views.rendered_claims(claims, turns.select("paper", F.col("turn").alias("passage"), F.lit(1).alias("page"), "text"))
    return told.select("paper", "claim", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.md5(s["text"])), ",").alias("sources"))


@query("""SELECT o_orderkey AS hypothesis, o_custkey AS direction, c_name AS title, o_orderstatus AS status, c_mktsegment AS problem, o_orderpriority AS statement, '../../evidence/' || o_orderkey || '.md' AS evidence_file,
coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem WHERE l_orderkey = o_orderkey)), '') AS judgments, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT l_linenumber::VARCHAR AS n FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 20)), '') AS experiments,
'model_reviewed_not_empirically_validated' AS scientific_validation FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def proposal_records(spark: SparkSession, d: str) -> DataFrame:
    """Flat records of hypotheses (orders) of directions (customers), with judgments and experiments (line items)."""
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem").withColumn("hypothesis", F.col("l_orderkey"))
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("direction"), F.col("c_mktsegment").alias("problem"), F.lit("q").alias("question"), F.lit("s").alias("scope"), F.col("c_name").alias("title"))
    hypotheses = orders.select(F.col("o_orderkey").alias("hypothesis"), F.col("o_custkey").alias("direction"), F.col("o_orderpriority").alias("statement"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("diagnostic"))
    told = views.proposal_records(hypotheses.join(customer.select("direction", "title"), "direction", "left"), customer.drop("title"), line.select("hypothesis", F.col("l_returnflag").alias("judgment")), line.where("l_quantity > 20").select("hypothesis", F.col("l_linenumber").cast("string").alias("experiment")))
    return told.select("hypothesis", "direction", "title", "status", "problem", "statement", "evidence_file", F.array_join("judgments", ",").alias("judgments"), F.array_join("experiments", ",").alias("experiments"), "scientific_validation")


@query("SELECT p_name AS text, p_brand AS facet, min(p_partkey) AS pos FROM part GROUP BY p_name, p_brand")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels (names of parts) of each facet (brand) once, where they come first."""
    return views.distinct_labels(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("text"), F.col("p_brand").alias("facet")))


_DEPTH = 75
_STATED = batches._STATED
_DEEP = f"""q AS ({_STATED}), {batches._BM25.replace("rank <= 50", f"rank <= {_DEPTH}")},
vq AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding AS qe FROM embeddings WHERE vec_id IN (0, 1, 2)),
vs AS (SELECT query_id, vec_id AS record_id, round(list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS score FROM embeddings, vq),
v AS (SELECT * FROM (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM vs) WHERE rank <= {_DEPTH}),
f AS (SELECT query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, record_id, rank FROM b UNION ALL SELECT query_id, record_id, rank FROM v) GROUP BY ALL),
t AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM f) WHERE rank <= 15)"""


def _deep(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """The best k records of each stated query, both channels `fetch_depth` deep."""
    depth = max(views.LEAST_DEPTH, views.TIMES * k)
    vectors = batches._vectors(spark, d)
    texts = spark.createDataFrame(list(batches.TEXTS.items()), "query_id string, text string")
    asked = vectors.where("record_id < 3").select(F.concat(F.lit("q"), (F.col("record_id") + 1).cast("string")).alias("query_id"), "vector")
    channels = [batch_search.postings_rankings(spark, batches._postings(spark, d), texts, depth), batch_search.vector_rankings(vectors, asked, depth)]
    fused = search.reciprocal_ranks(channels).withColumn("score", F.round("score", 12))
    return search.ranked(fused, k, ["query_id"])


@query(f"WITH {_DEEP} SELECT query_id, record_id, round(score, 9) AS score, rank FROM t")
def deep_search(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen records of each stated query, from channels five times as deep."""
    return _deep(spark, d).select("query_id", "record_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_custkey AS run, count(*) AS n, bool_and(coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW'), false)) AS ready FROM orders GROUP BY o_custkey""")
def loop_states(spark: SparkSession, d: str) -> DataFrame:
    """Loops (customers) all of whose candidates (orders) go on to ranking or stop."""
    stage = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ranking").when(F.col("o_orderpriority") == "5-LOW", "stop").when(F.col("o_orderpriority") == "3-MEDIUM", "resolve_upstream")
    return views.loop_states(table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("direction"), stage.alias("next_stage")))


#: Cue words of relations in the invented texts.
CUES = {"of": "CAUSES", "for": "REDUCES", "with": "DEPENDS_ON"}


@query(rf"""WITH {_DEEP}, p AS (SELECT DISTINCT source FROM t JOIN documents ON doc_id = record_id),
x AS (SELECT source AS paper_id, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '[.!?]', '. ', 'g'), '[\pL\pN_]+ (?:for|of|with) [\pL\pN_]+')) AS hit FROM documents WHERE source IN (SELECT source FROM p)),
r AS (SELECT paper_id, w[1] AS source, CASE w[2] WHEN 'of' THEN 'CAUSES' WHEN 'for' THEN 'REDUCES' ELSE 'DEPENDS_ON' END AS relation, w[3] AS target FROM (SELECT paper_id, string_split(hit, ' ') AS w FROM x))
SELECT source, relation, target, count(DISTINCT paper_id) AS support FROM r GROUP BY ALL""")
def query_landscape(spark: SparkSession, d: str) -> DataFrame:
    """From queries to a landscape: retrieval, the papers' texts, relations found in them, and how many papers bear each out."""
    docs = table(spark, d, "documents")
    papers = _deep(spark, d).join(docs.select(F.col("doc_id").alias("record_id"), "source"), "record_id").select("source").distinct()
    # As many papers as records were found at most: the texts are not dealt out for them.
    texts = docs.join(F.broadcast(papers), "source", "left_semi").select(F.col("source").alias("paper_id"), "text")
    found, _ = extraction.extracted(texts, extraction.CueExtractor(CUES, {}))
    return graph.relationships(found.select("paper_id", "source", F.col("label").alias("relation"), "target"))
