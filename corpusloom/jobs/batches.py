"""Queries of search for whole tables of queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.jobs.registry import query
from corpusloom.operators import batch_search
from corpusloom.sources.tables import checkpoint_dir, table

TEXTS = {"q1": "the of and with", "q2": "der die und ist", "q3": "que los las para"}
WORDS = r"[\p{L}\p{N}_]+"
#: Queries that each target (benchmark item) has, of six words each.
PARTS, WIDTH = 4, 6
#: Folders of the index, a file or more each.
BUCKETS = 32


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("paper_id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))


def _postings(spark: SparkSession, d: str) -> str:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    batch_search.build_postings(_records(spark, d), folder, buckets=BUCKETS)
    return folder


@query("""WITH a AS (SELECT p_partkey AS query_id, embedding AS qe FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
s AS (SELECT query_id, vec_id AS record_id, round(list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS score FROM embeddings, a)
SELECT query_id, record_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s) WHERE rank <= 5""")
def vector_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest records of every part, whose vector is an embedding."""
    vectors = _vectors(spark, d)
    n = max(1, vectors.count())
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % n).alias("asked"))
    # Parts that have one vector have one ranking, made once.
    own = vectors.join(parts.select(F.col("asked").alias("record_id")).distinct(), "record_id", "left_semi")
    found = batch_search.vector_rankings(vectors, own.withColumnRenamed("record_id", "query_id"), 5)
    told = parts.join(found.withColumnRenamed("query_id", "asked"), "asked")
    return told.select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_BM25 = rf"""d AS (SELECT doc_id AS record_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS found FROM documents),
s AS (SELECT count(*) AS n, avg(length(found)) AS mean_length FROM d),
e AS (SELECT record_id, length(found) AS len, unnest(found) AS term FROM d),
tf AS (SELECT record_id, len, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, record_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))), 9) AS score
       FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY ALL),
b AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 50)"""
_STATED = " UNION ALL ".join(f"SELECT '{q}' AS query_id, unnest({sorted(set(t.split()))!r}) AS term" for q, t in TEXTS.items())


@query(f"WITH q AS ({_STATED}), {_BM25} SELECT query_id, record_id, round(score, 6) AS score, rank FROM b")
def postings_topk(spark: SparkSession, d: str) -> DataFrame:
    """Lexical search of stated queries in stored postings."""
    asked = spark.createDataFrame(list(TEXTS.items()), "query_id string, text string")
    return batch_search.postings_rankings(spark, _postings(spark, d), asked, 50).select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_ASKED = rf"""w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS words FROM benchmark),
a AS (SELECT item_id AS target, item_id * {PARTS} + i AS query_id, words[i * {WIDTH} + 1:i * {WIDTH} + {WIDTH}] AS words, (item_id * {PARTS} + i) % (SELECT count(*) FROM embeddings) AS vec FROM w, range({PARTS}) r(i) WHERE length(words) > i * {WIDTH}),
q AS (SELECT DISTINCT query_id, unnest(words) AS term FROM a)"""


@query(f"""WITH {_ASKED}, {_BM25},
vs AS (SELECT query_id, e.vec_id AS record_id, round(list_inner_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9) AS score FROM a JOIN embeddings f ON f.vec_id = a.vec, embeddings e),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM vs) WHERE rank <= 50),
f AS (SELECT query_id, record_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, record_id, rank FROM b UNION ALL SELECT query_id, record_id, rank FROM v) GROUP BY ALL),
p AS (SELECT query_id, source AS paper_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, record_id) AS i FROM f JOIN documents ON doc_id = record_id),
r AS (SELECT query_id, paper_id, sum(score * pow(0.5::DOUBLE, i - 1)) AS score FROM p GROUP BY ALL),
k AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM r),
t AS (SELECT target, paper_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n_queries FROM k JOIN (SELECT target, query_id FROM a) USING (query_id) GROUP BY ALL)
SELECT target, paper_id, round(score, 9) AS score, n_queries, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, paper_id) AS rank FROM t) WHERE rank <= 20""")
def target_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Twenty papers (sources) for each target (benchmark item) over its queries, lexical and vector, from stored postings."""
    vectors = _vectors(spark, d)
    n = vectors.count()
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(0))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("target"), words.alias("words"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("i")).where(F.size("words") > F.col("i") * WIDTH)
    asked = items.select("target", (F.col("target") * PARTS + F.col("i")).alias("query_id"), F.array_join(F.slice("words", F.col("i") * WIDTH + 1, F.lit(WIDTH)), " ").alias("text"))
    asked = asked.withColumn("record_id", F.col("query_id") % n).join(vectors, "record_id", "left").drop("record_id")
    found = batch_search.search_targets(_records(spark, d), vectors, asked, _postings(spark, d))
    return found.select("target", "paper_id", F.round("score", 9).alias("score"), "n_queries", F.col("rank").cast("long").alias("rank"))
