"""The registered queries over the driver's tables, each beside the SQL that gives the same rows.

documents stand for papers and their text (source: venue, lang: type), embeddings for vectors, benchmark for
quotes and queries, events for a status log, conversations for review rounds, lineitem for links, triples and
evidence between papers, concepts and threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs.registry import QUERIES, SQL, query  # noqa: F401
from corpusloom.operators import decisions, gates, graph, merging, packing, search
from corpusloom.operators import reviews as review_operators
from corpusloom.sources.tables import table

#: The stated queries of the search jobs: text, and the vector of an embedding.
TEXTS = {"q1": "the of and with", "q2": "der die und ist", "q3": "que los las para"}
VECTOR_IDS = {"q1": 0, "q2": 1, "q3": 2}
WORDS = r"[\p{L}\p{N}_]+"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("paper_id"), F.col("lang").alias("type"), "text", "n_chars")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[float]]]:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    asked = {r["record_id"]: r["vector"] for r in vectors.where(F.col("record_id").isin(*VECTOR_IDS.values())).collect()}
    return vectors, {q: asked[v] for q, v in VECTOR_IDS.items()}


_TERMS = " UNION ALL ".join(f"SELECT '{q}' AS query_id, unnest({sorted(set(t.split()))!r}) AS term" for q, t in TEXTS.items())
_BM25 = rf"""
q AS ({_TERMS}),
d AS (SELECT doc_id AS record_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS found FROM documents),
s AS (SELECT count(*) AS n, avg(length(found)) AS mean_length FROM d),
e AS (SELECT record_id, length(found) AS len, unnest(found) AS term FROM d),
tf AS (SELECT record_id, len, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, record_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean_length))), 9) AS score
       FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY ALL),
b AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 50)"""
_VECTOR = """
vq AS (SELECT 'q' || (vec_id + 1) AS query_id, embedding AS qe FROM embeddings WHERE vec_id IN (0, 1, 2)),
vs AS (SELECT query_id, vec_id AS record_id, round(list_inner_product(embedding::DOUBLE[], qe::DOUBLE[]), 9) AS score FROM embeddings, vq),
v AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM vs) WHERE rank <= 50)"""


@query(f"""WITH {_BM25}, {_VECTOR},
f AS (SELECT query_id, record_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, record_id, rank FROM b UNION ALL SELECT query_id, record_id, rank FROM v) GROUP BY ALL),
p AS (SELECT query_id, source AS paper_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, record_id) AS i FROM f JOIN documents ON doc_id = record_id),
r AS (SELECT query_id, paper_id, sum(score * pow(0.5::DOUBLE, i - 1)) AS score FROM p GROUP BY ALL),
k AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM r)
SELECT paper_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_queries FROM k GROUP BY paper_id ORDER BY score DESC, paper_id LIMIT 20""")
def hybrid_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Three queries, lexical and vector, fused into twenty papers."""
    vectors, asked = _vectors(spark, d)
    out = search.hybrid_search(_records(spark, d), vectors, TEXTS, asked)
    return out.select("paper_id", F.round("score", 9).alias("score"), F.size("queries").cast("long").alias("n_queries"))


@query(f"WITH {_BM25} SELECT query_id, record_id, round(score, 6) AS score, rank FROM b")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_records(spark, d), TEXTS, 50).select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(f"WITH {_VECTOR} SELECT query_id, record_id, round(score, 6) AS score, rank FROM v")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors, asked = _vectors(spark, d)
    return search.vector_top_k(vectors, asked, 50).select("query_id", "record_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("""SELECT * FROM (SELECT source AS paper_id, doc_id AS record_id, n_chars AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
FROM documents WHERE lang IN ('en', 'de') AND contains(lower(source), '1') AND n_chars >= 300) WHERE rank <= 5""")
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The longest records of each venue that a retrieval filter lets through, filtered before they are ranked."""
    own = _records(spark, d).withColumn("venue", F.col("paper_id")).where(search.record_filter(types=["en", "de"], venue="1", where="n_chars >= 300"))
    return search.ranked(own.select("paper_id", "record_id", F.col("n_chars").alias("score")), 5, ["paper_id"]).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH h AS (SELECT lang AS query_id, source AS paper_id, doc_id % 97 AS record_id, max(n_chars::DOUBLE) AS score FROM documents GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, record_id) AS i FROM h)
SELECT query_id, paper_id, round(sum(score * pow(0.5::DOUBLE, i - 1)), 6) AS score, count(*) AS n_records FROM o GROUP BY ALL""")
def decayed_rollup(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("paper_id"), (F.col("doc_id") % 97).alias("record_id"), F.col("n_chars").cast("double").alias("score"))
    return search.roll_up(hits).withColumn("score", F.round("score", 6))


@query(r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)) AS x, text FROM documents)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(x) END::BIGINT AS n_sentences, list_max(list_transform(x, lambda y: length(y)))::BIGINT AS longest FROM s""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", "text", T.sentences(F.coalesce("text", F.lit(""))).alias("x"))
    empty = F.coalesce("text", F.lit("")) == ""
    return cut.select("doc_id", F.when(empty, 0).otherwise(F.size("x")).cast("long").alias("n_sentences"), F.array_max(F.transform("x", F.length)).cast("long").alias("longest"))


@query(r"""SELECT p_partkey, substr(sha256(concat_ws('|', regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), p_size::VARCHAR)), 1, 12) AS paper_id,
regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, replace(p_type, ' ', '_') AS folder,
CASE WHEN regexp_matches(p_name || ' 20' || lpad(p_size::VARCHAR, 2, '0'), '(19|20)\d{2}') THEN regexp_extract(p_name || ' 20' || lpad(p_size::VARCHAR, 2, '0'), '((?:19|20)\d{2})', 1)::INT END AS year FROM part""")
def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    dated = F.concat(F.col("p_name"), F.lit(" 20"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(spark, d, "part").select("p_partkey", T.paper_id(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("paper_id"), T.slug(F.col("p_name")).alias("slug"), T.folder_name(F.col("p_type")).alias("folder"), T.year(dated).alias("year"))


_STOP = repr(T.STOP_WORDS)


@query(rf"""WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\-]{{2,}}')), lambda x: NOT list_contains({_STOP}, x)) AS own FROM documents)
SELECT doc_id, length(own)::BIGINT AS n_tokens, round(length(list_intersect(own, ['erion', 'with', 'dans', 'para', 'nicht'])) / 5.0::DOUBLE + 0.5::DOUBLE * length(list_intersect(own, ['que', 'und'])) / 2.0::DOUBLE, 6) AS relevance FROM t""")
def token_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Token sets, and their overlap with a query and with hints. (`with` is a stop word, so no text has it.)"""
    lit = lambda *x: F.array(*map(F.lit, x))
    own = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("own"))
    return own.select("doc_id", F.size("own").cast("long").alias("n_tokens"), F.round(T.relevance(F.col("own"), lit("erion", "with", "dans", "para", "nicht"), lit("que", "und")), 6).alias("relevance"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT source, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality IS NULL) AS unlabelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Decisions per venue in columns; documents without one are counted, not dropped."""
    told = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return told.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    return merging.latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("user_id", F.col("event_type").alias("status"), "event_id")


@query("SELECT event_type AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 GROUP BY event_type")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10")
def failures_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten most recent failures: a report, limited by what it is."""
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "user_id")


@query("SELECT DISTINCT item_id AS quote_id, doc_id AS text_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that documents contain literally."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return graph.quote_matches(quotes, table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def _triples(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("A", "INTRODUCES", "R", "HURTS", "N", "REDUCES")))
    line, part, supplier = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    nations = table(spark, d, "nation")
    joined = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("p_brand").alias("source"), kinds[F.col("l_returnflag")].alias("relation"), F.col("n_name").alias("target"), F.col("l_orderkey").alias("paper_id"))


_TRIPLES = "SELECT DISTINCT p_brand AS source, CASE l_returnflag WHEN 'A' THEN 'INTRODUCES' WHEN 'R' THEN 'HURTS' WHEN 'N' THEN 'REDUCES' END AS relation, n_name AS target, l_orderkey AS paper_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
_RELATIONS = f"SELECT source, relation, target, count(*) AS support FROM ({_TRIPLES}) GROUP BY ALL"


@query(_RELATIONS)
def concept_relationships(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationships(_triples(spark, d))


@query(f"""WITH r AS ({_RELATIONS}) SELECT a.source, a.target, a.relation AS relation_a, b.relation AS relation_b, a.support AS support_a, b.support AS support_b
FROM r a JOIN r b ON a.source = b.source AND a.target = b.target AND a.relation < b.relation WHERE (a.relation, b.relation) IN (('HURTS', 'REDUCES'), ('INTRODUCES', 'REDUCES'))""")
def concept_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return graph.contradictions(graph.relationships(_triples(spark, d)))


@query("SELECT p_brand AS concept, count(DISTINCT l_suppkey) AS n_papers, list_sort(list(DISTINCT l_suppkey))[1] AS first_paper FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def concept_groups(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("concept"), F.col("l_suppkey").alias("paper_id"))
    return graph.concept_groups(mentions).select("concept", "n_papers", F.element_at("papers", 1).alias("first_paper"))


_STANCES = """papers AS (SELECT DISTINCT o_custkey AS thread, o_orderkey AS paper FROM orders),
ev AS (SELECT o_custkey AS thread, o_orderkey AS paper, CASE l_returnflag WHEN 'N' THEN 'supports' WHEN 'A' THEN 'qualifies' ELSE 'contradicts' END AS stance FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25),
k AS (SELECT p.thread, p.paper, bool_or(stance = 'supports') AS s, bool_or(stance = 'qualifies') AS q, bool_or(stance = 'contradicts') AS c FROM papers p LEFT JOIN ev USING (thread, paper) GROUP BY ALL),
g AS (SELECT thread, CASE WHEN c AND s THEN 'mixed' WHEN c THEN 'contradicts' WHEN q THEN 'qualifies' WHEN s THEN 'supports' ELSE 'unknown' END AS kind FROM k),
agreed AS (SELECT thread, count(*) FILTER (WHERE kind = 'supports') AS supports, count(*) FILTER (WHERE kind = 'qualifies') AS qualifies, count(*) FILTER (WHERE kind = 'contradicts') AS contradicts, count(*) FILTER (WHERE kind = 'mixed') AS mixed, count(*) FILTER (WHERE kind = 'unknown') AS unknown FROM g GROUP BY thread)"""


@query(f"""WITH {_STANCES} SELECT *, CASE WHEN unknown * 2 > supports + qualifies + contradicts + mixed + unknown OR contradicts > 0 OR mixed > 0 THEN 'low' WHEN supports + qualifies = 2 OR qualifies > 0 THEN 'medium' ELSE 'high' END AS confidence FROM agreed""")
def agreement_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Stances of papers on threads (orders of customers), and the confidence they allow."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("thread"), F.col("o_orderkey").alias("paper"))
    stance = F.when(F.col("l_returnflag") == "N", "supports").when(F.col("l_returnflag") == "A", "qualifies").otherwise("contradicts")
    evidence = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("paper"), stance.alias("stance")).join(orders, "paper")
    return decisions.agreement(evidence, orders.distinct()).withColumn("confidence", decisions.confidence())


@query("""SELECT thread, paper, i AS place, i <= 4 AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY supporting DESC, CASE WHEN supporting THEN 0 ELSE -shared END, paper) AS i
FROM (SELECT l_partkey AS thread, l_suppkey AS paper, bool_or(l_returnflag = 'R') AS supporting, count(*) AS shared FROM lineitem GROUP BY ALL))""")
def supporting_first(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("thread"), F.col("l_suppkey").alias("paper")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("supporting"), F.count("*").alias("shared"))
    return packing.supporting_first(told, 4)


@query("SELECT l_suppkey AS paper, l_linenumber AS page, count(*) AS demand FROM lineitem GROUP BY ALL")
def page_demand(spark: SparkSession, d: str) -> DataFrame:
    return packing.page_demand(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("paper"), F.col("l_linenumber").alias("page")))


@query("""SELECT l_suppkey AS thread, l_orderkey * 10 + l_linenumber AS item, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 25)::BIGINT AS batch,
((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) - 1) // 25) >= 12 AS omitted FROM lineitem""")
def work_batches(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("thread"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"))
    return packing.batches(items, 25, 12)


@query("""WITH s AS (SELECT o_custkey AS target, o_orderstatus = 'F' AND o_totalprice > 20000 AS good, o_orderpriority <> '5-LOW' AS retrieved FROM orders)
SELECT target, count(*) AS total, count(*) FILTER (WHERE good) AS accepted, round(count(*) FILTER (WHERE good) / count(*), 6) AS coverage, bool_and(retrieved) AND count(*) FILTER (WHERE good) / count(*) >= 0.4 AS met FROM s GROUP BY target""")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Targets (customers) whose shortlist (orders) is reviewed far enough."""
    told = table(spark, d, "orders").select(F.col("o_custkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("withheld").alias("status"), (F.col("o_totalprice") <= 20000).cast("int").alias("n_missing"), (F.col("o_orderpriority") != "5-LOW").alias("retrieved"))
    return gates.coverage(told, ["target"], 0.4).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT 'order_without_customer' AS rule, CAST(o_custkey AS VARCHAR) AS key, '' AS detail FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
UNION ALL SELECT 'repeated_line', l_orderkey || '|' || l_partkey, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
UNION ALL SELECT 'discount', l_orderkey || '|' || l_linenumber, '' FROM lineitem WHERE l_discount > 0.09""")
def integrity_violations(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references, repeated keys and a bound, as rows of one gate."""
    line, orders, customers = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    return gates.gate(gates.dangling(orders, "o_custkey", customers.where("c_acctbal > 0"), "c_custkey", "order_without_customer"), gates.repeated(line, ["l_orderkey", "l_partkey"], "repeated_line"), gates.violations(line, "discount", F.col("l_discount") > 0.09, F.concat_ws("|", "l_orderkey", "l_linenumber")))


@query("SELECT 'round_sequence' AS rule, conv_id::VARCHAR AS key, min(turn) || '/' || max(turn) || '/' || count(*) AS detail FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*)")
def review_sequence(spark: SparkSession, d: str) -> DataFrame:
    return gates.sequence_gaps(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn")


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS i FROM conversations) WHERE i = 1")
def latest_review(spark: SparkSession, d: str) -> DataFrame:
    """The last round of each review."""
    return merging.latest(table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars")), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "n_chars")


_SIGNALS = """SELECT l_suppkey AS candidate, bool_or(l_discount > 0.1) AS downranked, coalesce(avg(CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'N' THEN (l_returnflag = 'R')::INT::DOUBLE END), 0) AS concern,
coalesce(avg(CASE WHEN l_linestatus = 'O' OR l_returnflag <> 'N' THEN (l_returnflag = 'A')::INT::DOUBLE END), 0) AS uncertain, l_suppkey % 3 AS novelty_priority FROM lineitem GROUP BY l_suppkey"""


@query(f"""WITH s AS ({_SIGNALS}), o AS (SELECT candidate, row_number() OVER (ORDER BY downranked, concern, uncertain, novelty_priority, candidate) AS i FROM s)
SELECT candidate, CASE WHEN i <= 10 THEN i ELSE 0 END::BIGINT AS place, CASE WHEN i <= 10 THEN 'selected' ELSE 'reserve' END AS disposition FROM o""")
def portfolio_rank(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers ranked by the findings on their lines; ten are selected."""
    kind = F.when((F.col("l_linestatus") != "O") & (F.col("l_returnflag") == "N"), "not_applicable").when(F.col("l_returnflag") == "R", "concern").when(F.col("l_returnflag") == "A", "uncertain").otherwise("sound")
    findings = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.when(F.col("l_discount") > 0.1, "DOWNRANK").otherwise("KEEP").alias("action"), kind.alias("assessment"))
    ranked = decisions.portfolio(decisions.ranking_signals(findings).withColumn("novelty_priority", F.col("candidate") % 3), 10)
    return ranked.withColumn("place", F.coalesce("place", F.lit(0)).cast("long"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue with the rows of an increment in the place of its own."""
    orders = table(spark, d, "orders")
    new = orders.where("o_orderstatus = 'P'").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return merging.merge(orders.where("o_orderdate < timestamp_ntz'1997-01-01'").select("o_orderkey", "o_totalprice"), new, ["o_orderkey"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND event_type IN ('purchase', 'error'))""")
def work_left(spark: SparkSession, d: str) -> DataFrame:
    """What is still to do: neither done nor failed by the latest status."""
    told = F.create_map(*map(F.lit, ("purchase", "done", "error", "failed")))
    status = _status(spark, d).select(F.col("user_id").alias("c_custkey"), told[F.col("event_type")].alias("status"))
    return merging.todo(table(spark, d, "customer").select("c_custkey"), status, "c_custkey")


@query("""SELECT l_suppkey AS target, l_partkey AS paper, l_suppkey % 7 = 0 OR l_partkey % 11 = 0 OR (l_suppkey % 5 = 1 AND l_partkey % 5 = 1) AS invalidated FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def invalidated_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("paper")).distinct()
    none = F.lit(None).cast("long")
    targets = table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("target"), none.alias("paper"))
    papers = table(spark, d, "part").where("p_partkey % 11 = 0").select(none.alias("target"), F.col("p_partkey").alias("paper"))
    marks = targets.unionByName(papers).unionByName(pairs.where("target % 5 = 1 and paper % 5 = 1"))
    return merging.invalidated(pairs, marks).select("target", "paper", "invalidated")


@query("""SELECT doc_id % 50 AS paper_id, first(source ORDER BY doc_id) FILTER (WHERE source <> 'src3') AS venue, first(lang ORDER BY doc_id) FILTER (WHERE lang <> 'en') AS lang,
count(DISTINCT CASE WHEN source <> 'src3' THEN source END) > 1 AS venue_conflict, count(DISTINCT CASE WHEN lang <> 'en' THEN lang END) > 1 AS lang_conflict FROM documents GROUP BY ALL""")
def bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of papers from many sources, each field by priority, with the conflicts."""
    own = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("paper_id"), F.col("doc_id").alias("priority"), F.when(F.col("source") != "src3", F.col("source")).alias("venue"), F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return merging.bibliography(own, ["venue", "lang"]).select("paper_id", "venue", "lang", F.array_contains("conflicts", "venue").alias("venue_conflict"), F.array_contains("conflicts", "lang").alias("lang_conflict"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/@\s]+(?:[/?#]|$)') AND NOT regexp_matches(lower(url), '[?&](?:x-amz-|signature=|sig=|token=|expires=|awsaccesskeyid=)') THEN replace(trim(url), ' ', '%20') END AS url,
regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.public_url(F.col("url")).alias("url"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))


@query("SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS value, sum(user_id)::BIGINT AS user_id FROM events GROUP BY event_type")
def usage_ledger(spark: SparkSession, d: str) -> DataFrame:
    return merging.usage_ledger(table(spark, d, "events").withColumnRenamed("event_type", "model"), "model", ["value", "user_id"]).withColumn("value", F.round("value", 4))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.02 THEN 'no_verdict' WHEN l_returnflag = 'A' THEN 'tested' WHEN l_returnflag = 'R' THEN 'inferred' WHEN l_linestatus = 'F' THEN 'discussed_only' ELSE 'not_established' END AS tested,
CASE WHEN l_linestatus <> 'F' THEN 'unresolved' WHEN l_returnflag = 'A' THEN 'overlap_found' WHEN l_returnflag = 'R' THEN 'low_overlap' WHEN l_discount < 0.05 THEN 'unresolved' ELSE 'partial_overlap' END AS novelty,
CASE WHEN l_returnflag = 'A' THEN 'reject' WHEN l_discount >= 0.05 THEN 'retain' ELSE 'defer' END AS action FROM lineitem""")
def decision_tables(spark: SparkSession, d: str) -> DataFrame:
    """Test status, novelty status and action of every line."""
    conclusion = F.when(F.col("l_returnflag") == "A", "direct_empirical").when(F.col("l_returnflag") == "R", "inferred").when(F.col("l_linestatus") == "F", "discussed").otherwise("none")
    finding = F.when(F.col("l_returnflag") == "A", "ALREADY_STUDIED").when(F.col("l_returnflag") == "R", "LOW_PRIOR_OVERLAP").otherwise("PARTIAL")
    complete = F.col("l_discount") >= 0.05
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decisions.tested_status(conclusion, F.col("l_tax") >= 0.02).alias("tested"), decisions.novelty_status(finding, complete, F.col("l_linestatus") == "F").alias("novelty"), decisions.hypothesis_action(finding, complete).alias("action"))


@query("SELECT 'lineage' AS rule, o_custkey || '|' || pos AS key, coalesce(before, 'gap') AS detail FROM (SELECT o_custkey, pos, result, CASE WHEN pos > 0 AND o_orderkey % 10 > 0 THEN before END AS parent, before FROM (SELECT *, sha256(o_orderkey::VARCHAR) AS result, lag(sha256(o_orderkey::VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)) WHERE CASE WHEN pos = 0 THEN parent IS NOT NULL ELSE parent IS DISTINCT FROM before END")
def lineage_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Stages (a customer's orders) bound by digests to the one before; every tenth order has lost its parent."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    stages = table(spark, d, "orders").select("o_custkey", "o_orderkey", digest.alias("result"), (F.row_number().over(order) - 1).alias("pos"), F.lag(digest).over(order).alias("before"))
    stages = stages.withColumn("parent", F.when((F.col("pos") > 0) & (F.col("o_orderkey") % 10 > 0), F.col("before")))
    return gates.chain_breaks(stages.drop("before"), "o_custkey", "pos", "parent", "result")


@query("""SELECT source AS paper_id, count(DISTINCT x)::BIGINT AS n_hints FROM (SELECT source, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\\-]{2,}'), lambda x: NOT list_contains(""" + _STOP + """, x))) AS x FROM documents) GROUP BY source""")
def search_hints(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct tokens the records of each venue offer as hints."""
    matches = table(spark, d, "documents").select(F.col("source").alias("paper_id"), "text")
    return review_operators.hint_tokens(matches).select("paper_id", F.size("hints").cast("long").alias("n_hints"))


@query("""SELECT l_suppkey AS paper_id, array_to_string(list_sort(list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'cited' ELSE 'compared' END)), ',') AS roles, count(DISTINCT l_partkey) AS n_candidates, count(DISTINCT l_linenumber) AS n_pages FROM lineitem GROUP BY l_suppkey""")
def paper_inventory(spark: SparkSession, d: str) -> DataFrame:
    """In which roles, for which candidates and with which pages each paper is used."""
    line = table(spark, d, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("paper_id"), F.col("l_partkey").alias("candidate"), F.col("l_linenumber").alias("page"))
    told = review_operators.inventory(("cited", line.where("l_returnflag = 'R'")), ("compared", line.where("l_returnflag <> 'R'")))
    return told.select("paper_id", F.array_join("roles", ",").alias("roles"), F.size("candidates").cast("long").alias("n_candidates"), F.size("pages").cast("long").alias("n_pages"))


@query("""SELECT o_custkey AS target, o_orderkey AS paper, coalesce(i, 0) AS rank, i IS NOT NULL AS in_pool, coalesce(i <= 3, false) AS in_shortlist FROM orders
LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 8) USING (o_custkey, o_orderkey) WHERE o_orderpriority = '1-URGENT'""")
def control_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Where urgent orders stand among each customer's eight dearest, and whether they are in the shortlist of three."""
    orders = table(spark, d, "orders")
    pool = search.ranked(orders.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("paper"), F.col("o_totalprice").alias("score")), 8, ["target"], key="paper")
    controls = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("paper"))
    return review_operators.control_coverage(pool, controls, 3).withColumn("rank", F.coalesce("rank", F.lit(0)).cast("long"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' WHEN o_orderpriority = '5-LOW' THEN 'changed' ELSE 'same' END AS change FROM orders""")
def proposal_changes(spark: SparkSession, d: str) -> DataFrame:
    """Proposals (orders) whose science changed between two versions; the date only explains."""
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    new = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"), F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return review_operators.scientific_changes(old, new, "o_orderkey", ["o_orderdate"])


from corpusloom.jobs import analyses, batches, indexing, integrity, landscape, provenance, reviews, revisions, views  # noqa: E402, F401  its queries
