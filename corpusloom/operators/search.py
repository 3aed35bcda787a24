"""Hybrid search: filter, lexical and vector top-k, reciprocal rank fusion, decayed roll-up, fusion across queries.

Queries are a small stated set and travel as literals, so the records are scanned once for all of them, filters
reach the scan, and only matching terms leave it. Each channel's top k is a row_number whose limit Spark applies
in every task before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import all_tokens, dot
from corpusloom.sources.tables import cut

RRF_K, DECAY = 60, 0.5
#: The usual constants of BM25.
K1, B = 1.5, 0.75


def record_filter(*, types: Sequence[str] = (), paper_ids: Sequence = (), year_min: int | None = None, year_max: int | None = None, venue: str | None = None, areas: Sequence[str] = (), meta: dict[str, str] | None = None, where: str | None = None) -> Column:
    """The condition of a retrieval filter over the columns type, paper_id, year, venue, areas and meta. An empty list is no filter."""
    out = F.lit(True)
    if types:
        out &= F.col("type").isin(*types)
    if paper_ids:
        out &= F.col("paper_id").isin(*paper_ids)
    if year_min is not None:
        out &= F.col("year") >= year_min
    if year_max is not None:
        out &= F.col("year") <= year_max
    if venue:
        out &= F.contains(F.lower("venue"), F.lit(venue.lower()))
    if areas:
        wanted = [a.lower() for a in areas]
        out &= F.exists("areas", lambda a: F.lower(a).isin(wanted))
    for key, value in (meta or {}).items():
        own = F.lower(F.col(f"meta.{key}").cast("string"))
        accepted = {"true": ["true", "1"], "false": ["false", "0"]}.get(value.lower(), [value.lower()])
        out &= own.isin(accepted)
    return out & F.expr(where) if where else out


def ranked(hits: DataFrame, k: int, by: Sequence[str], score: str = "score", key: str = "record_id") -> DataFrame:
    """The top k of each group by score, of equals by key, with rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(records: DataFrame, queries: dict[str, str], k: int, text: str = "text") -> DataFrame:
    """(query_id, record_id, score, rank) of the records of positive score. Statistics are those of all `records`.

    The texts are read once: what leaves the scan are the lengths of the records and the occurrences of query terms,
    which are kept, for statistics and scores both rest on them.
    """
    import re

    terms = {q: sorted(set(re.findall(r"\w+", t.lower()))) for q, t in queries.items()}
    every = sorted({t for own in terms.values() for t in own})
    if not every:
        return records.sparkSession.createDataFrame([], f"query_id string, record_id {records.schema['record_id'].dataType.simpleString()}, score double, rank int")
    wanted = F.array(*map(F.lit, every))
    parsed = records.select("record_id", all_tokens(F.col(text)).alias("found"))
    counted = cut(parsed.select("record_id", F.size("found").alias("length"), F.filter("found", lambda t: F.array_contains(wanted, t)).alias("hits")))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")).first()  # two numbers
    per_term = counted.select("record_id", "length", F.explode("hits").alias("term")).groupBy("record_id", "length", "term").agg(F.count("*").alias("tf"))
    df = per_term.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as query terms
    by_term = records.sparkSession.createDataFrame([(q, t) for q, own in terms.items() for t in own], "query_id string, term string")
    scored = per_term.join(by_term.join(df, "term"), "term")
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (stats["mean_length"] or 1.0)))
    summed = scored.groupBy("query_id", "record_id").agg(F.round(F.sum(part), 9).alias("score"))
    return ranked(summed.where("score > 0"), k, ["query_id"]).select("query_id", "record_id", "score", "rank")


def vector_top_k(vectors: DataFrame, queries: dict[str, Sequence[float]], k: int, vector: str = "vector") -> DataFrame:
    """(query_id, record_id, score, rank) by exact inner product."""
    asked = [F.struct(F.lit(q).alias("query_id"), F.round(dot(F.col(vector), F.array(*(F.lit(float(x)) for x in v))), 9).alias("score")) for q, v in queries.items()]
    hits = vectors.select("record_id", F.explode(F.array(*asked)).alias("h")).select("h.query_id", "record_id", "h.score")
    return ranked(hits, k, ["query_id"])


def reciprocal_ranks(channels: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, record_id, score): the sum of 1 / (k + rank) over the channels."""
    union = channels[0].select("query_id", "record_id", "rank")
    for c in channels[1:]:
        union = union.unionByName(c.select("query_id", "record_id", "rank"))
    return union.groupBy("query_id", "record_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def roll_up(hits: DataFrame, decay: float = DECAY) -> DataFrame:
    """(query_id, paper_id, score, n_records): a paper's records by falling score weigh 1, 1/2, 1/4 and so on; a record counts once, at its best.

    The weight of a record so far down that a double can't show it beside the first one's is left out of the sum,
    so that Spark limits every group in each task before the shuffle; all records are counted.
    """
    best = hits.groupBy("query_id", "paper_id", "record_id").agg(F.max("score").alias("score"))
    shown = math.ceil(-60 / math.log2(decay))
    top = ranked(best, shown, ["query_id", "paper_id"]).withColumn("part", F.col("score") * F.pow(F.lit(decay), F.col("rank") - 1))
    counts = best.groupBy("query_id", "paper_id").agg(F.count("*").alias("n_records"))
    return top.groupBy("query_id", "paper_id").agg(F.sum("part").alias("score")).join(counts, ["query_id", "paper_id"])


def fuse_queries(papers: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """(paper_id, score, queries): the sum over queries of 1 / (k + rank of the paper), best first of (-score, paper_id)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("paper_id"))
    places = papers.withColumn("rank", F.row_number().over(order))
    fused = places.groupBy("paper_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_list(F.struct("query_id", "rank"))).alias("queries"))
    return fused.orderBy(F.desc("score"), F.asc("paper_id")).limit(limit)


def hybrid_search(records: DataFrame, vectors: DataFrame, texts: dict[str, str], query_vectors: dict[str, Sequence[float]], record_k: int = 50, paper_k: int = 20) -> DataFrame:
    """(paper_id, score, queries) of a batch of queries, as one plan. `records` carries record_id, paper_id, text."""
    hits = reciprocal_ranks([bm25(records, texts, record_k), vector_top_k(vectors, query_vectors, record_k)])
    placed = hits.join(records.select("record_id", "paper_id"), "record_id")
    return fuse_queries(roll_up(placed), paper_k)


def distinct_queries(plan: DataFrame, limit: int) -> DataFrame:
    """(pos, query) of a plan without blanks and repeats: the first of each key, the lowest positions, at most `limit`."""
    from corpusloom.functions.text import query_key

    first = plan.where(F.trim("query") != "").groupBy(query_key(F.col("query")).alias("key")).agg(F.min(F.struct("pos", "query")).alias("first"))
    return first.select("first.*").orderBy("pos").limit(limit)
