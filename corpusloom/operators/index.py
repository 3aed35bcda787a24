"""Search tables: postings with document and corpus statistics, vectors with reuse, variants, deletions, exact top ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import all_tokens, normalized_vector
from corpusloom.operators import gates
from corpusloom.operators.merging import reusable


def postings(records: DataFrame, text: str = "text") -> DataFrame:
    """(term, record_id, tf): how often each word stands in each record. One scan, one shuffle of counts."""
    return records.select("record_id", F.explode(all_tokens(F.col(text))).alias("term")).groupBy("term", "record_id").agg(F.count("*").alias("tf"))


def record_lengths(records: DataFrame, text: str = "text") -> DataFrame:
    """(record_id, length) in words."""
    return records.select("record_id", F.size(all_tokens(F.col(text))).cast("long").alias("length"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """(term, n_records, n_words) of a table of postings."""
    return posted.groupBy("term").agg(F.count("*").alias("n_records"), F.sum("tf").alias("n_words"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """(n_records, n_words, mean_length): one row."""
    return lengths.agg(F.count("*").alias("n_records"), F.sum("length").alias("n_words"), F.avg("length").alias("mean_length"))


def build(records: DataFrame, papers: DataFrame, folder: str) -> None:
    """Writes records, papers, postings and lengths as Parquet below `folder`; records that share an id stop the build."""
    twice = gates.repeated(records, ["record_id"], "duplicate_record")
    if not gates.passed(twice):
        raise ValueError(f"records with one id: {[r['key'] for r in twice.limit(5).collect()]}")
    for name, table in (("records", records), ("papers", papers), ("postings", postings(records)), ("lengths", record_lengths(records))):
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def vectors(prior: DataFrame, records: DataFrame, embed) -> DataFrame:
    """(record_id, vector) of all records at length one: prior ones where there are any, `embed`(records without) for the rest."""
    kept, missing = reusable(prior, records)
    made = embed(missing)
    return kept.select("record_id", normalized_vector(F.col("vector")).alias("vector")).unionByName(made.select("record_id", normalized_vector(F.col("vector")).alias("vector")))


def stale_vectors(prior: DataFrame, variant: DataFrame, model: str, size: int) -> DataFrame:
    """Violations that keep a table of vectors from being used: another model or size in its `variant` row, vectors of another length, repeated ids."""
    return gates.gate(
        gates.violations(variant, "model", F.col("model") != model, F.col("model")),
        gates.violations(variant, "size", F.col("size") != size, F.col("size")),
        gates.violations(prior, "length", F.size("vector") != size, F.col("record_id")),
        gates.repeated(prior, ["record_id"], "duplicate_record"),
    )


def without_papers(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` without those of the papers (paper_id) that are gone."""
    return rows.join(gone.select("paper_id").distinct(), "paper_id", "left_anti")


def with_vectors(records: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their vectors, violations: records without one)."""
    missing = records.select("record_id").join(own.select("record_id"), "record_id", "left_anti")
    return records.join(own, "record_id"), gates.violations(missing, "missing_vector", F.lit(True), F.col("record_id"))


def located(papers: DataFrame, listing: DataFrame) -> DataFrame:
    """(paper_id, uri) of papers (paper_id, layout_key, recorded_uri) in a listing of files (key, uri): by the layout's key, else the recorded address, else any file named by the id."""
    by_key = listing.select(F.col("key").alias("layout_key"), F.col("uri").alias("_a")).groupBy("layout_key").agg(F.min("_a").alias("_a"))
    by_uri = listing.select(F.col("uri").alias("recorded_uri")).distinct().withColumn("_b", F.col("recorded_uri"))
    name = F.regexp_extract("key", r"([^/]+)\.pdf$", 1)
    by_name = listing.select(name.alias("paper_id"), "uri").where("paper_id <> ''").groupBy("paper_id").agg(F.min("uri").alias("_c"))
    told = papers.join(by_key, "layout_key", "left").join(by_uri, "recorded_uri", "left").join(by_name, "paper_id", "left")
    return told.select("paper_id", F.coalesce("_a", "_b", "_c").alias("uri"))


def reranked_violations(ranked: DataFrame, pool: DataFrame, keep: int, by: str = "target", key: str = "paper") -> DataFrame:
    """A reranker gives min(keep, pool) different papers of the pool for each target."""
    size = pool.groupBy(by).agg(F.least(F.count("*"), F.lit(keep)).alias("_due"))
    got = ranked.groupBy(by).agg(F.countDistinct(key).alias("_got"), F.count("*").alias("_all"))
    told = size.join(got, by, "left")
    outside = ranked.join(pool.select(by, key), [by, key], "left_anti")
    wrong = (F.coalesce("_got", F.lit(0)) != F.col("_due")) | (F.coalesce("_all", F.lit(0)) != F.coalesce("_got", F.lit(0)))
    return gates.gate(gates.violations(told, "exact_k", wrong, F.col(by), F.coalesce("_all", F.lit(0))), gates.violations(outside, "not_in_pool", F.lit(True), F.concat_ws("|", by, key)))


def closest(pairs: DataFrame, order: dict[str, int], by: str, k: int) -> DataFrame:
    """The k closest prior papers of each group: by the order of overlap, then paper and target."""
    from corpusloom.operators.search import ranked

    place: Column = F.coalesce(F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("classification")], F.lit(len(order)))
    keyed = pairs.withColumn("_order", -place).withColumn("_key", F.struct("paper", "target"))
    return ranked(keyed, k, [by], score="_order", key="_key").drop("_order", "_key")
