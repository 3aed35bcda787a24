"""Ranked lexical search (operator 11) by best-first document intervals over range-maximum sparse tables.

The documents are cut into shards of bounded size. A shard keeps, in one row, its documents in the order of
their ids and a posting list for each term. A search weighs the lists of the queries' terms, lays a sparse
table of range maxima over each, and then splits intervals of documents: an interval's bound is the sum of
the largest weight of each term within it, the interval of the largest bound is split at the document of its
largest weight, that document is scored exactly, and what can't reach the k best any more is left. The k best
of a query stay with the task from shard to shard, so later shards begin with a high bar; k rows of each task
and query are shuffled, no posting is.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm._common import documents, slices
from corpusloom.sources.tables import checkpoint_dir, cut, table

#: Text bytes and documents of a shard, at most; a longer text is a shard of its own.
SHARD_BYTES, DOC_BITS = 8 << 20, 24
#: Text bytes of a query block, which every task gets; more queries make more blocks.
BLOCK_BYTES = 1 << 20
#: Intervals split at a time, and text bytes tokenised at a time.
FRONT, PIECE = 256, 1 << 20
MASK = (1 << DOC_BITS) - 1
#: ASCII letters and digits and all bytes of other characters stay, A-Z lower-cased; the rest separates terms.
TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Numbers(dict):
    """Numbers its keys in the order in which they are asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        if found := text[at:end].split():
            yield found
        at = end


class Shard:
    """Postings of some documents while they are gathered."""

    def __init__(self) -> None:
        self.vocabulary, self.ids, self.lengths, self.size = Numbers(), [], [], 0
        self.keys, self.counts, self.open, self.pending = [], [], [], 0

    def add(self, doc_id: object, text: bytes) -> None:
        number, length = len(self.ids), 0
        for found in term_pieces(text):
            terms = np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found))
            self.open.append(terms << DOC_BITS | number)
            length += len(found)
            self.pending += len(found)
            if self.pending >= PIECE:
                self._count()
        if length:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.size += len(text)

    def _count(self) -> None:
        if self.open:
            keys, counts = np.unique(np.concatenate(self.open), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.open, self.pending = [], 0

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        """The shard as one row: documents by id (null last), and postings by term and document."""
        self._count()
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        keys, place = np.unique(keys & ~MASK | rank[keys & MASK], return_inverse=True)
        counts = np.bincount(place, counts, len(keys)).astype(np.int64)
        sizes = np.bincount(keys >> DOC_BITS, minlength=len(self.vocabulary))
        lists = [pa.array([self.ids[k] for k in order], kind), pa.array(np.array(self.lengths, np.int64)[order]), pa.array([t.decode() for t in self.vocabulary], pa.string()), pa.array(sizes.astype(np.int32)), pa.array((keys & MASK).astype(np.int32)), pa.array(counts.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) for x in lists], ["docs", "lengths", "terms", "sizes", "posts", "counts"])


def index(docs: DataFrame) -> DataFrame:
    """A row for each shard: docs, lengths (terms of each), terms, sizes (documents of each), posts and counts (documents and occurrences, term by term).

    A document without terms (null, empty, nothing but separators) is in no shard. Rows that repeat a doc_id are
    documents of their own. Every text is indexed whole. The shards are made within the scan's tasks.
    """
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if shard.ids and (shard.size + len(text or b"") > SHARD_BYTES or len(shard.ids) > MASK >> 4):
                    yield shard.row(kind)
                    shard = Shard()
                shard.add(doc_id, text or b"")
        if shard.ids:
            yield shard.row(kind)

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"docs array<{name}>, lengths array<long>, terms array<string>, sizes array<int>, posts array<int>, counts array<int>")


def stored_index(docs: DataFrame) -> DataFrame:
    """The index, written to the shared folder of spark.checkpoint.dir: its columns are then read one by one.

    Each shard is a file of its own. Spark's reader takes thousands of rows of a file at once, here all its shards.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    index(docs).write.option("maxRecordsPerFile", 1).parquet(folder)
    return spark.read.parquet(folder)


class Ranges:
    """The weighed posting lists of a shard, end to end, under one sparse table: no range asked for leaves its list."""

    def __init__(self, docs: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.places = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << DOC_BITS | docs
        self.values = values
        self.log = np.zeros(int(sizes.max(initial=1)) + 1, np.int64)
        self.log[2:] = np.floor(np.log2(np.arange(2, len(self.log)))).astype(np.int64)
        self.table = np.zeros((int(self.log[-1]) + 1, len(docs)), np.int64)
        self.table[0] = values << DOC_BITS | MASK - docs
        for k in range(1, len(self.table)):
            half, last = 1 << (k - 1), len(docs) - (1 << k) + 1
            np.maximum(self.table[k - 1, :last], self.table[k - 1, half : half + last], out=self.table[k, :last])

    def largest(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The largest weight of each range with its document (the first of equals): weight << DOC_BITS | MASK - document; 0: empty."""
        size = right - left
        level = self.log[np.maximum(size, 0)]
        left, other = np.where(size > 0, left, 0), np.where(size > 0, right - (1 << level), 0)
        return np.where(size > 0, np.maximum(self.table[level, left], self.table[level, other]), 0)

    def split(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, lists): where each document is or would be in each list, whether it is there, and its weights."""
        wanted = lists[None, :] << DOC_BITS | docs[:, None]
        place = np.searchsorted(self.places, wanted)
        at = np.minimum(place, len(self.places) - 1)
        hit = self.places[at] == wanted
        return place, hit, np.where(hit, self.values[at], 0)


def best(ranges: Ranges, lists: np.ndarray, ids: list, n_docs: int, top: list[tuple], k: int) -> tuple[list[tuple], int]:
    """The k best of `top` and of a shard's documents for the query of these lists, as (-score, id is null, id), ascending; and how many documents were scored."""
    left, right = ranges.starts[lists][None, :], ranges.ends[lists][None, :]
    low, scored = np.zeros(1, np.int64), 0
    most = ranges.largest(left, right)
    bound, at = (most >> DOC_BITS).sum(axis=1), MASK - (most.max(axis=1) & MASK)
    while True:
        bar, before = 0, n_docs
        if len(top) == k:
            bar = -top[-1][0]
            before = bisect_left(ids, top[-1][2]) if not top[-1][1] else len(ids)
        alive = (bound > bar) | ((bound == bar) & (bar > 0) & (low < before))
        chosen = np.flatnonzero(alive)
        if not len(chosen):
            return top, scored
        rest = chosen[:0]
        if len(chosen) > FRONT:
            order = np.argpartition(-bound[chosen], FRONT)
            chosen, rest = chosen[order[:FRONT]], chosen[order[FRONT:]]
        docs, a, b = at[chosen], left[chosen], right[chosen]
        place, hit, weights = ranges.split(lists, docs)
        scores = weights.sum(axis=1)
        scored += len(docs)
        good = np.flatnonzero((scores >= bar) & (scores > 0))
        found = [(-int(scores[g]), d >= len(ids), ids[d] if d < len(ids) else None) for g, d in zip(good.tolist(), docs[good].tolist(), strict=True)]
        top = sorted(top + found, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k]
        new_left, new_right = np.concatenate([a, place + hit]), np.concatenate([place, b])
        most = ranges.largest(new_left, new_right)
        bounds = (most >> DOC_BITS).sum(axis=1)
        keep = np.flatnonzero(bounds > 0)
        low = np.concatenate([low[rest], np.concatenate([low[chosen], docs + 1])[keep]])
        left, right = np.concatenate([left[rest], new_left[keep]]), np.concatenate([right[rest], new_right[keep]])
        bound = np.concatenate([bound[rest], bounds[keep]])
        at = np.concatenate([at[rest], MASK - (most[keep].max(axis=1) & MASK)])


def weigh(frequency: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's occurrences count for in documents of these lengths, before its weight."""
    m = 100 - 90 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _searcher(queries: list[tuple[object, list[str]]], frequencies: dict[str, int], n_docs: int, n_terms: int, k: int, query_kind: pa.DataType, kind: pa.DataType):
    """A function of Arrow batches: the k best of a task's shards for each query."""
    vocabulary = sorted(frequencies)
    numbers = {t: n for n, t in enumerate(vocabulary)}
    weights = np.array([weigh(frequencies[t], n_docs) for t in vocabulary], np.int64)
    asked = [np.array(sorted(numbers[t] for t in terms if t in numbers), np.int64) for _, terms in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple]] = [[] for _ in queries]
        values = pa.array(vocabulary, pa.string())

        def visit(batch: pa.RecordBatch, row: int) -> None:
            """One shard; what it takes is free again before the next."""
            docs, lengths, terms, sizes, posts, counts = (batch.column(c).slice(row, 1).flatten() for c in ("docs", "lengths", "terms", "sizes", "posts", "counts"))
            place = pc.fill_null(pc.index_in(terms, value_set=values), -1).to_numpy(zero_copy_only=False)
            sizes, ends = sizes.to_numpy(), np.cumsum(sizes.to_numpy())
            mine = np.flatnonzero(place >= 0)
            if not len(mine):
                return
            own = sizes[mine].astype(np.int64)
            spots = np.repeat(ends[mine] - sizes[mine] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            at, found = posts.to_numpy()[spots].astype(np.int64), counts.to_numpy()[spots].astype(np.int64)
            ranges = Ranges(at, np.repeat(weights[place[mine]], own) * impacts(found, lengths.to_numpy()[at], n_docs, n_terms), own)
            lists = np.full(len(vocabulary), -1, np.int64)
            lists[place[mine]] = np.arange(len(mine))
            ids = docs.slice(0, len(docs) - docs.null_count).to_pylist()
            for q, numbered in enumerate(asked):
                there = lists[numbered]
                if len(there := there[there >= 0]):
                    tops[q], _ = best(ranges, there, ids, len(docs), tops[q], k)

        for batch in batches:
            for row in range(batch.num_rows):
                visit(batch, row)
            del batch
        rows = [(q, queries[q][0], doc_id, -score) for q, top in enumerate(tops) for score, _, doc_id in top]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), query_kind, kind, pa.int64()), strict=True)], ["_query", "item_id", "doc_id", "score"])

    return run


def blocks(items: DataFrame, budget: int = BLOCK_BYTES) -> Iterator[list[tuple[object, list[str]]]]:
    """The queries as (item_id, distinct terms), in lists of about `budget` bytes of text; the driver holds one list at a time."""
    block, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        text = (row["text"] or "").encode()
        terms = sorted({t.decode() for piece in term_pieces(text) for t in piece})
        if block and size + len(text) > budget:
            yield block
            block, size = [], 0
        if terms:
            block.append((row["item_id"], terms))
            size += len(text)
    if block:
        yield block


def search(postings: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each row of `items` (item_id, text).

    Every row of `items` is a query; rows that repeat an item_id have ranks of their own. A query without terms, or
    none of whose terms is in the index, has no rows, as has any query of an empty table. Equal scores are ordered
    by doc_id, null last. Ids may be of any type that orders. Extra columns are ignored.
    """
    spark, results = postings.sparkSession, []
    query_kind, kind = (to_arrow_type(t) for t in (items.schema["item_id"].dataType, postings.schema["docs"].dataType.elementType))
    names = [t.simpleString() for t in (items.schema["item_id"].dataType, postings.schema["docs"].dataType.elementType)]
    schema = f"_query int, item_id {names[0]}, doc_id {names[1]}, score long"
    totals = postings.agg(F.sum(F.size("docs")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("terms")).first()
    for block in blocks(items) if totals["docs"] else ():
        asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms in block for t in terms})], "term string")
        listed = postings.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("size"))
        counted = listed.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("size").alias("n")).collect()  # no more rows than the block has terms
        run = _searcher(block, {r["term"]: r["n"] for r in counted}, totals["docs"], totals["terms"], k, query_kind, kind)
        ranked = postings.mapInArrow(run, schema).withColumn("rank", F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
        results.append(ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {names[0]}, rank int, doc_id {names[1]}, score long")
    if len(results) > 1:
        results = [cut(r) for r in results]
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item of the benchmark."""
    return search(stored_index(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), held AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM held),
items AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM benchmark
), asked AS (SELECT q, item_id, unnest(terms) AS term FROM items),
posts AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posts, totals GROUP BY term),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM posts JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
