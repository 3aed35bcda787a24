"""Substring dedup (operator 7) by content-defined chunking.

A gear hash rolls over the bytes of a text; where it is low, a chunk ends. A cut depends on the 32
bytes before it alone, so text that is inserted or deleted moves no cut further on. Chunks are deduplicated by
digest over the whole collection: the first place in order of (doc_id, start) keeps a chunk, the others are
removed if they lie in runs of repeated chunks of at least MIN_RUN bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices, utf8
from corpusloom.sources.tables import cut

#: Bytes of a chunk on average, those that the hash spans, and those after which a cut is forced.
MEAN, WINDOW, MAX_CHUNK = 32, 32, 1024
#: Shortest run of repeated chunks that counts: shorter ones are phrases that texts share by chance.
MIN_RUN = 96
#: Ids and texts with equal rows that go to every task at most (some 24 bytes each); beyond that they are joined by a shuffle.
MAX_SHARED = 100_000
GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest() for b in range(256)), np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte over the WINDOW bytes up to it: by doubling the span of the sums, five steps for 32 bytes."""
    out, span = GEAR[data], 1
    while span < WINDOW:
        longer = out.copy()
        longer[span:] += out[:-span] << np.uint32(span)
        out, span = longer, span * 2
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all texts, ascending, then the end of the data. An empty text has no chunk."""
    if not len(data):
        return np.zeros(1, np.int64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    ends = (gear(data) < np.uint32((1 << 32) // MEAN)) & (place >= WINDOW - 1)
    borders = np.unique(np.concatenate([offsets, np.flatnonzero(ends) + 1]))
    for k in np.flatnonzero(np.diff(borders) > MAX_CHUNK).tolist():
        borders = np.append(borders, np.arange(borders[k] + MAX_CHUNK, borders[k + 1], MAX_CHUNK))
    return np.unique(borders)


def _chunked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its text, length, digest as a long) of each chunk of a slice.

    64 bits: a billion chunks have 0.03 pairs of equal digests by chance, 3 * 10^12 (some 100 TB) a quarter of a million;
    one of those removes bytes only where its neighbours make up a run of MIN_RUN bytes with it. The digest takes in the bytes
    that decided on the chunk's start, so that a chunk of a few bytes is no repetition wherever those bytes stand.
    """
    import xxhash

    data, offsets = utf8(part)
    borders, raw = cuts(data, offsets), data.tobytes()
    starts, lengths = borders[:-1], np.diff(borders)
    digest = xxhash.xxh3_64_digest
    row = np.searchsorted(offsets, starts, side="right") - 1
    before = np.maximum(starts - WINDOW, offsets[row])
    digests = np.frombuffer(b"".join(digest(raw[a:b]) for a, b in zip(before.tolist(), borders[1:].tolist(), strict=True)), np.int64)
    return row, starts - offsets[row], lengths, digests


def keyed(docs: DataFrame, max_shared: int = MAX_SHARED) -> DataFrame:
    """(doc_id, text, text_key, many): rows are told apart by id and text_key, 64 bits of a text.

    The key is 0 where one row alone has the id, so that it costs the shuffle of chunks next to nothing. `many`: others
    may have the id. Beyond `max_shared` repeated ids every row counts as such, with equal results.
    """
    text = F.col("text").cast("string")
    rows, again = docs.select("doc_id", text.alias("text")), cut(docs.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_doc_id"))
    if again.count() > max_shared:
        return rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.lit(True).alias("many"))
    told = rows.join(F.broadcast(again.withColumn("_many", F.lit(True))), F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    many = F.coalesce("_many", F.lit(False))
    return told.select("doc_id", "text", F.when(many, F.xxhash64("text")).otherwise(0).alias("text_key"), many.alias("many"))


def chunk_table(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, d1): a row for each chunk, no wider than it must be, for all of them are shuffled. Lengths are found again in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, start, _, digests = _chunked(part)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_key").take(at), pa.array(start.astype(np.int32)), pa.array(digests)], ["doc_id", "text_key", "start", "d1"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "text_key").mapInArrow(run, f"doc_id {kind}, text_key long, start int, d1 long")


def _place() -> Column:
    """The order of rows: by doc_id, null last, then by text_key."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")


def repeated(chunks: DataFrame) -> DataFrame:
    """(d1, first_row) of the digests with two places or more, counted map-side first."""
    return chunks.groupBy("d1").agg(F.count("*").alias("n"), F.min(_place()).alias("first_row")).where("n > 1").select("d1", "first_row")


def spans(rows: DataFrame) -> DataFrame:
    """(_doc_id, _text_key, _found): the repeated chunks of each row as (start, d1, later), later where the first place is in a row before."""
    found = chunk_table(rows).join(cut(repeated(chunk_table(rows))), "d1").select("doc_id", "text_key", "start", "d1", (_place() > F.col("first_row")).alias("later"))
    return found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(F.array_sort(F.collect_set(F.struct("start", "d1", "later"))).alias("_found"))


def marked(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_dup_chunks, n_removed, n_spans, kept_text) for every row of `docs`.

    n_dup_chunks counts the chunks in runs that occur elsewhere too, n_removed the bytes that are not the first
    of their kind. kept_text is what stays, with bytes that a cut inside a character orphaned left out. Null is
    an empty text: no chunks. Rows come in order of doc_id, null last, then of a digest of the text; rows that repeat
    a doc_id or have none are rows of their own, and of rows with equal id and text all but one lose all. Extra
    columns are ignored; an empty table gives no rows. Texts are chunked whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, start, length, digests = _chunked(part)
            totals, own = np.bincount(row, minlength=part.num_rows), [{} for _ in range(part.num_rows)]
            for k, place, size in zip(row.tolist(), zip(start.tolist(), digests.tolist(), strict=True), length.tolist(), strict=True):
                own[k][place] = size
            out = [_kept((text or "").encode(), [f | {"length": mine[f["start"], f["d1"]], "later": f["later"] or again} for f in found or () if (f["start"], f["d1"]) in mine], min_run) for text, found, again, mine in zip(part.column("text").to_pylist(), part.column("_found").to_pylist(), part.column("_again").to_pylist(), own, strict=True)]
            columns = [[o[k] for o in out] for k in range(5)]
            arrays = [part.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(totals, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_chunks", "n_dup_chunks", "n_removed", "n_spans", "kept_text"])

    rows = keyed(docs)
    found = spans(rows)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    # Rows that are equal in id and text are counted without their texts; one row of each stands for them.
    copies = cut(rows.where("many").groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(F.count("*").alias("_n")).where("_n > 1"))
    rows = rows.drop("many")
    copies = F.broadcast(copies) if copies.count() <= MAX_SHARED else copies
    single = rows.join(copies, same, "left_anti").withColumn("_again", F.lit(False))
    many = rows.join(copies, same).drop("_doc_id", "_text_key").dropDuplicates(["doc_id", "text_key"])
    many = many.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("doc_id", "text", "text_key", (F.col("_copy") > 1).alias("_again"))
    told = single.unionByName(many).join(found, same, "left").select("doc_id", "text", "_found", "_again")
    return told.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_chunks long, n_dup_chunks long, n_removed long, n_spans long, kept_text string")


def _kept(text: bytes, found: list[dict], min_run: int) -> tuple[int, int, int, int, str]:
    """(bytes, repeated chunks in runs, bytes removed, spans, what stays) of a text with its repeated chunks in order.

    A run is a row of neighbouring repeated chunks of `min_run` bytes together, or a whole text of them. In a run
    goes what has its first place in a document before, or before in this one.
    """
    runs: list[list[dict]] = []
    for chunk in found:
        if runs and chunk["start"] <= runs[-1][-1]["start"] + runs[-1][-1]["length"]:
            runs[-1].append(chunk)
        else:
            runs.append([chunk])
    chunks, gone, seen = 0, [], set()
    for run in runs:
        size = run[-1]["start"] + run[-1]["length"] - run[0]["start"]
        counts = size >= min_run or size == len(text)
        chunks += len(run) * counts
        for chunk in run:
            if counts and (chunk["later"] or chunk["d1"] in seen):
                start, end = chunk["start"], chunk["start"] + chunk["length"]
                if gone and start <= gone[-1][1]:
                    gone[-1][1] = max(end, gone[-1][1])
                else:
                    gone.append([start, end])
            seen.add(chunk["d1"])
    pieces, at = [], 0
    for start, end in gone:
        pieces.append(text[at:start])
        at = end
    pieces.append(text[at:])
    return len(text), chunks, sum(b - a for a, b in gone), len(gone), b"".join(pieces).decode("utf-8", "ignore")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated chunks counted and removed."""
    return marked(documents(spark, sf_dir))
