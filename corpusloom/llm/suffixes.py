"""Substring dedup (operator 6) over sampled, sorted suffixes.

A suffix is read to LENGTH bytes; a byte goes if it lies in such a string that starts twice or more. A position
for each byte of a collection is too much to sort, so the suffixes are sampled: each string of LENGTH bytes has a
minimizer, the least hash among its GRAM-byte grams, and neighbouring strings share theirs. Equal strings have
equal minimizers, so it is enough to compare strings that hang on equal grams.

Level 1 has a record for each run of strings with one minimizer: its leading token is the gram, the next the
span of the whole run. Records are range-partitioned by sampled splitters, sorted within buckets by token after
token, and compared with their neighbours, also across the borders of buckets. A run whose whole span recurs is
removed; one whose gram does not recur is kept. The others are cut into blocks, of which the leading token is
what all strings of a block share and the next the block's span (level 2), and what is left into single strings
(level 3), sorted and compared in the same way. Tokens are compared by 64-bit digests under two seeds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices
from corpusloom.sources.tables import cut, fleeting

LENGTH, GRAM, BLOCK = 400, 64, 16
MIX = np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x9E3779B97F4A7C15
BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8, person=b"suffix").digest() for b in range(256)), np.uint64)
#: Bits of a hash that hold the place in its piece; pieces of longer texts overlap by LENGTH - 1 bytes.
PLACE_BITS = 22
PIECE = (1 << PLACE_BITS) - 1
#: Records that go out in one batch.
BATCH = 10_000
#: Columns of a record: two tokens, the row it is from (its doc_id and a hash of its text, so that null and repeated ids are told apart),
#: and its place; origin is the gram's place at level 1, then the start of the span a block is from.
RECORD = {"lead": pa.int64(), "whole": pa.int64(), "text_key": pa.int64(), "origin": pa.int32(), "start": pa.int32(), "strings": pa.int32()}
EDGE = "bucket int, lead long, whole long, last_lead long, last_whole long"
EDGE_NAMES = [f.split()[0] for f in EDGE.split(", ")]
PLACE = ["doc_id", "text_key", "origin", "start", "strings"]


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling the span."""
    out, base, span = BYTES[data], BASE, 1
    while span < GRAM:
        out = out[:-span] * np.uint64(base) + out[span:]
        base, span = base * base & (1 << 64) - 1, span * 2
    return (out ^ (out >> np.uint64(31))) * MIX


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram's place, first start, last start) of the runs of strings of `length` bytes that share a minimizer, leftmost of equals."""
    window = length - GRAM + 1
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    found = []
    for low in range(0, n, PIECE - length + 1):
        piece = data[low : low + PIECE]
        marks = grams(piece) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(piece) - GRAM + 1, dtype=np.uint64)
        rows = np.full(-(-len(marks) // window) * window, 2**64 - 1, np.uint64)
        rows[: len(marks)] = marks
        rows = rows.reshape(-1, window)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        own = len(marks) - window + 1
        least = np.minimum(right[:own], left[window - 1 : window - 1 + own]) & np.uint64((1 << PLACE_BITS) - 1)
        found.append(least.astype(np.int64) + low)
    places = np.concatenate(found)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[first], first, np.append(first[1:], n) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of `docs`."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_key"] == b["_text_key"]) & a["doc_id"].eqNullSafe(b["_doc_id"])


def _schema(docs: DataFrame, names: list[str]) -> str:
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString()} | {n: "long" if t == pa.int64() else "int" for n, t in RECORD.items()}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _records(rows: Iterable[tuple], doc_id: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, the columns of RECORD), in batches that neither a short text leaves nearly empty nor a long one swells."""
    kinds, rows = {"doc_id": doc_id} | RECORD, iter(rows)
    while part := list(islice(rows, BATCH)):
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def run_records(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Level 1: a record for each run of strings with one minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, half = xxhash.xxh3_64_intdigest, 1 << 63

        def rows(part: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, raw, key in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("text_key").to_pylist(), strict=True):
                for place, first, last in zip(*(x.tolist() for x in runs(np.frombuffer(raw, np.uint8), length)), strict=True):
                    yield doc_id, digest(raw[place : place + GRAM]) - half, digest(raw[first : last + length]) - half, key, place, first, last - first + 1

        for part in slices(batches):
            yield from _records(rows(part), part.schema.field("doc_id").type)

    return docs.mapInArrow(run, _schema(docs, ["doc_id", *RECORD]))


def block_records(spans: DataFrame, block: int, length: int = LENGTH) -> DataFrame:
    """Levels 2 and 3: a record for each block of strings of the spans (doc_id, text_key, start, strings, span). Blocks stand on a grid from each span's gram on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, half = xxhash.xxh3_64_intdigest, 1 << 63

        def rows(part: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, key, start, strings, grid, raw in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "strings", "grid", "span")), strict=True):
                k = 0
                while k < strings:
                    phase = (k + grid) % block
                    n = min(strings - k, block - phase)
                    low = k - phase  # what the strings of the whole block share lies in each of them
                    lead = digest(raw[low + block - 1 : low + length], seed=1) - half
                    whole = digest(raw[k : k + n - 1 + length], seed=2 + phase) - half
                    yield doc_id, lead, whole, key, start, start + k, n
                    k += n

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield from _records(rows(part), part.schema.field("doc_id").type)

    return spans.mapInArrow(run, _schema(spans, ["doc_id", *RECORD]))


def recurring(records: DataFrame) -> DataFrame:
    """The records whose leading token recurs, with whole_again, whether the span does too, and open, whether their strings are to be compared further.

    Equal tokens are neighbours in the sorted buckets. The order ends in the place, so a token that a third of all
    records share is spread over many buckets. The first and last token of each bucket, two of each, come to the
    driver and go to the tasks, which compare across the borders with them. Open are the records whose span does
    not recur, and, as their witnesses, the first and last of those whose span recurs and whose leading token has
    other spans beside it.
    """
    order = ["lead", "whole", "doc_id", "text_key", "start"]
    buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with fleeting(records.repartitionByRange(buckets, *order).sortWithinPartitions(*order)) as ordered:  # keeps its buckets, for both passes
        return _compared(ordered)


def _compared(ordered: DataFrame) -> DataFrame:
    """What `recurring` returns, of records in sorted buckets."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                leads, wholes = batch.column("lead"), batch.column("whole")
                first = first or (leads[0].as_py(), wholes[0].as_py())
                last = (leads[-1].as_py(), wholes[-1].as_py())
        if first:
            yield pa.RecordBatch.from_pylist([dict(zip(EDGE_NAMES, (TaskContext.get().partitionId(), *first, *last), strict=True))], pa.schema([(n, pa.int64() if k else pa.int32()) for k, n in enumerate(EDGE_NAMES)]))

    edges = sorted(tuple(r) for r in ordered.mapInArrow(ends, EDGE).collect())
    before = {b[0]: a[3:] for a, b in zip(edges, edges[1:], strict=False)}
    after = {a[0]: b[1:3] for a, b in zip(edges, edges[1:], strict=False)}
    shared = ordered.sparkSession.sparkContext.broadcast((before, after))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        previous, held = shared.value[0].get(bucket), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield _flagged(held, previous, (batch.column("lead")[0].as_py(), batch.column("whole")[0].as_py()))
                previous = (held.column("lead")[-1].as_py(), held.column("whole")[-1].as_py())
            held = batch
        if held is not None:
            yield _flagged(held, previous, shared.value[1].get(bucket))

    return cut(ordered.mapInArrow(compare, f"{_schema(ordered, PLACE)}, whole_again boolean, open boolean"))


def _flagged(batch: pa.RecordBatch, previous: tuple[int, int] | None, following: tuple[int, int] | None) -> pa.RecordBatch:
    """The records of a batch whose leading token is that of a neighbour."""
    lead, whole = (batch.column(c).to_numpy() for c in ("lead", "whole"))
    same_lead, same_whole = np.zeros(len(lead) + 1, bool), np.zeros(len(lead) + 1, bool)  # between each record and the one before it
    same_lead[1:-1] = lead[1:] == lead[:-1]
    same_whole[1:-1] = same_lead[1:-1] & (whole[1:] == whole[:-1])
    for at, own, other in ((0, 0, previous), (-1, -1, following)):
        if other is not None:
            same_lead[at] = lead[own] == other[0]
            same_whole[at] = same_lead[at] and whole[own] == other[1]
    other_span = same_lead & ~same_whole
    again = same_whole[1:] | same_whole[:-1]
    kept = pa.array(same_lead[1:] | same_lead[:-1])
    columns = [*(batch.column(c) for c in PLACE), pa.array(again), pa.array(~again | other_span[1:] | other_span[:-1])]
    return pa.RecordBatch.from_arrays(columns, [*PLACE, "whole_again", "open"]).filter(kept)


def _spans(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, start, strings, grid, span): the bytes of the wanted runs of strings."""
    asked = wanted.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(F.collect_set(F.struct("start", "strings", "origin")).alias("wanted"))
    told = docs.join(asked, _same_row(docs, asked)).select("doc_id", "text", "text_key", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, key, raw, asked in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist(), part.column("wanted").to_pylist(), strict=True):
                for start, strings, place in sorted((w["start"], w["strings"], w["origin"]) for w in asked):
                    rows.append((doc_id, key, start, strings, (start - place) % BLOCK, raw[start : start + strings - 1 + length]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (part.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "start", "strings", "grid", "span"])

    return told.mapInArrow(run, f"{_schema(docs, ['doc_id', 'text_key', 'start', 'strings'])}, grid int, span binary")


def recurring_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, start, strings): runs of starts of strings of `length` bytes that start elsewhere too."""
    own = _keyed(docs).where(F.octet_length("text") >= length)
    level1 = recurring(run_records(own, length))
    spans = cut(_spans(own, level1.where("open"), length))
    level2 = recurring(block_records(spans, BLOCK, length))
    left = level2.where("open").select("doc_id", "text_key", "origin", F.col("start").alias("low"), F.col("strings").alias("n")).distinct()
    told = spans.withColumnRenamed("start", "origin")
    singles = told.join(left.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key", "origin": "_origin"}), (F.col("text_key") == F.col("_text_key")) & (F.col("origin") == F.col("_origin")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    piece = F.expr(f"substring(span, low - origin + 1, n + {length - 1})")
    level3 = recurring(block_records(singles.select("doc_id", "text_key", F.col("low").alias("start"), F.col("n").alias("strings"), F.lit(0).alias("grid"), piece.alias("span")), 1, length))
    found = [x.where("whole_again").select("doc_id", "text_key", "start", "strings") for x in (level1, level2, level3)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of `docs`: the removed runs as (start, end) in bytes, in order, and the bytes that stay.

    Bytes of strings of `length` bytes that start elsewhere too go, judged on the input. Null is an empty text, of
    which nothing goes. Rows that repeat a doc_id, or have none, count as documents of their own; equal ones recur.
    The doc_id may be of any type. Extra columns are ignored; an empty table gives no rows. Texts are read whole.
    """
    found = recurring_strings(docs, length).groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).agg(F.collect_set(F.struct("start", "strings")).alias("found"))
    own = _keyed(docs)
    told = own.join(found, _same_row(own, found), "left").select("doc_id", "text", "found")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [raw or b"" for raw in part.column("text").cast(pa.large_binary()).to_pylist()]
            spans = [_merged(found, length) for found in part.column("found").to_pylist()]
            kept = [_rest(raw, gone) if gone else raw for raw, gone in zip(texts, spans, strict=True)]
            arrays = [pa.array(list(map(len, texts)), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in gone] for gone in spans], span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def _merged(found: list[dict] | None, length: int) -> list[list[int]]:
    """The runs of bytes under recurring strings, as [start, end] in order; runs that touch are one."""
    gone: list[list[int]] = []
    for start, end in sorted((f["start"], f["start"] + f["strings"] - 1 + length) for f in found or ()):
        if gone and start <= gone[-1][1]:
            gone[-1][1] = max(end, gone[-1][1])
        else:
            gone.append([start, end])
    return gone


def _rest(raw: bytes, gone: list[list[int]]) -> bytes:
    """What stays of a text without the runs `gone`."""
    starts, ends = zip(*gone, strict=True)
    return b"".join(raw[a:b] for a, b in zip((0, *ends), (*starts, len(raw)), strict=True))


def _figures() -> list[Column]:
    """n_removed, n_spans and kept_sha256, from the columns of `deduplicated`."""
    return [(F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of `docs`: `deduplicated` in figures."""
    return deduplicated(docs, length).select("doc_id", "n_bytes", *_figures())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what recurring strings of 400 bytes take from it, and the text that stays: a character that a cut went through reads as U+FFFD there."""
    told = deduplicated(documents(spark, sf_dir))
    return told.select("doc_id", "n_bytes", *_figures(), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
