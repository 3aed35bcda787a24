"""SimHash near-duplicates (operator 8), linked through Golay-code fuzzy hashing.

Fingerprints are computed in the scan, and only distinct ones are linked. A fingerprint is cut into three
segments. Two fingerprints that differ in two bits at most have one equal segment, and one of the other two
differs in a bit at most. The [23,12] Golay code covers each 23-bit word by exactly one codeword within three
bits, so a word one bit off lies within four bits of that codeword, and at most six codewords are that near.
A pair hence meets on (equal segment, codeword index) of one of six orders of segments; each meeting is
verified by counting the bits that differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices
from corpusloom.operators.components import connected_components
from corpusloom.sources.tables import cut

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Segments of a fingerprint: (lowest bit, width); narrower than 23 bits, they are padded with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Shingles whose bits are held unpacked at once.
VOTES = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text: majority over the XXH64 values of its 3-word shingles, repeats included."""
    import xxhash

    found = (text or b"").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    stops = (ends[SHINGLE - 1 :] - 1).tolist() if len(found) >= SHINGLE else [len(joined)]
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        bits = np.unpackbits(hashes[at : at + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        prints = np.fromiter((fingerprint(t) for t in part.column("text").cast(pa.binary()).to_pylist()), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): print holds the 64 bits as a long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_fingerprints, f"doc_id {kind}, print long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes: the error patterns of weight four at most (six, the least first; -1: none), and the syndrome of each unit."""
    units = np.empty(23, np.int64)
    for bit in range(23):
        rest = 1 << bit
        for at in range(22, 10, -1):
            if rest >> at & 1:
                rest ^= GENERATOR << (at - 11)
        units[bit] = rest
    patterns, found = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for spots in combinations(range(23), weight):
            syndrome = int(np.bitwise_xor.reduce(units[list(spots)])) if spots else 0
            patterns[syndrome, found[syndrome]] = sum(1 << s for s in spots)
            found[syndrome] += 1
    return patterns, units


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6): indices (top 12 bits) of the codewords within four bits of each 23-bit word, the nearest first; -1: none."""
    patterns, units = golay()
    syndrome = np.zeros(len(segment), np.int64)
    for bit in range(23):
        syndrome ^= np.where(segment >> bit & 1, units[bit], 0)
    errors = patterns[syndrome]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The single key under which a fingerprint asks, (n, 6), and those under which it is found, (n, 36); -1: none."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    near = [codewords(p) for p in parts]
    ask, found = [], []
    for k, (equal, fuzzy) in enumerate(permutations(range(3), 2)):
        head = (parts[equal] << 3 | k) << 12
        ask.append(head | near[fuzzy][:, 0])
        found.append(np.where(near[fuzzy] < 0, -1, head[:, None] | near[fuzzy]))
    return np.stack(ask, axis=1), np.concatenate(found, axis=1)


def _keyed(asking: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                prints, nodes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("print", "node"))
                own = keys(prints)[0 if asking else 1]
                row, column = np.nonzero(own >= 0)
                names = ("key", "print_a", "node_a") if asking else ("key", "print_b", "node_b")
                yield pa.RecordBatch.from_arrays([pa.array(own[row, column]), pa.array(prints[row]), pa.array(nodes[row])], list(names))

    return run


def near_prints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node_a, node_b) of distinct fingerprints (print, node) that differ in `max_bits` bits at most (up to two)."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys are complete for 0 to {MAX_BITS} bits")
    ask = distinct.mapInArrow(_keyed(True), "key long, print_a long, node_a long")
    found = distinct.mapInArrow(_keyed(False), "key long, print_b long, node_b long")
    verified = (F.col("print_a") < F.col("print_b")) & (F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= max_bits)
    # Spark takes the keys of a print for one row, so without the hint it would broadcast some 30 times what it reckons.
    return ask.hint("merge").join(found, "key").where(verified).select("node_a", "node_b").distinct()


def components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, print, component_id): the documents with the least doc_id that chains of near fingerprints reach.

    A text that is null, empty or blank has fingerprint zero and links like any other. Repeated doc_ids keep
    a row each. A row with a null doc_id keeps its row and links like any other; null is a component's id only where
    the component has no other. Ids may be of any type that orders. Extra columns are ignored. An empty table gives an
    empty result.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    linked = cut(connected_components(near_prints(distinct.select("print", F.col("print").alias("node")), max_bits), "node_a", "node_b").join(distinct.withColumnRenamed("print", "node"), "node"))
    named = linked.select("node", "component").join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    least = distinct.join(named, F.col("print") == F.col("node"), "left").select("print", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(least, "print").select("doc_id", "print", "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return components(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
