"""Near-duplicates of the pipeline: texts whose 5-word shingles are similar (Jaccard) to 0.8 and more.

Candidates are the links of operator 8 (equal fingerprints and, by its Golay keys, those within two bits). SimHash
alone can't find the others: at a similarity of 0.8 some 10 of 64 bits differ, and no keys of a fingerprint are
complete for so many. So texts have further keys, and every candidate is verified by its shingles.

A text has BANDS keys of ROWS minima of its shingles' hashes each; two texts at 0.8 share a key with probability
1 - (1 - 0.8^4)^14 = 0.9994. In buckets of up to HOT texts these are candidates. Texts of larger buckets, as those
that share a common passage, get other keys: of its n shingles, rarest first, the first n - 0.8 n + 1, of which the
first n - 0.89 n + 1 are its core (2 * 0.8 / 1.8 = 0.89). Two texts similar to 0.8 share for certain a key that is core
to the smaller one, and a passage that many texts share is none of the rarest.

Candidates are compared shingle by shingle, never all with all: in each round a bucket's members are compared with
its centres only, of which every round has twice as many, chosen among those to which the key is core. A text that is
near to one before it goes, and a centre that was compared with all members leaves the bucket. Those that stay stay
in their buckets until they were compared, so no two of them that share a key are near.

Rows made of one text's keys or shingles are joined by merging: Spark reckons their size by that of the texts' rows and
would broadcast many times as much, by way of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import row_key, slices
from corpusloom.llm.simhash import fingerprint, near_prints
from corpusloom.sources.tables import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Buckets of so many members are compared all with all after the first round.
SMALL = 16
#: Members of a larger bucket are keyed by their rarest shingles instead.
HOT = 32
SEEDS = np.random.Generator(np.random.PCG64(8)).integers(0, 2**63, BANDS * ROWS, np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Shingles whose hashes are held at once.
BLOCK = 4096


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes.lower() changes A-Z only


def shingles(text: bytes | None) -> set[bytes]:
    """The distinct shingles of a text; one of fewer words is a shingle as a whole."""
    found = _words(text)
    return {b" ".join(found[k : k + SHINGLE]) for k in range(max(1, len(found) - SHINGLE + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def band_keys(own: set[bytes]) -> list[int]:
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    least = np.full(len(SEEDS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        mixed = (hashes[at : at + BLOCK, None] ^ SEEDS) * MIX
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * MIX).min(axis=0))
    return [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, ROWS))]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for part in slices(batches):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        same = [xxhash.xxh3_128_digest(b" ".join(_words(t))) for t in texts]
        found = [shingles(t) for t in texts]
        bands, sizes = [band_keys(f) for f in found], [len(f) for f in found]
        prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(same, pa.binary()), pa.array(prints), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["doc_id", "row", "same", "print", "bands", "size"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the distinct shingles of each text."""
    import xxhash

    for part in slices(batches):
        found = [[xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in shingles(t)] for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.list_(pa.int64()))], ["row", "found"])


def rarest(held: DataFrame) -> DataFrame:
    """(row, key, core, size): of the n shingles of each text (row, text), rarest among all these texts first, those of the first n - 0.8 n + 1 that another text has too.

    Shingles of one text only come first and need no key: they take part in the count.
    """
    hashed = cut(held.select("row", "text").mapInArrow(_hashed, "row binary, found array<long>"))
    single = hashed.select("row", F.size("found").alias("size"), F.explode("found").alias("key"))
    counts = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = single.hint("merge").join(counts, "key").groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    prefix = lambda share: (F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9) + 1 - alone).cast("int")
    first = shared.select("row", "size", prefix(2 * SIMILARITY / (1 + SIMILARITY)).alias("core"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix(SIMILARITY)))).alias("pos", "s"))
    return first.select("row", "s.key", (F.col("pos") < F.col("core")).alias("core"), "size")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, set()
    for part in slices(batches, "text_a"):
        out = []
        for a, row, text in zip(part.column("text_a").cast(pa.binary()).to_pylist(), part.column("later").to_pylist(), part.column("text_b").cast(pa.binary()).to_pylist(), strict=True):
            if a != last or not own:
                last, own = a, shingles(a)
            if similar(own, shingles(text)):
                out.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])


def _near_later(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of the later texts of the pairs (earlier, later) that are near."""
    first = held.select(F.col("row").alias("earlier"), F.col("text").alias("text_a"))
    second = held.select(F.col("row").alias("later"), F.col("text").alias("text_b"))
    return pairs.join(first, "earlier").join(second, "later").select("text_a", "later", "text_b").mapInArrow(_verified, "row binary").distinct()


def dropped(members: DataFrame, held: DataFrame) -> list[DataFrame]:
    """Rows of the texts that are near to an earlier one, of members (key, place, core, size), place ending in the row, and texts (row, text)."""
    active, gone, turn = members, [], 0
    while True:
        sizes = active.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("core").alias("some")).where("n > 1 and some").select("key", "n")
        active = cut(active.select("key", "place", "core", "size").join(sizes, "key"))
        if active.isEmpty():
            return gone
        small = F.lit(turn > 0) & (F.col("n") <= SMALL)
        own = active.where("core").select("key", "n", F.struct("place", "size").alias("centre"))
        some = own.where(~small).groupBy("key", F.pmod(F.hash("centre.place.row"), F.lit(1 << min(turn, 30)))).agg(F.min("centre").alias("centre")).select("key", "centre")
        centres = cut(some.unionByName(own.where(small).select("key", "centre")).select("key", F.col("centre.place").alias("centre"), F.col("centre.size").alias("centre_size")))
        before = F.col("centre") < F.col("place")
        alike = (F.least("size", "centre_size") >= F.greatest("size", "centre_size") * F.lit(SIMILARITY) - 1e-9) & (F.col("core") | (F.col("centre_size") <= F.col("size")))
        met = active.join(centres, "key").where((F.col("centre.row") != F.col("place.row")) & alike)
        pairs = met.select(F.when(before, F.col("centre.row")).otherwise(F.col("place.row")).alias("earlier"), F.when(before, F.col("place.row")).otherwise(F.col("centre.row")).alias("later")).distinct()
        near = cut(_near_later(pairs, held))
        gone.append(near)
        left = active.join(centres.select("key", F.col("centre.row").alias("_row")), (active["key"] == centres["key"]) & (F.col("place.row") == F.col("_row")), "left_anti")
        active = left.join(near.withColumnRenamed("row", "_row"), F.col("place.row") == F.col("_row"), "left_anti")
        turn += 1


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those whose text is near to that of a row that comes before.

    Rows come in order of doc_id, null last, then of a digest of the whole row, so null and repeated doc_ids are rows
    of their own; ids may be of any type that orders. Rows and equal texts are told apart by 128 bits. Of equal texts (but for case and white space) the first stays, also of null, empty and blank ones. Each row that goes is linked to one that stays by a chain of
    near texts. An empty table gives no rows.
    """
    whole, kind = row_key(docs.columns).alias("row"), docs.schema["doc_id"].dataType.simpleString()
    told = docs.select("doc_id", whole, F.col("text").cast("string").alias("text"))
    signed = cut(told.mapInArrow(_signed, f"doc_id {kind}, row binary, same binary, print long, bands array<long>, size int"))
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    distinct = cut(signed.groupBy("same").agg(F.min(F.struct(place.alias("place"), "print", "bands", "size")).alias("first")).select("first.*"))
    prints = distinct.groupBy("print").agg(F.min(F.struct("place", "size")).alias("first")).select("print", "first.*")
    links = near_prints(prints.select("print", F.col("print").alias("node"))).select(F.explode(F.array("node_a", "node_b")).alias("print"), F.xxhash64(F.lit("link"), "node_a", "node_b").alias("key"))
    members = distinct.select("place", "size", F.explode(F.concat("bands", F.array(F.xxhash64(F.lit("print"), "print")))).alias("key"))
    members = members.unionByName(links.join(prints, "print").select("place", "size", "key"))
    members = cut(members.hint("merge").join(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    asked = members.select(F.col("place.row").alias("row")).distinct()
    held = cut(told.select("row", "text").join(asked, "row", "left_semi").dropDuplicates(["row"]))
    hot = cut(members.where(F.col("n") > HOT).select("place", F.col("place.row").alias("row")).distinct())
    keyed = rarest(held.join(hot, "row", "left_semi")).join(hot, "row").select("place", "size", "key", "core")
    members = members.where(F.col("n") <= HOT).select("place", "size", "key", F.lit(True).alias("core")).unionByName(keyed)
    kept = distinct.select(F.col("place.row").alias("_kept_row"))
    if gone := dropped(members, held):
        kept = kept.join(reduce(DataFrame.unionByName, gone).distinct(), F.col("_kept_row") == F.col("row"), "left_anti")
    found = docs.withColumn("_kept_row", whole).join(kept, "_kept_row", "left_semi")
    return found.dropDuplicates(["_kept_row"]).select(*docs.columns)
