"""Benchmark decontamination (operator 9) by greedy string tiling.

Documents and benchmark items are sequences of words. Runs of five words that both have are seeds. For each
document and item with seeds, the longest common match that overlaps nothing marked is marked again and again; the
marked share of the item is its coverage, whatever the order of its passages in the document. Matches are compared
by running Karp-Rabin hashes; what is marked is compared word by word.

A match is listed once, at the seed where it begins, so that a text of one phrase over and over has about as many
matches as words, not as many as words times words of the item.

The seeds of a benchmark of up to BLOCK_BYTES are joined inside the scan. A larger one meets the documents in a join
on the hashes of seeds; only documents and items that share seeds enough are then fetched and tiled, pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm._common import documents, slices
from corpusloom.sources.tables import cut, table

MIN_MATCH, COVERAGE = 5, 0.8
#: Bytes of benchmark text that go to every task at once; a larger benchmark is joined by its seeds.
BLOCK_BYTES = 4 << 20
#: Base of the running hash, an odd number, and its inverse; sums wrap at 64 bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stands between items; no word has this id, nor STRANGE, that of words that no item has.
BORDER, STRANGE = -2, -1
#: Words whose hashes a worker keeps.
MEMO = 1_000_000
TOKEN = re.compile(r"\w+")
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return TOKEN.findall((text or "").lower())


def mixed(ids: np.ndarray) -> np.ndarray:
    """A number of 64 scattered bits for each id."""
    out = ids.astype(np.uint64) * np.uint64(BASE)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


def rolling(values: np.ndarray, width: int, places: np.ndarray | None = None) -> np.ndarray:
    """The hash of the run of `width` values at each place, at every place if none are told."""
    places = np.arange(max(0, len(values) - width + 1)) if places is None else places
    out = np.zeros(len(places), np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + values[places + k]
    return out


class Prefixes:
    """Running sums that give the hash of any run of a sequence."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray) -> None:
        cls = type(self)
        if len(cls.powers) <= len(ids):
            size = 2 * len(ids)
            cls.powers, cls.inverses = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (BASE, INVERSE))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(ids) * cls.powers[: len(ids)])])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.inverses[starts]


def extended(doc: Prefixes, other: Prefixes, d: np.ndarray, i: np.ndarray, size: int, longest: int) -> np.ndarray:
    """How many words match at each pair of places, of which `size` do."""
    out = np.full(len(d), size)
    room = np.minimum(len(doc.sums) - 1 - d, len(other.sums) - 1 - i)
    for step in (1 << k for k in range(longest.bit_length() - 1, -1, -1)):
        fits = np.flatnonzero(out + step <= room)
        more = out[fits] + step
        same = doc.hashes(d[fits], more) == other.hashes(i[fits], more)
        out[fits[same]] += step
    return out


def tile(doc: np.ndarray, item: np.ndarray, runs: Runs, width: int) -> list[tuple[int, int, int]]:
    """(place in document, place in item, words) of the tiles that greedy tiling marks, from the runs (places in both, words).

    The longest run comes first, of equals the earliest in the document, then in the item. Of the others stays what
    does not overlap it in either, if that has `width` words.
    """
    (d, i, n), out = runs, []
    while len(n):
        top = np.flatnonzero(n == n.max())
        best = top[np.lexsort((i[top], d[top]))[0]]
        at, to, size = int(d[best]), int(i[best]), int(n[best])
        if len(wrong := np.flatnonzero(doc[at : at + size] != item[to : to + size])):  # equal hashes of different words
            n[best] = wrong[0]
            d, i, n = (x[n >= width] for x in (d, i, n))
            continue
        out.append((at, to, size))
        a, b, e, f = (np.clip(x, 0, n) for x in (at - d, at + size - d, to - i, to + size - i))
        first, second = (np.minimum(a, e), np.where(e < a, f, b)), (np.maximum(a, e), np.where(e < a, b, f))
        left = [(np.zeros_like(n), first[0]), (first[1], second[0]), (np.maximum(first[1], second[1]), n)]
        start, end = (np.concatenate([x[k] for x in left]) for k in (0, 1))
        stay = end - start >= width
        d, i, n = np.tile(d, 3)[stay] + start[stay], np.tile(i, 3)[stay] + start[stay], (end - start)[stay]
    return out


class Benchmark:
    """The words and seeds of some items. An item of fewer words than a seed is matched as a whole, by a seed of its own length."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = MIN_MATCH) -> None:
        self.vocabulary: dict[str, int] = {}
        found = [(item_id, [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens(text)]) for item_id, text in items]
        found = [x for x in found if x[1]]
        self.item_ids, self.sizes = [x[0] for x in found], np.array([len(x[1]) for x in found], np.int64)
        self.flat = np.array([BORDER, *(w for _, ids in found for w in (*ids, BORDER))], np.int64)
        self.first = np.cumsum([1, *(self.sizes + 1)])[: len(found)]
        self.prefixes, self.base = Prefixes(self.flat), len(self.vocabulary) + 3
        self.seeds: dict[int, tuple[np.ndarray, ...]] = {}
        values, own = mixed(self.flat), np.minimum(self.sizes, width)
        for w in np.unique(own).tolist():
            places = np.concatenate([np.arange(a, a + n - w + 1) for a, n in zip(self.first[own == w].tolist(), self.sizes[own == w].tolist(), strict=True)])
            codes, rank = np.unique(rolling(values, w, places), return_inverse=True)
            keys = rank * self.base + self.flat[places - 1] + 2
            order = np.argsort(keys, kind="stable")
            self.seeds[w] = codes, keys[order], places[order], np.concatenate([[0], np.cumsum(np.bincount(rank))])

    def begun(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the document, places in `flat`) of the seeds of a width at which a match begins: the words before them differ."""
        codes, keys, places, firsts = self.seeds[width]
        none = np.zeros(0, np.int64)
        strange = np.concatenate([[0], np.cumsum(ids == STRANGE)])
        d = np.flatnonzero(strange[width:] == strange[:-width]) if len(ids) >= width else none
        hashed = rolling(mixed(ids), width, d)
        rank = np.minimum(np.searchsorted(codes, hashed), len(codes) - 1)
        same = codes[rank] == hashed
        d, rank = d[same], rank[same]
        if not len(d):
            return none, none
        before = np.where(d > 0, ids[d - 1] + 2, self.base - 1)
        low, high = firsts[rank], firsts[rank + 1]
        equal_low, equal_high = (np.searchsorted(keys, rank * self.base + before, side=s) for s in ("left", "right"))
        ahead = equal_low - low
        counts = ahead + high - equal_high
        k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row = np.repeat(np.arange(len(d)), counts)
        return d[row], places[np.where(k < ahead[row], low[row] + k, equal_high[row] + k - ahead[row])]

    def hits(self, text: str | None, coverage: float) -> list[tuple[int, float, int, int, int]]:
        """(item_id, coverage, tiles, words, longest) of the items that a text covers to `coverage` at least."""
        found = tokens(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(STRANGE)), np.int64, len(found))
        doc, out = None, []
        for width in self.seeds:
            d, i = self.begun(ids, width)
            if not len(d):
                continue
            doc = doc or Prefixes(ids)
            n = extended(doc, self.prefixes, d, i, width, int(self.sizes.max()))
            item = np.searchsorted(self.first, i, side="right") - 1
            reached = np.bincount(item, n, len(self.sizes)) >= coverage * self.sizes  # matches enough, were they all apart
            for k in np.unique(item[reached[item]]).tolist():
                own, at, size = item == k, int(self.first[k]), int(self.sizes[k])
                tiles = tile(ids, self.flat[at : at + size], (d[own], i[own] - at, n[own]), width)
                words = sum(t[2] for t in tiles)
                if tiles and words >= coverage * size:
                    out.append((self.item_ids[k], words / size, len(tiles), words, max(t[2] for t in tiles)))
        return sorted(out, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1:]))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("item_text")).where("item_text is not null").distinct()


def _pairs(items: DataFrame) -> str:
    return f"item_id {items.schema['item_id'].dataType.simpleString()}, coverage double, n_tiles long, n_words long, longest long"


def _small(items: DataFrame, block_bytes: int) -> list[tuple[int, str]] | None:
    """The items, if their texts have `block_bytes` together at most."""
    if (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) > block_bytes:
        return None
    return [tuple(row) for row in items.orderBy("item_id", "item_text").collect()]


def _rows(found: list[tuple], ids: pa.Array, item_kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 6
    kinds = (item_kind, pa.float64(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *arrays], ["doc_id", "item_id", "coverage", "n_tiles", "n_words", "longest"])


def seed_codes(rows: DataFrame, keys: list[str], text: str, widths: list[int] | int) -> DataFrame:
    """(keys, code, places, words): the different seeds of each text. One width: that or, if the text is shorter, its own; several: each."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo: dict[str, int] = {}
        for part in slices(batches, text):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
            for row, found in enumerate(map(tokens, part.column(text).to_pylist())):
                memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(found).difference(memo))
                values = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
                for w in widths if isinstance(widths, list) else [min(widths, len(found))]:
                    if 0 < w <= len(found):
                        code, places = np.unique(rolling(values, w) ^ np.uint64(w), return_counts=True)
                        out.append((np.full(len(code), row), code.view(np.int64), places, len(found)))
                if len(memo) > MEMO:
                    memo.clear()
            if out:
                row = pa.array(np.concatenate([o[0] for o in out]))
                sizes = np.repeat([o[3] for o in out], [len(o[0]) for o in out])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in keys), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out])), pa.array(sizes, pa.int64())], [*keys, "code", "places", "words"])

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, code long, places long, words long")


def _text_keys() -> list[Column]:
    """Two hashes of a text: equal texts are tiled once."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def joined_by_seeds(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """(_k1, _k2, and the columns of overlaps): the texts that cover an item, through a join on hashes of seeds.

    A text that covers an item to c words by tiles of w words at least has c / w of the item's seeds; pairs with
    fewer are left out before any text is fetched.
    """
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    own = cut(seed_codes(items, ["item_id"], "item_text", min_match))
    widths = sorted(r[0] for r in own.select(F.least("words", F.lit(min_match))).distinct().collect())  # min_match numbers at most
    texts = docs.select(*_text_keys(), F.col("text").cast("string").alias("text")).where("text is not null")
    met = seed_codes(texts, ["_k1", "_k2"], "text", [int(w) for w in widths]).select("_k1", "_k2", "code").distinct().join(own, "code")
    need = F.ceil(F.col("words") * F.lit(float(coverage)) / F.least("words", F.lit(min_match)))
    pairs = cut(met.groupBy("_k1", "_k2", "item_id", "words").agg(F.sum("places").alias("n")).where(F.col("n") >= need).select("_k1", "_k2", "item_id").distinct())
    asked = texts.join(pairs.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    both = pairs.join(asked, ["_k1", "_k2"]).alias("p").join(items.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id"))).select("_k1", "_k2", "p.item_id", "item_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            k1, k2 = part.column("_k1"), part.column("_k2")
            columns = zip(*(part.column(c).to_pylist() for c in ("item_id", "item_text", "text")), strict=True)
            found = [(row, *h) for row, (item_id, item, text) in enumerate(columns) for h in Benchmark([(item_id, item)], min_match).hits(text, coverage)]
            told = _rows(found, k1, item_kind)
            yield pa.RecordBatch.from_arrays([told.column(0), k2.take(pa.array([f[0] for f in found], pa.int64())), *told.columns[1:]], ["_k1", "_k2", *told.schema.names[1:]])

    return both.mapInArrow(run, f"_k1 long, _k2 long, {_pairs(items)}")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words, longest): the documents that cover an item to `coverage` at least.

    Null and empty texts, and items without a word, match nothing. Rows that repeat a doc_id give their pairs
    each; texts are read whole. Extra columns are ignored. Empty tables give no rows. The result is the same
    whether the benchmark is joined inside the scan or, beyond `block_bytes`, by its seeds.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    items = _items(benchmark)
    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    if (small := _small(items, block_bytes)) is None:
        own = docs.select("doc_id", *_text_keys())
        return own.join(joined_by_seeds(docs, items, min_match, coverage), ["_k1", "_k2"]).drop("_k1", "_k2")
    shared = spark.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(shared.value, min_match)
        for part in slices(batches):
            yield _rows([(n, *h) for n, t in enumerate(part.column("text").to_pylist()) for h in block.hits(t, coverage)], part.column("doc_id"), item_kind)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {_pairs(items)}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, that cover no item to `coverage`. Dropped in the scan, or beyond `block_bytes` by an anti join on hashes of texts."""
    spark, items = docs.sparkSession, _items(benchmark)
    if (small := _small(items, block_bytes)) is None:
        found = joined_by_seeds(docs, items, min_match, coverage).select("_k1", "_k2").distinct()
        return docs.withColumns(dict(zip(("_k1", "_k2"), _text_keys(), strict=True))).join(found, ["_k1", "_k2"], "left_anti").select(*docs.columns)
    shared = spark.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Benchmark(shared.value, min_match)
        for part in slices(batches):
            yield part.filter(pa.array([not block.hits(t, coverage) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
