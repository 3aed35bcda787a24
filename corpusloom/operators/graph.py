"""Concept graph: similar pairs, clusters, groups, relationships, contradictions and thinly supported concepts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import dot, slug
from corpusloom.operators.components import connected_components
from corpusloom.operators.ranking import numbered
from corpusloom.sources.tables import cut

#: Relations that contradict each other.
OPPOSED = (("REDUCES", "HURTS"), ("REDUCES", "INTRODUCES"), ("SOLVES", "FAILS_UNDER"))
#: Items of a key up to which all are compared with all, in one task.
EXACT = 2048
#: Vectors of a tile of larger keys, and tiles whose middles are compared at a time.
TILE, GROUP = 1024, 512
#: Items of a bucket on average, and the probability with which a pair at the threshold may be missed in a hashed key.
BUCKET, MISSED = 64, 0.002


def classes(items: DataFrame, key: str = "key") -> DataFrame:
    """(id, representative): the least id of the items of one key that have the same vector."""
    told = items.select("id", F.col(key).alias("_key"), "vector")
    first = told.groupBy("_key", "vector").agg(F.min("id").alias("representative"))
    same = [told["_key"].eqNullSafe(first["_key"]), told["vector"] == first["vector"]]
    return told.join(first, same).select("id", "representative")


def hashing(size: int, threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """(bits, bands) for a key of so many items: bits so that a bucket stays small, bands so that no more than `missed` of the pairs at the threshold are lost."""
    bits = max(4, math.ceil(math.log2(max(2, size / BUCKET))))
    agree = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(missed) / math.log1p(-min(agree, 1 - 1e-12))))


def _near(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[list, list, list]:
    """(a, b, similarity) of the pairs of two sets of vectors that reach the threshold, the smaller id first; of one set with itself each pair once."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(ids_a), 512):
        near = a[at : at + 512] @ b.T
        rows, columns = np.nonzero(near >= threshold)
        for r, c, s in zip((at + rows).tolist(), columns.tolist(), near[rows, columns].tolist(), strict=True):
            x, y = ids_a[r], ids_b[c]
            if x < y or (x > y and not same):
                out[0].append(min(x, y))
                out[1].append(max(x, y))
                out[2].append(s)
    return out


def similar_pairs(items: DataFrame, threshold: float, key: str = "key", exact: int = EXACT, missed: float | None = None) -> DataFrame:
    """(a, b, similarity) of items (id, key, vector of unit length) of one key whose cosine is `threshold` at least, a < b.

    Of items with the same vector the least id stands for all (`classes` tells which). Keys of up to `exact`
    different vectors are compared in one piece, larger ones tile by tile (`tiled_pairs`): all pairs are found. With
    `missed` larger keys are hashed instead (`hashed_pairs`), where a pair at the threshold is missed with that
    probability: for very large keys and high thresholds, whose tiles would be too many.
    """
    own = cut(items.select("id", F.col(key).alias("key"), "vector").groupBy("key", "vector").agg(F.min("id").alias("id")).select("id", "key", "vector"))
    sizes = cut(own.groupBy("key").agg(F.count("*").alias("n")))
    kind = own.schema["id"].dataType.simpleString()

    def compared(group):
        import pandas as pd

        ids, vectors = np.array(group["id"].tolist(), object), np.array(group["vector"].tolist(), float)
        return pd.DataFrame(dict(zip(("a", "b", "similarity"), _near(ids, vectors, ids, vectors, threshold, True), strict=True)))

    of = lambda where: own.join(sizes.where(where), own["key"].eqNullSafe(sizes["key"])).select("id", own["key"], "vector", "n")
    few = of(F.col("n") <= exact).drop("n").groupBy("key").applyInPandas(compared, f"a {kind}, b {kind}, similarity double")
    if sizes.where(F.col("n") > exact).isEmpty():
        return few
    many = of(F.col("n") > exact)
    return few.unionByName(tiled_pairs(many, threshold) if missed is None else hashed_pairs(many, threshold, missed))


def tiled_pairs(items: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, similarity) of the pairs of one key (id, key, vector) that reach the threshold: all of them, for keys of any size.

    The vectors of a key are put in an order in which neighbours are alike (signs of projections) and cut into tiles.
    A tile is a matrix with its middle and its widest angle from there; two tiles whose middles are farther apart than
    their angles and the threshold's together can't have a pair and never meet. The others are multiplied, a pair of
    tiles a row. Where nothing is alike, all tiles of a key meet: n vectors make (n / tile)^2 / 2 products, spread
    over all tasks, and each tile moves as often as it is needed.
    """
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    planes = np.random.default_rng(7).standard_normal((12, len(items.select("vector").first()[0])))

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            code = (vectors @ planes.T > 0) @ (1 << np.arange(len(planes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "vector")), pa.array(code)], ["id", "key", "vector", "code"])

    def packed(group):
        import pandas as pd

        vectors = np.array(group["vector"].tolist(), float)
        middle = vectors.mean(axis=0)
        middle = middle / (np.linalg.norm(middle) or 1.0)
        width = float(np.arccos(np.clip((vectors @ middle).min(), -1, 1)))
        return pd.DataFrame({"key": group["key"].iloc[:1].tolist(), "tile": [int(group["tile"].iloc[0])], "ids": [group["id"].tolist()], "matrix": [vectors.tobytes()], "middle": [middle.tolist()], "width": [width]})

    def apart(batches):
        """Pairs of tiles, of two groups of tiles, that may hold a pair."""
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                (ti, mi, wi), (tj, mj, wj) = ([np.array([t[c] for t in row[side]]) for c in ("tile", "middle", "width")] for side in ("left", "right"))
                angle = np.arccos(np.clip(mi @ mj.T, -1, 1)) - wi[:, None] - wj[None, :]
                i, j = np.nonzero((angle <= math.acos(min(1.0, max(-1.0, threshold))) + 1e-9) & (ti[:, None] <= tj[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(i), batch.schema.field("key").type), pa.array(ti[i], pa.int64()), pa.array(tj[j], pa.int64())], ["key", "i", "j"])

    def multiplied(batches):
        import pyarrow as pa

        kind = None
        for batch in batches:
            kind = batch.schema.field("ids_i").type.value_type
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[f"matrix_{s}"]).reshape(len(row[f"ids_{s}"]), -1) for s in "ij")
                found = _near(np.array(row["ids_i"], object), a, np.array(row["ids_j"], object), b, threshold, row["i"] == row["j"])
                yield pa.RecordBatch.from_arrays([pa.array(found[0], kind), pa.array(found[1], kind), pa.array(found[2], pa.float64())], ["a", "b", "similarity"])

    placed = numbered(items.select("id", "key", "vector").mapInArrow(coded, f"id {kinds['id']}, key {kinds['key']}, vector {kinds['vector']}, code long"), ["key"], ["code", "id"])
    tiles = placed.withColumn("tile", F.floor((F.col("number") - 1) / tile)).groupBy("key", "tile").applyInPandas(packed, f"key {kinds['key']}, tile long, ids array<{kinds['id']}>, matrix binary, middle array<double>, width double")
    tiles = cut(tiles)
    grouped = tiles.groupBy("key", F.floor(F.col("tile") / GROUP).alias("group")).agg(F.collect_list(F.struct("tile", "middle", "width")).alias("tiles"))
    left, right = (grouped.select("key", F.col("group").alias(f"g{k}"), F.col("tiles").alias(side)) for k, side in enumerate(("left", "right")))
    met = cut(left.join(right, left["key"].eqNullSafe(right["key"]) & (left["g0"] <= right["g1"])).select(left["key"], "left", "right").mapInArrow(apart, f"key {kinds['key']}, i long, j long"))
    side = lambda s: tiles.select(F.col("key").alias(f"_key_{s}"), F.col("tile").alias(f"_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("matrix").alias(f"matrix_{s}"))
    own = lambda s: F.col("key").eqNullSafe(F.col(f"_key_{s}")) & (F.col(s) == F.col(f"_{s}"))
    both = met.join(side("i"), own("i")).join(side("j"), own("j")).select("i", "j", "ids_i", "matrix_i", "ids_j", "matrix_j")
    return both.mapInArrow(multiplied, f"a {kinds['id']}, b {kinds['id']}, similarity double")


def hashed_pairs(many: DataFrame, threshold: float, missed: float = MISSED) -> DataFrame:
    """(a, b, similarity) of pairs of one key (id, key, vector, n: size of the key) that share the signs of random projections in a band, verified exactly.

    Bits and bands follow each key's own size, so that buckets stay small and a pair at the threshold is missed with
    probability `missed` at most, one farther above it less. At a cosine of 0.8 a key of 10^6 vectors takes some 150
    rows for each, at 0.4 some 3,900: low thresholds are for `tiled_pairs`.
    """
    kinds = {f.name: f.dataType.simpleString() for f in many.schema}
    largest = hashing(many.agg(F.max("n")).first()[0], threshold, missed)
    planes = np.random.default_rng(7).standard_normal((largest[0] * largest[1], len(many.select("vector").first()[0])))

    def signed(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("n").to_numpy()
            for size in np.unique(sizes).tolist():
                bits, bands = hashing(size, threshold, missed)
                own = np.flatnonzero(sizes == size)
                for at in range(0, len(own), 1024):
                    part = batch.take(pa.array(own[at : at + 1024]))
                    vectors = np.array(part.column("vector").to_pylist(), float)
                    signs = (vectors @ planes[: bands * bits].T > 0).reshape(len(vectors), bands, bits)
                    codes = signs @ (1 << np.arange(bits)) + (np.arange(bands) << bits)
                    rows = pa.array(np.repeat(np.arange(len(vectors)), bands))
                    yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("key").take(rows), pa.array(codes.ravel())], ["id", "key", "band"])

    bucketed = many.mapInArrow(signed, f"id {kinds['id']}, key {kinds['key']}, band long")
    left, right = bucketed.withColumnRenamed("id", "a"), bucketed.withColumnRenamed("id", "b")
    met = left.join(right, (left["band"] == right["band"]) & left["key"].eqNullSafe(right["key"])).where("a < b").select("a", "b").distinct()
    va, vb = many.select(F.col("id").alias("a"), F.col("vector").alias("va")), many.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    scored = met.join(va, "a").join(vb, "b").select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def clusters(items: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of every item: single linkage over the pairs, the cluster named by its least id. `members` are the classes whose representatives the pairs have."""
    linked = connected_components(pairs, "a", "b")
    own = members if members is not None else items.select("id", F.col("id").alias("representative"))
    return own.join(linked.withColumnRenamed("node", "representative"), "representative", "left").select("id", F.coalesce("component", "representative").alias("cluster"))


def aggregated_statements(statements: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, kind, statement, n_papers, n_statements) of statements (id, kind, text, paper_id) and their clusters.

    The shortest text speaks for its cluster, of equals the first by id. The papers behind it stay rows: join
    `members` for them.
    """
    told = statements.join(members, "id")
    best = F.min(F.struct(F.length("text").alias("n"), "id", "text", "kind")).alias("best")
    grouped = told.groupBy("cluster").agg(best, F.countDistinct("paper_id").alias("n_papers"), F.count("*").alias("n_statements"))
    return grouped.select("cluster", "best.kind", F.col("best.text").alias("statement"), "n_papers", "n_statements")


def canonical_labels(members: DataFrame) -> DataFrame:
    """(cluster, label, concept_id): the shortest label of each cluster, of equals the first by position, and its slug."""
    best = members.groupBy("cluster").agg(F.min(F.struct(F.length("label").alias("n"), "pos", "label")).alias("best"))
    return best.select("cluster", "best.label", slug(F.col("best.label")).alias("concept_id"))


def concept_groups(mentions: DataFrame) -> DataFrame:
    """(concept, n_papers, papers): each concept with its sorted distinct papers."""
    return mentions.groupBy("concept").agg(F.countDistinct("paper_id").alias("n_papers"), F.array_sort(F.collect_set("paper_id")).alias("papers"))


def relationships(triples: DataFrame) -> DataFrame:
    """(source, relation, target, support): distinct papers of each triple. Pre-aggregated before the shuffle."""
    return triples.select("source", "relation", "target", "paper_id").distinct().groupBy("source", "relation", "target").agg(F.count("*").alias("support"))


def contradictions(found: DataFrame, opposed: tuple = OPPOSED) -> DataFrame:
    """(source, target, relation_a, relation_b, support_a, support_b) of opposed relations between the same concepts, a < b by name.

    A relation named CONTRADICTS opposes any other.
    """
    spark = found.sparkSession
    both = sorted({tuple(sorted(p)) for p in opposed})
    table = spark.createDataFrame(both, "relation_a string, relation_b string")
    left = found.select("source", "target", F.col("relation").alias("relation_a"), F.col("support").alias("support_a"))
    right = found.select("source", "target", F.col("relation").alias("relation_b"), F.col("support").alias("support_b"))
    pairs = left.join(right, ["source", "target"]).where("relation_a < relation_b")
    told = pairs.join(F.broadcast(table.withColumn("opposed", F.lit(True))), ["relation_a", "relation_b"], "left")
    return told.where("opposed or relation_a = 'CONTRADICTS' or relation_b = 'CONTRADICTS'").select("source", "target", "relation_a", "relation_b", "support_a", "support_b")


def relationship_evidence(triples: DataFrame, matches: DataFrame) -> DataFrame:
    """(source, relation, target, paper_id, record_id, page): the records, and the pages they name, that a paper's triple rests on.

    `triples` carry quote_id, `matches` (quote_id, record_id, pages). Rows, not lists: a relation may rest on any number of records.
    """
    told = triples.join(matches, "quote_id").select("source", "relation", "target", "paper_id", "record_id", F.explode_outer("pages").alias("page"))
    return told.distinct()


def sparse_concepts(mentions: DataFrame, found: DataFrame, min_support: int = 2) -> DataFrame:
    """(concept, n_mentions, best_support) of the concepts that few papers mention and none of whose relations has many.

    Few and many are below and from `min_support`. `mentions` are (concept, paper_id); the ends of relations count
    as mentions when they are among them. A concept without relations has 0.
    """
    counted = mentions.groupBy("concept").agg(F.countDistinct("paper_id").alias("n_mentions"))
    ends = found.select(F.explode(F.array("source", "target")).alias("concept"), "support")
    best = ends.groupBy("concept").agg(F.max("support").alias("best_support"))
    told = counted.join(best, "concept", "left").select("concept", "n_mentions", F.coalesce("best_support", F.lit(0)).cast("long").alias("best_support"))
    return told.where((F.col("n_mentions") < min_support) & (F.col("best_support") < min_support))


def resolved_facets(mentions: DataFrame, fallback: str) -> DataFrame:
    """(concept, facet): the first facet that a concept was mentioned with, by paper and position."""
    first = mentions.groupBy("concept").agg(F.min_by("facet", F.struct("paper_id", "pos")).alias("facet"))
    return first.select("concept", F.coalesce("facet", F.lit(fallback)).alias("facet"))


#: Quotes of fewer than three words that go to every task at a time, and seeds of longer ones that do so at most; more seeds are joined by a shuffle.
MAX_SHORT, MAX_SEEDS = 1000, 100_000


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")


def _seeds(found: Column, width: int) -> Column:
    """The distinct hashes of the runs of `width` words."""
    hashed = F.transform(found, lambda w, i: F.xxhash64(F.lit(width), w, *(F.get(found, i + k) for k in range(1, width))))
    return F.array_distinct(F.slice(hashed, 1, F.greatest(F.lit(0), F.size(found) - (width - 1))))


def quote_matches(quotes: DataFrame, texts: DataFrame, seed_words: int = 5) -> DataFrame:
    """(quote_id, text_id) of texts that contain a quote literally, case aside.

    The inner words of a quote stand whole in any text that contains it: the hash of the second and up to four more
    is the key of an equi-join, and the text is searched only where it meets. The texts are read once for quotes of
    all widths. Quotes of one or two words have no inner words and are searched for in every text, MAX_SHORT at a time.
    """
    parsed = quotes.select("quote_id", F.lower("quote").alias("quote"), _words(F.col("quote")).alias("w")).where("quote <> ''").withColumn("width", F.least(F.lit(seed_words), F.size("w") - 2))
    own = texts.select("text_id", F.lower("text").alias("text"), _words(F.col("text")).alias("w"))
    widths = [r[0] for r in parsed.where("width > 0").select("width").distinct().orderBy("width").collect()]  # seed_words numbers at most
    short = parsed.where("width <= 0").select("quote_id", "quote")
    turns = math.ceil(short.count() / MAX_SHORT)
    found = []
    for turn in range(turns):
        part = short.where(F.pmod(F.xxhash64("quote_id", "quote"), F.lit(turns)) == turn)
        found.append(own.join(F.broadcast(part), F.contains("text", F.col("quote"))).select("quote_id", "text_id"))
    if widths:
        hashed = [F.when(F.col("width") == width, F.xxhash64(F.lit(width), *(F.get("w", F.lit(1 + k)) for k in range(width)))) for width in widths]
        seeds = cut(parsed.where("width > 0").select("quote_id", "quote", F.coalesce(*hashed).alias("seed")))
        asked = seeds.select("seed").distinct()
        asked = F.broadcast(asked) if asked.count() <= MAX_SEEDS else asked
        held = own.select("text_id", F.explode(F.flatten(F.array(*(_seeds(F.col("w"), width) for width in widths)))).alias("seed")).join(asked, "seed")
        met = held.join(seeds, "seed").select("quote_id", "quote", "text_id").distinct()
        found.append(met.join(own.select("text_id", "text"), "text_id").where(F.contains("text", F.col("quote"))).select("quote_id", "text_id"))
    if not found:
        return parsed.join(own, F.lit(False)).select("quote_id", "text_id")
    return reduce(DataFrame.unionByName, found).distinct()


def resolved_quotes(quotes: DataFrame, records: DataFrame) -> DataFrame:
    """(quote_id, record_id, pages) of quotes (quote_id, paper_id, quote) and records (record_id, paper_id, text, pages) of the same paper, one of which contains the other, case aside.

    Empty texts match nothing. The join is by paper; containment is its condition.
    """
    folded = lambda c: F.replace(F.lower(F.trim(c)), F.lit("ß"), F.lit("ss"))
    a = quotes.select("quote_id", "paper_id", folded(F.col("quote")).alias("_quote")).where("_quote <> ''")
    b = records.select("record_id", F.col("paper_id").alias("_paper"), "pages", folded(F.col("text")).alias("_text")).where("_text <> ''")
    met = (F.col("paper_id") == F.col("_paper")) & (F.contains("_text", F.col("_quote")) | F.contains("_quote", F.col("_text")))
    return a.join(b, met).select("quote_id", "record_id", "pages")


def stable_id(kind: str, *parts: Column) -> Column:
    """The kind and 24 hexadecimal digits of its parts, as one JSON array of strings."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, 24))


def landscape_violations(papers: DataFrame, groups: DataFrame, found: DataFrame, support: DataFrame, opposed: DataFrame, sparse: DataFrame) -> DataFrame:
    """(rule, key, detail) of what does not hold together in a landscape.

    papers (paper_id), groups (concept, n_papers), relations `found` (source, relation, target, support) with their
    papers `support` (source, relation, target, paper_id), contradictions `opposed`, `sparse` (concept, n_mentions, best_support).
    """
    from corpusloom.operators import gates

    ends = found.select(F.explode(F.array("source", "target")).alias("concept"), "support")
    counted = support.groupBy("source", "relation", "target").agg(F.countDistinct("paper_id").alias("_n"))
    told = found.join(counted, ["source", "relation", "target"], "left")
    sides = opposed.select("source", "target", F.explode(F.array(F.struct(F.col("relation_a").alias("relation"), F.col("support_a").alias("support")), F.struct(F.col("relation_b").alias("relation"), F.col("support_b").alias("support")))).alias("s")).select("source", "target", "s.*")
    unmatched = sides.join(found, ["source", "relation", "target", "support"], "left_anti")
    best = ends.groupBy("concept").agg(F.max("support").alias("_best"))
    checked = sparse.join(groups.select("concept", "n_papers"), "concept", "left").join(best, "concept", "left")
    wrong = ~F.col("n_mentions").eqNullSafe(F.col("n_papers")) | (F.col("best_support") != F.coalesce("_best", F.lit(0)))
    key = F.concat_ws("|", "source", "relation", "target")
    return gates.gate(
        gates.repeated(papers, ["paper_id"], "duplicate_paper"),
        gates.repeated(groups, ["concept"], "duplicate_concept"),
        gates.dangling(ends, "concept", groups, "concept", "unknown_concept"),
        gates.dangling(support, "paper_id", papers, "paper_id", "unknown_paper"),
        gates.repeated(found, ["source", "relation", "target"], "duplicate_relation"),
        gates.violations(told, "support_count", ~F.col("support").eqNullSafe(F.coalesce("_n", F.lit(0))), key),
        gates.violations(unmatched, "contradiction_side", F.lit(True), key),
        gates.violations(checked, "sparse_counts", wrong, F.col("concept")),
    )
