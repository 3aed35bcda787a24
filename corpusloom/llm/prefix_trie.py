"""Trie of conversation prefixes (operator 12) by union-find over the common prefixes of sorted neighbours.

A conversation is the path of its turns' digests. Paths are sorted over ranges of (path, conv_id), and
neighbours share a prefix of so many turns: an edge of that depth. Edges are taken in descending depth; a
component of neighbours climbs to the depth of the edge, leaving a node at each depth that it passes, and a
merge of components is a branching node. Nodes that no neighbour outside can share are done. Those on the
first and the last path of a block are not: the block is contracted to these two paths with what hangs on
each of their nodes, and contracted blocks are merged as if they were conversations, first within a
partition, then partitions by FAN at a time, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import cut, table

#: Bytes of a turn's digest (MD5), conversations and bytes of paths of a block, contracted blocks merged at a time.
WIDTH, BLOCK, BLOCK_BYTES, FAN = 16, 1024, 16 << 20, 64
#: A conversation is rebuilt from up to HEADS - 1 turns of the first conversation of its FAMILY ids.
FAMILY, HEADS = 100, 6
NONE = hashlib.sha256(b"").hexdigest()
NODE, SPINE, ENDS = 0, 1, 2
SCHEMA = """kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string,
key binary, parent_key binary, forest long, side int, path binary, sizes array<long>, own array<long>, first long, ids string"""
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ARROW = pa.schema([("kind", pa.int32()), *((c, pa.string() if c == "ends_sha256" else pa.int64()) for c in COLUMNS), ("key", pa.binary()), ("parent_key", pa.binary()), ("forest", pa.int64()), ("side", pa.int32()), ("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("first", pa.int64()), ("ids", pa.string())])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation's turns in order, as their digests end to end and their texts' code points.

    Turns are ordered by turn, null first; equal turns by the digest of (role, text). A null role or text is empty.
    Rows without a conv_id belong to no conversation. A conversation's digests, 16 bytes a turn, make one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.isnotnull("turn").alias("given"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("turn"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): conversations that begin with the first h turns of the first conversation of their family, h = crc32(conv_id) % 6, instead of their own."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.max(F.when(F.col("conv_id") == family, F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy(family))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    given = paths(conversations).withColumn("head", head).withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    turns = F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h")), own)
    return given.select("conv_id", turns.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


@dataclass(slots=True)
class Part:
    """What is known of a node: conversations at and below it, the smallest, finished children, leaves and savings below, ids that end here, rows that wait for its smallest member."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)

    def take(self, other: Part) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends += other.ends
        self.waiting += other.waiting


@dataclass(slots=True)
class Item:
    """A path with what hangs on its nodes, by depth: a conversation, or a side of a contracted block."""

    path: bytes
    sizes: list[int]
    own: dict[int, Part]

    @property
    def depth(self) -> int:
        return len(self.path) // WIDTH


def conversation(conv_id: int, path: bytes, sizes: list[int]) -> Item:
    return Item(path, sizes, {len(path) // WIDTH: Part(1, conv_id, ends=[conv_id])})


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    if a[: len(b)] == b or b[: len(a)] == a:
        return min(len(a), len(b)) // WIDTH
    low, high = 0, min(len(a), len(b)) // WIDTH  # shared at low, not at high + 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


def key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: depth * WIDTH]).digest()


def merged(items: list[Item], last: bool = False, raw: bool = False) -> tuple[list[dict], list[Item]]:
    """Rows that are done, and the contracted block: its first and its last path, one item if they are equal.

    `items` are in the order of their paths. `last`: there is nothing beyond them, so all nodes are done. `raw`: they
    are conversations, so a node that is done has all its ends; else the ends are in rows of their own, under its key.
    """
    rows: list[dict] = []
    up = list(range(len(items)))
    at = [x.depth for x in items]
    rest = [dict(x.own) for x in items]
    part = [own.pop(d, None) or Part() for own, d in zip(rest, at, strict=True)]
    first, final = [not last and k == 0 for k in range(len(items))], [not last and k == len(items) - 1 for k in range(len(items))]
    kept: tuple[dict[int, Part], dict[int, Part]] = {}, {}

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def keep(c: int) -> None:
        """The node may be shared with a neighbour outside: what hangs on it stays with the path."""
        held, depth = part[c], at[c]
        if not held.n:
            return
        if held.ends or held.waiting:
            own_key = key(items[c].path, depth)
            for row in held.waiting:
                row["parent_key"] = own_key
            if held.ends:
                rows.append({"kind": ENDS, "key": own_key, "first": held.ends[0], "ids": ",".join(map(str, held.ends))})
            held.waiting, held.ends = [], []
        kept[0 if first[c] else 1][depth] = held

    def finish(c: int) -> dict:
        done, depth, item = part[c], at[c], items[c]
        done.leaves = done.leaves if done.children else 1
        done.saved += (done.n - 1) * item.sizes[depth - 1] if depth else 0
        row = {"kind": NODE, "conv_id": done.least, "depth": depth, "n_convs": done.n, "n_children": done.children, "n_leaves": done.leaves, "saved_tokens": done.saved}
        if raw:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, done.ends)).encode()).hexdigest() if done.ends else NONE
        else:
            row["key"] = key(item.path, depth)
        for child in done.waiting:
            child["parent_conv_id"] = done.least
        rows.append(row)
        return row

    def climb(c: int, depth: int) -> None:
        while at[c] > depth:
            above = rest[c].pop(at[c] - 1, None) or Part()
            if first[c] or final[c]:
                keep(c)
            else:
                row, done = finish(c), part[c]
                above.take(Part(done.n, done.least, 1, done.leaves, done.saved, [], [row]))
            part[c] = above
            at[c] -= 1

    edges = sorted(((-common(a.path, b.path), k) for k, (a, b) in enumerate(zip(items, items[1:]))))
    for depth, k in edges:
        a, b = find(k), find(k + 1)
        climb(a, -depth)
        climb(b, -depth)
        part[a].take(part[b])
        first[a], final[a] = first[a] or first[b], final[a] or final[b]
        small, large = sorted((rest[a], rest[b]), key=len)
        for d, held in small.items():
            if d in large:
                large[d].take(held)
            else:
                large[d] = held
        rest[a], up[b] = large, a
    root = find(0)
    climb(root, 0)
    if last:
        finish(root)
        return rows, []
    keep(root)
    sides = [Item(items[0].path, items[0].sizes, kept[0])]
    if items[-1].path != items[0].path:
        sides.append(Item(items[-1].path, items[-1].sizes, kept[1]))
    return rows, sides


def _spine(forest: int, side: int, item: Item) -> dict:
    own = [x for d, p in sorted(item.own.items()) for x in (d, p.n, p.least, p.children, p.leaves, p.saved)]
    return {"kind": SPINE, "forest": forest, "side": side, "path": item.path, "sizes": item.sizes, "own": own}


def _item(row: dict) -> Item:
    own = row["own"]
    return Item(row["path"], row["sizes"], {own[k]: Part(*own[k + 1 : k + 6]) for k in range(0, len(own), 6)})


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def _of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's sorted conversations: blocks, then contracted blocks, then one contracted forest."""
    block, size, contracted, forest = [], 0, [], TaskContext.get().partitionId()

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal block, size, contracted
        rows, sides = merged(block, raw=True)
        contracted += sides
        block, size = [], 0
        yield _table(rows)
        if len(contracted) >= 2 * FAN:
            yield contract()

    def contract() -> pa.RecordBatch:
        nonlocal contracted
        rows, contracted = merged(contracted)
        return _table(rows)

    for row in (r for batch in batches for at in range(0, batch.num_rows, BLOCK) for r in batch.slice(at, BLOCK).to_pylist()):
        block.append(conversation(row["conv_id"], row["path"], row["sizes"]))
        size += len(row["path"]) + 1
        if len(block) >= BLOCK or size >= BLOCK_BYTES:
            yield from close()
    if block:
        yield from close()
    if contracted:
        yield contract()
        yield _table([_spine(forest, side, item) for side, item in enumerate(contracted)])


def _of_group(last: bool):
    def run(group: pa.Table) -> pa.Table:
        found = sorted(group.to_pylist(), key=lambda r: (r["forest"], r["side"]))
        rows, sides = merged([_item(r) for r in found], last)
        rows += [_spine(found[0]["forest"] // FAN, side, item) for side, item in enumerate(sides)]
        return pa.Table.from_pylist(rows, schema=ARROW)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's ids, which come in order, a piece at a time."""
    now, digest = None, None
    for batch in batches:
        done = []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own == now:
                digest.update(b",")
            else:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = own, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["own_key", "digest"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["own_key", "digest"])


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path, sizes), a conv_id once: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    An empty table has no nodes, not even a root. The ids that end at a node are digested in the order of the sort,
    in pieces of a block, so a node that many conversations end at is no group in memory.
    """
    rows = cut(rows.select("conv_id", "path", "sizes"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(rows.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_of_partition, SCHEMA))
    pieces = found.where(F.col("kind") == ENDS).select("key", "first", "ids")
    nodes, spines = [found.where(F.col("kind") == NODE)], found.where(F.col("kind") == SPINE)
    most = spines.agg(F.max("forest").alias("forest")).first()["forest"]
    while most is not None:
        group = F.floor(F.col("forest") / FAN).alias("group")
        found = cut(spines.groupBy(group).applyInArrow(_of_group(most < FAN), SCHEMA))
        nodes.append(found.where(F.col("kind") == NODE))
        spines = found.where(F.col("kind") == SPINE)
        most = None if most < FAN else most // FAN
    every = nodes[0]
    for more in nodes[1:]:
        every = every.union(more)
    known = every.where("key is null").select(*COLUMNS, "parent_key")
    digests = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "own_key binary, digest string")
    late = every.where("key is not null").join(digests, F.col("key") == F.col("own_key"), "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(NONE)))
    late = cut(late.select(*COLUMNS, "key", "parent_key"))
    both = known.union(late.select(*COLUMNS, "parent_key"))
    parents = late.select(F.col("key").alias("own_key"), F.col("conv_id").alias("own_parent"))
    waiting = both.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("own_key"), "left").withColumn("parent_conv_id", F.col("own_parent"))
    return both.where("parent_key is null").select(*COLUMNS).union(waiting.select(*COLUMNS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = """
WITH lookup AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), given AS (
  SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest, length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'digest': digest, 'size': size} ORDER BY turn NULLS FIRST, digest) AS turns FROM given GROUP BY conv_id
), headed AS (
  SELECT c.conv_id, c.turns, b.turns AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c.conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100, lookup
), rebuilt AS (SELECT conv_id, list_concat(coalesce(head[1:h], []), turns[h + 1:]) AS turns FROM headed),
prefixes AS (
  SELECT conv_id, d, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.digest), '') AS key, CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY key, d
), children AS (SELECT left(key, 32 * (d - 1)) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (key)),
spread AS (SELECT left(key, 32 * up) AS key, (n_convs - 1) * size AS saved, n_children = 0 AS leaf FROM (SELECT *, unnest(range(d + 1)) AS up FROM full_nodes)),
summed AS (SELECT key, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM spread GROUP BY key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN summed s USING (key) LEFT JOIN nodes p ON n.d > 0 AND p.key = left(n.key, 32 * (n.d - 1))
"""
