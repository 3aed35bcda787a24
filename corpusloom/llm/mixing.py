"""Mixing sources to target weights (operator 4) by Efraimidis-Spirakis sampling.

Each document draws an exponential key from a digest of its id, divided by its quality weight. A source whose
target is k times its size and a bit gives k complete epochs, then the documents of least keys until the rest
of the target is filled. The running sum over the sorted keys is taken in two steps, so that no task sorts a
whole source: documents are dealt to ranges of keys, the sums of the ranges are added up, and only inside a
range are keys sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, row_key, words

WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2.0
#: Documents that a range of keys holds on average, and the least number of ranges.
RANGE_ROWS, MIN_RANGES = 20_000, 1024
#: Bounds of a document's quality weight.
LOW, HIGH = 0.25, 1.0


def quality(text: str | Column = "text") -> Column:
    """A document's sampling weight: the share of its \\n-split lines that are distinct, within LOW and HIGH. Null, empty: HIGH."""
    lines = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n")
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.size(F.array_distinct(lines)) / F.size(lines)))


def draw(doc_id: Column, weight: Column, text: Column) -> Column:
    """The exponential key of a document: least keys come first, at rates in proportion to the weights; reruns agree. Documents without an id draw by their text."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(uniform) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    Sources by code point, null last, take the weights in turn. They share `share` times all sizes by weight,
    none beyond `max_epochs` times its own size; what that leaves is shared among the others by weight. The
    fixed point is target = min(cap, level * weight); sources in order of cap / weight give the level: those
    before it are at their caps. One row per source goes through one task, never a row per document.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    own = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = own.select("*", (F.sum("source_size").over(whole) * F.lit(float(share))).alias("all"), F.sum("weight").over(whole).alias("weight_all"), F.coalesce(F.sum("cap").over(up), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("weight").over(up), F.lit(0.0)).alias("weight_before"))
    level = (F.col("all") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    leveled = told.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    level = F.max("level").over(whole)  # it grows while the sources are at their caps, and is the level at the first that is not
    return leveled.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def _mix(docs: DataFrame, row: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """What `mix` returns, and `row`."""
    keyed = docs.select(row.alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), F.size(words("text")).cast("long").alias("size"), draw(F.col("doc_id"), quality("text"), F.col("text")).alias("key"))
    ranges = max(MIN_RANGES, docs.select("source").count() // RANGE_ROWS)
    keyed = keyed.withColumn("range", F.floor((1 - F.exp(-F.col("key") * F.lit(LOW))) * ranges).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_source = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_before"))
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    placed = sums.alias("r").join(by_source.alias("s"), same("r", "s", "source")).select("r.*", "source_size", "target")
    ahead = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("inside", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    joined = inside.alias("d").join(placed.alias("p"), same("d", "p", "source", "range")).select("d.*", "range_before", "source_size", "target")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    rest = F.floor(F.col("target")) - epochs * F.col("source_size") - F.col("range_before") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("row", "doc_id", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), taken.cast("long").alias("taken"), epochs.cast("long").alias("epochs"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs) for every row of `docs`.

    `taken` sums to each source's target, rounded down to a word: the last document taken gives its leading
    words only. A null or blank text has size 0 and takes 0; a null source is a source. Rows that repeat a
    doc_id share its key and are taken in some order, which shows only where the budget ends between them. An
    empty table gives no rows. Extra columns are ignored.
    """
    return _mix(docs, F.lit(0), weights, share, max_epochs).drop("row")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of `docs` with size, source_size, target, taken and epochs, named so even where `docs` has such columns.

    Rows are told apart by all their columns, so null and repeated doc_ids are rows of their own; of rows that are
    equal in all columns each has what one of them takes, and each source's taken words come to its target.
    """
    added = ("size", "source_size", "target", "taken", "epochs")
    own = [c for c in docs.columns if c not in added]
    told = _mix(docs, row_key(own), weights, share, max_epochs).select(F.col("row").alias("_row"), *added)
    rows = docs.select(*own, row_key(own).alias("_row")).dropDuplicates(["_row"])
    return told.join(rows, "_row").select(*own, *added)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         greatest(0.25, least(1.0, length(list_distinct(string_split(coalesce(text, ''), chr(10)))) / length(string_split(coalesce(text, ''), chr(10))))) AS quality,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / quality::DOUBLE AS key FROM d),
o AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT a.source, a.weight, a.cap,
        (SELECT 1.5::DOUBLE * sum(source_size) - coalesce(sum(cap) FILTER (WHERE cap / weight < a.cap / a.weight), 0) FROM w)
        / (SELECT coalesce(sum(weight) FILTER (WHERE cap / weight >= a.cap / a.weight), 0) FROM w) AS level FROM w a),
t AS (SELECT w.source, w.source_size, least(w.cap, w.weight * (SELECT max(level) FROM l WHERE l.cap >= l.level * l.weight)) AS target FROM w),
e AS (SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs FROM t)
SELECT o.doc_id, o.size::BIGINT AS size, e.source_size::BIGINT AS source_size, e.target::DOUBLE AS target,
       (e.epochs * o.size + greatest(0, least(o.size, floor(e.target) - e.epochs * e.source_size - o.before)))::BIGINT AS taken
FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
"""
