"""Nested rows: references under short aliases and back again, values of any depth, and stored projections held against recomputed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.canonical import digest
from corpusloom.operators import gates
from corpusloom.sources.tables import cut

#: Fields that refer to a passage, one and several: fixed values.
REFERENCES = ("passage_id", "passage_ids")


def mapped(value: Column, kind: T.DataType, use: Callable[[Column], Column], names: Iterable[str] = REFERENCES) -> Column:
    """`value` with `use` applied to every reference: the strings, or lists of strings, in the fields of these names at any depth. Other texts stay."""
    names = tuple(names)

    def rewrite(x: Column, kind: T.DataType, named: bool) -> Column:
        if isinstance(kind, T.StructType):
            out = F.struct(*(rewrite(x[f.name], f.dataType, f.name in names).alias(f.name) for f in kind.fields))
            return F.when(x.isNotNull(), out)
        if isinstance(kind, T.ArrayType):
            return F.transform(x, lambda y: rewrite(y, kind.elementType, named))
        if isinstance(kind, T.MapType):
            return F.transform_values(x, lambda _, y: rewrite(y, kind.valueType, named))
        return use(x) if named and isinstance(kind, T.StringType) else x

    return rewrite(value, kind, False)


def aliases(passages: Column, prefix: str = "src") -> Column:
    """The alias of each passage id of a packet by its place from 0; of an id that repeats the last place."""
    last = F.filter(F.transform(passages, lambda x, i: F.struct(x.alias("id"), i.alias("at"))), lambda e: ~F.array_contains(F.slice(passages, e["at"] + 2, F.size(passages)), e["id"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["id"], F.concat(F.lit(prefix), e["at"].cast("string")))))


def _known(names: Column) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(F.try_element_at(names, x), x)


def aliased(packets: DataFrame, packet: str, passages: Column) -> DataFrame:
    """`packets` with the column `packet` under aliases and `aliases` (map of id to alias). An id that no passage has stays as it is."""
    kind, told = packets.schema[packet].dataType, packets.withColumn("aliases", aliases(passages))
    return told.withColumn(packet, mapped(F.col(packet), kind, _known(F.col("aliases"))))


def restored(packets: DataFrame, packet: str) -> DataFrame:
    """`packets` of `aliased`, or answers that cite the same aliases, with the ids in their places and without `aliases`."""
    back = F.map_from_entries(F.transform(F.map_entries("aliases"), lambda e: F.struct(e["value"], e["key"])))
    kind, told = packets.schema[packet].dataType, packets.withColumn("_back", back)
    return told.withColumn(packet, mapped(F.col(packet), kind, _known(F.col("_back")))).drop("_back", "aliases")


def by_page(passages: Column) -> Column:
    """Passages (passage_id, page_id or null, text) grouped by page as map of page to list of (passage_id, text); without a page, by what stands before the id's first colon."""
    page = lambda p: F.coalesce(p["page_id"], F.split(p["passage_id"], ":")[0])
    pages = F.array_distinct(F.transform(passages, page))
    own = lambda name: F.transform(F.filter(passages, lambda p: page(p) == name), lambda p: F.struct(p["passage_id"].alias("passage_id"), p["text"].alias("text")))
    return F.map_from_arrays(pages, F.transform(pages, own))


def descendants(documents: DataFrame, key: str, value: str) -> DataFrame:
    """(key, place, value): every object and list of VARIANT values, whatever their depth; place holds the positions on the way down.

    A level is exploded at a time, until none is left: the driver's loop follows the depth, the rows stay on Spark.
    """
    level = cut(documents.select(key, F.array().cast("array<int>").alias("place"), F.col(value).alias("value")).where(_nests("value")))
    levels = [level]
    while not level.isEmpty():
        level.createOrReplaceTempView("_corpusloom_level")
        below = level.sparkSession.sql(f"SELECT l.`{key}`, array_append(l.place, v.pos) AS place, v.value AS value FROM _corpusloom_level AS l, LATERAL variant_explode(l.value) AS v")
        level = cut(below.where(_nests("value")))
        levels.append(level)
    level.sparkSession.catalog.dropTempView("_corpusloom_level")
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def _nests(column: str) -> Column:
    return F.schema_of_variant(F.col(column)).rlike("^(OBJECT|ARRAY)<")


def harvested(documents: DataFrame, key: str, value: str) -> DataFrame:
    """(key, paper_id, title, year, venue): what VARIANT values say of papers, at any depth.

    An object with a paper_id says it in paper.paper_metadata, else in metadata, else itself; without a title there it
    may have one itself. Of several objects of one paper the last in reading order counts, fields by name.
    """
    at = lambda path, kind="string": F.try_variant_get(F.col("value"), path, kind)
    filled = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")).rlike("^OBJECT<.+>"), F.lit(False))
    inner, own = "$.paper.paper_metadata", "$.metadata"
    pick = lambda name: F.when(filled(inner), at(f"{inner}.{name}")).when(filled(own), at(f"{own}.{name}")).otherwise(at(f"$.{name}"))
    told = descendants(documents, key, value).select(key, "place", at("$.paper_id").alias("paper_id"), F.coalesce(F.nullif(pick("title"), F.lit("")), F.nullif(at("$.title"), F.lit(""))).alias("said"), *(pick(n).alias(n) for n in ("title", "year", "venue")))
    named = told.where("paper_id <> '' and said is not null")
    return named.groupBy(key, "paper_id").agg(F.max_by(F.struct("title", "year", "venue"), F.col("place")).alias("last")).select(key, "paper_id", "last.*")


def inexact(stored: DataFrame, recomputed: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys whose stored value is not the recomputed one, by canonical digests; or that only one side has; or whose recorded digest is not that of their value.

    `stored` (key, value, sha256), `recomputed` (key, value), value of one nested type on both sides.
    """
    if stored.schema["value"].dataType.simpleString() != recomputed.schema["value"].dataType.simpleString():
        raise ValueError("stored and recomputed values differ in type")
    kind = recomputed.schema["value"].dataType
    a = stored.select(key, digest(F.col("value"), kind).alias("_own"), F.col("sha256").alias("_said"), F.lit(True).alias("_stored"))
    b = recomputed.select(key, digest(F.col("value"), kind).alias("_due"), F.lit(True).alias("_made"))
    told = a.join(b, key, "full")
    detail = F.when(F.col("_stored").isNull(), "missing").when(F.col("_made").isNull(), "unexpected").when(~F.col("_said").eqNullSafe(F.col("_own")), "digest").when(F.col("_own") != F.col("_due"), "value")
    return gates.violations(told, rule, detail.isNotNull(), F.col(key), detail)
