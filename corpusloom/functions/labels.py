"""Answers of classifiers and addresses in documents, as Spark columns: labels, areas, pages, JSON pointers, tables and their captions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import confidence, json_object

ANSWER = "struct<label:string,confidence:string,primary_topic:string,reason:string,research_areas:array<struct<area:string,relevance:string,confidence:string>>>"


def normalized_area(text: Column) -> Column:
    """Small letters and digits, all else one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def matched_area(text: Column, areas: Sequence[str], aliases: Mapping[str, str], guess: bool = True) -> Column:
    """The area that a name means: itself, by an alias, or, if guessed, the first area that contains it or is contained, numbers before it aside."""
    name = normalized_area(text)
    plain = [(a, _plain(a)) for a in areas]
    exact = F.create_map(*(F.lit(x) for a, n in plain for x in (n, a)), *(F.lit(x) for k, a in aliases.items() if _plain(k) not in dict((n, a) for a, n in plain) for x in (_plain(k), a)))
    rest = F.regexp_replace(name, r"^\d+\s+", "")
    near = F.lit(None).cast("string")
    for a, n in reversed(plain):
        near = F.when(F.contains(F.lit(n), rest) | F.contains(rest, F.lit(n)), a).otherwise(near)
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(exact[name], near) if guess else exact[name])


def _plain(text: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def resolved_area(text: Column, known: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """(area, problem): the one known area a user's name means; `no match` or `ambiguous` otherwise."""
    name = normalized_area(text)
    exact = matched_area(text, known, aliases, guess=False)
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lit(_plain(k)), name), k) for k in known)))
    one = F.coalesce(F.when(exact.isin(*known), exact), F.when(F.size(hits) == 1, hits[0]))
    return F.struct(one.alias("area"), F.when(one.isNull(), F.when(F.size(hits) == 0, "no match").otherwise("ambiguous")).alias("problem"))


def classification(raw: Column, areas: Sequence[str], aliases: Mapping[str, str]) -> Column:
    """A classifier's answer as (label, confidence, primary_topic, areas, reason); null for one that is no use.

    Labels are ML and NON_ML; areas only count for ML: those that are known, each once by its first mention, with a
    relevance of SECONDARY unless it is PRIMARY.
    """
    told = F.from_json(json_object(raw), ANSWER)
    label = F.replace(F.upper(F.trim(told["label"])), F.lit("-"), F.lit("_"))
    item = lambda x: F.struct(matched_area(x["area"], areas, aliases).alias("area"), F.when(F.upper(F.trim(x["relevance"])) == "PRIMARY", "PRIMARY").otherwise("SECONDARY").alias("relevance"), confidence(x["confidence"]).alias("confidence"))
    known = F.filter(F.transform(told["research_areas"], item), lambda x: x["area"].isNotNull())
    names = F.transform(known, lambda x: x["area"])
    first = F.filter(known, lambda x, i: F.array_position(names, x["area"]) == i + 1)
    none = F.array().cast("array<struct<area:string,relevance:string,confidence:double>>")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    answer = F.struct(label.alias("label"), confidence(told["confidence"]).alias("confidence"), text(told["primary_topic"]).alias("primary_topic"), F.when(label == "ML", F.coalesce(first, none)).otherwise(none).alias("areas"), text(told["reason"]).alias("reason"))
    return F.when(label.isin("ML", "NON_ML"), answer)


def in_areas(areas: Column, wanted: Sequence[str], secondary: bool = False) -> Column:
    """Whether a paper's areas (area, relevance) have one that is wanted as PRIMARY, or at all."""
    return F.coalesce(F.exists(areas, lambda a: a["area"].isin(*wanted) & (F.lit(secondary) | (a["relevance"] == "PRIMARY"))), F.lit(False))


def page_label(raw: Column, known: Sequence[str], default: str = "paper") -> Column:
    """A page's label without punctuation, in small letters; the default for any other."""
    word = F.regexp_replace(F.lower(F.trim(raw)), r"^[^a-z]+|[^a-z]+$", "")
    return F.when(word.isin(*known), word).otherwise(default)


def abstract_pages(pages: DataFrame, leading: int = 3) -> DataFrame:
    """(paper_id, page): the first of the leading pages that mentions an abstract, else page 1."""
    told = pages.groupBy("paper_id").agg(F.min(F.when((F.col("page") <= leading) & F.lower("text").contains("abstract"), F.col("page"))).alias("page"))
    return told.select("paper_id", F.coalesce("page", F.lit(1)).alias("page"))


def pointed(rows: DataFrame, document: str, pointer: str) -> DataFrame:
    """`rows` with `value`, what the pointer finds in the JSON text, and `valid`, whether it finds anything; a JSON null is found, with a null value.

    A step is a place where an array stands, and a key, also of digits, where an object does. Objects and arrays are
    given as JSON. A text that is no JSON, and a pointer that is neither empty nor begins with `/`, find nothing. A key
    with quotes of both kinds isn't found.
    """
    told = F.transform(F.split(F.col(pointer), "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    rooted = (F.col(pointer) == "") | F.col(pointer).startswith("/")
    start = F.when(rooted, F.try_parse_json(F.col(document)))

    def step(found: Column, x: Column) -> Column:
        quote = F.when(x.contains("'"), '"').otherwise("'")
        key = F.concat(F.lit("$["), quote, x, quote, F.lit("]"))
        kind = F.schema_of_variant(found)
        place = F.when(x.rlike(r"^(0|[1-9]\d{0,8})$"), F.try_variant_get(found, F.concat(F.lit("$["), x, F.lit("]")), "variant"))
        return F.when(kind.startswith("ARRAY"), place).when(kind.startswith("OBJECT"), F.try_variant_get(found, key, "variant"))

    at = F.aggregate(F.slice(told, F.lit(2), F.size(told)), start, step)
    kind = F.schema_of_variant("_at")
    value = F.when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json("_at")).when(kind != "VOID", F.try_variant_get("_at", "$", "string"))
    return rows.withColumn("_at", at).withColumn("value", value).withColumn("valid", F.col("_at").isNotNull()).drop("_at")


def proposal_path(path: Column) -> Column:
    """A path without the wrapper that some answers put before it."""
    return F.regexp_replace(path, "^/candidate(?=/)", "")


def relocated_path(path: Column, has_revisions: Column) -> Column:
    """A review's path to revisions inside a target, moved to the root where they are; others stay."""
    return F.when(has_revisions, F.regexp_replace(path, r"^/targets/\d+/revisions/", "/revisions/")).otherwise(path)


#: Patterns of table captions, setup lines, notes and tables: fixed values.
CAPTION = r"(?i)^\s*(?:#{1,6}\s*)?(?:\*\*)?Table\s+(?:\d+|[A-Z]\d*|[IVX]+)\s*[:.]"
SETUP = r"^\s*(?:\*\*)?[A-Za-z][A-Za-z0-9 /()_-]{0,40}\s*:"
NOTE = r"(?i)^\s*(?:\*\*)?(?:Notes?\s*:|\[\^[^\]]+\]:)"
TABLE = r"(?m)^\s*\|?\s*:?-{2,}:?\s*\|"


def table_contexts(passages: DataFrame, longest: int = 400) -> DataFrame:
    """(passage, context, pos): the passages that belong to each table of a page: its caption with short setup lines after it, and a note right below.

    passages (page, start, passage, text). A caption binds to the next table of its page if only setup lines are
    between. The passages of a page are folded in order; no page is joined with another.
    """
    item = F.struct("start", "passage", F.col("text").rlike(TABLE).alias("table"), F.col("text").rlike(CAPTION).alias("caption"), ((F.length("text") <= longest) & F.col("text").rlike(SETUP)).alias("setup"), F.col("text").rlike(NOTE).alias("note"))
    pages = passages.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = passages.schema["passage"].dataType.simpleString()
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<struct<passage:{kind},context:{kind},pos:int>>")

    def step(acc: Column, x: Column) -> Column:
        bound = F.when(x["table"], F.transform(acc["open"], lambda c, i: F.struct(x["passage"].alias("passage"), c.alias("context"), i.alias("pos")))).otherwise(nothing)
        noted = F.when(x["note"] & acc["last"].isNotNull(), F.array(F.struct(acc["last"].alias("passage"), x["passage"].alias("context"), F.lit(1 << 20).alias("pos")))).otherwise(nothing)
        own = F.when(x["caption"], F.array(x["passage"])).when(x["table"] | (F.size(acc["open"]) == 0) | ~x["setup"], none).otherwise(F.concat(acc["open"], F.array(x["passage"])))
        return F.struct(own.alias("open"), F.when(x["table"], x["passage"]).alias("last"), F.concat(acc["out"], bound, noted).alias("out"))

    start = F.struct(none.alias("open"), F.lit(None).cast(kind).alias("last"), nothing.alias("out"))
    return pages.select(F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("o")).select("o.*")
