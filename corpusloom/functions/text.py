"""Scalar text functions as Spark columns: ids, slugs, tokens, years, URLs, chunks. None of them is a user function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no evidence.
STOP_WORDS = "the and for with that this from are was were than into over under when which while their these those have has not but its".split()
#: Placeholders that stand for a missing value.
PLACEHOLDERS = ["", "unknown", "n/a", "none", "not specified", "not reported"]


def normalized(text: Column) -> Column:
    """Lower-case ASCII letters and digits; all else dropped."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def paper_id(title: Column, venue: Column, year: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of the normalised `title|venue|year`; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (title, venue, year)]
    return F.substring(F.sha2(F.concat_ws("|", *map(normalized, parts)), 256), 1, 12)


def slug(text: Column, fallback: str = "concept") -> Column:
    """Lower case, each run of other than letters and digits as one underscore, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", fallback).otherwise(out)


def file_name(text: Column, longest: int = 150) -> Column:
    """A title as a file name: reserved characters as underscores, trimmed, at most `longest` characters, no final space or dot."""
    out = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")), 1, longest)
    out = F.regexp_replace(out, r"[ .]+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def folder_name(text: Column) -> Column:
    return F.replace(file_name(text), F.lit(" "), F.lit("_"))


def year(*candidates: Column) -> Column:
    """The first candidate that is, or holds, a year from 1900 to 2099."""
    found = (F.nullif(F.regexp_extract(c.cast("string"), r"(?:19|20)\d{2}", 0), F.lit("")) for c in candidates)
    return F.coalesce(*(f.cast("int") for f in found))


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct lower-case runs of three or more of a-z, digits and hyphens that don't start with a hyphen, without stop words; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop_words)))


def all_tokens(text: Column) -> Column:
    """Lower-case words with repeats, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def relevance(own: Column, query: Column, hints: Column, hint_weight: float = 0.5) -> Column:
    """The share of the query's tokens that a text has, plus half its share of the hints'."""
    share = lambda wanted: F.when(F.size(wanted) > 0, F.size(F.array_intersect(own, wanted)) / F.size(wanted)).otherwise(0.0)
    return share(query) + hint_weight * share(hints)


def query_key(text: Column) -> Column:
    """What makes two queries the same: white space collapsed, case folded."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))), F.lit("ß"), F.lit("ss"))


def clean(text: Column) -> Column:
    """White space collapsed; null for a placeholder."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.lower(out).isin(PLACEHOLDERS), None).otherwise(out)


def public_url(text: Column) -> Column:
    """An http(s) address without user data or a signed query, blanks encoded; null for any other."""
    out = F.replace(F.trim(text), F.lit(" "), F.lit("%20"))
    plain = out.rlike(r"^https?://[^/@\s]+(?:[/?#]|$)")
    signed = F.lower(out).rlike(r"[?&](?:x-amz-|signature=|sig=|token=|expires=|awsaccesskeyid=)")
    return F.when(plain & ~signed, out)


def doi_link(text: Column) -> Column:
    """The canonical link of a DOI, from an identifier or an address."""
    doi = F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, r"[.,;]+$", "")))


def arxiv_link(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)(?:^|arxiv[:/.]|abs/|pdf/)(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    return F.when(found != "", F.concat(F.lit("https://arxiv.org/abs/"), found))


def confidence(value: Column, default: float = 0.0) -> Column:
    """A number within 0 and 1; the default for what is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def token_estimate(text: Column) -> Column:
    """Tokens by the rule of four characters each, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def labelled(*parts: tuple[str, Column]) -> Column:
    """`Label: value` of each part that has a value, joined by blanks; lists (arrays) joined by `; ` without empty elements."""
    return F.concat_ws(" ", *(F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{label}: " if label else ""), F.trim(c))) for label, c in parts))


def listed(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda x: F.trim(x) != ""), "; ")


def page_ranges(text: Column) -> Column:
    """`1-3,7` as the ascending distinct pages."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ","), lambda x: x.rlike(r"^\d+(-\d+)?$"))
    ends = lambda x: F.split(x, "-")
    pages = F.transform(parts, lambda x: F.sequence(F.least(F.element_at(ends(x), 1).cast("int"), F.element_at(ends(x), -1).cast("int")), F.greatest(F.element_at(ends(x), 1).cast("int"), F.element_at(ends(x), -1).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def json_object(raw: Column) -> Column:
    """The outermost `{...}` of a model's answer, without a code fence; null without one."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def sentences(text: Column) -> Column:
    """A text cut after each `.`, `!` or `?` that white space follows."""
    return F.split(text, r"(?<=[.!?])[\s\p{Z}]+")


def chunks(text: Column, limit: int | Column = 4000) -> Column:
    """Sentences packed into chunks of up to `limit` characters, as an array.

    A sentence beyond the limit is cut into pieces of it; all but the last go out at once, ahead of what was being
    packed, and the last is packed on. A text within the limit is one chunk; null and empty texts have none.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        heads_n = F.when(F.length(x) > limit, F.ceil(F.length(x) / limit).cast("int") - 1).otherwise(F.lit(0))
        heads = F.when(heads_n > 0, F.transform(F.sequence(F.lit(0), heads_n - 1), lambda k: F.substr(x, k * limit + 1, limit))).otherwise(empty)
        tail = F.substr(x, heads_n * limit + 1)
        full = (acc.cur != "") & (F.length(acc.cur) + F.length(tail) + 1 > limit)
        parts = F.concat(acc.parts, heads, F.when(full, F.array(acc.cur)).otherwise(empty))
        return F.struct(parts.alias("parts"), F.when(full, tail).otherwise(F.trim(F.concat_ws(" ", acc.cur, tail))).alias("cur"))

    start = F.struct(empty.alias("parts"), F.lit("").alias("cur"))
    packed = F.aggregate(sentences(text), start, step, lambda a: F.concat(a.parts, F.when(a.cur != "", F.array(a.cur)).otherwise(empty)))
    return F.when(F.coalesce(text, F.lit("")) == "", empty).when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def passages(text: Column) -> Column:
    """Blocks between blank lines as structs (start, end, text), offsets in characters, empty ones left out."""
    marked = F.regexp_replace(text, r"\n[ \t]*(?:\n[ \t]*)+", "\u0001$0\u0001")
    pieces = F.split(marked, "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(acc.at.alias("start"), (acc.at + F.length(x)).alias("end"), x.alias("text"))
        return F.struct((acc.at + F.length(x)).alias("at"), F.when(F.trim(F.regexp_replace(x, r"\s", "")) != "", F.concat(acc.out, F.array(own))).otherwise(acc.out).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a.out)


def passage_id(page_id: Column, page_hash: Column, start: Column, end: Column, text: Column) -> Column:
    """Page id and 12 hexadecimal digits of what the passage is bound to."""
    bound = F.concat_ws(":", page_hash, start.cast("string"), end.cast("string"), text)
    return F.concat(page_id, F.lit(":"), F.substring(F.sha2(bound, 256), 1, 12))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized_vector(v: Column) -> Column:
    """A vector at length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
