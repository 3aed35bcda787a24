"""Quality rules (operator 2): a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, words

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for with as on be are was this by at from or an "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an "
    "le la les de des et un une du en est que qui dans pour par au sur pas avec "
    "el los las y en un una por con del se lo su al como para es no"
).split()
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Rule(NamedTuple):
    """A document passes if low <= numerator / denominator <= high; a denominator of zero passes."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


#: The method's own verdict, on top of the base rules. Numerators and denominators name measures.
RULES = (
    Rule("words", "n_words", "one", 50, float("inf")),
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.25),
    Rule("exclamations", "n_exclamations", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("letter_words", "n_letter_words", "n_words", 0.6, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0.0, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0.0, 0.9),
)


def _removed(text: Column, characters: str) -> Column:
    """How many of the ASCII characters a text has: bytes that go when each is taken out, which costs less than a translation of the whole text."""
    return reduce(Column.__add__, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters))


def _windows(found: Column) -> Column:
    """The hashes of the 3-word windows, in order.

    Where some are equal, they are sorted with their places, so that equal windows are neighbours; the places of
    those, sorted, are the starts of the repeated windows. Each start covers three words, or fewer where the next
    start is nearer: n log n for any text, never all pairs.
    """
    n = F.size(found) - (WINDOW - 1)
    hashed = F.transform(found, lambda w, i: F.xxhash64(w, F.get(found, i + 1), F.get(found, i + 2)))
    return F.slice(hashed, 1, F.greatest(n, F.lit(0)))


def _repeats(hashes: Column) -> Column:
    """The hashes with their places, sorted; none where all hashes differ, which a set tells without sorting."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.sort_array(F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, given, row, measures ...): a long for each measure of the rules and of the base, for every row of `docs`.

    `given` is the row as it came, a struct, so that its columns can't clash with the measures.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The row number keeps conditions on the measures above them: pushed below, they would take the words anew for each window.
    row = F.monotonically_increasing_id().alias("row")
    first = docs.select("doc_id", text.alias("text"), words(text).alias("found"), F.struct(*docs.columns).alias("given"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = first.select("doc_id", "given", "text", "found", lines.alias("lines"), _windows(F.col("found")).alias("hashes"))
    second = windows.select("doc_id", "given", "text", "found", "lines", _repeats(F.col("hashes")).alias("hashed"))
    third = second.select("doc_id", "given", "text", "found", "lines", F.sort_array(F.transform(F.filter("hashed", _twin(F.col("hashed"))), lambda x: x.i)).alias("starts"))
    ends = lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - x, F.lit(WINDOW)))
    long = lambda c, name: c.cast("long").alias(name)
    return third.select(
        "doc_id",
        "given",
        row,
        F.lit(1).cast("long").alias("one"),
        long(F.size("found"), "n_words"),
        long(F.length(F.array_join("found", "")), "word_chars"),
        long(_removed(F.col("text"), SYMBOLS), "n_symbols"),
        long(F.size("lines"), "n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.aggregate(F.transform("starts", ends), F.lit(0), lambda a, b: a + b), "n_repeat_words"),
        long(_removed(F.col("text"), "!"), "n_exclamations"),
        long(F.size(F.filter("found", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))), "n_stop_words"),
        long(F.size(F.filter("found", lambda w: w.rlike(r"\p{L}"))), "n_letter_words"),
        long(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))), "n_ellipsis_lines"),
        long(F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]"))), "n_bullet_lines"),
    )


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep."""
    return judge(docs, rules).where((F.col("row") >= 0) & F.col("kept")).select("given.*")


def _twin(hashed: Column):
    """Whether an element of the sorted array has a neighbour of equal hash. Index -1 gives null, as past the end."""
    return lambda x, i: F.coalesce(F.get(hashed, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(hashed, i + 1).h == x.h, F.lit(False))


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table compiled into one condition, in whole numbers where the bounds are whole."""
    out = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator).cast("double"), F.col(r.denominator).cast("double")
        out &= (bottom == 0) | ((top >= bottom * r.low) & (top <= bottom * r.high))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures with base_failed and kept, a row for every row of `docs`.

    A null, empty or blank text has no words and fails. Rows with one doc_id are judged each for itself. Extra
    columns are ignored; an empty table gives no rows. Texts of any length are measured whole.
    """
    measured = measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, with the measures it rests on."""
    return judge(documents(spark, sf_dir)).drop("one", "row", "given")


def _sql_rules() -> str:
    parts = [f"({r.denominator} = 0 OR ({r.numerator} >= {r.denominator} * {float(r.low)!r}::DOUBLE AND {r.numerator} <= {r.denominator} * {float(r.high)!r}::DOUBLE))" for r in RULES if r.denominator != "one"]
    return " AND ".join(parts)


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS found,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT r, unnest(list_transform(generate_series(1, length(found) - 2), lambda i: {{'i': i, 'w': [found[i], found[i + 1], found[i + 2]]}}), recursive := false) AS x FROM w),
n AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.w) AS n FROM t),
p AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) FROM n WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, length(found) AS n_words, length(array_to_string(found, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(lines) AS n_lines,
             length(lines) - length(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
             length(list_filter(found, lambda x: list_contains({sorted(set(STOP_WORDS))!r}, lower(x)))) AS n_stop_words,
             length(list_filter(found, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
             length(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
             length(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]'))) AS n_bullet_lines
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
