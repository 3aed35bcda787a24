"""Concepts and relations found in texts by a pluggable extractor, checked against the text; labels joined by a judge; clusters merged to one text, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.models import judged, same_by_spelling
from corpusloom.functions.text import slug
from corpusloom.operators.components import connected_components
from corpusloom.operators.ranking import numbered
from corpusloom.sources.tables import cut

#: What a mention may be, and how two concepts may relate: fixed values.
FACETS = ("problem", "bottleneck", "method", "mechanism", "evaluation_regime", "hardware_regime", "model_scale", "optimization_target", "failure_mode")
RELATIONS = ("SOLVES", "REDUCES", "INTRODUCES", "CAUSES", "DEPENDS_ON", "REQUIRES", "FAILS_UNDER", "TRADES_OFF_WITH", "HURTS", "CONTRADICTS")
FOUND = "array<struct<kind:string,source:string,label:string,target:string,quote:string>>"
#: Texts that a merger gets at a time.
FAN = 32


class CueExtractor:
    """A stand-in without a model. `A relation B` with one of the cue words between two words is a relation; the word after a facet's name is a mention. The sentence is the quote."""

    def __init__(self, cues: dict[str, str], facets: dict[str, str]) -> None:
        import re

        self.cues, self.facets = cues, facets
        word = r"(\w+)"
        self.relation = re.compile(rf"{word} ({'|'.join(map(re.escape, sorted(cues)))}) {word}") if cues else None
        self.mention = re.compile(rf"\b({'|'.join(map(re.escape, sorted(facets)))}) {word}") if facets else None
        self.sentence = re.compile(r"[^.!?]*[.!?]?")

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        return [self.found(t) for t in texts]

    def found(self, text: str) -> list[dict]:
        out = []
        for sentence in (s.strip() for s in self.sentence.findall(text)):
            for m in self.mention.finditer(sentence) if self.mention else ():
                out.append({"kind": "mention", "source": m[2], "label": self.facets[m[1]], "target": None, "quote": sentence})
            for m in self.relation.finditer(sentence) if self.relation else ():
                out.append({"kind": "relation", "source": m[1], "label": self.cues[m[2]], "target": m[3], "quote": sentence})
        return out


def extracted(texts: DataFrame, extractor: Callable[[list[str]], list[list[dict]]], key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(found (key, kind, source, label, target, quote), rejected (the same, and why)) of texts (key, text).

    The extractor is called for a batch of texts and may say anything. What stays has a facet or relation of the
    vocabulary, concepts, and a quote that is in its own text as it stands. A text in which nothing is found is no
    error; a null text is empty. An answer that is no list of such rows, for any text of the batch, ends the task.
    """
    kind = texts.schema[key].dataType.simpleString()
    rows = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "source", "label", "target", "quote")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = extractor([t or "" for t in batch.column("text").to_pylist()])
            if len(answers) != batch.num_rows:
                raise ValueError(f"{len(answers)} answers for {batch.num_rows} texts")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, rows)], [key, "text", "found"])

    told = texts.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"`{key}` {kind}, text string, found {FOUND}")
    each = told.select(key, "text", F.explode("found").alias("f")).select(key, "text", "f.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = (
        F.when(F.col("kind") == "mention", F.when(~F.coalesce(F.col("label").isin(*FACETS), F.lit(False)), "facet"))
        .when(F.col("kind") == "relation", F.when(~F.coalesce(F.col("label").isin(*RELATIONS), F.lit(False)), "relation").when(blank("target"), "concept"))
        .otherwise("kind")
    )
    why = F.coalesce(why, F.when(blank("source"), "concept").when(blank("quote") | ~F.contains("text", "quote"), "quote"))
    checked = cut(each.withColumn("why", why).drop("text"))
    return checked.where("why is null").drop("why"), checked.where("why is not null")


def normalized_labels(labels: DataFrame, pairs: DataFrame, judge: Callable[[Column, Column], Column] = same_by_spelling) -> DataFrame:
    """(id, concept_id) of labels (id, label, facet): those that a judge holds for equal have one concept.

    `pairs` (a, b) are candidates by similarity, a < b by id; pairs of two facets are never judged. The shortest label
    of a group names its concept, of equals the one with the least id; a label in no pair names its own.
    """
    left = labels.select(F.col("id").alias("a"), F.col("label").alias("a_text"), F.col("facet").alias("_fa"))
    right = labels.select(F.col("id").alias("b"), F.col("label").alias("b_text"), F.col("facet").alias("_fb"))
    told = judged(pairs.select("a", "b").join(left, "a").join(right, "b").where("_fa = _fb"), judge)
    linked = connected_components(told.where("same"), "a", "b")
    grouped = labels.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    names = grouped.groupBy("group").agg(F.min(F.struct(F.length("label").alias("n"), "id", "label")).alias("best"))
    return grouped.select("id", "group").join(names.select("group", slug(F.col("best.label")).alias("concept_id")), "group").select("id", "concept_id")


def shortest(texts: Column) -> Column:
    """The default merger: the shortest of some texts (an array), of equals the first by code point."""
    return F.array_min(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("text"))))["text"]


def cluster_summaries(statements: DataFrame, merger: Callable[[Column], Column] = shortest, fan: int = FAN) -> DataFrame:
    """(cluster, statement, n_statements, n_papers) of statements (cluster, id, text, paper_id): each cluster merged to one text.

    A merger makes one text of an array of up to `fan`, in order of id; what it makes is merged again until a cluster
    has one. So no call and no task sees a whole cluster, however large, and a cluster of one text is never given to
    it. A merger that answers null for some texts raises ValueError: nothing is published from half a cluster.
    """
    counted = statements.groupBy("cluster").agg(F.count("*").alias("n_statements"), F.countDistinct("paper_id").alias("n_papers"))
    level = cut(numbered(statements.select("cluster", "id", "text"), ["cluster"], ["id"], "place").select("cluster", F.col("place"), "text"))
    done = []
    while True:
        sizes = level.groupBy("cluster").agg(F.max("place").alias("n"))
        done.append(level.join(sizes.where("n = 1").select("cluster"), "cluster", "left_semi").select("cluster", F.col("text").alias("statement")))
        many = level.join(sizes.where("n > 1").select("cluster"), "cluster", "left_semi")
        texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
        parts = many.groupBy("cluster", (F.floor((F.col("place") - 1) / fan) + 1).alias("place")).agg(texts.alias("texts"))
        level = cut(parts.select("cluster", "place", F.when(F.size("texts") > 1, merger(F.col("texts"))).otherwise(F.col("texts")[0]).alias("text")))
        if level.isEmpty():
            break
        if not level.where("text is null").isEmpty():
            raise ValueError("a merger gave no text")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return counted.join(out, "cluster").select("cluster", "statement", "n_statements", "n_papers")
