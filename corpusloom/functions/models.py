"""The model boundary: embedders, judges and planners as pluggable functions, with defaults that need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Texts to vectors of `size` numbers; called once for each Arrow batch of a task."""

    size: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: signed hashed counts of the words, at length one."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import re

        import numpy as np
        import xxhash

        out = np.zeros((len(texts), self.size))
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                code = xxhash.xxh64_intdigest(word)
                out[row, code % self.size] += 1 if code >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()


def embedded(records: DataFrame, embedder: Embedder | None = None, text: str = "text", key: str = "record_id") -> DataFrame:
    """(key, vector) of the records; a task holds a batch at a time."""
    model = embedder or HashEmbedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": model([x or "" for x in batch[text]])})

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")


#: What some models want before a query, not before a text that is searched: a fixed form.
INSTRUCTED = "Instruct: {task}\nQuery: {query}"


def embedded_queries(queries: DataFrame, embedder: Embedder | None = None, task: str | None = None) -> DataFrame:
    """(query_id, vector) of queries (query_id, text): by the model that made the vectors which they are to meet, with its instruction where it is told apart from texts."""
    before, after = INSTRUCTED.split("{query}")
    text = F.concat(F.lit(before.format(task=task)), F.coalesce("text", F.lit("")), F.lit(after)) if task else F.col("text")
    return embedded(queries.select("query_id", text.alias("text")), embedder, key="query_id")


def same_by_spelling(a: Column, b: Column) -> Column:
    """The default judge of two labels: equal letters and digits, or one in plural."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), "s$", "")
    return plain(a) == plain(b)


def judged(pairs: DataFrame, judge: Callable[[Column, Column], Column] = same_by_spelling) -> DataFrame:
    """`pairs` (a_text, b_text, ...) with the judge's decision as `same`; every pair gets one."""
    return pairs.withColumn("same", F.coalesce(judge(F.col("a_text"), F.col("b_text")), F.lit(False)))


def within_budget(requests: DataFrame, attempts: int, order: list[str]) -> DataFrame:
    """Requests with whether they may be made under a limit of attempts: the first by order. Decided before they run, without a shared counter."""
    allowed = requests.orderBy(*order).limit(attempts).select(*order).withColumn("_allowed", F.lit(True))
    return requests.join(allowed, order, "left").withColumn("allowed", F.coalesce("_allowed", F.lit(False))).drop("_allowed")
