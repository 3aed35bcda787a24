"""Language identification (operator 5) by prediction by partial matching.

Each language has a context tree over bytes, of orders three down to none. The probability of a byte is its
share of the longest context seen, and an escape (method C: as often as there were different bytes) passes the
rest on to the next shorter context, shared out over the bytes not seen before it. The statistics are frozen,
so they compile into one table of log probabilities by (context state, byte, language), and the code length of
a whole text is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices, utf8

ORDER = 3
#: Documents of each language that the trees learn from, on average: the bound of the sample.
SAMPLE_DOCS = 400
#: A context of order three has a state of its own if it was seen so often in the sample.
MIN_SEEN = 2
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: ASCII capitals count as small letters. Byte 0 stands before a text.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept for evaluation: crc32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): the bytes of each text with the three before them, as one number, counted within a slice."""
    for part in slices(batches):
        codes, offsets = _contexts(*utf8(part))
        langs, rows = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        owner = np.repeat(rows, np.diff(offsets))
        for k, lang in enumerate(langs):
            grams, counts = np.unique(codes[owner == k], return_counts=True)
            if len(grams):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it in its text (zeros before the text), as 32-bit numbers."""
    folded = FOLDED[data].astype(np.uint32)
    codes, place = folded.copy(), np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        codes[back:] |= np.where(place[back:] >= back, folded[:-back], 0).astype(np.uint32) << np.uint32(8 * back)
    return codes, offsets


@dataclass
class Model:
    """Frozen statistics: symbol of each byte, state of each context of three symbols, and log probabilities (states, symbols, languages)."""

    langs: list[str]
    symbol: np.ndarray
    state: np.ndarray
    log_p: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): nats that each language takes to code each whole text."""
        size, n = self.log_p.shape[1], len(data)
        coded = self.symbol[data].astype(np.int32)
        context, place = np.zeros(n, np.int32), np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        before = int(self.symbol[0])
        for back in range(1, ORDER + 1):
            past = np.full(n, before, np.int32)
            past[back:] = np.where(place[back:] >= back, coded[:-back], before)
            context = context + past * np.int32(size ** (back - 1))
        entries = self.state[context].astype(np.int64) * size + coded
        flat, out = self.log_p.reshape(-1, len(self.langs)), np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for k in range(len(self.langs)):
                out[full, k] = -np.add.reduceat(flat[entries, k], offsets[:-1][full], dtype=np.float64)
        return out


def compile_model(counts: list[tuple[str, int, int]]) -> Model | None:
    """The model of (language, gram, count) rows; None without any."""
    if not counts:
        return None
    langs = sorted({lang for lang, _, _ in counts})
    index = {lang: k for k, lang in enumerate(langs)}
    lang = np.array([index[x] for x, _, _ in counts])
    gram, n = (np.array([row[k] for row in counts], np.int64) for k in (1, 2))
    parts = [gram >> (8 * back) & 255 for back in range(ORDER + 1)]
    known = np.unique(np.concatenate([[0], *parts]))
    size = len(known) + 1  # the last symbol: any byte that was not seen
    symbol = np.full(256, size - 1, np.uint8 if size <= 256 else np.uint16)
    symbol[known] = np.arange(size - 1)
    symbol = symbol[FOLDED]
    share = np.ones(size)
    share[-1] = max(1, 256 - len(known))
    coded = [symbol[p].astype(np.int64) for p in parts]
    context = [np.zeros(len(gram), np.int64)]  # by order: its symbols as one number, the nearest byte lowest
    for back in range(1, ORDER + 1):
        context.append(context[-1] + coded[back] * size ** (back - 1))
    seen, total = np.unique(context[ORDER], return_inverse=True)
    frequent = seen[np.bincount(total, n) >= MIN_SEEN]
    own = [np.zeros(1, np.int64), *(np.unique(context[k]) for k in range(1, ORDER)), frequent]
    tables = []
    for k in range(len(langs)):
        mine = lang == k
        shorter = np.full((1, size), 1 / 256)
        for order in range(ORDER + 1):
            rows = np.searchsorted(own[order], context[order][mine])
            rows[rows == len(own[order])] = 0
            valid = own[order][rows] == context[order][mine]
            found = np.zeros((len(own[order]), size))
            np.add.at(found, (rows[valid], coded[0][mine][valid]), n[mine][valid])
            base = shorter if order == 0 else shorter[np.searchsorted(own[order - 1], own[order] % size ** (order - 1))]
            all_n, kinds, unseen = found.sum(1, keepdims=True), (found > 0).sum(1, keepdims=True), found == 0
            free = (base * share * unseen).sum(1, keepdims=True)
            escape = np.divide(kinds, all_n + kinds, out=np.ones_like(all_n), where=all_n > 0) / np.where(free > 0, free, 1)
            shorter = np.where(unseen, base * np.where(all_n > 0, escape, 1), found / np.maximum(all_n + kinds, 1))
            if k == 0:
                tables.append([])
            tables[order].append(np.log(np.maximum(shorter, 1e-12)).astype(np.float32))
    firsts = np.cumsum([0, *map(len, own)])
    state = np.zeros(size**ORDER, np.int32)
    every = np.arange(size**ORDER)
    for order in range(1, ORDER + 1):
        tail = every % size**order
        rows = np.searchsorted(own[order], tail)
        rows[rows == len(own[order])] = 0
        state = np.where(own[order][rows] == tail, firsts[order] + rows, state).astype(np.int32) if len(own[order]) else state
    return Model(langs, symbol, state, np.concatenate([np.stack(t, axis=-1) for t in tables]))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from a sample of the labelled documents outside the held-out fold: about `sample_docs` whole texts of each language.

    The rate of a language follows from its count over all documents; a digest of the id draws the texts, so
    reruns agree. Grams are counted in tasks; what comes to the driver is bounded by the sample.
    """
    usable = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    per_lang = {row["lang"]: row["count"] for row in usable.groupBy("lang").count().collect()}
    if not per_lang:
        return None
    rates = F.create_map(*(x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))))
    drawn = (F.pmod(F.xxhash64(F.lit("ppm"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)) < rates[F.col("lang")]
    counted = usable.where(drawn).select("text", "lang").mapInArrow(_grams, "lang string, gram long, n long")
    return compile_model([tuple(row) for row in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`, from the text alone.

    The language of least code length wins, the first by name of equals; the score is its posterior among the
    languages at even odds. A text that is null or has no letter, or a model that learned nothing, gives `und`
    and 0. Texts are scored whole at any length; extra columns are ignored; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for part in slices(batches):
            ids, held, letter = (part.column(c) for c in ("doc_id", "held_out", "letter"))
            if frozen is None:
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                lengths = frozen.code_lengths(*utf8(part))
                best = lengths.argmin(axis=1)
                known = letter.to_numpy(zero_copy_only=False).astype(bool)
                scores = np.where(known, 1 / np.exp(lengths.min(axis=1, keepdims=True) - lengths).sum(axis=1), 0.0)
                names = [frozen.langs[k] if x else UNKNOWN for k, x in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text.alias("text"), held_out().alias("held_out"), letter.alias("letter")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
