"""Token counts (operator 3) by compiled finite-state transducers.

Pre-tokens are found by a deterministic transducer over character classes. A text is cut into chunks; stepping
all states through a chunk gives its state map; the maps compose associatively, so a parallel prefix scan over
them gives the state in which each chunk begins, and a second pass marks where pre-tokens start. What the transition
that ends a pre-token emits is the number of tokens that its byte-pair merges leave. That number is no property of a
transition between character classes: it is computed for each different word by the merges, for many words at once,
and kept by the word in a bounded table of the worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices

LIMIT = 2048
CHUNK = 64
#: Words whose counts a worker keeps; beyond that the table is emptied and grown anew.
MEMO = 1_000_000
#: Widths in bytes of the groups in which words are merged together; longer ones are merged one by one.
WIDTHS = (8, 16, 32)
NONE = np.int32(2**31 - 1)

#: Capitals of Unicode 16 and their small letters, which Python may not know yet.
NEW_CAPITALS = {0xA7CB: 0x264, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
HAS_NEW = re.compile(f"[{''.join(map(chr, NEW_CAPITALS))}]")

#: Character classes. The letters of 's 't 'm 'd, and of 're 've 'll, have their own.
SPACE, LETTER, NUMBER, QUOTE, OTHER, STMD, R, V, L, E = range(10)
#: States: before a pre-token, in letters, in other signs, after an opening quote, and after that quote with r, v or l.
START, WORD, SIGNS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
LETTERS = (LETTER, STMD, R, V, L, E)


def _transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, whether a pre-token starts here, whether one started a character ago) by state * 10 + class."""
    step, here, ago = np.zeros((7, 10), np.uint8), np.zeros((7, 10), bool), np.zeros((7, 10), bool)
    for state in range(7):
        for kind in range(10):
            if kind == SPACE:
                target, starts = START, False
            elif kind in LETTERS:
                target, starts = WORD, state != WORD
            elif kind == NUMBER:
                target, starts = START, True
            elif state in (SIGNS, QUOTED):  # a run of signs goes on
                target, starts = SIGNS, False
            else:
                target, starts = (QUOTED if kind == QUOTE else SIGNS), True
            if state == QUOTED and kind == STMD:
                target, starts = START, False
            elif state == QUOTED and kind in (R, V, L):
                target, starts = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], False
            elif state in (QUOTE_R, QUOTE_V) and kind == E or state == QUOTE_L and kind == L:
                target, starts = START, False
            elif state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no contraction: the letter began a word
                ago[state, kind] = True
                starts = starts and kind not in LETTERS
            step[state, kind], here[state, kind] = target, starts
    return step.ravel(), here.ravel(), ago.ravel()


STEP, HERE, AGO = _transitions()


@cache
def classes() -> np.ndarray:
    """The class of each code point, from the Unicode properties."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[list(map(ord, regex.findall(pattern, every)))] = kind
    for code in range(0x20000, 0x40000):  # ideographs that newer versions of Unicode have and the library has not
        table[code] = LETTER if unicodedata.category(chr(code))[0] == "L" else OTHER
    for kind, letters in ((STMD, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (QUOTE, "'")):
        table[[ord(c) for c in letters]] = kind
    return table


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """(chunks, 7): the state in which each chunk ends, for each in which it may begin. kinds: (chunks, CHUNK)."""
    maps = np.broadcast_to(np.arange(7, dtype=np.uint8), (len(kinds), 7))
    for at in range(kinds.shape[1]):
        maps = STEP[maps * np.uint8(10) + kinds[:, at, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """The composition of all maps up to each, in log n steps (Hillis and Steele)."""
    out, far = maps.astype(np.intp), 1
    while far < len(out):
        out[far:] = np.take_along_axis(out[far:], out[:-far], axis=1)
        far *= 2
    return out


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; the last character must be a space."""
    n = len(kinds)
    rows = np.full(-(-n // CHUNK) * CHUNK, SPACE, np.uint8)
    rows[:n] = kinds
    rows = np.ascontiguousarray(rows.reshape(-1, CHUNK))
    state = np.zeros(len(rows), np.uint8)
    state[1:] = prefix_scan(chunk_maps(rows))[:-1, START]
    moves = np.empty(rows.shape, np.uint8)
    for at in range(CHUNK):
        moves[:, at] = state * np.uint8(10) + rows[:, at]
        state = STEP[moves[:, at]]
    moves = moves.ravel()[:n]
    found = HERE[moves]
    found[:-1] |= AGO[moves][1:]
    return found


class Merges:
    """Byte-pair merges of the vocabulary, as counts of tokens by pre-token.

    Symbols are numbered for the merges alone: 0 to 255 the bytes, 256 to 511 the bytes that end a word, and
    512 + k what merge k makes. A merge is looked up by its pair of symbols.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        end = model["model"]["end_of_word_suffix"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves
        hidden = [b for b in range(256) if b not in set(visible)]
        signs = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        number = signs | {sign + end: 256 + b for sign, b in signs.items()}
        codes = np.empty(len(model["model"]["merges"]), np.int64)
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            codes[rank] = number[left] << 32 | number[right]
            number.setdefault(left + right, 512 + rank)
        self.made = np.array([number[l + r] for l, r in (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])], np.int32)
        order = np.argsort(codes)
        self.codes, self.ranks = np.append(codes[order], np.int64(1) << 62), np.append(order, NONE).astype(np.int32)
        self.rank = dict(zip(codes.tolist(), range(len(codes)), strict=True))
        self.memo: dict[str, int] = {}

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; NONE where there is no merge. Negative symbols are no symbols."""
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.codes, code)
        return np.where((self.codes[at] == code) & (right >= 0), self.ranks[at], NONE)

    def merged(self, word: bytes) -> int:
        """Tokens that the merges leave of a pre-token: the pair of least rank first, the leftmost of equals."""
        parts = [*word[:-1], 256 + word[-1]]
        rank, last = self.rank, len(parts)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        heap = [(r, i) for i in range(last - 1) if (r := rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        count = last
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or (j := after[i]) >= last or rank.get(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j], count = int(self.made[r]), -1, count - 1
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
                if (r := rank.get(parts[i] << 32 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank.get(parts[k] << 32 | parts[i])) is not None:
                heapq.heappush(heap, (r, k))
        return count

    def merged_many(self, words: list[bytes], width: int) -> np.ndarray:
        """`merged` for many words of up to `width` bytes, a merge of each at a time."""
        rows = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        columns = np.arange(width)
        parts = np.where(columns < sizes[:, None], rows, -1).astype(np.int32)
        parts[np.arange(len(words)), sizes - 1] += 256
        ranks = self.looked_up(parts[:, :-1], parts[:, 1:])
        counts, row = sizes.copy(), np.arange(len(words))
        while len(row):
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(row)), at]
            if not (live := rank < NONE).all():
                row, at, rank, parts, ranks = row[live], at[live], rank[live], parts[live], ranks[live]
            counts[row] -= 1
            every, beyond = np.arange(len(row)), columns[None, :-1] > at[:, None]
            parts[every, at] = self.made[rank]
            parts[:, :-1] = np.where(beyond, parts[:, 1:], parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(beyond[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[every, at] = self.looked_up(parts[every, at], parts[every, np.minimum(at + 1, width - 1)])
            ranks[every[at == width - 2], -1] = NONE
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.looked_up(parts[left, at[left] - 1], parts[left, at[left]])
        return counts

    def emitted(self, words: list[str]) -> np.ndarray:
        """The counts that the accepting transitions of the pre-tokens emit."""
        memo = self.memo
        by_width: dict[int, list[str]] = {}
        for word in set(words).difference(memo):
            size = len(word.encode())
            by_width.setdefault(next((w for w in WIDTHS if size <= w), 0), []).append(word)
        for width, own in by_width.items():
            counts = self.merged_many([w.encode() for w in own], width).tolist() if width else [self.merged(w.encode()) for w in own]
            memo.update(zip(own, counts, strict=True))
        out = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        if len(memo) > MEMO:
            memo.clear()
        return out

    def normalized(self, text: str) -> tuple[str, int]:
        """The text as the library normalizes it, special strings made spaces, and their number."""
        special = 0
        if "<|" in text:
            pieces = self.split.split(text)
            text, special = "\n".join(unicodedata.normalize("NFC", p) for p in pieces), len(pieces) - 1
        text = unicodedata.normalize("NFC", text)
        if not text.isascii():
            text = text.replace("Σ", "σ")  # a sigma by itself, wherever it stands
            text = text.translate(NEW_CAPITALS) if HAS_NEW.search(text) else text
        return text.lower(), special

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        plain, special = zip(*map(self.normalized, texts), strict=True)
        joined = "\n".join(plain) + "\n"
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        kinds = classes()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        begins = starts(kinds)
        borders = np.flatnonzero(begins | (kinds == SPACE))
        first = np.flatnonzero(begins[borders])
        at, to = borders[first], borders[first + 1]
        counts = self.emitted([joined[a:b] for a, b in zip(at.tolist(), to.tolist(), strict=True)])
        sums = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(at, np.concatenate([[0], ends]))]
        return np.diff(sums) + np.array(special)


@cache
def _merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of `docs`, with the vocabulary file at `path` (on every node).

    Null is an empty text: no bytes, no tokens. Texts are counted whole at any length. Rows with one doc_id
    are counted each for itself; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        for part in slices(batches):
            texts = part.column("text")
            tokens = merges.count([t or "" for t in texts.to_pylist()])
            size = pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op3_count_tokens(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Bytes and tokens of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(documents(spark, sf_dir), path).withColumn("over_limit", F.col("n_tokens") > LIMIT)
