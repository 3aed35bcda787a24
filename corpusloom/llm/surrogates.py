"""PII surrogates (operator 10): keyed replacements of one type, format, script and gender.

An entity is a type with a canonical value. A person is found by a title, and the words of the name are then names
wherever the document has them with a capital; each word has a surrogate of its own, so full, first and last names
of one person stay together. An entity's surrogate is a keyed permutation (a Feistel network over the
numbers of all values of the same shape, walked until it stays among them) that leaves no value as it is, so different
entities of a shape never share a surrogate and every mention of an entity, anywhere, gets the same one. A check over
the distinct entities of the corpus finds any two that came out equal, or one that is the value of another entity, and
they are permuted again under another key until none is left. Where keys alone don't help, as values of the shape run
out, names, addresses of mail and secrets get more letters, and numbers of a form share one permutation again.

Not found are persons without a title anywhere in the document. A telephone number of ten digits is one entity with
and without +1; other national forms are entities of their own. An address of mail is one entity in any capitals.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, slices
from corpusloom.sources.tables import cut

KEY = b"surrogates/1"
ROUNDS, TRIES = 6, 16
#: From this attempt on, surrogates of free length get more letters than the shape has.
WIDER = 6
#: Kinds whose surrogates have the length of the value.
FIXED = ("ip", "ssn", "card", "phone", "iban")
#: Entities that needed another key and go to every task; beyond that each document gets its own by a join.
MAX_SHARED = 100_000
MEMO = 200_000

VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Letters that stand for each other, by script: fixed values.
CLASSES = ("0123456789", VOWELS, CONSONANTS, VOWELS.upper(), CONSONANTS.upper(), "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
CLASS_OF = {c: k for k, signs in enumerate(CLASSES) for c in signs}
#: Forms of address, which stay and so keep the gender: fixed values.
TITLES = "Dr\\.?|Dra\\.|Doctor|Doktor|Docteur|Doctora|Prof\\.?|Professor|Professorin|Professeur|Profesora?|Sir|Dame|Lord|Lady|Rev\\.?|Mx\\.?|Доктор|Профессор|Mrs?\\.?|Ms\\.?|Miss|Mister|Herrn?|Frau|Señora?|Señorita|Sra?\\.|Monsieur|Madame|Mademoiselle|Mme\\.?|Mlle\\.?|Господин|Госпожа|Κύριος|Κυρία"

AT = re.compile("@")
#: Letters of addresses: Latin with its accents, Greek, Cyrillic.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u04ff"
LOCAL, DOMAIN = re.compile(rf"[{LETTERS}0-9_.+%-]{{1,64}}\Z"), re.compile(rf"[{LETTERS}0-9](?:[{LETTERS}0-9-]{{0,62}}\.)+[{LETTERS}]{{2,24}}")
#: What may hold a number, and the forms in it; an address of four numbers is not taken for the end of a telephone number.
NUMBERS = re.compile(r"(?<![\w@])[+(]?\d[\d().\- ]{5,}\d")
FORMS = re.compile(
    r"(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{13,19})(?!\d))"
    r"|(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|\+\d{1,3}(?:[ -]?(?!\d{1,3}\.\d{1,3}\.)\(?\d{2,5}\)?){2,5}(?!\d)"
    r"|\(\d{2,5}\)[ -]?\d{3,4}[ -]?\d{3,4}(?!\d)"
    r"|(?<!\d)\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d))"
)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SECRET = re.compile(r"[=:]\s*[\"']?([A-Za-z0-9_\-+/]{16,})")
SECRET_NAME = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential)[\"']?\s*\Z", re.IGNORECASE)
TITLED = re.compile(rf"(?:{TITLES})\Z")
NAMED = re.compile(rf"\b(?:(?:{TITLES})\s{{1,2}})+((?!(?:{TITLES})(?!\w))(?:[^\W\d_a-zà-ÿ][^\W\d_]+(?:-[^\W\d_]+)?)(?: [^\W\d_a-zà-ÿ][^\W\d_]+(?:-[^\W\d_]+)?){{0,2}})")
NAME_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    value: str  # canonical


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def _canonical(kind: str, found: str) -> str | None:
    """The value behind a number in one of the forms; None if it is none after all: a card's check digit must fit."""
    digits = re.sub(r"\D", "", found)
    if kind == "ip":
        parts = [int(x) for x in found.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 else None
    if kind == "card":
        return digits if luhn(digits) else None
    if kind == "phone":  # a number of ten digits is the same with and without the country before it
        if len(digits) == 10 and found[0] != "+" and digits[0] > "1":
            return f"+1{digits}"
        return ("+" if found[0] == "+" else "") + digits if 8 <= len(digits) <= 15 else None
    return digits


def _lower(word: str) -> str:
    """A name in small letters, one for each."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in word)


def names(text: str) -> list[Mention]:
    """The names after titles and, in the same document, every run of their words with capitals."""
    titled = list(NAMED.finditer(text))
    known = {_lower(w) for m in titled for w in m[1].split(" ") if not TITLED.match(w)}
    out = [Mention(*m.span(1), "name", _lower(m[1])) for m in titled]
    runs: list[list[int]] = []
    for m in NAME_WORD.finditer(text) if known else ():
        if not m[0][0].islower() and _lower(m[0]) in known:
            if runs and m.start() == runs[-1][1] + 1 and text[runs[-1][1]] == " ":
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
    return out + [Mention(a, b, "name", _lower(text[a:b])) for a, b in runs]


def parts(m: Mention) -> list[tuple[str, str]]:
    """The entities that get surrogates: each word of a name."""
    return [(m.kind, w) for w in m.value.split(" ")] if m.kind == "name" else [(m.kind, m.value)]


def n_distinct(found: list[Mention]) -> int:
    """The different entities of a document; a name whose words are among those of another is the same person."""
    persons: dict[str, list[frozenset]] = {}
    count = len({(m.kind, m.value) for m in found if m.kind != "name"})
    for own in sorted({frozenset(m.value.split(" ")) for m in found if m.kind == "name"}, key=len, reverse=True):
        if not any(own <= p for p in min((persons.get(w, []) for w in own), key=len)):
            count += 1
            for w in own:
                persons.setdefault(w, []).append(own)
    return count


def mentions(text: str) -> list[Mention]:
    """The entities of a text in order, none overlapping; the earliest and of those the longest wins."""
    found: list[Mention] = []
    for at in AT.finditer(text):
        k = at.start()
        if (left := LOCAL.search(text[max(0, k - 64) : k])) and (right := DOMAIN.match(text, k + 1)):
            own = text[k - len(left[0]) : right.end()]
            found.append(Mention(k - len(left[0]), right.end(), "email", _lower(own)))
    for segment in NUMBERS.finditer(text):
        if text[segment.end() : segment.end() + 1].isalpha():
            continue
        for m in FORMS.finditer(text, *segment.span()):
            if (value := _canonical(m.lastgroup if m.lastgroup != "gap" else "card", m[0])) is not None:
                found.append(Mention(*m.span(), "card" if m["card"] else m.lastgroup, value))
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and _remainder(plain) == 1:
            found.append(Mention(*m.span(), "iban", plain))
    for m in SECRET.finditer(text):
        if SECRET_NAME.search(text[max(0, m.start() - 24) : m.start()]) and re.search(r"\d", m[1]):
            found.append(Mention(*m.span(1), "secret", m[1]))
    found += names(text)
    found.sort(key=lambda x: (x.start, -x.end))
    out: list[Mention] = []
    for m in found:
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


def _mixed(right: int, turn: int, length: int, person: bytes, key: bytes) -> int:
    out = b""
    while len(out) < length:
        out += hashlib.blake2b(right.to_bytes(length, "big") + bytes([turn, len(out) // 64]), key=key, person=person, digest_size=64).digest()
    return int.from_bytes(out[:length], "big")


def permuted(value: int, size: int, tweak: bytes, key: bytes = KEY, back: bool = False) -> int:
    """A keyed permutation of the numbers below `size`, another for each tweak; `back`: its inverse."""
    half = ((size - 1).bit_length() + 1) // 2
    mask, length, person = (1 << half) - 1, (half + 7) // 8, hashlib.blake2b(tweak, digest_size=16).digest()
    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (_mixed(left, turn, length, person, key) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, turn, length, person, key) & mask)
        value = left << half | right
        if value < size:
            return value


def moved(value: int, size: int, tweak: bytes, key: bytes = KEY) -> int:
    """A keyed permutation of the numbers below `size` that leaves none of them as it is: in the order of one permutation, the number so many places on."""
    if size < 2:
        return value
    step = 1 + int.from_bytes(hashlib.blake2b(tweak, key=key, digest_size=8).digest(), "big") % (size - 1)
    return permuted((permuted(value, size, tweak, key) + step) % size, size, tweak, key, True)


@cache
def _script(script: str, category: str) -> str:
    """The letters of a script and category that stand in no class and keep their number of characters in the other case."""
    signs = map(chr, range(128, sys.maxunicode + 1))
    return "".join(c for c in signs if c not in CLASS_OF and unicodedata.category(c) == category and len(c.upper()) == len(c.lower()) == 1 and unicodedata.name(c, "").split(" ")[0] == script)


@cache
def pool(sign: str) -> str | None:
    """The signs that may stand for one: its class, or else the letters of its script, of its own 256 code points if they are ten or more. None: it stays."""
    if (k := CLASS_OF.get(sign)) is not None:
        return CLASSES[k]
    if not sign.isalpha():
        return None
    every = _script(unicodedata.name(sign, "").split(" ")[0], unicodedata.category(sign))
    near = "".join(c for c in every if ord(c) >> 8 == ord(sign) >> 8)
    found = near if len(near) >= 10 else every
    return found if sign in found else None


def reshaped(text: str, tweak: str, key: bytes = KEY) -> str:
    """`text` with each digit and letter replaced by one of its class, as one permutation over all texts of that shape."""
    shape = [pool(c) for c in text]
    number, size = 0, 1
    for c, own in zip(text, shape, strict=True):
        if own:
            number, size = number * len(own) + own.index(c), size * len(own)
    told = "".join(c if not own else chr(1 + CLASS_OF[c]) if c in CLASS_OF else f"<{own[0]}>" for c, own in zip(text, shape, strict=True))
    number = moved(number, size, (tweak + "|" + told).encode(), key)
    out = list(text)
    for at in range(len(text) - 1, -1, -1):
        if own := shape[at]:
            number, rest = divmod(number, len(own))
            out[at] = own[rest]
    return "".join(out)


def _remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def family(kind: str, value: str) -> str:
    """What shares a permutation with an entity whose surrogate can't get longer: the values of its form. Else the entity itself."""
    if kind == "card":
        return f"{value[0]}/{len(value)}"
    if kind == "phone":
        return f"{value[:2] if value[0] == '+' else ''}/{len(value)}"
    if kind == "iban":
        return value[:2] + "".join("0" if c.isdigit() else "A" for c in value[4:])
    return "" if kind in ("ip", "ssn") else value


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical replacement of an entity. Attempts use different keys."""
    tweak, more = f"{kind}/{attempt}", max(0, attempt - WIDER + 1)
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        number = moved(int.from_bytes(bytes(parts), "big"), 1 << 32, tweak.encode(), key)
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "email":  # the top-level domain stays
        local, _, rest = value.partition("@")
        head, _, top = f"{local}{'a' * more}@{rest}".rpartition(".")
        return f"{reshaped(head, f'{tweak}/{top}', key)}.{top}"
    if kind == "card":  # the issuer's digit stays, and the check digit fits again
        head = value[0] + reshaped(value[1:-1], f"{tweak}/{value[0]}/checked", key)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))
    if kind == "phone":  # a country's first digit stays
        keep = 2 if value[0] == "+" else 0
        return value[:keep] + reshaped(value[keep:], f"{tweak}/{value[:keep]}", key)
    if kind == "iban":
        body = reshaped(value[4:], f"{tweak}/{value[:2]}", key)
        return f"{value[:2]}{98 - _remainder(value[:2] + '00' + body):02d}{body}"
    if kind == "name":  # a last letter that may mark the gender stays; wide signs are syllables or words
        ends = len(value) > 2 and unicodedata.east_asian_width(value[-1]) != "W"
        first, kept = (value[:-1], value[-1]) if ends else (value, "")
        sign = next((c for c in reversed(first) if pool(c)), "a")
        first += (sign.lower() if len(sign.lower()) == 1 and pool(sign.lower()) else sign) * more
        return reshaped(first, f"{tweak}/{len(first)}/{kept}", key) + kept
    if kind == "ssn":
        return reshaped(value, tweak, key)
    value += "0" * more
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):  # a hexadecimal secret stays one
        number = moved(int(value, 16), 16 ** len(value), f"{tweak}/hex/{len(value)}".encode(), key)
        return f"{number:0{len(value)}{'x' if value == value.lower() else 'X'}}"
    return reshaped(value, tweak, key)


def formatted(kind: str, mention: str, canonical: str) -> str:
    """The canonical surrogate in the format of a mention: its signs and its capitals."""
    if kind == "email":
        at = mention.index("@")
        mention = mention[:at] + "a" * (len(canonical) - len(mention)) + mention[at:]
        return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, canonical, strict=True))
    if kind == "name":  # word by word; letters that were added stand before the last
        out = []
        for m, c in zip(mention.split(" "), canonical.split(" "), strict=True):
            m = m[:-1] + (m[-1] if m.isupper() else m[-1].lower()) * (len(c) - len(m)) + m[-1]
            out.append("".join(y.upper() if x.isupper() else y for x, y in zip(m, c, strict=True)))
        return " ".join(out)
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(canonical.lstrip("+")[-sum(c.isalnum() for c in mention) :])  # a national mention goes without the country
        return "".join(next(signs) if m.isalnum() else m for m in mention)
    return canonical


class Replacer:
    """Replaces the mentions of texts; `attempts` holds the entities that needed another key."""

    def __init__(self, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> None:
        self.attempts, self.key, self.memo = attempts, key, {}

    def canonical(self, kind: str, value: str, attempts: dict[tuple[str, str], int]) -> str:
        told = kind, value, attempts.get((kind, value), 0)
        if (out := self.memo.get(told)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            out = self.memo[told] = surrogate(*told, self.key)
        return out

    def replace(self, text: str | None, own: dict[tuple[str, str], int] | None = None) -> tuple[str | None, list[str], int]:
        """The new text, the kind of each mention, and the number of different entities."""
        if not text or not (found := mentions(text)):
            return text, [], 0
        attempts, out, end = self.attempts if own is None else own, [], 0
        for m in found:
            out += [text[end : m.start], formatted(m.kind, text[m.start : m.end], " ".join(self.canonical(*x, attempts) for x in parts(m)))]
            end = m.end
        return "".join([*out, text[end:]]), [m.kind for m in found], n_distinct(found)


def entities(docs: DataFrame) -> DataFrame:
    """The distinct entities (kind, value) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = sorted({x for t in part.column("text").to_pylist() if t for m in mentions(t) for x in parts(m)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["kind", "value"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string").distinct()


def rekeyed(found: DataFrame, key: bytes = KEY, tries: int = TRIES) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is the value of an entity or another's surrogate, each with the attempt that fits.

    All but the first by value of those that share a surrogate go on to the next attempt, and the check is made
    again over all, until nothing clashes. An attempt is at least the number of the round, so that from round WIDER
    on names, addresses of mail and secrets that still clash get longer values; from then on only a value of its own,
    not that of another entity, is refused, for a form may have no other left. A form that can't grow (numbers) then
    takes one attempt for all its entities together: that is one permutation without a fixed point, so none of them
    clash, however full the form is. Raises RuntimeError after `tries` rounds.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempts = (batch.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            new = [surrogate(*x, key) for x in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(family, kinds, values), pa.string()), pa.array(new, pa.string())], ["kind", "value", "attempt", "family", "new"])

    found = cut(found.select("kind", "value"))
    current = found.withColumn("attempt", F.lit(0))
    for turn in range(tries):
        new = cut(current.mapInArrow(made, "kind string, value string, attempt int, family string, new string"))
        first = new.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("value").alias("first")).where("n > 1")
        real = new.where(F.col("attempt") < WIDER).join(found.select("kind", F.col("value").alias("new")), ["kind", "new"], "left_semi")
        own, shared = new.where("new = value"), new.join(first, ["kind", "new"]).where("value <> first")
        clash = cut(reduce(DataFrame.unionByName, (x.select("kind", "value", "family") for x in (real, own, shared))).distinct())
        if clash.isEmpty():
            return current.where("attempt > 0")
        fixed = F.col("kind").isin(*FIXED) if turn >= WIDER else F.lit(False)
        single = new.join(clash.where(~fixed).select("kind", "value", F.lit(1).alias("clash")), ["kind", "value"], "left")
        if turn >= WIDER:  # forms that can't grow move as a whole
            forms = clash.where(fixed).select("kind", "family", F.lit(1).alias("form")).distinct()
            single = single.join(forms, ["kind", "family"], "left")
        else:
            single = single.withColumn("form", F.lit(None).cast("int"))
        later = F.greatest(F.col("attempt"), F.lit(turn)) + 1
        current = cut(single.select("kind", "value", F.when(F.col("form") == 1, F.lit(WIDER + 1)).when(F.col("clash") == 1, later).otherwise(F.col("attempt")).cast("int").alias("attempt")))
    raise RuntimeError(f"surrogates still clash after {tries} attempts")


def replace_pii(docs: DataFrame, key: bytes = KEY, max_shared: int = MAX_SHARED) -> DataFrame:
    """`docs` with every text rewritten, and n_entities, n_distinct (longs) and kinds (array, one for each mention).

    Null, empty and clean texts stay as they are. Rows that repeat a doc_id, and equal entities anywhere, get
    equal surrogates; reruns under one key agree. Other columns pass through; those that have the name of a new
    one are replaced. An empty table gives no rows. Texts are read whole.
    """
    columns = [c for c in docs.columns if c not in ("n_entities", "n_distinct", "kinds", "_own", "_text")]
    docs = docs.select(*columns)
    again = cut(rekeyed(entities(docs), key))
    shared = again.limit(max_shared + 1).collect()
    few = len(shared) <= max_shared
    if few:
        attempts = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in shared})
        taken = docs
    else:
        attempts, taken = None, _with_own(docs, again)
    extra = "n_entities long, n_distinct long, kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = Replacer(attempts.value if few else {}, key)
        for part in slices(batches):
            owns = [None] * part.num_rows if few else [{(x["kind"], x["value"]): x["attempt"] for x in own or ()} for own in part.column("_own").to_pylist()]
            done = [replacer.replace(t, own) for t, own in zip(part.column("text").to_pylist(), owns, strict=True)]
            at = columns.index("text")
            arrays = [part.column(c) for c in columns]
            arrays[at] = pa.array([d[0] for d in done], pa.string())
            arrays += [pa.array([len(d[1]) for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_entities", "n_distinct", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return taken.mapInArrow(run, f"{schema}, {extra}")


def rewritten(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """`docs` with surrogates in the texts and, where there is n_chars, the new number of characters: the same columns."""
    out = replace_pii(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _with_own(docs: DataFrame, again: DataFrame) -> DataFrame:
    """`docs` with the entities of `again` that each text mentions, as the column _own. Rows are told apart by their texts, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = sorted({(k, *x) for k, t in enumerate(part.column("text").to_pylist()) if t for m in mentions(t) for x in parts(m)})
            yield pa.RecordBatch.from_arrays([part.column("_text").take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], ["_text", "kind", "value"])

    text = F.md5(F.col("text").cast("string"))
    told = docs.select(text.alias("_text"), F.col("text").cast("string")).where("text is not null").mapInArrow(run, "_text string, kind string, value string").distinct()
    own = told.join(again, ["kind", "value"]).groupBy("_text").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_own"))
    return docs.join(own, text == F.col("_text"), "left").drop("_text")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after replacement."""
    return replace_pii(documents(spark, sf_dir)).select("doc_id", "text", "n_entities", "n_distinct", "kinds")
