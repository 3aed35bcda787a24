"""The corpus operators against brute force, and their defined results for nulls, empty, long, repeated and clashing input."""

import hashlib
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chunks, decontaminate, language, licenses, mixing, near_texts, quality, simhash, suffixes, surrogates, token_counts

chunks_module = chunks
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with what the operators add.
EXTRA = ("size", "kept", "print", "row", "target", "n_entities", "found", "component_id", "given", "range", "key", "one")
rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]


def prose(n, words=VOCABULARY, seed=None):
    r = random.Random(seed) if seed is not None else rnd
    return " ".join(r.choice(words) for _ in range(n))


def frame(spark, texts, lang="en", source="s"):
    data = [(i, t, lang, source, len(t or "")) for i, t in texts]
    out = spark.createDataFrame(data, DOCS)
    return out.select("*", *(F.lit("clash").alias(c) for c in EXTRA)).repartition(3)


EDGES = [(900, None), (901, ""), (902, " \t\n "), (903, "word"), (904, prose(30_000, seed=5)), (905, "same text twice"), (905, "same text twice"), (906, "é" * 3000), (None, "a row without an id"), (907, "a\u0000b   \U0001f600 end")]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


APPLY = {
    "licenses": lambda d: licenses.scan(d),
    "quality": lambda d: quality.judge(d),
    "quality kept": lambda d: quality.kept(d),
    "tokens": lambda d: token_counts.count_tokens(d, path()),
    "mix": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed(d),
    "language": lambda d: language.predict(d, language.learn(d)),
    "suffixes": lambda d: suffixes.removed(d),
    "chunks": lambda d: chunks.marked(d),
    "simhash": lambda d: simhash.components(d),
    "near_dedup": lambda d: near_texts.near_dedup(d),
    "overlaps": lambda d: decontaminate.overlaps(d, bench(d.sparkSession)),
    "decontaminate": lambda d: decontaminate.decontaminate(d, bench(d.sparkSession)),
    "pii": lambda d: surrogates.replace_pii(d),
    "pii rewritten": lambda d: surrogates.rewritten(d),
}
ROW_FOR_ROW = {"quality", "tokens", "mix", "language", "suffixes", "chunks", "simhash", "pii", "pii rewritten"}


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")


@pytest.mark.parametrize("name", APPLY)
def test_edges(spark, name):
    """Nulls in any column, empty, blank, very long and odd texts, repeated rows, an empty table, and extra columns."""
    docs = frame(spark, EDGES).withColumn("source", F.when(F.col("doc_id") != 903, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") != 904, F.col("lang")))
    got = APPLY[name](docs)
    if name in ROW_FOR_ROW:
        assert got.count() == len(EDGES)
    else:
        got.collect()
    assert APPLY[name](docs.limit(0)).count() == 0
    if name in ("quality kept", "near_dedup", "decontaminate", "pii rewritten"):
        assert got.columns == docs.columns


def test_license_scan(spark):
    texts = [(1, prose(80) + ". Released under the MIT License. " + prose(40)), (2, prose(100)), (3, licenses.TEMPLATES[9][2]), (4, licenses.TEMPLATES[7][2].replace("WARRANTIES", "PROMISES")), (5, "under the MIT license"), (6, prose(500) + "\n" + licenses.TEMPLATES[3][2].upper())]
    expected = set()
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, t in texts:
        for name, _, wording in licenses.TEMPLATES:
            own = shingles(words(wording))
            if len(own & shingles(words(t))) >= 0.8 * len(own):
                expected.add((i, name))
    got = licenses.scan(frame(spark, texts))
    assert {(r["doc_id"], r["template_id"]) for r in got.collect()} == expected and (4, "apache-2-header") in expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert (1 - 0.7375 / (2 - 0.7375)) ** licenses.bands() <= 0.001


def test_license_scan_of_many_templates(spark):
    """Four hundred templates of 5 to 300 words, from a table; texts hold some whole, some with edits."""
    r = random.Random(6)
    wide = ["".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(5000)]
    templates = [(f"t{k}", "L", prose(r.choice([5, 9, 40, 300]), wide, seed=500 + k)) for k in range(400)]
    texts = []
    for i in range(60):
        parts = []
        for k in r.sample(range(400), 3):
            w = templates[k][2].split()
            parts += [prose(r.randint(0, 60), wide), " ".join("edit" if len(w) > 20 and r.random() < 0.02 else x for x in w)]
        texts.append((i, " ".join(parts)))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = {t: shingles(x.split()) for t, _, x in templates}
    expected = {(i, t) for i, x in texts for s in [shingles(x.split())] for t, o in own.items() if len(o & s) >= 0.8 * len(o)}
    got = licenses.scan(frame(spark, texts), spark.createDataFrame(templates, "template_id string, license string, wording string"))
    found = {(x["doc_id"], x["template_id"]) for x in got.collect()}
    assert found <= expected and len(found) >= 0.995 * len(expected) and len(expected) > 100
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, texts), (("x", "L", "too short"),))


def test_quality_measures(spark):
    texts = [(i, "\n".join(prose(rnd.randint(0, 12), VOCABULARY[:9]) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", " #$ a|b", "\n\n"])) for i in range(60)] + EDGES
    expected = []
    for i, t in texts:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = quality.judge(frame(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got) == sorted(expected, key=str)
    english = prose(200, ["the", "cache", "of", "a", "router", "is", "and", "model", "to", "learns", *VOCABULARY[:80]])
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, [(1, english), (2, " | ".join(english.split())), (3, "the of and " * 100)])).collect()}
    assert verdicts == {1: True, 2: False, 3: False}


def test_no_text_is_too_long_for_the_rules(spark):
    """The count of words alone rejects no text from above."""
    names = {x for r in quality.RULES for x in (r.numerator, r.denominator)} - {"one", "n_words"}
    told = spark.range(1).select(F.lit(1).alias("one"), F.lit(10_000_001).alias("n_words"), *(F.lit(0).alias(n) for n in sorted(names)))
    assert told.select(quality.passes(tuple(r for r in quality.RULES if r.name == "words")).alias("ok")).first()["ok"]


def test_token_counts_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(path())
    signs = [*"abc'strevlLSd  \n\t!?12٣é ΣσİßA<|>", "é", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", "😀", "中", "\x1c", "\x85", "Ⅷ", "²"]
    r = random.Random(2)
    texts = [(i, "".join(r.choices(signs, k=r.randint(0, 60)))) for i in range(400)] + [(500, "x" * 5000), (501, "!" * 700 + "'s'" * 50), (502, None), (503, "word " * 9000)]
    got = {x["doc_id"]: (x["n_bytes"], x["n_tokens"]) for x in token_counts.count_tokens(frame(spark, texts), path()).collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts}


def test_chunk_maps_compose():
    kinds = np.array([rnd.randrange(10) for _ in range(64 * 37)], np.uint8)
    state, expected = 0, []
    for kind in kinds.tolist():
        expected.append(state)
        state = int(token_counts.STEP[state * 10 + kind])
    scanned = token_counts.prefix_scan(token_counts.chunk_maps(kinds.reshape(-1, 64)))
    assert scanned[:-1, 0].tolist() == expected[64::64]


def test_mixing(spark):
    sizes = {"a": 900, "b": 40, None: 300, "c": 2000, "B": 10}
    data = [(i, prose(r.randint(0, 20)), "en", s, 0) for s, n in sizes.items() for r in [random.Random(str(s))] for i in range(1000 * list(sizes).index(s), 1000 * list(sizes).index(s) + n // 10)]
    docs = spark.createDataFrame(data, DOCS)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data) and rows(mixing.mix(docs.repartition(5))) == sorted((tuple(r) for r in got), key=str)
    own = defaultdict(int)
    for _, text, _, s, _ in data:
        own[s] += len(text.split())
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free, left, target = set(own), 1.5 * sum(own.values()), {}
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * own[s]
            left -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    source = {(i, len(t.split())): s for i, t, _, s, _ in data}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == own[s] and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) < 1 for s in own)


def test_mixing_prefers_quality(spark):
    good, poor = "one line\nanother line\nthird line\nfourth line", "\n".join(["same line here"] * 4)
    docs = spark.createDataFrame([(i, good if i % 2 else poor, "en", "s" if i < 2000 else "t", 0) for i in range(2400)], DOCS)
    got = mixing.mix(docs, weights=(1, 100), share=0.5).where("source_size > 10000").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("n"), F.max("epochs").alias("e")).collect()
    n = {r["good"]: r["n"] for r in got}
    assert n[1] > 1.5 * n[0]


def test_language(spark):
    alphabets = {"aa": [w + "e" for w in VOCABULARY[:200]], "bb": [w[::-1] + "o" for w in VOCABULARY[200:]]}
    data = [(i, prose(40, alphabets[x]) if i % 17 else "123 !", x if i % 5 else None, "s", 0) for i in range(400) for x in [["aa", "bb"][i % 2]]]
    got = language.predict(docs := spark.createDataFrame(data, DOCS), language.learn(docs)).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] % 17 == 0 else ["aa", "bb"][r["doc_id"] % 2])
    assert language.learn(docs.where("lang is null")) is None
    relabelled = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert rows(language.predict(relabelled, language.learn(relabelled))) == sorted((tuple(r) for r in got), key=str)


def test_code_lengths_are_those_of_the_tree():
    """Probabilities of every context sum to one over all bytes, and a text's code length is the sum over its bytes."""
    text = b"abracadabra abra"
    counts = Counter()
    padded = b"\0\0\0" + text
    for k in range(len(text)):
        counts[int.from_bytes(padded[k : k + 4], "big")] += 1
    model = language.compile_model([("x", g, n) for g, n in counts.items()])
    p = np.exp(model.log_p[:, :, 0].astype(float))
    seen = len(np.unique(list(text) + [0]))
    assert (p[:, :-1].sum(1) + p[:, -1] * (256 - seen)) == pytest.approx(1, abs=1e-4)
    total, size = 0.0, model.log_p.shape[1]
    symbols = [int(model.symbol[b]) for b in padded]
    for k in range(3, len(symbols)):
        context = symbols[k - 1] + symbols[k - 2] * size + symbols[k - 3] * size**2
        total -= float(model.log_p[model.state[context], symbols[k], 0])
    assert model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0] == pytest.approx(total, rel=1e-5)


def ppm(counts, context, byte, told):
    """The probability of a byte after a context by the definition: method C with exclusion, contexts as bytes, the longest first. `told` keeps what was computed."""
    if (context, byte) not in told:
        told[context, byte] = escaped(counts.get(context, {}), lambda b: ppm(counts, context[1:], b, told) if context else 1 / 256, byte)
    return told[context, byte]


def escaped(own, shorter, byte):
    if not own:
        return shorter(byte)
    n, kinds = sum(own.values()), len(own)
    if byte in own:
        return own[byte] / (n + kinds)
    free = sum(shorter(b) for b in range(256) if b not in own)
    return kinds / (n + kinds) * shorter(byte) / free


def test_code_lengths_are_those_of_the_definition():
    """Two small languages, contexts counted apart, against the recursion over probabilities."""
    texts = {"x": ["abracadabra abra", "banana cabana Banana", "zebra"], "y": ["der die das dem", "den dessen deren", "ab und an"]}
    grams, counts, total = [], {}, Counter()
    for lang, own in texts.items():
        counts[lang] = defaultdict(Counter)
        for text in own:
            raw = b"\0\0\0" + text.lower().encode()
            for k in range(3, len(raw)):
                grams.append((lang, int.from_bytes(raw[k - 3 : k + 1], "big")))
                total[raw[k - 3 : k]] += 1
                for order in range(4):
                    counts[lang][raw[k - order : k]][raw[k]] += 1
    for lang in counts:  # rare contexts of order three have no state
        for context in [c for c in counts[lang] if len(c) == 3 and total[c] < language.MIN_SEEN]:
            del counts[lang][context]
    model = language.compile_model([(lang, g, n) for (lang, g), n in Counter(grams).items()])
    told = {lang: {} for lang in counts}
    for text in ("a banana abra", "die Zebra und q?", "dem"):
        raw = b"\0\0\0" + text.lower().encode()
        expected = [-sum(np.log(ppm(counts[lang], raw[k - 3 : k], raw[k], told[lang])) for k in range(3, len(raw))) for lang in model.langs]
        data = np.frombuffer(text.encode(), np.uint8)
        assert model.code_lengths(data, np.array([0, len(data)]))[0] == pytest.approx(expected, rel=1e-4)


def brute_removed(texts, length):
    seen = Counter(b[k : k + length] for _, t in texts for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        yield i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(raw, gone, strict=True) if not x)).hexdigest()


@pytest.mark.parametrize("length", [130, 400])
def test_suffix_dedup(spark, length):
    r = random.Random(length)
    shared = [prose(130, seed=k) for k in range(5)]
    texts = []
    for i in range(40):
        p, q = r.choice(shared), r.choice(shared)
        low = r.randint(0, 250)
        texts.append((i, prose(r.randint(1, 50)) + p[low : r.randint(low, len(p))] + prose(r.randint(1, 50)) + q[r.randint(0, 300) :] * (r.random() < 0.4)))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (3, texts[3][1]), (7, prose(200)), (200, None), (201, ""), (202, "a" * 1200), (203, "ab" * 700), (204, "line of text number one\n" * 50), (206, shared[0] + shared[1]), (207, shared[1] + shared[0])]
    texts += [(None, prose(9) + shared[2]), (None, prose(120)), (None, texts[5][1])]
    assert rows(suffixes.removed(frame(spark, texts), length)) == sorted(brute_removed(texts, length), key=str)


def test_suffix_dedup_returns_what_stays(spark, tmp_path):
    """The runs and the bytes, of which the query's figures come, and the text: without the shared passage, whatever the cuts go through."""
    passage = prose(120, seed=1)
    texts = [(1, prose(60, seed=2) + "<" + passage + ">" + prose(60, seed=3)), (2, passage + "|" + prose(60, seed=4)), (3, prose(90, seed=5)), (4, "á" * 300 + "éx"), (5, "á" * 300 + "öy"), (6, None), (7, ""), (8, prose(9) + " " + passage[:399])]
    raw = {i: (t or "").encode() for i, t in texts}
    got = {r["doc_id"]: r for r in suffixes.deduplicated(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and [(s["start"], s["end"]) for s in got[2]["spans"]] == [(0, len(passage))]
    for i, r in got.items():
        gone = bytearray(len(raw[i]))
        for s in r["spans"]:
            gone[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert bytes(r["kept"]) == bytes(b for b, x in zip(raw[i], gone, strict=True) if not x)
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    told = suffixes.op6_suffix_dedup(spark, str(tmp_path))
    assert told.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert rows(told.drop("kept_text")) == sorted(brute_removed(texts, 400), key=str)
    text = {r["doc_id"]: r["kept_text"] for r in told.collect()}
    assert text[1] == texts[0][1].replace(passage, "") and text[2] == "|" + prose(60, seed=4) and text[4] == "\ufffdx"
    assert text[3] == texts[2][1] and text[8] == texts[7][1] and text[6] == text[7] == ""
    assert text == {i: bytes(r["kept"]).decode("utf-8", "replace") for i, r in got.items()}


def test_records_of_suffixes_go_out_in_even_batches():
    """A batch for each of many short texts costs more than their records; one for a long repetitive text has no bound."""
    rows = ((k, k, -k, 7, k, k, 1) for k in range(2 * suffixes.BATCH + 5))
    batches = list(suffixes._records(rows, pa.int64()))
    assert [b.num_rows for b in batches] == [suffixes.BATCH, suffixes.BATCH, 5]
    assert batches[1].to_pylist()[0] == dict(zip(["doc_id", *suffixes.RECORD], (suffixes.BATCH, suffixes.BATCH, -suffixes.BATCH, 7, suffixes.BATCH, suffixes.BATCH, 1), strict=True))
    assert not list(suffixes._records((), pa.int64()))


def test_suffix_dedup_takes_any_ids(spark):
    texts = [("a", prose(90, seed=1)), ("b", prose(90, seed=1)), ("b", prose(90, seed=2))]
    got = suffixes.removed(spark.createDataFrame(texts, "doc_id string, text string"))
    assert {(r["doc_id"], r["n_removed"] > 0) for r in got.collect()} == {("a", True), ("b", True), ("b", False)}


def test_chunking_resists_shifts(spark):
    passage = prose(300, seed=1)
    texts = [(1, prose(90) + " " + passage + " " + prose(90)), (2, prose(7) + " " + passage + " " + prose(60)), (3, prose(400, seed=9)), (4, prose(90, seed=4)), (5, prose(90, seed=4)), (6, "")]
    got = {r["doc_id"]: r for r in chunks.marked(frame(spark, texts)).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["n_dup_chunks"] > 5
    assert got[2]["n_removed"] > 0.8 * len(passage) and len(got[2]["kept_text"]) == len(texts[1][1]) - got[2]["n_removed"]
    assert got[3]["n_dup_chunks"] == got[3]["n_removed"] == 0 and got[3]["kept_text"] == texts[2][1]
    assert got[4]["n_removed"] == 0 and got[5]["n_removed"] == len(texts[4][1]) and got[5]["kept_text"] == ""
    data = np.frombuffer(passage.encode(), np.uint8)
    direct = 0
    for k, b in enumerate(data.tolist()):
        direct = (direct << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        assert k < 31 or direct == int(chunks.gear(data)[k])


def brute_chunks(texts):
    """Chunks by rolling over each byte, digests by counting all of them, runs by walking over the chunks."""
    import xxhash

    own = {}
    for i, text in texts:
        raw, value, start, chunks = (text or "").encode(), 0, 0, []
        for k, b in enumerate(raw):
            value = (value << 1) + int(chunks_module.GEAR[b]) & 0xFFFFFFFF
            if (k >= 31 and value < 2**32 // chunks_module.MEAN) or k + 1 - start == chunks_module.MAX_CHUNK or k + 1 == len(raw):
                chunks.append((start, k + 1, xxhash.xxh3_64_intdigest(raw[max(0, start - 32) : k + 1])))
                start = k + 1
        own[i] = raw, chunks
    places = defaultdict(list)
    for i, (_, found) in sorted(own.items()):
        for c in found:
            places[c[2]].append(i)
    for i, (raw, found) in own.items():
        marks, runs, seen, gone, n_dup = [c for c in found if len(places[c[2]]) > 1], [], set(), bytearray(len(raw)), 0
        for c in marks:
            if runs and runs[-1][-1][1] == c[0]:
                runs[-1].append(c)
            else:
                runs.append([c])
        for run in runs:
            counts = run[-1][1] - run[0][0] >= chunks_module.MIN_RUN or run[-1][1] - run[0][0] == len(raw)
            n_dup += len(run) * counts
            for a, b, digest in run:
                if counts and (places[digest][0] < i or digest in seen):
                    gone[a:b] = b"\1" * (b - a)
                seen.add(digest)
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        yield i, len(raw), len(found), n_dup, sum(gone), spans, bytes(b for b, x in zip(raw, gone, strict=True) if not x).decode("utf-8", "ignore")


def test_chunks_against_brute_force(spark):
    r = random.Random(77)
    shared = [prose(r.randint(20, 300), seed=700 + k) for k in range(6)]
    texts = [(i, " ".join(x for _ in range(r.randint(0, 4)) for x in (prose(r.randint(1, 60)), r.choice(shared)[r.randint(0, 40) :]))) for i in range(60)]
    texts += [(100, "é" * 3000), (101, "é" * 3000), (102, "same line\n" * 40), (103, None), (104, texts[3][1])]
    assert rows(chunks.marked(frame(spark, texts))) == sorted(brute_chunks(texts), key=str)


def test_short_passages_are_met(spark):
    """Of many passages of 51 words that two texts share, 97 in a hundred are marked in both."""
    r = random.Random(51)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrst", k=r.randint(2, 8))) for _ in range(3000)]
    texts = []
    for k in range(1500):
        passage = " ".join(r.choices(vocabulary, k=51))
        texts += [(2 * k + j, " ".join([*r.choices(vocabulary, k=60), passage, *r.choices(vocabulary, k=60)])) for j in (0, 1)]
    met = {x["doc_id"] for x in chunks.marked(frame(spark, texts)).where("n_dup_chunks > 0").collect()}
    assert len(met) >= 0.97 * len(texts)


def brute_components(prints):
    """Least ids reachable over fingerprints within two bits."""
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(prints, 2):
        if bin(a ^ b).count("1") <= 2:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def test_simhash(spark):
    import xxhash

    base = [prose(120, seed=k) for k in range(12)]
    texts = [(i, " ".join(w if rnd.random() > 0.01 else "edit" for w in rnd.choice(base).split())) for i in range(150)] + [(200, ""), (201, None), (202, "Ab cD"), (203, "ab cd")]
    prints = []
    for i, t in texts:
        w = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        votes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((i, sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in votes) > len(votes))))
    got = simhash.components(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["print"] % 2**64 for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def brute_similarity(a, b):
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def test_near_dedup_meets_edited_copies(spark):
    """Copies with edits, families and a large group: no two rows that stay are similar to 0.8, and what goes was near to something."""
    r = random.Random(21)
    base = [prose(150, seed=1000 + k) for k in range(30)]
    texts = [(k, t) for k, t in enumerate(base)]
    for k in range(170):
        w = (base[0] if k < 60 else r.choice(base)).split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "edit"
        texts.append((100 + k, " ".join(w)))
    near = {(i, j) for (i, a), (j, b) in combinations(texts, 2) if brute_similarity(a, b) >= 0.8}
    stay = {x["doc_id"] for x in near_texts.near_dedup(frame(spark, texts)).collect()}
    assert len(near) > 200 and not [p for p in near if stay.issuperset(p)]
    later = {j for _, j in near}
    assert {i for i, _ in texts} - stay <= later and set(range(30)) <= stay


def test_near_dedup_of_a_common_passage(spark):
    """Texts that share half of their words, many more than a bucket holds, all stay; edited copies among them go."""
    passage = prose(80, seed=900)
    texts = [(k, f"{passage} {prose(80, seed=3000 + k)}") for k in range(150)]
    texts += [(1000 + k, texts[k][1].replace(" ", "  ", 9).rsplit(" ", 3)[0]) for k in range(20)] + [(2000 + k, f"{passage} {passage.upper()} {prose(12, seed=k)}") for k in range(60)]
    near = {(i, j) for (i, a), (j, b) in combinations(texts, 2) if brute_similarity(a, b) >= 0.8}
    stay = {x["doc_id"] for x in near_texts.near_dedup(frame(spark, texts)).collect()}
    assert set(range(150)) <= stay and len(near) >= 20 and not [p for p in near if stay.issuperset(p)]
    assert {i for i, _ in texts} - stay <= {j for _, j in near}


def test_near_dedup_keeps_rows_apart(spark):
    """Null and repeated doc_ids with different texts stay; of equal texts one row stays."""
    a, b, c, d = (prose(60, seed=k) for k in (61, 62, 63, 64))
    texts = [(None, a), (None, b), (7, c), (7, d), (8, a), (None, c), (9, d), (9, d)]
    got = near_texts.near_dedup(frame(spark, texts)).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got if x["doc_id"]) == sorted([(7, c), (7, d), (8, a)])
    assert [x["text"] for x in got if x["doc_id"] is None] == [b]


def test_near_prints_lose_no_pair(spark):
    r = random.Random(3)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for n in (1, 2, 2, 3):
            values.add(v ^ sum(1 << k for k in r.sample(range(64), n)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.near_prints(spark.createDataFrame(list(zip(signed, range(len(values)), strict=True)), "print long, node long"))
    expected = {frozenset((i, j)) for i, j in combinations(range(len(values)), 2) if bin(values[i] ^ values[j]).count("1") <= 2}
    assert {frozenset((x["node_a"], x["node_b"])) for x in got.collect()} == expected and len(expected) > 150


def test_golay_tables():
    patterns, _ = simhash.golay()
    assert all(p[0] >= 0 and bin(int(p[0])).count("1") <= 3 for p in patterns)
    words = np.array([rnd.getrandbits(23) for _ in range(200)])
    first, near = simhash.codewords(words)[:, 0], simhash.codewords(words ^ (1 << np.arange(200) % 23))
    assert (near == first[:, None]).any(axis=1).all()


def brute_tiles(doc, item, width):
    """Greedy string tiling by comparing everything with everything."""
    marked_d, marked_i, out = set(), set(), []
    while True:
        best = None
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in marked_d and i + n not in marked_i:
                    n += 1
                if n >= width and (best is None or n > best[0]):
                    best = (n, d, i)
        if best is None:
            return sorted(out)
        n, d, i = best
        out.append((d, i, n))
        marked_d.update(range(d, d + n))
        marked_i.update(range(i, i + n))


def tiles(doc, item, width):
    """The tiles of a document and one item, both lists of small numbers, by the operator's own steps."""
    block = decontaminate.Benchmark([(1, " ".join(f"w{x}" for x in item))], width)
    ids = np.array([block.vocabulary.get(f"w{x}", decontaminate.STRANGE) for x in doc], np.int64)
    d, i = block.begun(ids, width)
    n = decontaminate.extended(decontaminate.Prefixes(ids), block.prefixes, d, i, width, len(item))
    return sorted(decontaminate.tile(ids, block.flat[1:-1], (d, i - 1, n), width))


def test_tiling():
    r = random.Random(4)
    for _ in range(150):
        item = [r.randrange(5) for _ in range(r.randint(3, 25))]
        doc = [r.randrange(6) for _ in range(r.randint(3, 40))]
        doc[5:5] = item[4:] + item[:4]
        assert tiles(doc, item, 3) == brute_tiles(doc, item, 3)
    assert tiles([0, 1] * 30, [1, 0] * 9, 5) == brute_tiles([0, 1] * 30, [1, 0] * 9, 5)


def test_repetitive_texts_are_tiled_in_time():
    """A million equal words, and a period of three, against items of the same words."""
    block = decontaminate.Benchmark([(1, "la " * 200), (2, "a b c " * 100), (3, "la " * 5 + "b")])
    began = time.perf_counter()
    assert [h[0] for h in block.hits("la " * 1_000_000, 0.8)] == [1, 3]
    assert [h[:3] for h in block.hits("b c a " * 300_000, 0.8)] == [(2, 1.0, 1)]
    assert time.perf_counter() - began < 30


def test_decontamination(spark):
    items = [(k, prose(40, seed=100 + k)) for k in range(6)] + [(8, "only four words here"), (9, "!?")]
    w = items[0][1].split()
    texts = [(1, prose(50) + " " + items[1][1].upper().replace(" ", ", ") + "."), (2, prose(80)), (3, prose(9) + " " + " ".join(w[20:] + w[:20]) + " " + prose(9)), (4, " ".join(w[:20])), (5, items[2][1] + " and " + items[3][1]), (6, "So: only FOUR words here!")]
    expected = {(1, 1), (3, 0), (5, 2), (5, 3), (6, 8)}
    docs, benchmark = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 22, 300):  # inside the scan, and by a join on seeds
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, benchmark, block_bytes=block).collect()} == expected
        assert {r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark, block_bytes=block).collect()} == {2, 4}
    brute = {(i, k) for i, t in texts for k, x in items for own in [decontaminate.tokens(x)] if own for n in [min(5, len(own))] if sum(z[2] for z in brute_tiles(decontaminate.tokens(t), own, n)) >= 0.8 * len(own)}
    assert brute == expected


def test_surrogates(spark):
    texts = [(1, "Write to Jo.Doe12@mail3.example.com or jo.doe12@Mail3.example.com, call +1 (017) 555-7713."), (2, "jo.doe12@mail3.example.com at 10.20.30.40, card 4539 1488 0343 6467, token = \"9742a250774262d69ad6a86100194ed53da5a0ef\""), (3, "Dear Mrs. Maria Lopez and Mr. Ivan Petrov; Mrs. Maria Lopez"), (4, "Nothing private, 12345 and 3.14."), (5, "SSN 123-45-6789 and DE89370400440532013000.")]
    got = {r["doc_id"]: r for r in surrogates.replace_pii(frame(spark, texts)).collect()}
    for value in ("jo.doe12@mail3", "555-7713", "10.20.30.40", "0343 6467", "9742a25077", "Lopez", "Petrov", "123-45", "DE8937"):
        assert not any(value.lower() in r["text"].lower() for r in got.values())
    mails = re.findall(r"[\w.]+@[\w.]+", got[1]["text"] + " " + got[2]["text"])
    assert len({m.lower().rstrip(".") for m in mails}) == 1 and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}\d\d@.*", mails[0])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", got[1]["text"])
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[2]["text"])[1]
    assert surrogates.luhn(card.replace(" ", "")) and card[0] == "4"
    names = re.findall(r"(Mrs|Mr)\. (\w+ \w+)", got[3]["text"])
    assert names[0] == names[2] and names[0][1] != names[1][1] and names[0][1].split()[0][-1] == "a"
    assert got[4]["text"] == texts[3][1] and got[4]["n_entities"] == 0
    assert surrogates._remainder(re.search(r"DE\d{20}", got[5]["text"])[0]) == 1
    beyond = surrogates.replace_pii(frame(spark, texts), max_shared=-1)  # the way beyond the shared table
    assert {r["doc_id"]: r["text"] for r in beyond.collect()} == {i: r["text"] for i, r in got.items()}


def test_surrogates_stay_distinct(spark):
    """Whole small domains: a permutation leaves values in place, and the check moves them on."""
    found = spark.createDataFrame([("secret", f"{a}{b}") for a in "0123456789" for b in "0123456789"], "kind string, value string")
    again = {(r["kind"], r["value"]): r["attempt"] for r in surrogates.rekeyed(found).collect()}
    made = {v: surrogates.surrogate("secret", v, again.get(("secret", v), 0)) for v in (f"{a}{b}" for a in range(10) for b in range(10))}
    assert len(set(made.values())) == 100 and all(k != v for k, v in made.items())


def test_surrogates_are_no_real_values(spark):
    """Where a shape has room, no surrogate is the value of an entity, nor of another's surrogate; checked one by one."""
    r = random.Random(8)
    values = sorted({f"{r.randrange(10**4):04d}" for _ in range(2500)})
    again = {x["value"]: x["attempt"] for x in surrogates.rekeyed(spark.createDataFrame([("secret", v) for v in values], "kind string, value string")).collect()}
    made = [surrogates.surrogate("secret", v, again.get(v, 0)) for v in values]
    assert len(set(made)) == len(values) and sum(m in set(values) for m in made) <= 0.01 * len(values)


def test_surrogates_of_one_number_and_one_address(spark):
    text = "Call 555-123-4567, +1 555 123 4567 or (555) 123-4567. Jürgen.Öz@Example.de, jürgen.öz@example.DE; иван@почта.рф"
    got = surrogates.replace_pii(frame(spark, [(1, text)])).first()
    found = re.fullmatch(r"Call (\d{3}-\d{3}-\d{4}), \+1 (\d{3} \d{3} \d{4}) or (\(\d{3}\) \d{3}-\d{4})\. (\w+\.\w+@\w+\.de), (\w+\.\w+@\w+\.DE); (\w+@\w+\.рф)", got["text"]).groups()
    digits = {re.sub(r"\D", "", x) for x in found[:3]}
    assert len(digits) == 1 and digits != {"5551234567"} and found[3].lower() == found[4].lower() != "jürgen.öz@example.de"
    assert not set("иван") & set("jurgen") and found[5] != "иван@почта.рф" and got["n_distinct"] == 3


def test_surrogates_of_other_scripts_and_full_shapes(spark):
    """Names in scripts without a class are replaced by letters of their own script; a shape of which all values occur gets longer ones."""
    names = ["李明", "김철수", "محمد", "דוד", "สมชย"]
    got = [r["text"] for r in surrogates.replace_pii(frame(spark, [(k, f"Mr. {n}") for k, n in enumerate(names)])).orderBy("doc_id").collect()]
    script = lambda t: [unicodedata.name(c).split()[0] for c in t]
    assert all(g[4:] != n and script(g[4:]) == script(n) for g, n in zip(got, names, strict=True))
    for kind, full in (("name", [f"{a}{b}" for a in surrogates.VOWELS for b in surrogates.CONSONANTS]), ("email", [f"{a}@{b}.io" for a in surrogates.VOWELS for b in surrogates.CONSONANTS])):
        again = {r["value"]: r["attempt"] for r in surrogates.rekeyed(spark.createDataFrame([(kind, v) for v in full], "kind string, value string")).collect()}
        made = {v: surrogates.surrogate(kind, v, again.get(v, 0)) for v in full}
        assert len(set(made.values())) == len(full) and all(k != v for k, v in made.items())
    assert surrogates.formatted("email", "A@b.io", surrogates.surrogate("email", "a@b.io", surrogates.WIDER + 1)).endswith(".io")


def test_surrogates_of_one_person(spark):
    """Full, first and last names of a titled person, titled or not, in any capitals, get surrogates word by word."""
    text = "Mr. John Smith met Prof. Dr. Jane Roe. Mr. Smith left; John Smith and JANE ROE's friend stayed, Smith too. The smith did not."
    got = surrogates.replace_pii(frame(spark, [(1, text), (2, "Dr. Roe"), (3, "Jane Roe has no title here")])).orderBy("doc_id").collect()
    found = re.fullmatch(r"Mr\. (\w+) (\w+) met Prof\. Dr\. (\w+) (\w+)\. Mr\. (\w+) left; (\w+) (\w+) and (\w+) (\w+)'s friend stayed, (\w+) too\. The smith did not\.", got[0]["text"]).groups()
    john, smith, jane, roe = found[:4]
    assert found[4:] == (smith, john, smith, jane.upper(), roe.upper(), smith) and not {"John", "Smith", "Jane", "Roe"} & set(found)
    assert got[0]["n_entities"] == 6 and got[0]["n_distinct"] == 2
    assert got[1]["text"] == f"Dr. {roe}" and got[2]["text"] == "Jane Roe has no title here"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = ["the", "of", "and", "is"] * 20 + VOCABULARY
    item = prose(30, seed=77)
    texts = [(i, prose(120, words, seed=i)) for i in range(20)] + [(30, prose(120, words, seed=3)), (31, "too short"), (32, prose(70, words, seed=50) + " " + item), (33, prose(90, words, seed=51) + " a.b@mail.example.org")]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    result = corpus_pipeline.run(spark, str(tmp_path))
    out = {r["doc_id"]: r for r in result.collect()}
    folder = Path(result.inputFiles()[0].removeprefix("file:")).parent.parent
    assert [p.name for p in folder.iterdir()] == ["4"] and not list(folder.parent.glob("scratch-*/*"))
    assert set(out) == {*range(20), 33}
    assert "a.b@mail.example.org" not in out[33]["text"] and out[33]["n_chars"] == len(out[33]["text"])
    assert sum(r["taken"] for r in out.values()) == int(1.5 * sum(r["size"] for r in out.values()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "personal data", "source mix"]
