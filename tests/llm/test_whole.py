"""Surrogates and the pipeline against plain versions, identities of rows for all operators, and texts that repeat themselves."""

import random
import re
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chunks, decontaminate, language, licenses, mixing, near_texts, quality, ranked_search, simhash, suffixes, surrogates, token_counts

rnd = random.Random(21)
WORDS = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def card():
    head = "4" + "".join(rnd.choices("0123456789", k=14))
    return next(head + str(d) for d in range(10) if surrogates.luhn(head + str(d)))


def iban():
    body = "".join(rnd.choices("0123456789", k=18))
    return f"DE{98 - surrogates._remainder('DE00' + body):02d}{body}"


FORMS = {
    "ssn": lambda: f"{rnd.randrange(1000):03d}-{rnd.randrange(100):02d}-{rnd.randrange(10000):04d}",
    "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
    "card": card,
    "iban": iban,
    "phone": lambda: rnd.choice([f"({rnd.randrange(200, 999)}) {rnd.randrange(100, 999)}-{rnd.randrange(10000):04d}", f"+44 20 {rnd.randrange(1000, 9999)} {rnd.randrange(1000, 9999)}"]),
    "email": lambda: f"u{rnd.randrange(10**9)}.{rnd.choice('abc')}@example.org",
    "secret": lambda: rnd.choice([f"token={rnd.getrandbits(128):032x}", f"api_key = 'Ab1{''.join(rnd.choices('xyzXYZ019', k=20))}'"]),
    "name": lambda: "Mrs. " + rnd.choice("ABCDEFG") + "".join(rnd.choices("abcdefghijklmnop", k=6)),
}
VALID = {"ssn": r"\d{3}-\d{2}-\d{4}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "card": r"4\d{15}", "iban": r"DE\d{20}", "phone": r"\(\d{3}\) \d{3}-\d{4}|\+4\d \d\d \d{4} \d{4}", "email": r"[a-z]\d+\.[a-z]@[a-z]{7}\.org", "secret": r"token=[0-9a-f]{32}|api_key = '[A-Za-z0-9]{23}'", "name": r"Mrs\. [A-Z][a-z]{6}"}


@pytest.mark.parametrize("kind", FORMS)
def test_surrogates_keep_their_form_in_print(kind):
    """5,000 values of each kind: the new text holds one entity of that kind and shape, no two print alike, and none is as it was."""
    replacer, seen = surrogates.Replacer({}), {}
    for value in sorted({FORMS[kind]() for _ in range(5000)}):
        new, kinds, _ = replacer.replace(f"so {value} it is")
        assert kinds == [kind] and re.fullmatch(f"so (?:{VALID[kind]}) it is", new), (value, new)
        assert [m.kind for m in surrogates.mentions(new)] == [kind] and new != f"so {value} it is"
        if kind != "phone":  # national and international forms of one number are one entity
            assert seen.setdefault(new, value) == value


def test_permutations_move_every_number():
    for size in (2, 3, 10, 105, 1000):
        image = [surrogates.moved(v, size, b"t") for v in range(size)]
        assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))
        assert all(surrogates.permuted(surrogates.permuted(v, size, b"t"), size, b"t", back=True) == v for v in range(size))


def rekeyed_plainly(found):
    """What `rekeyed` gives, by one loop over dictionaries."""
    attempts = dict.fromkeys(found, 0)
    for turn in range(surrogates.TRIES):
        new = {e: surrogates.surrogate(*e, a) for e, a in attempts.items()}
        owners = {}
        for (kind, value), n in new.items():
            owners.setdefault((kind, n), []).append(value)
        clash = {e for e, n in new.items() if n == e[1] or (attempts[e] < surrogates.WIDER and (e[0], n) in attempts) or min(owners[e[0], n]) < e[1]}
        if not clash:
            return {e: a for e, a in attempts.items() if a}
        forms = {(k, surrogates.family(k, v)) for k, v in clash if k in surrogates.FIXED and turn >= surrogates.WIDER}
        for e in attempts:
            if (e[0], surrogates.family(*e)) in forms:
                attempts[e] = surrogates.WIDER + 1
            elif e in clash:
                attempts[e] = max(attempts[e], turn) + 1
    raise RuntimeError


def test_surrogates_against_a_plain_version(spark):
    """Entities that clash and texts that mention them, equal to a loop over all of them; also joined by texts."""
    texts = [" and ".join(FORMS[k]() for k in rnd.sample(sorted(FORMS), 3)) for _ in range(60)] + ["token=" + f"{n:016d}" for n in range(30)] + [None, "", "Mr. Bo met Mr. Ab; Bo, Ab"]
    texts += [f"Mr. {a.upper()}{b}" for a in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"]  # a full shape
    found = {x for t in texts if t for m in surrogates.mentions(t) for x in surrogates.parts(m)}
    due = rekeyed_plainly(sorted(found))
    frame = spark.createDataFrame([(None if i % 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {(r["kind"], r["value"]): r["attempt"] for r in surrogates.rekeyed(surrogates.entities(frame)).collect()} == due and due
    plain = surrogates.Replacer(due)
    wanted = sorted((t or "", plain.replace(t)[0] or "") for t in texts)
    for settings in ({}, {"max_shared": -1}):
        out = frame.withColumn("own", F.col("text")).transform(surrogates.replace_pii, **settings).collect()
        assert sorted((r["own"] or "", r["text"] or "") for r in out) == wanted


IDS = [(1, "t1"), (1, "t2"), (2, "t1"), (None, "t1"), (None, "t3"), (None, "t3"), (3, None), (3, ""), (3, "t4"), (3, "t4")]


def id_frame(spark, kind):
    passage = prose(120, 1)
    texts = {"t1": passage + " " + prose(60, 2), "t2": passage + " " + prose(60, 3), "t3": prose(150, 4), "t4": prose(40, 5) + " " + passage, None: None, "": ""}
    name = lambda i: None if i is None else f"id{i}" if kind == "string" else i
    return spark.createDataFrame([(name(i), texts[t], "s", "en", 0) for i, t in IDS], f"doc_id {kind}, text string, source string, lang string, n_chars long").repartition(3)


def bench(spark, kind):
    return spark.createDataFrame([("b1" if kind == "string" else 1, prose(30, 4)), (None, prose(30, 5)), ("b1" if kind == "string" else 1, prose(20, 2))], f"item_id {kind}, text string")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_rows_and_ids(spark, kind):
    """Null, repeated and text ids: every operator keeps the type of the ids, and rows are rows."""
    docs = id_frame(spark, kind)
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    for apply in (quality.judge, lambda d: token_counts.count_tokens(d, path), mixing.mix, mixing.mixed, lambda d: language.predict(d, language.learn(d)), suffixes.removed, chunks.marked, simhash.components, surrogates.replace_pii):
        out = apply(docs)
        assert out.count() == len(IDS) and dict(out.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    for apply in (licenses.scan, lambda d: decontaminate.overlaps(d, bench(spark, kind)), near_texts.near_dedup):
        assert dict(apply(docs).dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    small, large = (sorted(map(tuple, decontaminate.overlaps(docs, bench(spark, kind), block_bytes=b).collect()), key=str) for b in (1 << 20, 0))
    assert small == large and {r[1] for r in small} == {None, "b1" if kind == "string" else 1}
    found = ranked_search.search(ranked_search.index(docs), bench(spark, kind), 3)
    assert dict(found.dtypes)["item_id"] == dict(found.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"] and found.count() == 9
    kept = {(r["doc_id"], r["text"]) for r in near_texts.near_dedup(docs).collect()}
    assert len(kept) == 5  # t1, t2, t3, t4 and the empty text, each once
    told = chunks.marked(docs).collect()
    first = {t: min((i is None, i or 0) for i, u in IDS if u == t) for t in ("t1", "t3", "t4")}
    texts = {r["text"]: 0 for r in docs.collect() if r["text"]}
    for r in told:
        if r["n_bytes"]:
            assert r["n_removed"] <= r["n_bytes"]
    whole = sum(r["n_removed"] == r["n_bytes"] > 0 for r in told)
    assert whole == len([1 for _, t in IDS if t]) - len(texts) and len(first) == 3  # of equal texts all but one go


@pytest.mark.parametrize("kind", ["long", "string"])
def test_mixed_meets_its_targets(spark, kind):
    """Sums of what is taken come to each source's target, with null and repeated ids and equal rows."""
    docs = id_frame(spark, kind).withColumn("source", F.when(F.col("doc_id").isNull(), "b").otherwise("a"))
    out = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(out) == 2 and all(r["taken"] == int(r["target"]) for r in out)


@pytest.mark.parametrize("n", [5, 31, 32, 33, 40])
def test_near_dedup_at_the_line_of_hot_buckets(spark, n):
    """Groups of copies, edited copies and texts that only share a passage, at both sides of the size that changes the keys."""
    base, passage = prose(100, 60).split(), prose(60, 61)
    copies = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(n)]
    others = [passage + " " + prose(60, 100 + k) for k in range(n)]
    frame = spark.createDataFrame(list(enumerate(copies + others)), "doc_id long, text string").repartition(3)
    near = [(i, j) for (i, a), (j, b) in combinations(enumerate(copies + others), 2) if near_texts.similar(near_texts.shingles(a.encode()), near_texts.shingles(b.encode()))]
    assert len(near) == n * (n - 1) // 2 and all(j < n for _, j in near)
    assert sorted(r["doc_id"] for r in near_texts.near_dedup(frame).collect()) == [0, *range(n, 2 * n)]


def test_keys_of_texts_are_not_broadcast(spark):
    """A print has up to 36 keys and a text many shingles, which Spark doesn't reckon with: such rows never go by way of the driver."""
    numbers = spark.range(4)  # unlike a list, of a size that Spark knows
    prints = numbers.select(F.shiftleft("id", 40).alias("print")).select("print", F.col("print").alias("node"))
    held = numbers.select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("row"), F.when(F.col("id") < 2, prose(40, 70)).otherwise(prose(40, 71)).alias("text"))
    links, keyed = simhash.near_prints(prints), near_texts.rarest(held)
    for frame in (links, keyed):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in links.collect()} == {(a << 40, b << 40) for a, b in combinations(range(4), 2)}
    assert {r["row"] for r in keyed.collect()} == {bytes([k]) for k in range(4)}


def test_licenses_in_repetitive_texts(spark):
    """A license thousands of times in one text, and a part of one over and over: the first place, and nothing."""
    mit = licenses.TEMPLATES[9][2]
    part = " ".join(mit.split()[10:22])
    docs = spark.createDataFrame([(1, (mit + " ") * 2000), (2, (part + " ") * 1700), (3, "x " * 5000 + mit + " y" * 3000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["template_id"], r["containment"]) for r in licenses.scan(docs).collect()}
    assert got == {1: ("mit-grant", 1.0), 3: ("mit-grant", 1.0)}


def test_licenses_across_pieces(spark, monkeypatch):
    """A license found wherever the border of a piece falls in it, equal to a text in one piece."""
    docs = spark.createDataFrame([(k, prose(k, k) + " " + licenses.TEMPLATES[10][2] + " " + prose(50, 9)) for k in range(0, 130, 7)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, licenses.scan(docs).collect()))
    whole = rows()
    monkeypatch.setattr(licenses, "PIECE", 1)
    assert rows() == whole and len(whole) == docs.count()


def test_more_templates_than_go_out_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, prose(30, k) + " " + t[2]) for k, t in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    rows = lambda: sorted(map(tuple, licenses.scan(docs).collect()))
    whole = rows()
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 4)
    assert rows() == whole


def test_pipeline_against_a_plain_version(spark, tmp_path):
    """Five stages, each by its definition: rules and mix in SQL, cliques of near texts, whole items, surrogates one by one."""
    import corpus_pipeline

    common = ["the", "of", "and", "is"]
    text = lambda n, seed: " ".join(random.Random(seed).choices(common * 20 + WORDS, k=n))
    items = [text(25, 900 + k) for k in range(3)]
    rows = [(i, text(random.Random(i).randint(20, 200), i)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 7)] + [(200 + i, f"{rows[i][1]} extra") for i in range(0, 60, 11) if len(rows[i][1].split()) > 60]
    rows += [(300 + k, text(80, 300 + k) + " " + items[k % 3]) for k in range(4)] + [(400 + k, text(80, 400 + k) + f" {FORMS[f]()} end") for k, f in enumerate(FORMS)]
    rows += [(500, None), (501, ""), (None, text(90, 501)), (None, text(90, 502)), (7, text(100, 503))]
    data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    import pandas as pd

    def sql(query, held):
        frame = pd.DataFrame(held, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
        con.register("documents", frame)
        return con.sql(query)

    judged = sql(quality.OP2_SQL, [(n, *r[1:]) for n, r in enumerate(data)])
    place = judged.columns.index("kept")
    good = {r[judged.columns.index("doc_id")] for r in judged.fetchall() if r[place]}
    held = sorted((r for n, r in enumerate(data) if n in good), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [near_texts.shingles(r[1].encode()) for r in held]
    gone = {j for i, j in combinations(range(len(held)), 2) if near_texts.similar(sets[i], sets[j])}
    held = [r for j, r in enumerate(held) if j not in gone and not any(item in r[1] for item in items)]
    found = {x for r in held for m in surrogates.mentions(r[1]) for x in surrogates.parts(m)}
    plain = surrogates.Replacer(rekeyed_plainly(sorted(found)))
    held = [(i, new := plain.replace(t)[0], lang, source, len(new)) for i, t, lang, source, _ in held]
    mixed = sql(mixing.OP4_SQL, held)
    names = mixed.columns
    taken = sorted((r[names.index("doc_id")], r[names.index("taken")]) for r in mixed.fetchall() if r[names.index("doc_id")] is not None and r[names.index("taken")] > 0)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out if r["doc_id"] is not None) == taken and len(taken) > 30
    texts = {(i, t) for i, t, *_ in held}
    assert {(r["doc_id"], r["text"]) for r in out} <= texts and len(gone) >= 9
