"""Ranked search, prefix trie and WARC archives against brute force and round trips, and their defined results for odd input."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie, ranked_search, warc

DOCS = "doc_id long, text string, score string, rank string, docs string"
rnd = random.Random(3)
WORDS = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 4))) for _ in range(60)] + ["Éa", "ÇB", "naïve", "x1", "日本"]
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            length = sum(c.values())
            m = 10 + (90 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, place + 1, d, -s) for place, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, parts=3, k=10):
    frame = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in docs], DOCS).repartition(parts)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.search(ranked_search.stored_index(frame), asked, k).collect()), key=str)


def test_ranked_search(spark, monkeypatch):
    """Small shards and fronts, ties, copies, null and repeated ids, empty and very long texts."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 3000)
    docs = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 60)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (None, "naïve x1"), (7, "naïve naïve"), (500, None), (501, ""), (502, " ,;\n"), (503, " ".join(rnd.choices(WORDS, k=30_000)))]
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 20)))) for i in range(30)] + [(30, docs[7][1]), (30, "naïve"), (31, None), (32, "!"), (33, "unheard"), (34, "NAÏVE-Éa éa")]
    assert searched(spark, docs, items) == ranking(docs, items)


def test_ranked_search_reads_a_shard_at_a_time(spark, monkeypatch):
    """A task with many shards writes each to a file of its own: a reader takes all rows of a file at once."""
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 1000)
    docs = [(i, " ".join(rnd.choices(WORDS, k=30))) for i in range(100)]
    stored = ranked_search.stored_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    shards = stored.select(F.input_file_name().alias("file"), F.size("docs").alias("docs")).collect()
    assert len({r["file"] for r in shards}) == len(shards) > 5 and sum(r["docs"] for r in shards) == 100


def test_ranked_search_blocks_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 40)
    docs = [(f"d{i:03d}", " ".join(rnd.choices(WORDS, k=20))) for i in range(60)] + [(None, "abc abc")]
    items = [(f"i{i}", " ".join(rnd.choices(WORDS, k=6))) for i in range(8)]
    frame, asked = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = ranked_search.search(ranked_search.index(frame), asked, 4).collect()
    held = {d: k for k, (d, _) in enumerate(docs)}
    wanted = ranking([(held[d], t) for d, t in docs], items, 4)
    assert sorted([(r["item_id"], r["rank"], held[r["doc_id"]], r["score"]) for r in got], key=str) == wanted


def test_ranked_search_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert searched(spark, [(1, None)], [(1, "a")]) == []
    assert searched(spark, [(1, "a b")], []) == []
    assert ranked_search.search(ranked_search.index(nothing), nothing.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_intervals_leave_documents_out():
    """Few documents are scored where one is far better than the rest, and the result is that of a full scan."""
    r = np.random.default_rng(5)
    lists = [np.sort(r.choice(5000, size, replace=False)) for size in (4000, 2500, 900, 300)]
    values = [r.integers(1, 100, len(x)) * w for x, w in zip(lists, (1, 3, 9, 27))]
    best = int(lists[3][17])
    values = [np.where(x == best, 5000, v) for x, v in zip(lists, values)]
    ranges = ranked_search.Ranges(np.concatenate(lists), np.concatenate(values).astype(np.int64), np.array([len(x) for x in lists]))
    top, scored = ranked_search.best(ranges, np.arange(4), list(range(5000)), 5000, [], 3)
    sums = np.zeros(5000, np.int64)
    for x, v in zip(lists, values):
        sums[x] += v
    wanted = sorted(((-int(s), False, d) for d, s in enumerate(sums) if s), key=lambda x: (x[0], x[2]))[:3]
    assert top == wanted and scored < 3000


def path_of(turns):
    """The path of a conversation from (role, text) pairs, as the operator digests them."""
    return b"".join(hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in turns)


def nodes_of(convs):
    """The trie by definition, of (conv_id, [(role, text)])."""
    nodes, children = {}, defaultdict(set)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), ([], []))
            node[0].append(c)
            if d == len(turns):
                node[1].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    saved, leaves = Counter(), Counter()
    for key, (members, _) in nodes.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(members) - 1) * (len(key[-1][1]) if key else 0)
            leaves[key[:d]] += key not in children
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for k, (m, e) in nodes.items()), key=str)


def rebuild(rows):
    """Conversations from (conv_id, turn, role, text) by definition; equal turns by digest."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    out = []
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out.append((c, convs.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]))
    return out


def trie_rows(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(frame)).collect()), key=str)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    rows = [(c, t, rnd.choice(["user", "bot", None]), rnd.choice(["hi", "yes", "né", None, ""])) for c in [*range(0, 260), 1000, 1001, 5, -3, -150] for t in range(rnd.randint(1, 7))]
    rows += [(3, None, "user", "first"), (None, 0, "user", "lost"), (300, 0, "user", "x" * 50_000), *((400, t, "user", "turn") for t in range(300)), *((401 + c, t, "a", "b") for c in range(90) for t in range(8)), *rows[:3]]
    assert trie_rows(spark, rows) == nodes_of(rebuild(rows))


def test_prefix_trie_edges(spark):
    assert trie_rows(spark, []) == []
    only = [(101, 0, "user", "a")]  # its head has more turns than it has, and its family's first conversation is absent
    assert trie_rows(spark, only) == nodes_of(rebuild(only))


def trie_in_blocks(convs, block, fan):
    """merged() on blocks of conversations, contracted by `fan` until one is left."""
    convs = sorted(convs, key=lambda c: (c[1], c[0]))
    rows, level = [], []
    for i in range(0, len(convs), block):
        found, sides = prefix_trie.merged([prefix_trie.conversation(*c) for c in convs[i : i + block]], raw=True)
        rows, level = rows + found, [*level, sides]
    last = False
    while not last:
        last, groups = len(level) <= fan, [level[i : i + fan] for i in range(0, len(level), fan)]
        level = []
        for group in groups:
            found, sides = prefix_trie.merged([prefix_trie._item(prefix_trie._spine(0, 0, x)) for s in group for x in s], last)
            rows, level = rows + found, [*level, sides]
    ends, nodes = defaultdict(list), [r for r in rows if r["kind"] == prefix_trie.NODE]
    for r in rows:
        if r["kind"] == prefix_trie.ENDS:
            ends[r["key"]].append((r["first"], r["ids"]))
    by = {r["key"]: r["conv_id"] for r in nodes if r.get("key")}
    digest = lambda r: r.get("ends_sha256") or hashlib.sha256(",".join(x for _, x in sorted(ends[r["key"]])).encode()).hexdigest()
    return sorted(((r["conv_id"], r["depth"], by[r["parent_key"]] if r.get("parent_key") else r.get("parent_conv_id"), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], digest(r)) for r in nodes), key=str)


def test_contracted_blocks():
    for trial in range(400):
        signs = [("u", c) for c in "abc"[: trial % 3 + 1]]
        convs = [(3 * i - 5, [rnd.choice(signs) for _ in range(rnd.choice([0, 1, 2, 3, 5]))]) for i in range(rnd.randint(1, 14))]
        own = [(c, path_of(turns), [len(t) for _, t in turns]) for c, turns in convs]
        assert trie_in_blocks(own, rnd.randint(1, 4), rnd.randint(2, 3)) == nodes_of(convs)


PAGES = [(1, "http://a.org/x?y#z", "<p>one</p>"), (2, "http://a.org/2", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://b.org", None), (4, "not a url\r\nX: y", ""), (5, "http://c.org/é", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0 WARC/1."), (6, "http://d.org", "a\r\n\r\nb\n\n"), (7, "http://e.org", "line sep \u0000 é \U0001f600" * 50), (8, "http://f.org/" + "q" * 5000, "x" * 300_000), (None, "http://g.org", "<p>one</p>"), (None, "http://g.org", "<p>one</p>"), (10, "http://h.org", "twice"), (10, "http://h.org", "twice"), (10, "http://i.org", "twice")]


def pages_by_definition(pages, least=0):
    groups = defaultdict(list)
    for i, u, h in pages:
        groups[h or ""].append((i is not None, i or 0, u is not None, u or "", i))
    out = []
    for html, rows in groups.items():
        raw, rows = html.encode(), sorted(rows, reverse=True, key=lambda r: r[:4])
        for k, row in enumerate(rows):
            kind = "response" if k == 0 or len(raw) < least else "revisit"
            out.append((row[4], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, rows[0][4] if kind == "revisit" else None))
    return sorted(out, key=str)


def page_frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, sha1 string, n long").repartition(3)


@pytest.mark.parametrize("least", [0, 8])
def test_warc_round_trip(spark, tmp_path, least):
    folder = str(tmp_path / "archives")
    warc.write_archives(page_frame(spark, PAGES), folder, least_bytes=least)
    got = sorted(map(tuple, warc.page_records(warc.read_records(spark, folder)).collect()), key=str)
    assert got == pages_by_definition(PAGES, least)


def test_warc_captures(spark, tmp_path):
    """One nested row for each capture, with exact payloads, unique ids and the page's own request."""
    folder = str(tmp_path / "archives")
    warc.write_archives(page_frame(spark, PAGES), folder)
    records = warc.read_records(spark, folder).collect()
    assert len(records) == 3 * len(PAGES) == len({r["record_id"] for r in records}) and not any(r["error"] for r in records)
    found = warc.assembled(warc.read_records(spark, folder)).collect()
    assert len(found) == len(PAGES) and all(len(r["request"]) == len(r["metadata"]) == 1 for r in found)
    payloads = {bytes(r["block"]).split(b"\r\n\r\n", 1)[1].decode() for r in found if r["type"] == "response"}
    assert payloads == {h or "" for _, _, h in PAGES}
    own = next(r for r in found if r["uri"] and r["uri"].startswith("http://a.org/x"))
    assert bytes(own["request"][0]["block"]).startswith(b"GET /x?y HTTP/1.1\r\nHost: a.org\r\n")


def test_warc_of_others(spark, tmp_path):
    """Members of one record each, other line orders, links from the response to its request and by way of the request, and broken records."""
    record = lambda head, block: f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    parts = [
        record("WARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\n", "software: x\r\n"),
        record("warc-record-id: <r>\r\nWARC-Type: response\r\nWARC-Concurrent-To: <q>\r\n", "HTTP/1.1 200 OK\r\n\r\nbody WARC/1.0 in it"),
        record("WARC-Type: request\r\nWARC-Record-ID: <q>\r\n", "GET / HTTP/1.1\r\n\r\n"),
        record("WARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <q>\r\n", "via: y\r\n"),
        record("WARC-Type: resource\r\nWARC-Record-ID: <s>\r\n", ""),
        b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <t>\r\nContent-Length: 900\r\n\r\nshort",
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    records = warc.read_records(spark, str(tmp_path))
    assert {r["record_id"]: r["error"] for r in records.collect() if r["error"]} == {"<t>": "shorter than its Content-Length"}
    found = {r["capture_id"]: ([x["record_id"] for x in r["request"]], [x["record_id"] for x in r["metadata"]]) for r in warc.assembled(records).collect()}
    assert found == {"<r>": (["<q>"], ["<m>"]), "<s>": ([], [])}


def test_warc_empty(spark, tmp_path):
    warc.write_archives(page_frame(spark, []), str(tmp_path / "none"))
    assert warc.page_records(warc.read_records(spark, str(tmp_path / "none"))).count() == 0
