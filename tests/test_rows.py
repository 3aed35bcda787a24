"""Readers, keyed rows, scalar rules and gates on small rows with known answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels
from corpusloom.functions import text as T
from corpusloom.operators import assessments, cards, comparison, decisions, flatten, gates, graph, index, merging, packing, threads
from corpusloom.sources import artifacts, tables
from corpusloom.streaming import status


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


def test_artifacts(spark, tmp_path):
    for name, text in (("A_B", json.dumps({"paper_metadata": {"title": "T"}})), ("p2", "no json"), ("other", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "paper.json").write_text(text)
    (tmp_path / "p2" / "2.md").write_text("short name")
    (tmp_path / "p2" / "002.md").write_text("second")
    (tmp_path / "p2" / "10.md").write_text("tenth")
    (tmp_path / "p2" / "notes.md").write_text("no page")
    got = {r["folder"]: r for r in artifacts.analyses(spark, str(tmp_path)).collect()}
    assert {f: r["status"] for f, r in got.items()} == {"A_B": "loaded", "p2": "invalid", "other": "loaded"}
    assert got["A_B"]["doc"]["paper_metadata"]["title"] == "T" and got["p2"]["doc"] is None and len(got["p2"]["sha256"]) == 64
    pages = artifacts.pages(spark, str(tmp_path))
    assert {(r["folder"], r["page"], r["text"]) for r in pages.collect()} == {("p2", 2, "second"), ("p2", 10, "tenth")}
    assert artifacts.stitched(pages).first()["text"] == '<PAPER>\n<PAGE number="2">\nsecond\n</PAGE>\n<PAGE number="10">\ntenth\n</PAGE>\n</PAPER>'
    catalogue = spark.createDataFrame([("p2", "Second"), ("p1", "A B")], "paper_id string, title string")
    linked = artifacts.linked(artifacts.analyses(spark, str(tmp_path)).select("folder"), catalogue)
    assert {r["folder"]: (r["paper_id"], r["title"]) for r in linked.collect()} == {"A_B": ("p1", "A B"), "p2": ("p2", "Second"), "other": ("other", None)}


def test_keyed_rows(spark):
    log = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, t int, v string")
    assert rows(merging.first_rows(log, ["k"], ["t"])) == [("a", 1, "y"), ("b", 5, None)]
    kept, missing = merging.reusable(spark.createDataFrame([(1, [1.0]), (9, [2.0])], "record_id int, vector array<double>"), spark.createDataFrame([(1,), (2,)], "record_id int"))
    assert [r["record_id"] for r in kept.collect()] == [1] and rows(missing) == [(2,)]
    facets = spark.createDataFrame([("c", "p2", 0, "method"), ("c", "p1", 3, "problem"), ("d", "p1", 0, None)], "concept string, paper_id string, pos int, facet string")
    assert rows(graph.resolved_facets(facets, "method")) == [("c", "problem"), ("d", "method")]
    assert flatten.leaves(spark.createDataFrame([], "a struct<b:int,c:array<struct<d:int>>>, e array<string>").schema) == ["a.b", "a.c[].d", "e"]


def test_decision_tables(spark):
    t, n, m, b = F.col("t"), F.col("n"), F.col("m"), F.col("b")
    assert [one(spark, decisions.support_label(n), n=k) for k in (1, 2)] == ["single", "multiple"]
    assert [one(spark, decisions.limitation_origin(t), t=p) for p in ("/limitations/author_stated/0", "/limitations/inferred/12", "/claims/1")] == ["author_stated", "model_inferred", None]
    assert [one(spark, decisions.publication_status(n, m), n=x, m=y) for x, y in ((1, 1), (1, 0), (0, 1), (0, 0))] == ["partial", "ready", "blocked", "empty"]
    assert [one(spark, decisions.portfolio_status(n, m, 2), n=x, m=y) for x, y in ((1, 0), (2, 0), (2, 1), (0, 3), (0, 0))] == ["partial", "ready", "partial", "blocked", "empty"]
    assert [one(spark, decisions.hypothesis_status(t, b), t=a, b=e) for a, e in (("KEEP", True), ("DISCARD", True), ("REFINE", True), ("KEEP", False))] == ["approved", "discarded", "pending", "pending"]
    assert [one(spark, decisions.critic_route(t, n, m, b), t=a, n=x, m=y, b=z) for a, x, y, z in (("DISCARD", 1, 0, False), ("KEEP", 1, 1, False), ("KEEP", 0, 1, False), ("KEEP", 0, 0, False), ("KEEP", 0, 0, True))] == ["stop", "revise", "narrow", "ranking", "merge"]
    places = "array<struct<page:int>>"
    for pages, wanted in ((None, "unverifiable"), ([], "unverifiable"), ([(None,), (2,)], "unresolved"), ([(1,)], None)):
        row = spark.createDataFrame([(pages,)], f"x {places}")
        assert row.select(decisions.location_problem(F.col("x"), F.transform("x", lambda p: p["page"]))).first()[0] == wanted
    assert [one(spark, assessments.upstream_route(t, n, m), t=s, n=x, m=0) for s, x in ((None, 0), ("research_critic", 0), ("research_critic", 1), ("stop", 0))] == ["no accepted assessment", None, "upstream work remains", "upstream work remains"]
    assert one(spark, comparison.needs_repair(b, b, b, n, F.lit(False)), b=True, n=2) and not one(spark, comparison.needs_repair(b, b, b, n, F.lit(False)), b=True, n=3)


def test_scalars(spark):
    t = F.col("t")
    assert [one(spark, T.token_estimate(t), t=x) for x in ("", "abcdefgh", "abc")] == [1, 2, 1]
    assert one(spark, T.passage_id(F.lit("p#p1"), F.lit("h"), F.lit(3), F.lit(9), t), t="text").startswith("p#p1:") and len(one(spark, T.passage_id(F.lit("p"), F.lit("h"), F.lit(3), F.lit(9), t), t="x")) == 14
    assert one(spark, T.normalized_vector(F.col("v")), v=[3, 4]) == pytest.approx([0.6, 0.8]) and one(spark, T.normalized_vector(F.col("v")), v=[0, 0]) == [0, 0]
    areas, aliases = ("LLM Inference and Serving", "Reasoning"), {"rlhf": "Reasoning"}
    assert [one(spark, labels.matched_area(t, areas, aliases), t=x) for x in ("reasoning!", "RLHF", "4. LLM inference", "biology", "")] == ["Reasoning", "Reasoning", "LLM Inference and Serving", None, None]
    assert [tuple(one(spark, labels.resolved_area(t, areas, aliases), t=x)) for x in ("serving", "in", "none such")] == [("LLM Inference and Serving", None), (None, "ambiguous"), (None, "no match")]
    assert [one(spark, labels.page_label(t, ("paper", "appendix")), t=x) for x in (" **Appendix**.", "noise")] == ["appendix", "paper"]
    assert one(spark, labels.relocated_path(t, F.lit(True)), t="/targets/3/revisions/1/field") == "/revisions/1/field" and one(spark, labels.proposal_path(t), t="/candidate/scope") == "/scope"


def test_packing_of_pages_by_a_loop(spark):
    r = random.Random(5)
    data = [(t, p, 1, r.randint(1, 4), r.randint(5, 40)) for t in range(9) for p in range(r.randint(1, 15))]
    got = {(x["t"], x["paper"]): x["supplied"] for x in packing.page_budget(spark.createDataFrame(data, "t int, paper int, page int, demand int, tokens int"), "t", 4, 60).collect()}
    for t in range(9):
        n = used = 0
        for _, p, _, _, tokens in sorted((x for x in data if x[0] == t), key=lambda x: (-x[3], x[1])):
            fits = n < 4 and used + tokens <= 60
            n, used = n + fits, used + tokens * fits
            assert got[t, p] == fits


def test_threads(spark):
    """Contradiction with sides {P1, P2, P3} and {P3}; one paper at most can't decide it."""
    own = spark.createDataFrame([("a", ["P1", "P2", "P3"], 0), ("b", ["P3"], 1)], "thread string, papers array<string>, omitted long")
    opposed = spark.createDataFrame([("x", "a", "b")], "thread string, a string, b string")
    got = threads.contradictory(opposed, own, 12).first()
    assert got["side_a"] == ["P1", "P2", "P3"] and got["side_b"] == ["P3"] and got["papers"] == ["P1", "P2", "P3"] or set(got["papers"]) == {"P1", "P2", "P3"}
    assert threads.contradictory(opposed, own, 1).first()["status"] == "insufficient_for_adjudication"
    told = threads.schedule(("relationship", own), ("contradiction", threads.contradictory(opposed, own, 12)), max_threads=2).orderBy("thread_id").collect()
    assert [(r["thread_id"], r["kind"], r["status"]) for r in told] == [("t001", "relationship", "scheduled"), ("t002", "relationship", "scheduled"), ("t003", "contradiction", "budget_skipped")]


def test_cards(spark):
    names = spark.createDataFrame([([(" A ",), ("a",), ("B",), (None,), ("",)],)], "x array<struct<name:string>>")
    assert names.select(cards.names(F.col("x"))).first()[0] == ["A", "B"]
    mentions = spark.createDataFrame([("p", "in text", "method"), ("p", "absent", "method"), ("p", "in text", "odd")], "paper_id string, evidence_quote string, facet string")
    assert rows(cards.quoted(mentions, spark.createDataFrame([("p", "it is in text")], "paper_id string, text string"), ["method"])) == [("p", "in text", "method")]


def test_index(spark, tmp_path):
    records = spark.createDataFrame([("r1", "p", "to be or to"), ("r2", "p", None)], "record_id string, paper_id string, text string")
    assert rows(index.postings(records)) == [("be", "r1", 1), ("or", "r1", 1), ("to", "r1", 2)] and rows(index.corpus_statistics(index.record_lengths(records))) == [(2, 4, 2.0)]
    index.build(records, records.select("paper_id").distinct(), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() == 3
    with pytest.raises(ValueError):
        index.build(records.unionByName(records), records, str(tmp_path / "j"))
    prior = spark.createDataFrame([("r1", [2.0, 0.0])], "record_id string, vector array<double>")
    made = index.vectors(prior, records, lambda r: r.select("record_id", F.array(F.lit(0.0), F.lit(3.0)).alias("vector")))
    assert rows(made) == [("r1", [1.0, 0.0]), ("r2", [0.0, 1.0])]


def test_upsert_paper(spark):
    kinds = "paper_id string, record_id string, v string"
    table = spark.createDataFrame([("p1", "a", "x"), ("p2", "b", "x"), ("p2", "c", "x")], kinds)
    new = spark.createDataFrame([("p2", "b", "y"), ("p3", "d", "y")], kinds)
    assert rows(status.upsert_paper(table, new).select("paper_id", "record_id", "v")) == [("p1", "a", "x"), ("p2", "b", "y"), ("p3", "d", "y")]


def test_scratch_is_deleted(spark, tmp_path):
    with tables.scratch(spark):
        kept = tables.cut(spark.range(5))
        place = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        assert kept.count() == 5
    from pathlib import Path

    assert not Path(place).exists() and tables.cut(spark.range(3)).count() == 3


def test_gate_of_a_tampered_row(spark):
    directions = spark.createDataFrame([("d1", "o", "r1", "x"), ("d2", "o", "r0", "x"), ("d3", "o", "r9", "x"), ("d4", "o", "r1", "y")], "direction string, opportunity string, review string, digest string")
    reviews = spark.createDataFrame([("r0", "o", 0, "pass", "x"), ("r1", "o", 1, "pass", "x")], "review string, opportunity string, round int, decision string, digest string")
    assert {(r["rule"], r["key"]) for r in assessments.latest_passing(directions, reviews).collect()} == {("superseded", "d2"), ("unknown_review", "d3"), ("other_proposal", "d4")}
    assert gates.passed(assessments.latest_passing(directions.where("direction = 'd1'"), reviews))


def test_fleeting_checkpoints_last_for_their_block(spark, tmp_path):
    with tables.scratch(spark):
        spark.sparkContext.setCheckpointDir(str(tmp_path))
        depth = spark.sparkContext.getCheckpointDir().count("/")
        for _ in range(3):
            with tables.fleeting(spark.range(5)) as held:
                stays = tables.cut(held.where("id > 2"))
                assert held.count() == 5 and len(list(tmp_path.glob("fleeting-*/*/rdd-*"))) == 1
            assert not list(tmp_path.glob("fleeting-*")) and stays.count() == 2
        assert spark.sparkContext.getCheckpointDir().count("/") == depth
