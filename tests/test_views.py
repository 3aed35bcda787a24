"""Views, readers of lines, pointers and small rules on rows with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import labels, models
from corpusloom.operators import comparison, views
from corpusloom.sources import artifacts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_facet_views(spark):
    facets = spark.createDataFrame([("t", "problem", 0, "p0", "cited"), ("t", "problem", 1, "p1", "unknown"), ("t", "regime", 0, "r", "cited"), ("t", "other", 0, "o", "cited")], "target string, facet string, pos int, text string, basis string")
    got = {}
    for r in views.facet_views(facets).orderBy("place").collect():
        got.setdefault(r["dimension"], []).append(r["path"])
    assert got == {"problem": ["/problem/0", "/problem/1"], "scientific_question": ["/problem/0", "/problem/1"], "regime": ["/regime/0"], "evaluation": ["/regime/0"], "hypothesis": ["/regime/0"], "unknown": ["/problem/1"]}


def test_claims_and_records(spark):
    claims = spark.createDataFrame([("p", "c", "t", ["b", "gone", "a"]), ("p", "d", "t", [])], "paper string, claim string, text string, passages array<string>")
    passages = spark.createDataFrame([("p", "a", 1, "A"), ("p", "b", 2, "B"), ("q", "gone", 3, "G")], "paper string, passage string, page int, text string")
    got = {r["claim"]: [(s["passage"], s["page"], s["text"]) for s in r["sources"]] for r in views.rendered_claims(claims, passages).collect()}
    assert got == {"c": [("b", 2, "B"), ("a", 1, "A")], "d": []}
    hypotheses = spark.createDataFrame([("h", "d", "T", "s", "ok", None), ("i", "e", "U", "s", "ok", None)], "hypothesis string, direction string, title string, statement string, status string, diagnostic string")
    record = views.proposal_records(hypotheses, spark.createDataFrame([("d", "P", "Q", "S")], "direction string, problem string, question string, scope string"), spark.createDataFrame([("h", "y"), ("h", "x"), ("h", "x")], "hypothesis string, judgment string"), spark.createDataFrame([], "hypothesis string, experiment string"))
    assert {r["hypothesis"]: (r["problem"], r["judgments"], r["experiments"], r["evidence_file"]) for r in record.collect()} == {"h": ("P", ["x", "y"], [], "../../evidence/h.md"), "i": (None, [], [], "../../evidence/i.md")}


def test_loops(spark):
    routes = spark.createDataFrame([("a", 1, "ranking"), ("a", 2, "stop"), ("b", 1, "ranking"), ("b", 2, None), ("c", 1, "revise")], "run string, direction int, next_stage string")
    assert rows(views.loop_states(routes)) == [("a", 2, True), ("b", 2, False), ("c", 1, False)]
    candidates = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "run string, direction int, has_packet boolean")
    seen = spark.createDataFrame([("a", 1, "fine", "direction_correctness", ["/x"]), ("a", 2, "bare", "direction_correctness", ["/x"]), ("a", 3, "lost", "direction_correctness", ["/x"]), ("a", 1, "other", "comparison", ["/x"]), ("a", 1, "nowhere", "direction_correctness", [])], "run string, direction int, request string, stage string, paths array<string>")
    assert sorted((r["rule"], r["key"].split("|")[2]) for r in views.observation_violations(seen, candidates).collect()) == [("no_candidate", "bare"), ("no_candidate", "lost"), ("no_path", "nowhere"), ("stage", "other")]
    assert [spark.range(1).select(views.fetch_depth(k)).first()[0] for k in (5, 15)] == [50, 75]


def test_labels_and_queries(spark):
    given = spark.createDataFrame([(3, "a", "m"), (1, "a", "m"), (2, "a", "n"), (0, None, "m")], "pos int, text string, facet string")
    assert rows(views.distinct_labels(given)) == sorted([("a", "m", 1), ("a", "n", 2), (None, "m", 0)], key=str)
    asked = spark.createDataFrame([("q", "words of a query"), ("n", None)], "query_id string, text string")
    plain, told = ({r["query_id"]: r["vector"] for r in models.embedded_queries(asked, task=t).collect()} for t in (None, "find papers"))
    embed = models.HashEmbedder()
    assert plain["q"] == embed(["words of a query"])[0] and told["q"] == embed(["Instruct: find papers\nQuery: words of a query"])[0] and told["n"] == embed(["Instruct: find papers\nQuery: "])[0]


DOCUMENT = json.dumps({"list": [{"a": 1}, "x"], "3": "digits", "none": None, "a/b": {"~": True}, "": "empty", "it's": 2.5, "nested": {"0": ["deep"]}})


@pytest.mark.parametrize(("pointer", "value", "valid"), [("/list/1", "x", True), ("/list/0", '{"a":1}', True), ("/list/0/a", "1", True), ("/3", "digits", True), ("/none", None, True), ("/a~1b/~0", "true", True), ("/", "empty", True), ("/it's", "2.5", True), ("/nested/0/0", "deep", True), ("/list/2", None, False), ("/list/01", None, False), ("/list/-", None, False), ("/gone", None, False), ("/list/a", None, False), ("/3/x", None, False), ("no", None, False)])
def test_pointers(spark, pointer, value, valid):
    frame = spark.createDataFrame([(DOCUMENT, pointer)], "d string, p string")
    got = labels.pointed(frame, "d", "p").first()
    assert (got["value"], got["valid"]) == (value, valid)


def test_pointers_of_whole_and_broken_texts(spark):
    frame = spark.createDataFrame([('{"a":1}', ""), ("no json", "/a"), (None, "/a"), ("{}", None)], "d string, p string")
    assert [(r["value"], r["valid"]) for r in labels.pointed(frame, "d", "p").collect()] == [('{"a":1}', True), (None, False), (None, False), (None, False)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"paper_id": "p", "title": "T", "more": 1}\n\n  \n{"paper_id": "p"}\nbroken {\n{"title": "none"}\n[1]\n')
    found, lost = artifacts.json_lines(spark, str(tmp_path / "a.jsonl"), "paper_id string, title string")
    assert rows(found) == sorted([("p", "T"), ("p", None), (None, "none")], key=str) and {r["line"] for r in lost.collect()} == {"broken {", "[1]"}
    entries, wrong = artifacts.catalogue(spark, str(tmp_path / "gone.jsonl"), str(tmp_path / "*.jsonl"), schema="paper_id string, title string")
    assert entries.count() == 3 and sorted(r["rule"] for r in wrong.collect()) == ["broken_line", "broken_line", "no_paper_id", "repeated_paper"]
    with pytest.raises(FileNotFoundError):
        artifacts.catalogue(spark, str(tmp_path / "gone"), schema="paper_id string, title string")


def test_accepted_pairs(spark):
    pairs = spark.createDataFrame([(p, t, i) for p in "abcdef" for i, t in enumerate(("t0", "t1", "t2"))], "paper string, target string, pos long")
    claims = spark.createDataFrame([("c", "t1", "x", 0), ("c", "t2", "x", 0), ("c", "t0", "y", 1)], "paper string, target string, claim string, pos long")
    reports = spark.createDataFrame([("a", "pass"), ("b", "abstain"), ("c", "revise"), ("d", "revise"), ("e", "revise"), ("f", None)], "paper string, decision string")
    issues = spark.createDataFrame([("c", "/claims/0/text"), ("d", "/summary"), ("d", "/pairs/0"), ("e", "/pairs/9/text")], "paper string, field_path string")
    got = rows(comparison.accepted_pairs(reports, pairs, claims, issues))
    assert got == [("a", "t0"), ("a", "t1"), ("a", "t2"), ("c", "t0")]


def test_interpretation_patches(spark):
    kind = "target string, paper string, text string"
    old = spark.createDataFrame([("t0", "p", "old"), ("t1", "p", "old"), ("t0", "q", "old"), ("t0", "r", "old")], kind)
    fresh = spark.createDataFrame([("t0", "p", "new"), ("t0", "q", "new"), ("t0", "q", "twice"), ("t0", "r", "new"), ("t9", "r", "new")], kind)
    scope = spark.createDataFrame([("t0", "p"), ("t0", "q"), ("t0", "r")], "target string, paper string")
    merged, wrong = comparison.merged_pairs(old, fresh, scope)
    assert rows(merged) == [("t0", "p", "new"), ("t0", "q", "old"), ("t0", "r", "old"), ("t1", "p", "old")]
    assert {r["rule"] for r in wrong.collect()} == {"duplicate_patch", "unaffected_changed"}
