"""Closure of comparisons and provenance: whole sets pass, and each single fault breaks its own rule."""

import hashlib

from corpusloom.operators import integrity, provenance

PASSAGES = [("p", "a1"), ("p", "a2"), ("q", "b1")]


def hold(spark, function, tables, kinds, cases):
    """All cases at once: the tables of each with its number before the ids of papers and directions, and the rules whose keys have it."""
    named = {n: [f.split(" ")[0] for f in kinds[n].split(", ")] for n in tables}
    tag = lambda case, n, row: tuple(f"{case}:{v}" if c in ("paper", "direction") and v is not None else v for c, v in zip(named[n], row, strict=True))
    rows = {n: [tag(case, n, row) for case, (change, _) in enumerate(cases) for row in change.get(n, tables[n])] for n in tables}
    found = function(**{n: spark.createDataFrame(r, kinds[n]) for n, r in rows.items()}).collect()
    got = [sorted({r["rule"] for r in found if r["key"].startswith(f"{case}:")}) for case in range(len(cases))]
    assert got == [due for _, due in cases]
    assert function(**{n: spark.createDataFrame([], kinds[n]) for n in tables}).count() == 0


DRAFT = {"targets": [("p", "d", "direction"), ("p", "h", "hypothesis")], "pairs": [("p", "d", "SAME", "not_applicable"), ("p", "h", "SAME", "tested")], "claims": [("p", "c", ["a1", "a2"])], "passages": PASSAGES}
DRAFT_KINDS = {"targets": "paper string, target string, level string", "pairs": "paper string, target string, classification string, tested string", "claims": "paper string, claim string, passages array<string>", "passages": "paper string, passage string"}


def test_drafts(spark):
    cases = [
        ({}, []),
        ({"pairs": DRAFT["pairs"][:1]}, ["target_coverage"]),
        ({"pairs": [*DRAFT["pairs"], ("p", "x", "SAME", "tested")]}, ["target_coverage"]),
        ({"pairs": [DRAFT["pairs"][0], ("p", "h", "DIFFERENT", "not_applicable")]}, ["hypothesis_not_assessed"]),
        ({"pairs": [DRAFT["pairs"][0], ("p", "h", "SAME", "discussed_only")]}, ["same_without_test"]),
        ({"pairs": [DRAFT["pairs"][0], ("p", "h", "SAME", None)]}, ["same_without_test"]),
        ({"claims": [("p", "c", ["b1"])]}, ["unknown_passage"]),
    ]
    hold(spark, integrity.draft_violations, DRAFT, DRAFT_KINDS, cases)


FACETS = ["/i/0", "/e/0"]
WHOLE = [(f, "covered") for f in FACETS]
RECORD = {"targets": [("p", "h", FACETS)], "relationships": [("p", "h", "direct_empirical", WHOLE)], "claims": [("p", "c", ["a1", "a2"])], "passages": PASSAGES, "captions": [("p", "a1", "a2")]}
RECORD_KINDS = {"targets": "paper string, target string, facets array<string>", "relationships": "paper string, target string, coverage string, matches array<struct<facet:string,match:string>>", "claims": DRAFT_KINDS["claims"], "passages": DRAFT_KINDS["passages"], "captions": "paper string, passage string, context string"}


def test_records(spark):
    cases = [
        ({}, []),
        ({"relationships": [("p", "h", "related", [])]}, []),
        ({"relationships": []}, ["target_coverage"]),
        ({"relationships": RECORD["relationships"] * 2}, ["repeated_target"]),
        ({"relationships": [("p", "h", "related", [WHOLE[0], WHOLE[0]])]}, ["facet_anchor"]),
        ({"relationships": [("p", "h", "related", [("/x", "covered")])]}, ["facet_anchor"]),
        ({"relationships": [("p", "h", "inferred_implication", WHOLE[:1])]}, ["alignment"]),
        ({"relationships": [("p", "h", "direct_theoretical", [WHOLE[0], ("/e/0", "partial")])]}, ["alignment"]),
        ({"targets": [("p", "h", [])], "relationships": [("p", "h", "direct_empirical", [])]}, ["alignment"]),
        ({"claims": [("p", "c", ["a1"])]}, ["table_context"]),
        ({"claims": [("p", "c", ["a2", "z"])]}, ["unknown_passage"]),
    ]
    hold(spark, integrity.record_violations, RECORD, RECORD_KINDS, cases)


def check(decision="supported", passages=("a1",), summary="all", scopes=((("supported"), ("a1",)),)):
    return ("p", "c", decision, list(passages), summary, None if scopes is None else [(d, list(p)) for d, p in scopes])


AUDIT = {"claims": [("p", "c", "result", ["a1"])], "targets": [("p", "h")], "claim_checks": [check()], "coverage_checks": [("p", "h", ["a2"])], "passages": PASSAGES}
AUDIT_KINDS = {"claims": "paper string, claim string, kind string, passages array<string>", "targets": "paper string, target string", "claim_checks": "paper string, claim string, decision string, passages array<string>, scope_summary string, scopes array<struct<decision:string,passages:array<string>>>", "coverage_checks": "paper string, target string, passages array<string>", "passages": DRAFT_KINDS["passages"]}


def test_audits(spark):
    cases = [
        ({}, []),
        ({"claim_checks": []}, ["claim_checks"]),
        ({"claim_checks": [check(), check()]}, ["claim_checked_twice"]),
        ({"coverage_checks": []}, ["coverage_checks"]),
        ({"coverage_checks": AUDIT["coverage_checks"] * 2}, ["target_checked_twice"]),
        ({"coverage_checks": [("p", "h", ["b1"])]}, ["check_passage"]),
        ({"claim_checks": [check(passages=("a1", "b1"))]}, ["check_passage"]),
        ({"claim_checks": [check(scopes=(("supported", ("b1",)),))]}, ["scope_passage"]),
        ({"claim_checks": [check(summary=None)]}, ["scope_missing"]),
        ({"claim_checks": [check(scopes=None)]}, ["scope_missing", "scope_needed"]),
        ({"claim_checks": [check(scopes=())]}, ["scope_needed"]),
        ({"claim_checks": [check(scopes=())], "claims": [("p", "c", "method", ["a1"])]}, []),
        ({"claim_checks": [check(scopes=(("supported", ()),))]}, ["scope_without_evidence"]),
        ({"claim_checks": [check(scopes=(("overstated", ("a1",)),))]}, ["open_scope"]),
        ({"claim_checks": [check("unsupported", scopes=(("overstated", ("a1",)),))]}, []),
        ({"claim_checks": [check(passages=("a2",))]}, ["own_evidence"]),
    ]
    hold(spark, integrity.audit_violations, AUDIT, AUDIT_KINDS, cases)


PUBLISHED = {"papers": [("p", "complete", None), ("q", "unresolved", "why")], "targets": [("p", "h"), ("q", "h")], "pages": [("p", 1, "v"), ("q", 1, "v")], "missing": [("p", 2)], "passages": [("p", "a1", 1, "v")], "reviews": [("p", 0, 0), ("p", 1, 1)], "versions": [("p", 0, True), ("p", 1, True)], "accepted": [("p", "h", "x")], "published": [("p", "h", "x")]}
PUBLISHED_KINDS = {"papers": "paper string, status string, diagnostic string", "targets": "paper string, target string", "pages": "paper string, page int, sha256 string", "missing": "paper string, page int", "passages": "paper string, passage string, page int, page_sha256 string", "reviews": "paper string, round int, evidence_version int", "versions": "paper string, version int, reported boolean", "accepted": "paper string, target string, content string", "published": "paper string, target string, content string"}


def test_published(spark):
    cases = [
        ({}, []),
        ({"targets": [("p", "h"), ("p", "h2"), ("q", "h")], "papers": [("p", "partial", "one is left"), PUBLISHED["papers"][1]]}, []),
        ({"targets": [("p", "h"), ("p", "h2"), ("q", "h")]}, ["completeness", "diagnostic"]),
        ({"pages": PUBLISHED["pages"] * 2}, ["repeated_page"]),
        ({"passages": PUBLISHED["passages"] * 2}, ["repeated_passage"]),
        ({"missing": [("p", 1)]}, ["loaded_and_missing"]),
        ({"passages": [("p", "a1", 1, "old")]}, ["page_version"]),
        ({"passages": [("p", "a1", 7, "v")]}, ["page_version"]),
        ({"passages": []}, ["without_evidence"]),
        ({"versions": [("p", 0, True), ("p", 1, True), ("p", 2, True)]}, ["superseded_evidence"]),
        ({"versions": [("p", 0, True), ("p", 2, True)], "reviews": [("p", 0, 2)]}, ["evidence_sequence"]),
        ({"versions": [("p", 0, True), ("p", 1, False)]}, ["unbound_review"]),
        ({"published": [("p", "h", "y")]}, ["projection"]),
        ({"accepted": []}, ["completeness", "diagnostic", "projection"]),
        ({"papers": [("p", "failed", None), PUBLISHED["papers"][1]]}, ["completeness", "published_status"]),
        ({"papers": [("p", "complete", "why"), PUBLISHED["papers"][1]]}, ["diagnostic"]),
        ({"papers": [PUBLISHED["papers"][0], ("q", "unresolved", None)]}, ["diagnostic"]),
        ({"papers": [PUBLISHED["papers"][0], ("q", "partial", "why")]}, ["diagnostic"]),
    ]
    hold(spark, integrity.published_violations, PUBLISHED, PUBLISHED_KINDS, cases)


PAGE = "the text of a page"
SUPPORT = {"expected": [("d", "p", "v")], "artifacts": [("d", "p", "v")], "references": [("d", "p#1", "p", hashlib.sha256(PAGE.encode()).hexdigest())], "pages": [("d", "p#1", "p", PAGE)], "evidence": [("d", "p", "/x", "quoted", "/o")], "values": [("p", "/x", "quoted in full", "/o")]}
SUPPORT_KINDS = {"expected": "direction string, paper string, sha256 string", "artifacts": "direction string, paper string, sha256 string", "references": "direction string, page string, paper string, sha256 string", "pages": "direction string, page string, paper string, text string", "evidence": "direction string, paper string, value_path string, source_value string, provenance_path string", "values": "paper string, value_path string, source_value string, provenance_path string"}


def test_support(spark):
    cases = [
        ({}, []),
        ({"artifacts": [("d", "p", "w")]}, ["artifact"]),
        ({"artifacts": SUPPORT["artifacts"] * 2}, ["repeated_artifact"]),
        ({"pages": []}, ["page"]),
        ({"pages": SUPPORT["pages"] * 2}, ["repeated_page"]),
        ({"pages": [("d", "p#1", "p", "another")]}, ["page_content"]),
        ({"pages": [("d", "p#1", "q", PAGE)]}, ["page_content"]),
        ({"values": [("p", "/x", "not quoted", "/o")]}, ["evidence"]),
        ({"values": [("p", "/x", "quoted", None)]}, ["evidence"]),
        ({"values": []}, ["evidence"]),
    ]
    hold(spark, integrity.support_violations, SUPPORT, SUPPORT_KINDS, cases)


DIRECTION = {"drafts": [("d", 2, 1)], "claims": [("d", "c", ["e1", "e2"], ["g1", "g2"])], "hypotheses": [("d", "h", ["e1"])], "evidence": [("d", "e1", "p"), ("d", "e2", "q")], "pages": [("d", "g1", "p"), ("d", "g2", "q")], "supporting": [("d", "p")]}
DIRECTION_KINDS = {"drafts": "direction string, n_hypotheses int, n_experiments int", "claims": "direction string, claim string, evidence array<string>, pages array<string>", "hypotheses": "direction string, hypothesis string, evidence array<string>", "evidence": "direction string, evidence string, paper string", "pages": "direction string, page string, paper string", "supporting": "direction string, paper string"}


def test_direction_drafts(spark):
    cases = [
        ({}, []),
        ({"drafts": [("d", 7, 1)]}, ["cap"]),
        ({"drafts": [("d", 1, 7)]}, ["cap"]),
        ({"claims": [("d", "c", ["e1", "e1"], ["g1"])]}, ["repeated_citation"]),
        ({"hypotheses": [("d", "h", ["e1", "e1"])]}, ["repeated_citation"]),
        ({"claims": [("d", "c", ["e1", "e9"], ["g1"])]}, ["unknown_evidence"]),
        ({"hypotheses": [("d", "h", ["e9"])]}, ["unknown_evidence"]),
        ({"claims": [("d", "c", ["e1"], ["g1", "g9"])]}, ["unknown_page"]),
        ({"claims": [("d", "c", ["e1", "e2"], ["g1"])]}, ["uncovered_paper"]),
        ({"claims": [("d", "c", ["e2"], ["g2"])]}, ["no_supporting_citation"]),
    ]
    hold(spark, provenance.draft_violations, DIRECTION, DIRECTION_KINDS, cases)


def test_critics_and_packets(spark):
    rows = [("r", "original", 0, "o"), ("r", "repair", 1, "r1"), ("r", "repair", 2, "r2"), ("r", "cycle", 1, "c1"), ("r", "cycle", 2, None), ("s", "original", 0, "o"), ("s", "repair", 3, None), ("t", "cycle", 1, None)]
    got = {r["run"]: r["critic"] for r in provenance.current_critics(spark.createDataFrame(rows, "run string, part string, number int, critic string")).collect()}
    assert got == {"r": "c1", "s": None}
    targets = spark.createDataFrame([("d", "t0", "direction"), ("d", "h1", "hypothesis"), ("d", "h2", "hypothesis")], "direction string, target string, level string")
    evidence = spark.createDataFrame([("d", "t0", "p", "c", ["x"]), ("d", "h1", "p", "c", ["x", "lone"]), ("d", "h2", "q", "c", ["gone"])], "direction string, target string, paper string, claim string, passages array<string>")
    passages = spark.createDataFrame([("d", "x", "g1"), ("d", "y", "g1"), ("d", "z", "g2"), ("d", "lone", None)], "direction string, passage string, page string")
    own, shown = provenance.hypothesis_packets(targets, evidence, passages)
    assert sorted(r["target"] for r in own.collect()) == ["h1", "h2"]
    assert sorted((r["target"], r["passage"]) for r in shown.collect()) == [("h1", "lone"), ("h1", "x"), ("h1", "y")]
