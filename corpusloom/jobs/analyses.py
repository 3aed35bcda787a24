"""Queries over nested analyses: documents, their sentences dealt to the sections of the schema in turn.

Sentence j of a text goes to section j % 16, where it is row j / 16; source and lang fill the other fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.jobs.registry import query
from corpusloom.operators import cards, evidence, flatten, packing
from corpusloom.sources.tables import table

SECTIONS = 16


def papers(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, doc, title, venue, year) of the documents."""
    source, lang, lit = F.col("source"), F.col("lang"), F.lit
    pick = lambda k: F.filter("s", lambda x, j: j % SECTIONS == k)
    places = lambda x: F.array(F.struct((F.length(x) % 9).alias("page"), *(F.lit(None).cast("string").alias(n) for n in ("section", "table", "figure", "equation", "appendix"))))
    odd = lambda x, yes, no: F.when(F.length(x) % 2 == 1, yes).otherwise(no)

    def rows(k: int, fields) -> tuple[Column, object]:
        return pick(k), fields

    result = lambda x: (F.array(x), lambda y: {"method": source, "metric": lit("Accuracy"), "value": F.length(y), "unit": lit("%"), "dataset_or_setting": lang})
    given = {
        "paper_metadata": {"title": lit("A title."), "year": lit("2024"), "authors": F.array(source), "paper_type": lang, "research_areas": F.array(lang), "keywords": F.array(source, lang)},
        "research_problem": {"specific_problem": F.get("s", lit(0)), "why_difficult": lang, "research_questions": pick(15)},
        "research_gap": {"gap_description": F.get("s", lit(1)), "limitations_of_prior_work": source},
        "key_results": rows(0, lambda x: {"finding": x, "quantitative_result": source, "source_locations": places(x)}),
        "experiments": rows(1, lambda x: {"experiment_name": source, "setup": x, "key_result": x, "authors_conclusion": lang, "datasets": F.array(lang, source), "evidence_supports_conclusion": lit("yes"), "source_locations": places(x), "results": result(x)}),
        "ablations": rows(2, lambda x: {"component_or_variable": source, "change": x, "result": lang}),
        "scaling_and_sensitivity": rows(3, lambda x: {"variable": source, "values_tested": F.array(lang, x), "observed_trend": x}),
        "interesting_findings": rows(4, lambda x: {"finding": x, "expected_or_unexpected": odd(x, "unexpected", "expected")}),
        "failure_cases": rows(5, lambda x: {"failure": x, "conditions": source, "source_locations": places(x)}),
        "limitations": {"author_stated": rows(6, lambda x: {"limitation": x, "impact": lang}), "inferred": rows(7, lambda x: {"limitation": x, "severity": odd(x, "high", "low"), "reasoning": source})},
        "claims_and_evidence": rows(8, lambda x: {"claim": x, "claim_type": lit("empirical"), "evidence": source}),
        "method": {"high_level_idea": source, "architecture": {"description": lang}, "components": rows(9, lambda x: {"name": source, "purpose": x}), "systems_characteristics": {"latency": lang, "memory": source}},
        "contributions": rows(10, lambda x: {"contribution": x, "contribution_type": odd(x, "method", "analysis")}),
        "future_work": {"author_proposed": rows(11, lambda x: {"direction": x}), "inferred_research_opportunities": rows(12, lambda x: {"observation_or_limitation": x, "research_question": lang, "confidence": lit("low"), "supporting_source_locations": places(x)})},
        "metrics": rows(13, lambda x: {"name": lit("accuracy"), "what_it_measures": x, "better_direction": lit("higher")}),
        "datasets": rows(14, lambda x: {"name": F.concat(lit(" "), odd(x, "Set", "set"), lit(" "))}),
        "models": (F.array(lang, source, lang), lambda x: {"name": x}),
        "experimental_setup": {"hardware": F.array(lit("gpu"), lang), "number_of_runs": lit("3")},
    }
    cut = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.filter(T.sentences(F.coalesce("text", lit(""))), lambda x: F.trim(x) != "").alias("s"), F.coalesce("source", lit("")).alias("source"), F.coalesce("lang", lit("")).alias("lang"))
    none = lit(None).cast("string")
    return cut.select("paper_id", flatten.shaped(flatten.schema(), given).alias("doc"), none.alias("title"), source.alias("venue"), none.alias("year"))


#: Documents with their sentences (s), and those one by one: k the section, i the row in it, x the text.
BASE = rf"""
d AS (SELECT doc_id::VARCHAR AS paper_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents),
p AS (SELECT paper_id, source, lang, (j - 1) % {SECTIONS} AS k, ((j - 1) // {SECTIONS})::VARCHAR AS i, s[j] AS x FROM (SELECT *, unnest(range(1, length(s) + 1)) AS j FROM d))"""
#: What odd lengths say.
ODD = lambda yes, no: f"CASE WHEN length(x) % 2 = 1 THEN '{yes}' ELSE '{no}' END"


def _joined(*parts: str) -> str:
    return "trim(concat_ws(' ', " + ", ".join(f"nullif({p}, '')" for p in parts) + "))"


def _said(label: str, column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN '{label}: ' || {column} END"


_HARD = "concat_ws('; ', 'gpu', nullif(trim(lang), ''))"
_LIST = "concat_ws('; ', nullif(trim(lang), ''), nullif(trim(source), ''))"
_EVIDENCE = f"""WITH {BASE}, m AS (SELECT paper_id, arg_max(x, i::INT) AS what FROM p WHERE k = 13 GROUP BY paper_id), e AS (
SELECT paper_id, 'key result' AS label, '/key_results/' || i AS value_path, '/key_results/' || i AS provenance_path, {_joined('x', 'source')} AS source_value, '' AS context, false AS boundary, 1 AS n_locations FROM p WHERE k = 0
UNION ALL SELECT paper_id, 'experiment', '/experiments/' || i, '/experiments/' || i, {_joined("source || ':'", 'x', 'lang')}, {_joined("'setup: ' || x", _said('datasets', _LIST), _said('hardware', _HARD), "'evidence_supports_conclusion: yes'")}, false, 1 FROM p WHERE k = 1 AND true
UNION ALL SELECT paper_id, 'experiment result', '/experiments/' || i || '/results/0', '/experiments/' || i, source || ' — Accuracy = ' || length(x) || ' %' || CASE WHEN lang <> '' THEN ' (' || lang || ')' ELSE '' END, concat_ws(' ', {_said('experiment', 'source')}, {_said('setup', 'x')}, {_said('hardware', _HARD)}, 'metric definition: ' || what, CASE WHEN what IS NOT NULL THEN 'better: higher' END), false, 1 FROM p LEFT JOIN m USING (paper_id) WHERE k = 1
UNION ALL SELECT paper_id, 'ablation', '/ablations/' || i, '/ablations/' || i, {_joined("source || ': ' || x || '.'", 'lang')}, {_joined(_said('hardware', _HARD))}, false, 0 FROM p WHERE k = 2
UNION ALL SELECT paper_id, 'scaling / sensitivity', '/scaling_and_sensitivity/' || i, '/scaling_and_sensitivity/' || i, {_joined("source || ' over ' || concat_ws('; ', nullif(trim(lang), ''), x) || ':'", 'x')}, '', false, 0 FROM p WHERE k = 3
UNION ALL SELECT paper_id, 'interesting finding', '/interesting_findings/' || i, '/interesting_findings/' || i, {_joined('x')}, 'expected_or_unexpected: ' || {ODD('unexpected', 'expected')}, length(x) % 2 = 1, 0 FROM p WHERE k = 4
UNION ALL SELECT paper_id, 'failure case', '/failure_cases/' || i, '/failure_cases/' || i, {_joined('x', _said('under', 'source'))}, '', true, 1 FROM p WHERE k = 5
UNION ALL SELECT paper_id, 'author-stated limitation', '/limitations/author_stated/' || i, '/limitations/author_stated/' || i, {_joined('x', 'lang')}, '', true, 0 FROM p WHERE k = 6
UNION ALL SELECT paper_id, 'extractor-inferred limitation (severity ' || {ODD('high', 'low')} || ')', '/limitations/inferred/' || i, '/limitations/inferred/' || i, {_joined('x')}, {_joined(_said('reasoning', 'source'))}, true, 0 FROM p WHERE k = 7
UNION ALL SELECT paper_id, 'claim (empirical, evidence None)', '/claims_and_evidence/' || i, '/claims_and_evidence/' || i, {_joined('x', _said('evidence', 'source'))}, '', false, 0 FROM p WHERE k = 8
UNION ALL SELECT paper_id, 'method component', '/method/components/' || i, '/method/components/' || i, {_joined("source || ': ' || x || '.'")}, '', false, 0 FROM p WHERE k = 9
UNION ALL SELECT paper_id, 'contribution (' || {ODD('method', 'analysis')} || ')', '/contributions/' || i, '/contributions/' || i, {_joined('x')}, '', false, 0 FROM p WHERE k = 10
UNION ALL SELECT paper_id, 'author future work', '/future_work/author_proposed/' || i, '/future_work/author_proposed/' || i, {_joined('x')}, '', true, 0 FROM p WHERE k = 11
UNION ALL SELECT paper_id, 'inferred opportunity (confidence low)', '/future_work/inferred_research_opportunities/' || i, '/future_work/inferred_research_opportunities/' || i, {_joined('x', 'lang')}, '', true, 1 FROM p WHERE k = 12
UNION ALL SELECT paper_id, 'method: high-level idea', '/method/high_level_idea', '/method/architecture', trim(source), trim(lang), false, 0 FROM d
UNION ALL SELECT paper_id, 'systems characteristics', '/method/systems_characteristics', '/method/systems_characteristics', {_joined(_said('latency', 'lang'), _said('memory', 'source'))}, '', false, 0 FROM d
UNION ALL SELECT paper_id, 'research gap', '/research_gap', '/research_gap', trim(s[2]), trim(source), false, 0 FROM d
UNION ALL SELECT paper_id, 'evaluation setup', '/experimental_setup', '/experimental_setup', {_joined(_said('hardware', _HARD), "'runs: 3'")}, '', false, 0 FROM d)
SELECT *, length(list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', source_value, context)), '[a-z0-9][a-z0-9\\-]{{2,}}')), lambda t: NOT list_contains({T.STOP_WORDS!r}, t)))::BIGINT AS n_tokens FROM e WHERE source_value <> ''"""


@query(_EVIDENCE)
def evidence_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All evidence of all documents, 18 kinds, with pointers, provenance, context and boundary flags."""
    found = evidence.candidates(papers(spark, d))
    return found.select("paper_id", "label", "value_path", "provenance_path", "source_value", "context", "boundary", F.size("source_locations").alias("n_locations"), F.size("tokens").cast("long").alias("n_tokens"))


@query(f"""WITH e AS ({_EVIDENCE}), c AS (SELECT paper_id, value_path, provenance_path, source_value, n_locations, ('0x' || substr(md5(paper_id || value_path), 1, 6))::BIGINT % 5 AS turn FROM e)
SELECT paper_id, value_path, CASE WHEN paper_id::BIGINT % 13 = 0 THEN 'missing_paper' WHEN paper_id::BIGINT % 13 = 1 THEN 'changed_paper' WHEN turn = 0 THEN 'missing_value' WHEN turn = 1 THEN 'changed_value' WHEN turn = 2 THEN 'changed_provenance' WHEN turn = 3 AND n_locations > 0 THEN 'changed_locations' END AS problem FROM c""")
def revalidated_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Cited evidence, cut to a beginning and in part tampered with, against what the documents say now."""
    found = evidence.candidates(papers(spark, d))
    turn = F.conv(F.substring(F.md5(F.concat("paper_id", "value_path")), 1, 6), 16, 10).cast("long") % 5
    cited = found.select(
        "paper_id",
        F.when(turn == 0, F.concat("value_path", F.lit("/gone"))).otherwise(F.col("value_path")).alias("value_path"),
        F.when(turn == 2, F.lit("/elsewhere")).otherwise(F.col("provenance_path")).alias("provenance_path"),
        F.when(turn == 1, F.concat(F.lit("not "), "source_value")).otherwise(F.substring("source_value", 1, 40)).alias("source_value"),
        F.when(turn == 3, F.slice("source_locations", 1, 0)).otherwise(F.col("source_locations")).alias("source_locations"),
        F.md5("paper_id").alias("artifact_sha256"),
        F.col("value_path").alias("was"),
    )
    number = F.col("paper_id").cast("long")
    artifacts = found.select("paper_id").distinct().where(number % 13 != 0).select("paper_id", F.md5(F.when(number % 13 == 1, "other").otherwise(F.col("paper_id"))).alias("sha256"))
    return evidence.revalidated(cited, found, artifacts).select("paper_id", F.col("was").alias("value_path"), "problem")


#: Statements by type, with their texts; `extra` counts what the labels add.
_TYPED = f"""t AS (
SELECT paper_id, source, 'key_result' AS type, i, {_joined('trim(x)', _said('Quantitative result', 'trim(source)'))} AS text FROM p WHERE k = 0
UNION ALL SELECT paper_id, source, 'experiment', i, {_joined('trim(source)', "'Setup: ' || trim(x)", _said('Datasets', _LIST), "'Key result: ' || trim(x)", _said('Authors conclusion', 'trim(lang)'))} FROM p WHERE k = 1
UNION ALL SELECT paper_id, source, 'ablation', i, {_joined('trim(source)', "'Change: ' || trim(x)", _said('Result', 'trim(lang)'))} FROM p WHERE k = 2
UNION ALL SELECT paper_id, source, 'scaling', i, {_joined('trim(source)', "'Values tested: ' || trim(concat_ws('; ', nullif(trim(lang), ''), x))", "'Observed trend: ' || trim(x)")} FROM p WHERE k = 3
UNION ALL SELECT paper_id, source, 'interesting_finding', i, trim(x) FROM p WHERE k = 4
UNION ALL SELECT paper_id, source, 'failure_case', i, {_joined('trim(x)', _said('Conditions', 'trim(source)'))} FROM p WHERE k = 5
UNION ALL SELECT paper_id, source, 'limitation_author', i, {_joined('trim(x)', _said('Impact', 'trim(lang)'))} FROM p WHERE k = 6
UNION ALL SELECT paper_id, source, 'limitation_inferred', i, {_joined('trim(x)', _said('Reasoning', 'trim(source)'))} FROM p WHERE k = 7
UNION ALL SELECT paper_id, source, 'claim', i, {_joined('trim(x)', _said('Evidence', 'trim(source)'))} FROM p WHERE k = 8
UNION ALL SELECT paper_id, source, 'method_component', i, {_joined('trim(source)', "'Purpose: ' || trim(x)")} FROM p WHERE k = 9
UNION ALL SELECT paper_id, source, 'contribution', i, trim(x) FROM p WHERE k = 10
UNION ALL SELECT paper_id, source, 'future_work_author', i, trim(x) FROM p WHERE k = 11
UNION ALL SELECT paper_id, source, 'research_opportunity', i, {_joined("'Observation or limitation: ' || trim(x)", _said('Research question', 'trim(lang)'))} FROM p WHERE k = 12
UNION ALL SELECT paper_id, source, 'metric', i, {_joined("'accuracy'", "'What it measures: ' || trim(x)")} FROM p WHERE k = 13
UNION ALL SELECT paper_id, source, 'dataset', i, {ODD('Set', 'set')} FROM p WHERE k = 14
UNION ALL SELECT paper_id, source, 'research_question', i, 'Research question: ' || trim(x) FROM p WHERE k = 15
UNION ALL SELECT paper_id, source, 'problem', '0', {_joined("'Specific problem: ' || trim(s[1])", _said('Why difficult', 'trim(lang)'))} FROM d
UNION ALL SELECT paper_id, source, 'research_gap', '0', {_joined('trim(s[2])', _said('Limitations of prior work', 'trim(source)'))} FROM d
UNION ALL SELECT paper_id, source, 'method', '0', {_joined('trim(source)', 'trim(lang)')} FROM d
UNION ALL SELECT paper_id, source, 'systems', '0', {_joined(_said('Memory', 'trim(source)'), _said('Latency', 'trim(lang)'))} FROM d
UNION ALL SELECT paper_id, source, 'model', (row_number() OVER (PARTITION BY paper_id ORDER BY n) - 1)::VARCHAR, trim(x) FROM (SELECT paper_id, source, unnest([lang, source, lang]) AS x, unnest([1, 2, 3]) AS n FROM d) WHERE trim(x) <> ''
UNION ALL SELECT paper_id, source, 'evaluation_setup', '0', 'Hardware: ' || {_HARD} FROM d
UNION ALL SELECT paper_id, source, 'tags', '0', concat_ws('; ', nullif(trim(source), ''), nullif(trim(lang), '')) FROM d)"""


def _chunked(text: str, limit: str) -> str:
    """Chunks of a text by a fold over its sentences, in SQL."""
    sentences = rf"string_split(regexp_replace({text}, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1))"
    heads = f"CASE WHEN length(y.cur) > {limit} THEN (ceil(length(y.cur) / {limit}::DOUBLE) - 1)::INT ELSE 0 END"
    tail = f"substr(y.cur, ({heads}) * {limit} + 1)"
    full = f"(a.cur <> '' AND length(a.cur) + length({tail}) + 1 > {limit})"
    step = f"{{'parts': list_concat(a.parts, list_concat(list_transform(range({heads}), lambda h: substr(y.cur, (h * {limit} + 1)::BIGINT, {limit})), CASE WHEN {full} THEN [a.cur] ELSE []::VARCHAR[] END)), 'cur': CASE WHEN {full} THEN {tail} ELSE trim(a.cur || ' ' || {tail}) END}}"
    start = "{'parts': []::VARCHAR[], 'cur': ''}"
    folded = f"list_reduce(list_concat([{start}], list_transform({sentences}, lambda z: {{'parts': []::VARCHAR[], 'cur': z}})), lambda a, y: {step})"
    return f"CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN length({text}) <= {limit} THEN [{text}] ELSE (SELECT list_concat(f.parts, CASE WHEN f.cur <> '' THEN [f.cur] ELSE []::VARCHAR[] END) FROM (SELECT {folded} AS f)) END"


@query(f"""WITH c AS (SELECT doc_id, {_chunked("coalesce(text, '')", '4000')} AS parts FROM documents)
SELECT doc_id, (k - 1)::INT AS chunk, parts[k] AS chunk_text FROM (SELECT *, unnest(range(1, length(parts) + 1)) AS k FROM c)""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every text in chunks of 4,000 characters along its sentences."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "chunk_text"))


@query(f"WITH {BASE}, {_TYPED} SELECT paper_id, type, count(*) AS n FROM t WHERE text <> '' GROUP BY ALL")
def statement_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statements by paper and type; the chunks of one statement count once."""
    own = flatten.records(papers(spark, d)).select("paper_id", "type", F.regexp_replace("record_id", "#p[0-9]+$", "").alias("statement"))
    return own.distinct().groupBy("paper_id", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {BASE}, {_TYPED}, c AS (SELECT *, {_chunked('text', '3991')} AS parts FROM t WHERE text <> '')
SELECT paper_id || '#' || type || '/' || i || CASE WHEN length(parts) > 1 THEN '#p' || (n - 1) ELSE '' END AS record_id, paper_id, type, 'A title. ' || parts[n] AS text, 2024 AS year, source AS venue
FROM (SELECT *, unnest(range(1, length(parts) + 1)) AS n FROM c)""")
def statement_records(spark: SparkSession, d: str) -> DataFrame:
    """Every typed record of every document."""
    return flatten.records(papers(spark, d)).select("record_id", "paper_id", "type", "text", "year", "venue")


_CATALOGUE = "paper_id::BIGINT % 3"


@query(f"""WITH {BASE}, g AS (SELECT paper_id, list(x ORDER BY i::INT) FILTER (WHERE k = 14) AS sets FROM p GROUP BY paper_id)
SELECT paper_id, CASE WHEN {_CATALOGUE} = 0 THEN 'Catalogue ' || paper_id ELSE 'A title.' END AS title, CASE WHEN {_CATALOGUE} = 0 THEN 'Conf 2031' ELSE NULL END AS venue,
CASE WHEN {_CATALOGUE} = 0 THEN 'Conf.org/2031' END AS venueid, 2024 AS year, lang AS paper_type, array_to_string(CASE WHEN lower(trim(lang)) = lower(trim(source)) OR trim(source) = '' THEN [trim(lang)] ELSE [trim(lang), trim(source)] END, '|') AS model_names,
array_to_string(list_filter([{ODD('Set', 'set').replace('(x)', '(sets[1])')}], lambda z: sets[1] IS NOT NULL), '|') AS dataset_names, array_to_string(CASE WHEN {_CATALOGUE} = 0 THEN ['A', 'B'] ELSE [source] END, '|') AS authors,
source || '|' || lang AS keywords, '3' AS number_of_runs, 'f/' || paper_id AS folder FROM d LEFT JOIN g USING (paper_id)""")
def paper_rows(spark: SparkSession, d: str) -> DataFrame:
    """Papers as flat rows; every third is in the catalogue, whose values go first."""
    number = F.col("paper_id").cast("long")
    entry = F.struct(F.concat(F.lit("Catalogue "), "paper_id").alias("title"), F.array(F.lit("A"), F.lit("B")).alias("authors"), F.lit("Conf 2031").alias("venue"), F.lit("Conf.org/2031").alias("venueid"), F.lit("An abstract.").alias("abstract"), F.col("paper_id").alias("id"), F.lit(None).cast("string").alias("forum_url"))
    own = papers(spark, d).select("paper_id", "doc", F.when(number % 3 == 0, entry).alias("catalogue"), F.concat(F.lit("f/"), "paper_id").alias("folder"))
    told = cards.paper_rows(own)
    lists = ("model_names", "dataset_names", "authors", "keywords")
    return told.select("paper_id", "title", "venue", "venueid", "year", "paper_type", *(F.array_join(n, "|").alias(n) for n in lists), "number_of_runs", "folder")


@query(f"""WITH {BASE}, g AS (SELECT paper_id, count(*) FILTER (WHERE k = 0) AS findings, count(*) FILTER (WHERE k = 4) AS interesting, count(*) FILTER (WHERE k IN (6, 7)) AS limits, count(*) FILTER (WHERE k = 8) AS claims, count(*) FILTER (WHERE k IN (11)) AS future, count(*) FILTER (WHERE k = 12) AS asked, count(*) FILTER (WHERE k = 15) AS questions FROM p GROUP BY paper_id)
SELECT paper_id, coalesce(s[1], '') AS problem, coalesce(findings, 0) AS n_findings, coalesce(interesting, 0) AS n_interesting, coalesce(limits, 0) AS n_limitations, coalesce(claims, 0) AS n_claims, (coalesce(future, 0) + CASE WHEN lang <> '' THEN coalesce(asked, 0) ELSE 0 END)::BIGINT AS n_future, coalesce(questions, 0) AS n_questions,
array_to_string(list_filter(['research_problem.specific_problem', 'key_results/interesting_findings', 'claims_and_evidence'], lambda m: (m = 'research_problem.specific_problem' AND s[1] IS NULL) OR (m = 'key_results/interesting_findings' AND coalesce(findings, 0) + coalesce(interesting, 0) = 0) OR (m = 'claims_and_evidence' AND coalesce(claims, 0) = 0)), '|') AS missing FROM d LEFT JOIN g USING (paper_id)""")
def context_cards(spark: SparkSession, d: str) -> DataFrame:
    """The flat card of each paper: its problem, how many statements of each kind, what is missing."""
    card = lambda *fields: sum((F.size(f"card.{f}") for f in fields[1:]), F.size(f"card.{fields[0]}")).cast("long")
    told = cards.context_cards(papers(spark, d))
    return told.select("paper_id", F.col("card.problem").alias("problem"), card("findings").alias("n_findings"), card("interesting_findings").alias("n_interesting"), card("limitations", "inferred_limitations").alias("n_limitations"), card("claims").alias("n_claims"), card("future_work").alias("n_future"), card("research_questions").alias("n_questions"), F.array_join("missing_fields", "|").alias("missing"))


@query(f"""WITH {BASE}, l AS (SELECT paper_id, 2 AS o, 0 AS n, 'Method components: ' || source AS line, i::INT AS i FROM p WHERE k = 9 AND source <> ''
UNION ALL SELECT paper_id, 3, 0, 'Findings: ' || x, i::INT FROM p WHERE k = 0 UNION ALL SELECT paper_id, 4, 0, 'Interesting findings: ' || x, i::INT FROM p WHERE k = 4
UNION ALL SELECT paper_id, 5, 0, 'Limitations: ' || x, i::INT FROM p WHERE k = 6 UNION ALL SELECT paper_id, 6, 0, 'Inferred limitations: ' || x, i::INT FROM p WHERE k = 7
UNION ALL SELECT paper_id, 7, 0, 'Assumptions / difficulties: ' || lang, 0 FROM d WHERE lang <> ''
UNION ALL SELECT paper_id, 8, 0, 'Future work: ' || x, i::INT FROM p WHERE k = 11 UNION ALL SELECT paper_id, 8, 1, 'Future work: ' || lang, i::INT FROM p WHERE k = 12 AND lang <> ''
UNION ALL SELECT paper_id, 9, 0, 'Claims: ' || x, i::INT FROM p WHERE k = 8 UNION ALL SELECT paper_id, 0, 0, 'Title: A title.', 0 FROM d UNION ALL SELECT paper_id, 0, 1, 'Problem: ' || coalesce(s[1], ''), 0 FROM d UNION ALL SELECT paper_id, 1, 0, 'Method: ' || source, 0 FROM d WHERE source <> '')
SELECT paper_id, md5(string_agg(line, chr(10) ORDER BY o, n, i)) AS digest FROM l GROUP BY paper_id""")
def card_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the cards as labelled lines."""
    return cards.context_cards(papers(spark, d)).select("paper_id", F.md5(cards.card_text(F.col("card"))).alias("digest"))


@query(f"""WITH {BASE}, g AS (SELECT paper_id, string_agg(x, '|' ORDER BY i::INT) FILTER (WHERE k = 0) AS results, string_agg(x, '|' ORDER BY i::INT) FILTER (WHERE k = 5) AS failures, string_agg(x, '|' ORDER BY i::INT) FILTER (WHERE k = 8) AS claims FROM p GROUP BY paper_id)
SELECT paper_id, s[1] AS research_problem, source AS idea, lang AS mechanism, coalesce(results, '') AS main_results, coalesce(failures, '') AS failure_modes, coalesce(claims, '') AS claims FROM d LEFT JOIN g USING (paper_id)""")
def reasoning_cards(spark: SparkSession, d: str) -> DataFrame:
    """The nested card of each paper, some of its fields side by side."""
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    told = cards.reasoning_cards(papers(spark, d))
    return told.select("paper_id", F.col("card.problem.research_problem"), F.col("card.method.high_level_idea").alias("idea"), F.col("card.method.mechanism").alias("mechanism"), joined("card.findings.main_results").alias("main_results"), joined("card.boundaries.failure_modes").alias("failure_modes"), joined(F.transform("card.claims", lambda c: c["claim"])).alias("claims"))


@query(f"""WITH {BASE} SELECT paper_id, CASE k WHEN 0 THEN 'finding' WHEN 4 THEN 'finding' ELSE 'limitation' END AS kind, x AS text, CASE k WHEN 6 THEN 'author_stated' WHEN 7 THEN 'model_inferred' END AS origin, CASE k WHEN 6 THEN '/limitations/author_stated/' || i WHEN 7 THEN '/limitations/inferred/' || i END AS value_path FROM p WHERE k IN (0, 4, 6, 7)
UNION ALL SELECT paper_id, 'assumption', lang, NULL, NULL FROM d WHERE lang <> ''""")
def card_statements(spark: SparkSession, d: str) -> DataFrame:
    """Findings, limitations with their origin and assumptions of all cards."""
    return cards.statements(cards.context_cards(papers(spark, d)))


@query(f"""WITH {BASE}, r AS (SELECT DISTINCT paper_id, (length(x) % 9)::INT AS page FROM p WHERE k IN (0, 1, 5, 12) AND length(x) % 9 > 0), l AS (SELECT paper_id, 1 AS page FROM d UNION ALL SELECT paper_id, 8 FROM d)
SELECT paper_id, page, r.page IS NOT NULL AS referenced FROM (SELECT * FROM r UNION SELECT * FROM l) u LEFT JOIN r USING (paper_id, page)""")
def paper_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a paper has (1 and 8) or its locations name."""
    own = papers(spark, d)
    local = own.select("paper_id", F.explode(F.array(F.lit(1), F.lit(8))).alias("page"))
    return cards.referenced_pages(own, local)


_PACKED = lambda items, budget: f"list_reduce(list_concat([{{'u': 0::BIGINT, 't': []::VARCHAR[]}}], list_transform({items}, lambda z: {{'u': z.s, 't': [z.p]}})), lambda a, y: CASE WHEN a.u + y.u <= {budget} THEN {{'u': a.u + y.u, 't': list_concat(a.t, y.t)}} ELSE a END)"
_BUNDLES = f"""g AS (SELECT l_partkey AS thread, l_suppkey AS paper, list({{'o': -l_discount, 'p': concat_ws('/', '', l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT), 's': least(length(l_returnflag) + l_quantity::INT * 3, 120)::BIGINT, 'b': l_returnflag = 'R'}} ORDER BY -l_discount, concat_ws('/', '', l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT)) AS items FROM lineitem GROUP BY ALL),
h AS (SELECT g.*, floor(6000 / n)::BIGINT AS share FROM g JOIN (SELECT thread, count(*) AS n FROM g GROUP BY thread) USING (thread)),
f AS (SELECT *, {_PACKED('list_filter(items, lambda z: z.b)', 'floor(share * 0.3)')} AS first FROM h),
m AS (SELECT *, {_PACKED('list_filter(items, lambda z: NOT list_contains(first.t, z.p))', 'share - first.u')} AS more FROM f),
b AS (SELECT thread, paper, items, list_concat(first.t, more.t) AS kept, first.u + more.u AS used FROM m)"""


def _line_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Line items as evidence of parts by supplier."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("thread"), F.col("l_suppkey").alias("paper"), F.concat_ws("/", F.lit(""), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("path"), F.col("l_discount").alias("relevance"), (F.col("l_returnflag") == "R").alias("boundary"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int") * 3).alias("value"), F.col("l_returnflag").alias("context"))


@query(f"WITH {_BUNDLES} SELECT thread, paper, array_to_string(kept, ' ') AS kept, (length(items) - length(kept))::BIGINT AS n_omitted, used FROM b")
def evidence_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Evidence packed into a budget of 6,000 characters for each part."""
    told = packing.bundle(_line_evidence(spark, d), 6000, longest=120)
    return told.select("thread", "paper", F.array_join("kept", " ").alias("kept"), F.size("omitted").cast("long").alias("n_omitted"), "used")


@query(f"""WITH {_BUNDLES}, k AS (SELECT thread, paper, unnest(kept) AS path FROM b), l AS (SELECT *, concat_ws('/', '', l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS path, l_quantity::INT * 3 AS n FROM lineitem)
SELECT printf('%s-e%03d', thread::VARCHAR, row_number() OVER (PARTITION BY thread ORDER BY paper, path)) AS evidence_id, paper, path, least(n, 120)::INT AS value_chars, substr(l_returnflag, 1, greatest(0, 120 - n)) AS context, n + 1 > 120 AS truncated FROM k JOIN l ON k.thread = l_partkey AND k.paper = l_suppkey AND k.path = l.path""".replace("paper, path, least", "paper, k.path AS path, least").replace("ORDER BY paper, path)) AS evidence_id", "ORDER BY paper, k.path)) AS evidence_id"))
def bundle_items(spark: SparkSession, d: str) -> DataFrame:
    """The items of the bundles with their ids; values cut to 120 characters with their context."""
    own = _line_evidence(spark, d)
    told = packing.bundle_items(packing.bundle(own, 6000, longest=120), own, 120)
    return told.select("evidence_id", "paper", "path", F.length("value").alias("value_chars"), "context", "truncated")


_BUDGET = lambda a, z: f"{a}.n < 4 AND {a}.u + {z}.t <= 60"


@query("""WITH c AS (SELECT l_suppkey AS thread, l_partkey AS paper, l_linenumber AS page, count(*) AS demand, sum(l_quantity)::BIGINT AS tokens FROM lineitem GROUP BY ALL),
g AS (SELECT thread, list({'paper': paper, 'page': page, 't': tokens} ORDER BY demand DESC, paper, page) AS items FROM c GROUP BY thread),
f AS (SELECT thread, list_reduce(list_concat([{'n': 0, 'u': 0::BIGINT, 'k': []::VARCHAR[]}], list_transform(items, lambda z: {'n': 1, 'u': z.t, 'k': [z.paper || '#' || z.page]})), lambda a, y: CASE WHEN a.n < 4 AND a.u + y.u <= 60 THEN {'n': a.n + 1, 'u': a.u + y.u, 'k': list_concat(a.k, y.k)} ELSE a END).k AS kept FROM g)
SELECT thread, paper, page, list_contains(kept, paper || '#' || page) AS supplied FROM c JOIN f USING (thread)""")
def supplied_pages(spark: SparkSession, d: str) -> DataFrame:
    """Which cited pages a review is given: the most wanted, four at most, within 60 tokens."""
    cited = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("thread"), F.col("l_partkey").alias("paper"), F.col("l_linenumber").alias("page")).agg(F.count("*").alias("demand"), F.sum("l_quantity").cast("long").alias("tokens"))
    return packing.page_budget(cited, "thread", 4, 60)
