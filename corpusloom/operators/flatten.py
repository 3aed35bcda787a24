"""Nested document analyses as typed statement records.

Every record type is one line of a contract: where its rows are, which fields make its text, which its metadata.
All types become one array expression and one explode, so a document is read and parsed once, not once for each
type, and its counters are positions in that array: nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusloom.functions import text as T

CHUNK_CHARS = 4000


class RecordType(NamedTuple):
    name: str
    path: str  # of a struct, `a.b[]` of an array of structs, `a.b*` of an array of strings
    parts: tuple[str, ...]  # text fields in order; `.` before one: without its label; `*` after one: a list
    meta: tuple[str, ...]


def _contract(lines: str) -> tuple[RecordType, ...]:
    rows = (line.split("|") for line in lines.strip().splitlines())
    return tuple(RecordType(a.strip(), b.strip(), tuple(c.split()), tuple(d.split())) for a, b, c, d in rows)


#: The record types, their places, text fields and metadata fields.
RECORD_TYPES = _contract("""
summary | high_level_summary | .one_sentence_summary general_problem specific_problem proposed_solution main_result why_it_matters |
problem | research_problem | general_problem specific_problem motivation why_difficult |
research_question | research_problem.research_questions* | research_question |
hypothesis | research_problem.hypotheses* | hypothesis |
research_gap | research_gap | .gap_description what_existed_before limitations_of_prior_work why_existing_methods_are_insufficient evidence_for_gap | gap_explicitly_claimed_by_authors
prior_work | prior_work[] | method_or_family .description strengths* limitations* relationship_to_current_paper |
contribution | contributions[] | .contribution novelty_claim what_existed_before what_this_paper_changes why_it_matters | contribution_type explicitly_claimed_by_authors
method | method | .high_level_idea |
architecture | method.architecture | .description model_components* information_flow |
pipeline_step | method.pipeline[] | step .name .description inputs* outputs* |
method_component | method.components[] | .name purpose inputs* operations* outputs* technical_details | novel_component
objective | method.objectives_and_losses[] | .name .description purpose |
equation | method.important_equations[] | .meaning importance |
training | method.training | training_procedure training_data preprocessing optimization initialization fine_tuning_strategy regularization compute_requirements |
inference | method.inference | procedure decoding_or_sampling complexity latency_considerations throughput_considerations memory_considerations |
systems | method.systems_characteristics | time_complexity space_complexity flops memory memory_bandwidth communication_cost latency throughput other* |
model | models[] | .name role architecture parameter_count |
dataset | datasets[] | .name purpose size task domain important_characteristics* |
baseline | baselines[] | .name .description why_selected relationship_to_proposed_method |
metric | metrics[] | .name .description what_it_measures |
evaluation_setup | experimental_setup | hardware* software* statistical_testing other_details* |
experiment | experiments[] | .experiment_name research_question hypothesis_being_tested setup comparison datasets* models* baselines* metrics* key_result authors_conclusion | evidence_supports_conclusion
ablation | ablations[] | .component_or_variable change motivation baseline_setting modified_setting result quantitative_change interpretation |
scaling | scaling_and_sensitivity[] | .variable values_tested* observed_trend interpretation |
key_result | key_results[] | .finding quantitative_result comparison importance |
interesting_finding | interesting_findings[] | .finding why_interesting possible_implication | expected_or_unexpected authors_discuss_implication
figure_table | important_figures_and_tables[] | .identifier what_it_shows key_observation importance | type
failure_case | failure_cases[] | .failure conditions observed_behavior possible_cause implication |
limitation_author | limitations.author_stated[] | .limitation impact |
limitation_inferred | limitations.inferred[] | .limitation reasoning evidence | severity
future_work_author | future_work.author_proposed[] | .direction motivation |
research_opportunity | future_work.inferred_research_opportunities[] | observation_or_limitation research_question why_it_matters potential_approach | confidence
claim | claims_and_evidence[] | .claim evidence reasoning | claim_type evidence_strength
reproducibility | reproducibility | required_resources* missing_information* reproducibility_assessment |
paper_card | paper_assessment | main_strengths* main_weaknesses* most_important_contribution most_important_result most_important_limitation what_the_paper_demonstrates what_the_paper_does_not_demonstrate |
open_question | paper_assessment | most_interesting_open_question |
tags | retrieval_tags | problems* methods* architectures* model_families* training_techniques* inference_techniques* optimization_techniques* datasets* benchmarks* metrics* applications* hardware_or_system_topics* theoretical_topics* |
""")
#: `method` and `architecture` make one record between them.
JOINED = {"architecture": "method"}

#: Fields of the document that no record's text has: of the paper itself, and such as are read by their path alone.
PAPER_FIELDS = """
paper_metadata.title paper_metadata.authors* paper_metadata.venue paper_metadata.year paper_metadata.paper_type
paper_metadata.identifiers[].name paper_metadata.identifiers[].value paper_metadata.research_areas* paper_metadata.keywords*
experimental_setup.number_of_runs reproducibility.code_available reproducibility.code_url reproducibility.data_available
reproducibility.data_url reproducibility.model_checkpoints_available
""".split()
ON_DEMAND = """
prior_work[].citations_mentioned_in_paper* method.objectives_and_losses[].equation method.important_equations[].equation_identifier
method.important_equations[].equation method.important_equations[].variables[].symbol method.important_equations[].variables[].meaning
method.training.important_hyperparameters[].name method.training.important_hyperparameters[].value models[].configuration[].name
models[].configuration[].value models[].pretrained datasets[].train_split datasets[].validation_split datasets[].test_split
metrics[].better_direction experimental_setup.training_configuration[].name experimental_setup.training_configuration[].value
experimental_setup.inference_configuration[].name experimental_setup.inference_configuration[].value experimental_setup.random_seeds
experiments[].results[].method experiments[].results[].metric experiments[].results[].value experiments[].results[].raw_value
experiments[].results[].unit experiments[].results[].dataset_or_setting reproducibility.reproduction_steps*
""".split()
#: The one place whose locations have another name.
OTHER_LOCATIONS = {"future_work.inferred_research_opportunities[]": "supporting_source_locations"}
LOCATION = t.StructType([t.StructField("page", t.IntegerType()), *(t.StructField(n, t.StringType()) for n in ("section", "table", "figure", "equation", "appendix"))])


def schema() -> t.StructType:
    """The nested schema that the contract implies, for from_json."""
    tree: dict = {}

    def put(path: list[str], leaf: str, kind) -> None:
        node = tree
        for p in path:
            node = node.setdefault(p, {})
        node.setdefault(leaf, kind)

    for r in RECORD_TYPES:
        path = r.path.rstrip("*").split(".")
        if r.path.endswith("*"):
            put(path[:-1], path[-1], t.ArrayType(t.StringType()))
            continue
        for part in r.parts:
            put(path, part.strip(".*"), t.ArrayType(t.StringType()) if part.endswith("*") else t.StringType())
        for m in r.meta:
            put(path, m, t.StringType())
        put(path, OTHER_LOCATIONS.get(r.path, "source_locations"), t.ArrayType(LOCATION))
    for field in (*PAPER_FIELDS, *ON_DEMAND):
        *path, leaf = field.rstrip("*").split(".")
        put(path, leaf, t.ArrayType(t.StringType()) if field.endswith("*") else t.StringType())

    def made(node) -> t.DataType:
        if not isinstance(node, dict):
            return node
        fields = []
        for name, child in node.items():
            kind = made(child)
            fields.append(t.StructField(name.rstrip("[]"), t.ArrayType(kind) if name.endswith("[]") else kind))
        return t.StructType(fields)

    return made(tree)


def _label(field: str) -> str:
    return field.replace("_", " ").capitalize()


def _text(row: Column, parts: tuple[str, ...]) -> Column:
    """The text of a record: labelled parts that have a value, joined by blanks."""
    out = []
    for part in parts:
        name = part.strip(".*")
        value = T.listed(row[name]) if part.endswith("*") else F.trim(row[name])
        out.append(("" if part.startswith(".") else _label(name), value))
    return F.trim(T.labelled(*out))


def _typed(doc: Column, r: RecordType) -> Column:
    """The records of one type as an array of structs, empty texts left out."""
    name = JOINED.get(r.name, r.name)

    def record(row: Column, text: Column, locations: Column) -> Column:
        meta = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, r.meta)), F.array(*(row[m] for m in r.meta))), lambda k, v: v.isNotNull()) if r.meta else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(name).alias("type"), text.alias("text"), F.coalesce(locations, F.array().cast(t.ArrayType(LOCATION))).alias("source_locations"), meta.alias("meta"))

    place = doc
    for step in r.path.rstrip("*").split("."):
        place = place[step.rstrip("[]")]
    if r.path.endswith("*"):
        parent = doc[r.path.split(".")[0]]
        rows = F.transform(place, lambda x: record(x, F.when(F.trim(x) != "", F.concat(F.lit(f"{_label(r.parts[0])}: "), F.trim(x))), parent["source_locations"]))
    elif r.path.endswith("[]"):
        rows = F.transform(place, lambda x: record(x, _text(x, r.parts), x[OTHER_LOCATIONS.get(r.path, "source_locations")]))
    elif r.name == "method":
        both = F.trim(F.concat_ws(" ", _text(place, r.parts), _text(place["architecture"], RECORD_TYPES[[x.name for x in RECORD_TYPES].index("architecture")].parts)))
        rows = F.array(record(place, both, place["architecture"]["source_locations"]))
    elif r.name == "tags":
        lists = F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (doc["paper_metadata"]["keywords"], *(place[p.strip("*")] for p in r.parts))))
        rows = F.array(record(place, T.listed(lists), F.lit(None).cast(t.ArrayType(LOCATION))))
    else:
        rows = F.array(record(place, _text(place, r.parts), place["source_locations"]))
    found = F.filter(rows, lambda x: F.coalesce(x.text, F.lit("")) != "")
    numbered = F.transform(found, lambda x, i: F.struct(x.type.alias("type"), i.alias("n"), x.text.alias("text"), x.source_locations.alias("source_locations"), x.meta.alias("meta")))
    return F.coalesce(numbered, F.array().cast("array<struct<type:string,n:int,text:string,source_locations:array<struct<page:int,section:string,table:string,figure:string,equation:string,appendix:string>>,meta:map<string,string>>>"))


def records(papers: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(record_id, paper_id, type, text, source_locations, meta, year, venue, research_areas) from (paper_id, doc, title, venue, year).

    The title precedes each chunk; catalogue values (title, venue, year; null: none) go before extracted ones. A
    statement longer than `limit` less the title is cut along its sentences, its pieces numbered #p0, #p1, ...
    """
    meta = F.col("doc.paper_metadata")
    title = F.regexp_replace(F.trim(F.coalesce(F.col("title"), meta["title"], F.lit(""))), r"\.+$", "")
    venue = F.coalesce(F.col("venue"), meta["venue"])
    base = papers.select("paper_id", F.when(title != "", F.concat(title, F.lit(". "))).otherwise("").alias("prefix"), venue.alias("venue"), T.year(F.col("year"), meta["year"], venue).alias("year"), meta["research_areas"].alias("research_areas"), F.explode(F.concat(*(_typed(F.col("doc"), r) for r in RECORD_TYPES if r.name not in JOINED))).alias("r"))
    pieces = base.withColumn("pieces", T.chunks(F.col("r.text"), limit - F.length("prefix")))
    own = pieces.select("*", F.posexplode("pieces").alias("k", "piece"))
    name = F.concat("paper_id", F.lit("#"), F.col("r.type"), F.lit("/"), F.col("r.n").cast("string"))
    return own.select(F.when(F.size("pieces") > 1, F.concat(name, F.lit("#p"), F.col("k").cast("string"))).otherwise(name).alias("record_id"), "paper_id", F.col("r.type").alias("type"), F.concat("prefix", "piece").alias("text"), F.col("r.source_locations").alias("source_locations"), F.col("r.meta").alias("meta"), "year", "venue", "research_areas")


def shaped(kind: t.StructType, given: dict) -> Column:
    """A struct of the schema's type: given columns by field, dicts for structs, (array, function of an element to a dict) for arrays of structs; null otherwise."""
    fields = []
    for f in kind:
        own = given.get(f.name)
        if own is None:
            column = F.lit(None).cast(f.dataType)
        elif isinstance(own, dict):
            column = shaped(f.dataType, own)
        elif isinstance(own, tuple):
            column = F.transform(own[0], _element(f.dataType.elementType, own[1]))
        else:
            column = own.cast(f.dataType)
        fields.append(column.alias(f.name))
    return F.struct(*fields)


def _element(kind: t.StructType, fields):
    return lambda x: shaped(kind, fields(x))


def buckets() -> dict[str, list[str]]:
    """The fields of the documents by what becomes of them: TEXT of records, META of records and papers, ONDEMAND by path alone."""
    told: dict[str, list[str]] = {"TEXT": [], "META": [f.rstrip("*") for f in PAPER_FIELDS], "ONDEMAND": [f.rstrip("*") for f in ON_DEMAND]}
    for r in RECORD_TYPES:
        path = r.path.rstrip("*")
        told["TEXT"] += [path] if r.path.endswith("*") else [f"{path}.{p.strip('.*')}" for p in r.parts]
        told["META"] += [f"{path}.{m}" for m in r.meta]
    return told


def leaves(kind: t.DataType, prefix: str = "") -> list[str]:
    """All leaf paths of a schema, `[]` after arrays of structs."""
    if isinstance(kind, t.StructType):
        return [x for f in kind for x in leaves(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, t.ArrayType) and isinstance(kind.elementType, t.StructType):
        return leaves(kind.elementType, f"{prefix}[]")
    return [prefix]
