"""Evidence candidates of nested document analyses: 18 kinds, one array expression, one explode."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from corpusloom.functions import text as T
from corpusloom.operators.decisions import limitation_origin
from corpusloom.operators.flatten import LOCATION, OTHER_LOCATIONS, schema

FOUND = f"array<struct<label:string,value_path:string,provenance_path:string,source_locations:{t.ArrayType(LOCATION).simpleString()},source_value:string,context:string,boundary:boolean>>"


class Kind(NamedTuple):
    label: str
    place: str  # of a struct, or `a.b[]` of an array of structs
    value: list[str]  # parts with {fields}; a part whose fields are all empty is left out
    context: list[str]
    boundary: str  # yes, no, or a condition on the row


def _kinds(lines: str) -> tuple[Kind, ...]:
    rows = ([c.strip() for c in line.split("|")] for line in lines.strip().splitlines())
    split = lambda c: [p.strip() for p in c.split("~") if p.strip()]
    return tuple(Kind(a, b, split(c), split(d), e) for a, b, c, d, e in rows)


#: The kinds of evidence with their labels, places and parts. {hardware} is that of the whole document.
KINDS = _kinds("""
key result | key_results[] | {finding} ~ {quantitative_result} ~ {comparison} | {importance} | no
experiment | experiments[] | {experiment_name}: ~ {key_result} ~ {authors_conclusion} | setup: {setup} ~ comparison: {comparison} ~ datasets: {datasets} ~ models: {models} ~ baselines: {baselines} ~ metrics: {metrics} ~ hardware: {hardware} ~ evidence_supports_conclusion: {evidence_supports_conclusion} | no
ablation | ablations[] | {component_or_variable}: {change}. ~ {result} ~ {quantitative_change} ~ {interpretation} | baseline: {baseline_setting} ~ modified: {modified_setting} ~ motivation: {motivation} ~ hardware: {hardware} | no
scaling / sensitivity | scaling_and_sensitivity[] | {variable} over {values_tested}: ~ {observed_trend} ~ {interpretation} | | no
interesting finding | interesting_findings[] | {finding} ~ {possible_implication} | expected_or_unexpected: {expected_or_unexpected} ~ {why_interesting} | expected_or_unexpected = unexpected
failure case | failure_cases[] | {failure} ~ under: {conditions} ~ {observed_behavior} | possible cause: {possible_cause} ~ {implication} | yes
author-stated limitation | limitations.author_stated[] | {limitation} ~ {impact} | | yes
extractor-inferred limitation (severity {severity}) | limitations.inferred[] | {limitation} | reasoning: {reasoning} ~ evidence: {evidence} | yes
claim ({claim_type}, evidence {evidence_strength}) | claims_and_evidence[] | {claim} ~ evidence: {evidence} | {reasoning} | no
method component | method.components[] | {name}: {purpose}. ~ {technical_details} | novel_component: {novel_component} | no
systems characteristics | method.systems_characteristics | latency: {latency} ~ throughput: {throughput} ~ memory: {memory} ~ communication: {communication_cost} ~ {other} | | no
contribution ({contribution_type}) | contributions[] | {contribution} ~ {novelty_claim} | {what_this_paper_changes} | no
research gap | research_gap | {gap_description} | {limitations_of_prior_work} | no
author future work | future_work.author_proposed[] | {direction} ~ {motivation} | | yes
inferred opportunity (confidence {confidence}) | future_work.inferred_research_opportunities[] | {observation_or_limitation} ~ {research_question} | {why_it_matters} | yes
evaluation setup | experimental_setup | hardware: {hardware} ~ software: {software} ~ runs: {number_of_runs} ~ {other_details} | | no
""")


def _text(row: Column, kind: t.StructType, field: str, hardware: Column) -> Column:
    """A field as text, empty if it has no value; lists are joined."""
    if field == "hardware":
        return hardware
    own = T.listed(row[field]) if isinstance(kind[field].dataType, t.ArrayType) else row[field]
    return F.coalesce(own, F.lit(""))


def _part(template: str, row: Column, kind: t.StructType, hardware: Column, missing: str = "") -> Column:
    """A template with its fields filled in; null if all of them are empty and nothing stands for a missing one."""
    pieces = re.split(r"\{(\w+)\}", template)
    fields = [_text(row, kind, f, hardware) for f in pieces[1::2]]
    told = [F.lit(pieces[0])]
    for own, after in zip(fields, pieces[2::2], strict=True):
        told += [F.when(own == "", missing).otherwise(own) if missing else own, F.lit(after)]
    out = F.concat(*told)
    return out if missing or not fields else F.when(F.concat(*fields) != "", out)


def _joined(templates: list[str], row: Column, kind: t.StructType, hardware: Column) -> Column:
    return F.trim(F.concat_ws(" ", *(_part(p, row, kind, hardware) for p in templates))) if templates else F.lit("")


def _found(label: Column, path: Column, owner: Column, locations: Column, value: Column, context: Column, boundary: Column) -> Column:
    empty = F.array().cast(t.ArrayType(LOCATION))
    return F.struct(label.alias("label"), path.alias("value_path"), owner.alias("provenance_path"), F.coalesce(locations, empty).alias("source_locations"), value.alias("source_value"), context.alias("context"), boundary.alias("boundary"))


def _at(document: t.StructType, place: str) -> tuple[Column, t.StructType]:
    column, kind = F.col("doc"), document
    for step in place.split("."):
        column, kind = column[step.rstrip("[]")], kind[step.rstrip("[]")].dataType
    return column, kind.elementType if isinstance(kind, t.ArrayType) else kind


def _candidates(k: Kind, document: t.StructType, hardware: Column) -> Column:
    column, kind = _at(document, k.place)
    pointer = "/" + k.place.replace(".", "/").rstrip("[]")

    def made(row: Column, path: Column) -> Column:
        if "=" in k.boundary:
            field, wanted = (x.strip() for x in k.boundary.split("="))
            boundary = F.coalesce(row[field] == wanted, F.lit(False))
        else:
            boundary = F.lit(k.boundary == "yes")
        locations = row[OTHER_LOCATIONS.get(k.place, "source_locations")]
        return _found(_part(k.label, row, kind, hardware, "None"), path, path, locations, _joined(k.value, row, kind, hardware), _joined(k.context, row, kind, hardware), boundary)

    if k.place.endswith("[]"):
        return F.transform(column, lambda x, i: made(x, F.concat(F.lit(f"{pointer}/"), i.cast("string"))))
    return F.when(column.isNotNull(), F.array(made(column, F.lit(pointer))))


def _results(document: t.StructType, hardware: Column) -> Column:
    """Experiment results: provenance and locations are the experiment's, the metric's definition is looked up by its name."""
    column, kind = _at(document, "experiments[]")
    result = kind["results"].dataType.elementType

    def rows(e: Column, i: Column) -> Column:
        base = F.concat(F.lit("/experiments/"), i.cast("string"))

        def made(r: Column, j: Column) -> Column:
            metric = F.try_element_at(F.filter(F.col("doc.metrics"), lambda m: F.lower(m["name"]) == F.lower(F.coalesce(r["metric"], F.lit("")))), F.lit(-1))  # of equal names the last
            number = F.coalesce(F.nullif(r["raw_value"], F.lit("")), r["value"], F.lit("None"))
            name = F.concat(_text(r, result, "method", hardware), F.lit(" — "), _text(r, result, "metric", hardware), F.lit(" = "), number)
            place = F.when(_text(r, result, "dataset_or_setting", hardware) != "", F.concat(F.lit("("), r["dataset_or_setting"], F.lit(")")))
            said = lambda what, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{what}: "), c))
            context = F.concat_ws(" ", said("experiment", e["experiment_name"]), said("setup", e["setup"]), said("hardware", hardware), said("metric definition", metric["what_it_measures"]), said("better", metric["better_direction"]))
            return _found(F.lit("experiment result"), F.concat(base, F.lit("/results/"), j.cast("string")), base, e["source_locations"], F.concat_ws(" ", name, F.nullif(r["unit"], F.lit("")), place), context, F.lit(False))

        return F.transform(e["results"], made)

    return F.flatten(F.filter(F.transform(column, rows), lambda x: x.isNotNull()))


def _idea(document: t.StructType) -> Column:
    """The method's idea, whose provenance is its architecture."""
    method = F.col("doc.method")
    value, context = (F.trim(F.coalesce(c, F.lit(""))) for c in (method["high_level_idea"], method["architecture"]["description"]))
    path, owner = F.lit("/method/high_level_idea"), F.lit("/method/architecture")
    return F.when(method.isNotNull(), F.array(_found(F.lit("method: high-level idea"), path, owner, method["architecture"]["source_locations"], value, context, F.lit(False))))


def candidates(papers: DataFrame) -> DataFrame:
    """(paper_id, label, value_path, provenance_path, source_locations, source_value, context, boundary, tokens) from (paper_id, doc).

    Each value has its JSON pointer and that of the row that owns its locations. Empty values are dropped; fields
    without a value, null or empty, leave their part out. Tokens are those of value and context.
    """
    document, hardware = schema(), F.coalesce(T.listed(F.col("doc.experimental_setup.hardware")), F.lit(""))
    kinds = [*(_candidates(k, document, hardware) for k in KINDS), _results(document, hardware), _idea(document)]
    empty = F.array().cast(FOUND)
    own = papers.select("paper_id", F.explode(F.concat(*(F.coalesce(k.cast(FOUND), empty) for k in kinds))).alias("e")).select("paper_id", "e.*")
    return own.where("source_value <> ''").withColumn("tokens", T.tokens(F.concat_ws(" ", "source_value", "context")))


def revalidated(cited: DataFrame, current: DataFrame, artifacts: DataFrame) -> DataFrame:
    """`cited` evidence with `problem`: null while it is still what the documents say.

    `cited` carries paper_id, value_path, provenance_path, source_value, source_locations, artifact_sha256; `current`
    are candidates; `artifacts` has paper_id, sha256. A cited value may be a beginning of the current one, never other text.
    """
    own = current.select("paper_id", "value_path", F.col("provenance_path").alias("_owner"), F.col("source_value").alias("_value"), F.col("source_locations").alias("_locations"))
    told = cited.join(artifacts.select("paper_id", F.col("sha256").alias("_sha")), "paper_id", "left").join(own, ["paper_id", "value_path"], "left")
    problem = (
        F.when(F.col("_sha").isNull(), "missing_paper")
        .when(F.col("_sha") != F.col("artifact_sha256"), "changed_paper")
        .when(F.col("_value").isNull(), "missing_value")
        .when((F.coalesce("source_value", F.lit("")) == "") | ~F.startswith("_value", F.col("source_value")), "changed_value")
        .when(F.col("_owner") != F.col("provenance_path"), "changed_provenance")
        .when(F.to_json(F.struct("_locations")) != F.to_json(F.struct(F.col("source_locations").alias("_locations"))), "changed_locations")
    )
    return told.select(*cited.columns, problem.alias("problem"))


def origins(found: DataFrame) -> DataFrame:
    """Candidates with who states them, for limitations."""
    return found.withColumn("origin", limitation_origin(F.col("value_path")))
