"""Views for readers of comparisons and proposals: facets by dimension, claims with their sources, flat records of hypotheses, readiness of a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facets of a target in order, and those that each dimension of a comparison looks at: fixed values.
FACETS = ("problem", "intervention", "decision_signal", "mechanism", "regime", "comparison", "expected_effect")
DIMENSION_FACETS = {
    "problem": ("problem",),
    "method": ("intervention",),
    "mechanism": ("mechanism",),
    "signal": ("decision_signal",),
    "regime": ("regime",),
    "evaluation": ("comparison", "regime", "decision_signal"),
    "scientific_question": ("problem", "intervention", "expected_effect"),
    "hypothesis": ("intervention", "regime", "comparison", "expected_effect"),
}
#: How deep each channel of a search looks for a page of k hits: at least so many, and so many times k.
LEAST_DEPTH, TIMES = 50, 5


def facet_views(facets: DataFrame, dimensions: dict[str, tuple[str, ...]] = DIMENSION_FACETS) -> DataFrame:
    """(target, dimension, path, text, basis, place) of facets (target, facet, pos, text, basis): each in every dimension that it belongs to, and those of an unknown basis under `unknown` too.

    place orders a dimension: by the facet's turn in the dimension, then by position. A facet of no dimension is only
    seen if its basis is unknown.
    """
    rows = [(d, f, i) for d, keys in dimensions.items() for i, f in enumerate(keys)]
    table = facets.sparkSession.createDataFrame(rows, "dimension string, facet string, _turn int")
    path = F.concat(F.lit("/"), "facet", F.lit("/"), F.col("pos").cast("string")).alias("path")
    known = facets.join(F.broadcast(table), "facet")
    turn = F.array_position(F.array(*map(F.lit, FACETS)), F.col("facet")).cast("int")
    unknown = facets.where("basis = 'unknown'").withColumn("dimension", F.lit("unknown")).withColumn("_turn", turn)
    both = known.select(*facets.columns, "dimension", "_turn").unionByName(unknown.select(*facets.columns, "dimension", "_turn"))
    order = Window.partitionBy("target", "dimension").orderBy("_turn", "facet", "pos", "text", "basis")
    return both.select("target", "dimension", path, "text", "basis", F.row_number().over(order).alias("place"))


def rendered_claims(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """`claims` (paper, claim, text, passages array) with `sources`: the cited passages (passage, page, text) in the order of the citations; one that isn't there is left out."""
    cited = claims.select("paper", "claim", F.posexplode("passages").alias("pos", "passage")).join(passages.select("paper", "passage", "page", F.col("text").alias("_text")), ["paper", "passage"])
    source = F.struct("pos", F.struct("passage", "page", F.col("_text").alias("text")).alias("source"))
    lists = cited.groupBy("paper", "claim").agg(F.transform(F.array_sort(F.collect_list(source)), lambda x: x["source"]).alias("sources"))
    return claims.join(lists, ["paper", "claim"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)))


def proposal_records(hypotheses: DataFrame, opportunities: DataFrame, judgments: DataFrame, experiments: DataFrame) -> DataFrame:
    """A flat record for each hypothesis: what it proposes, why, what was judged of it, and the experiments that test it.

    `hypotheses` (hypothesis, direction, title, statement, status, diagnostic), `opportunities` (direction, problem,
    question, scope), `judgments` (hypothesis, judgment), `experiments` (hypothesis, experiment). Lists are sorted; a
    hypothesis without any has empty ones. What models reviewed was not tested in practice, and the record says so.
    """
    listed = lambda rows, column: rows.groupBy("hypothesis").agg(F.array_sort(F.collect_set(column)).alias(f"{column}s"))
    told = hypotheses.join(opportunities, "direction", "left").join(listed(judgments, "judgment"), "hypothesis", "left").join(listed(experiments, "experiment"), "hypothesis", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("judgments", "experiments")}
    out = told.withColumns(lists).withColumn("evidence_file", F.concat(F.lit("../../evidence/"), F.col("hypothesis").cast("string"), F.lit(".md"))).withColumn("scientific_validation", F.lit("model_reviewed_not_empirically_validated"))
    return out.select("hypothesis", "direction", "title", "status", "problem", "question", "statement", "scope", "diagnostic", "judgments", "experiments", "evidence_file", "scientific_validation")


def distinct_labels(labels: DataFrame) -> DataFrame:
    """(text, facet, pos) of labels (pos, text, facet): each text of a facet once, at its first position."""
    return labels.groupBy("text", "facet").agg(F.min("pos").alias("pos"))


def fetch_depth(k: Column | int) -> Column:
    """How many hits each channel gives for the best `k` of both."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.greatest(F.lit(LEAST_DEPTH), k * TIMES)


def loop_states(routes: DataFrame) -> DataFrame:
    """(run, n, ready) of routes (run, direction, next_stage): a loop is ready when every candidate goes to ranking or stops, and there is one at all."""
    done = F.coalesce(F.col("next_stage").isin("ranking", "stop"), F.lit(False))
    return routes.groupBy("run").agg(F.count("*").alias("n"), F.bool_and(done).alias("ready"))


def observation_violations(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Observations (run, direction, request, stage, paths array) of candidates (run, direction, has_packet): each is of a candidate with sources, of its correctness, and says where."""
    from corpusloom.operators import gates

    told = observations.join(candidates, ["run", "direction"], "left")
    key = F.concat_ws("|", "run", "direction", "request")
    return gates.gate(
        gates.violations(told, "no_candidate", ~F.coalesce("has_packet", F.lit(False)), key),
        gates.violations(told, "stage", F.col("stage") != "direction_correctness", key, F.col("stage")),
        gates.violations(told, "no_path", F.coalesce(F.size("paths"), F.lit(0)) == 0, key),
    )
