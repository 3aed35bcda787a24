"""Flat views of nested document analyses: paper rows, context cards, reasoning cards, and the statements of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def names(items: Column, field: str = "name") -> Column:
    """The distinct names of an array of structs, case aside, in their first spelling and order; none for null."""
    own = F.filter(F.transform(items, lambda x: F.trim(x[field])), lambda v: v != "")
    folded = F.transform(own, F.lower)
    return F.coalesce(F.filter(own, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1), F.array().cast("array<string>"))


def stated(items: Column, field: str) -> Column:
    """The values of a field of an array of structs that are not empty; none for null."""
    return F.coalesce(F.filter(F.transform(items, lambda x: x[field]), lambda v: v != ""), F.array().cast("array<string>"))


def paper_rows(papers: DataFrame) -> DataFrame:
    """26 columns for each paper from (paper_id, doc, catalogue, folder); the catalogue's values go before the extracted ones.

    `catalogue` is a struct of title, authors, venue, venueid, abstract, id and forum_url, null where a paper has no entry.
    """
    meta, setup, shared, listed = F.col("doc.paper_metadata"), F.col("doc.experimental_setup"), F.col("doc.reproducibility"), F.col("catalogue")
    given = lambda c: F.nullif(c, F.lit(""))
    venue = F.coalesce(given(listed["venue"]), meta["venue"])
    return papers.select(
        "paper_id",
        F.coalesce(given(listed["title"]), meta["title"]).alias("title"),
        F.when(F.size(listed["authors"]) > 0, listed["authors"]).otherwise(meta["authors"]).alias("authors"),
        venue.alias("venue"),
        listed["venueid"].alias("venueid"),
        T.year(meta["year"], venue, listed["venueid"]).alias("year"),
        meta["paper_type"].alias("paper_type"),
        meta["identifiers"].alias("identifiers"),
        listed["abstract"].alias("abstract"),
        listed["id"].alias("openreview_id"),
        listed["forum_url"].alias("forum_url"),
        "folder",
        meta["research_areas"].alias("research_areas"),
        meta["keywords"].alias("keywords"),
        F.col("doc.retrieval_tags").alias("retrieval_tags"),
        *(names(F.col(f"doc.{many}")).alias(f"{one}_names") for many, one in (("models", "model"), ("datasets", "dataset"), ("baselines", "baseline"), ("metrics", "metric"))),
        setup["hardware"].alias("hardware"),
        setup["number_of_runs"].alias("number_of_runs"),
        *(shared[f].alias(f) for f in ("code_available", "code_url", "data_available", "data_url", "model_checkpoints_available")),
    )


def context_cards(papers: DataFrame) -> DataFrame:
    """(paper_id, card, missing_fields): 17 fields as short statements; missing are sections that the analysis has not, not those it has empty parts of."""
    doc, problem = F.col("doc"), F.col("doc.research_problem")
    limits, future = F.col("doc.limitations"), F.col("doc.future_work")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    stated_problem = F.coalesce(F.nullif(problem["specific_problem"], F.lit("")), problem["general_problem"], F.lit(""))
    source = lambda section, origin: F.transform(F.coalesce(limits[section], F.array()), lambda x, i: F.struct(F.lit(origin).alias("origin"), F.concat(F.lit(f"/limitations/{section}/"), i.cast("string")).alias("value_path"), x["limitation"].alias("statement"), x["source_locations"].alias("source_locations")))
    sources = F.filter(F.concat(source("author_stated", "author_stated"), source("inferred", "model_inferred")), lambda s: F.coalesce(s["statement"], F.lit("")) != "")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    missing = (
        ("research_problem", problem.isNull()),
        ("method", doc["method"].isNull()),
        ("research_problem.specific_problem", stated_problem == ""),
        ("key_results/interesting_findings", none(doc["key_results"]) & none(doc["interesting_findings"])),
        ("limitations", limits.isNull()),
        ("future_work", future.isNull()),
        ("claims_and_evidence", none(doc["claims_and_evidence"])),
    )
    fields = {
        "paper_id": F.col("paper_id"),
        "title": F.coalesce(doc["paper_metadata"]["title"], F.lit("")),
        "venue": doc["paper_metadata"]["venue"],
        "year": T.year(doc["paper_metadata"]["year"]),
        "problem": stated_problem,
        "research_questions": listed(problem["research_questions"]),
        "hypotheses": listed(problem["hypotheses"]),
        "method_summary": F.coalesce(doc["method"]["high_level_idea"], F.lit("")),
        "method_components": stated(doc["method"]["components"], "name"),
        "findings": stated(doc["key_results"], "finding"),
        "interesting_findings": stated(doc["interesting_findings"], "finding"),
        "limitations": stated(limits["author_stated"], "limitation"),
        "inferred_limitations": stated(limits["inferred"], "limitation"),
        "limitation_sources": sources,
        "assumptions": F.filter(F.array(problem["why_difficult"]), lambda x: F.coalesce(x, F.lit("")) != ""),
        "future_work": F.concat(stated(future["author_proposed"], "direction"), stated(future["inferred_research_opportunities"], "research_question")),
        "claims": stated(doc["claims_and_evidence"], "claim"),
    }
    card = F.struct(*(c.alias(n) for n, c in fields.items()))
    return papers.select("paper_id", card.alias("card"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in missing))).alias("missing_fields"))


def card_text(card: Column) -> Column:
    """A context card as labelled lines, each item of a list on a line of its own."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    labelled = lambda label: lambda x: line(label, x)
    lists = (("Method components", "method_components"), ("Findings", "findings"), ("Interesting findings", "interesting_findings"), ("Limitations", "limitations"), ("Inferred limitations", "inferred_limitations"), ("Assumptions / difficulties", "assumptions"), ("Future work", "future_work"), ("Claims", "claims"))
    parts = [F.array(line("Title", card["title"]), line("Problem", card["problem"])), F.when(card["method_summary"] != "", F.array(line("Method", card["method_summary"]))).otherwise(F.array().cast("array<string>"))]
    parts += [F.transform(card[field], labelled(label)) for label, field in lists]
    return F.array_join(F.concat(*parts), "\n")


def reasoning_cards(papers: DataFrame) -> DataFrame:
    """(paper_id, card): a nested card of problem, method, evaluation, findings, boundaries and claims."""
    doc, limits = F.col("doc"), F.col("doc.limitations")
    said = lambda place, **fields: F.struct(*(c.alias(n) for n, c in fields.items())).alias(place)
    problem = doc["research_problem"]
    card = F.struct(
        said("problem", research_problem=problem["specific_problem"], general_problem=problem["general_problem"], bottlenecks=problem["why_difficult"], research_questions=problem["research_questions"]),
        said("method", high_level_idea=doc["method"]["high_level_idea"], components=stated(doc["method"]["components"], "name"), mechanism=doc["method"]["architecture"]["description"]),
        said("evaluation", datasets=stated(doc["datasets"], "name"), baselines=stated(doc["baselines"], "name"), metrics=stated(doc["metrics"], "name"), hardware=doc["experimental_setup"]["hardware"], models=stated(doc["models"], "name")),
        said("findings", main_results=stated(doc["key_results"], "finding"), ablations=stated(doc["ablations"], "result"), observations=stated(doc["interesting_findings"], "finding")),
        said("boundaries", limitations_author=stated(limits["author_stated"], "limitation"), limitations_inferred=stated(limits["inferred"], "limitation"), failure_modes=stated(doc["failure_cases"], "failure"), authors_future_work=stated(doc["future_work"]["author_proposed"], "direction")),
        F.transform(doc["claims_and_evidence"], lambda c: F.struct(*(c[f].alias(f) for f in ("claim", "claim_type", "evidence_strength", "source_locations")))).alias("claims"),
    )
    return papers.select("paper_id", card.alias("card"))


def statements(contexts: DataFrame) -> DataFrame:
    """(paper_id, kind, text, origin, value_path): findings, limitations with who states them, and assumptions of context cards."""
    none = F.lit(None).cast("string")
    plain = lambda field, kind: F.transform(F.col(f"card.{field}"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text"), none.alias("origin"), none.alias("value_path")))
    limits = F.transform(F.col("card.limitation_sources"), lambda s: F.struct(F.lit("limitation").alias("kind"), s["statement"].alias("text"), s["origin"].alias("origin"), s["value_path"].alias("value_path")))
    every = F.concat(plain("findings", "finding"), plain("interesting_findings", "finding"), limits, plain("assumptions", "assumption"))
    return contexts.select("paper_id", F.explode(every).alias("s")).select("paper_id", "s.*")


def quoted(mentions: DataFrame, texts: DataFrame, allowed: list[str], kind: str = "facet") -> DataFrame:
    """The mentions (paper_id, evidence_quote, facet or relation, ...) of the allowed kind whose quote stands in the paper's text."""
    told = mentions.join(texts.select("paper_id", F.col("text").alias("_text")), "paper_id")
    return told.where(F.contains("_text", F.col("evidence_quote")) & F.col(kind).isin(allowed)).drop("_text")


def referenced_pages(papers: DataFrame, local: DataFrame) -> DataFrame:
    """(paper_id, page, referenced): the pages above 0 that a paper's locations name, and those it has (paper_id, page)."""
    from corpusloom.operators.flatten import schema

    arrays = list(_locations(F.col("doc"), schema()))
    named = papers.select("paper_id", F.explode(F.concat(*(F.coalesce(F.transform(a, lambda x: x["page"]), F.array().cast("array<int>")) for a in arrays))).alias("page")).where("page > 0").distinct()
    return local.where("page > 0").select("paper_id", "page").distinct().join(named.withColumn("_named", F.lit(True)), ["paper_id", "page"], "full").select("paper_id", "page", F.coalesce("_named", F.lit(False)).alias("referenced"))


def _field(name: str):
    return lambda x: x[name]


def _locations(column: Column, kind):
    """All arrays of locations under a struct, those within arrays flattened."""
    from pyspark.sql import types as t

    for f in kind:
        if f.name.endswith("source_locations"):
            yield column[f.name]
        elif isinstance(f.dataType, t.StructType):
            yield from _locations(column[f.name], f.dataType)
        elif isinstance(f.dataType, t.ArrayType) and isinstance(f.dataType.elementType, t.StructType):
            for inner in f.dataType.elementType:
                if inner.name.endswith("source_locations"):
                    yield F.flatten(F.filter(F.transform(column[f.name], _field(inner.name)), lambda a: a.isNotNull()))
