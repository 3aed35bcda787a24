"""Ordered selection under caps and budgets: supporting first, two-sided quotas, greedy packing, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ranking import numbered


def supporting_first(candidates: DataFrame, cap: int) -> DataFrame:
    """(thread, paper, place, chosen): supporting papers by id, then others by falling overlap and id; the first `cap` are chosen."""
    keyed = candidates.select("thread", "paper", (~F.col("supporting")).alias("_other"), F.when(F.col("supporting"), 0).otherwise(-F.col("shared")).alias("_overlap"))
    return numbered(keyed, ["thread"], ["_other", "_overlap", "paper"], "place").select("thread", "paper", "place", (F.col("place") <= cap).alias("chosen"))


def allocate_sides(side_a: Column, side_b: Column, cap: int) -> Column:
    """Papers taken from two ordered sides under a cap, as an array: floor(cap/2) of a, the rest of b, then what is left of a and of b.

    A paper on both sides counts once, for the side that takes it first.
    """
    take_a, take_b = cap // 2, cap - cap // 2
    first_a = F.slice(side_a, 1, take_a) if take_a else F.array().cast("array<string>")
    first_b = F.slice(F.array_except(side_b, first_a), 1, take_b)
    first = F.concat(first_a, first_b)
    more_a = F.array_except(side_a, first)
    second = F.concat(first, F.slice(more_a, 1, F.greatest(F.lit(0), cap - F.size(first))))
    return F.concat(second, F.slice(F.array_except(side_b, second), 1, F.greatest(F.lit(0), cap - F.size(second))))


def greedy_pack(items: Column, budget: Column | int, size: str = "size") -> Column:
    """The items (array of structs, in order of preference) that fit a budget: one too large is skipped and smaller ones go on.

    This is no running sum: it is a fold, because what is skipped leaves its room to the next.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget

    def step(acc: Column, x: Column) -> Column:
        fits = acc.used + x[size] <= budget
        return F.struct(F.when(fits, acc.used + x[size]).otherwise(acc.used).alias("used"), F.concat(acc.taken, F.array(fits)).alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))
    flags = F.aggregate(items, start, step, lambda a: a.taken)
    return F.filter(F.transform(F.arrays_zip(items.alias("item"), flags.alias("fits")), lambda z: F.when(z.fits, z.item)), lambda x: x.isNotNull())


def bundle(candidates: DataFrame, budget: int, boundary_share: float = 0.3, longest: int = 1500) -> DataFrame:
    """(thread, paper, kept, omitted, used): evidence of each thread and paper packed into the paper's share of the budget.

    Boundary items (limits, failures) are tried first within their reserve, then all that is left by falling
    relevance and value path. A value and its context count up to `longest` characters. Each thread's budget is split
    evenly among its papers.
    """
    share = F.floor(F.lit(budget) / F.col("papers")).cast("long")
    papers = candidates.select("thread", "paper").distinct().groupBy("thread").agg(F.count("*").alias("papers"))
    sized = candidates.withColumn("size", F.least(F.length("value") + F.length("context"), F.lit(longest)).cast("long"))
    item = F.struct((-F.col("relevance")).alias("order"), F.col("path").alias("path"), F.col("size").alias("size"), F.col("boundary").alias("boundary"))
    grouped = sized.groupBy("thread", "paper").agg(F.array_sort(F.collect_list(item)).alias("items")).join(papers, "thread")
    reserve = F.floor(share * boundary_share).cast("long")
    first = grouped.select("thread", "paper", "items", share.alias("share"), greedy_pack(F.filter("items", lambda x: x.boundary), reserve).alias("first"))
    used = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.size)
    second = first.withColumn("more", greedy_pack(F.array_except("items", "first"), F.col("share") - used(F.col("first"))))
    kept = F.concat("first", "more")
    return second.select("thread", "paper", F.transform(kept, lambda x: x.path).alias("kept"), F.transform(F.array_except("items", kept), lambda x: x.path).alias("omitted"), used(kept).alias("used"))


def bundle_items(bundles: DataFrame, candidates: DataFrame, longest: int = 1500) -> DataFrame:
    """(evidence_id, thread, paper, path, value, context, boundary, truncated): the kept items of each thread, numbered by paper and path.

    What is longer than `longest` characters is cut: the value first, its context has what is left. A thread has as
    many items as fit its budget, so the numbering is over few rows.
    """
    kept = bundles.select("thread", "paper", F.explode("kept").alias("path"))
    told = kept.join(candidates.select("thread", "paper", "path", "value", "context", "boundary"), ["thread", "paper", "path"])
    number = F.row_number().over(Window.partitionBy("thread").orderBy("paper", "path"))
    value = F.substring("value", 1, longest)
    context = F.substr("context", F.lit(1), F.lit(longest) - F.length(value))
    return told.select(F.format_string("%s-e%03d", F.col("thread").cast("string"), number).alias("evidence_id"), "thread", "paper", "path", value.alias("value"), context.alias("context"), "boundary", (F.length("value") + F.length("context") > longest).alias("truncated"))


def page_budget(pages: DataFrame, by: str, max_pages: int, max_tokens: int | str) -> DataFrame:
    """(by, paper, page, supplied) of pages (by, paper, page, demand, tokens): most wanted first, as many as both limits allow.

    A page that does not fit is passed over and smaller ones go on, so it is a fold over each group's ordered pages;
    a group is what one review asks for.
    """
    item = F.struct((-F.col("demand")).alias("order"), "paper", "page", F.col("tokens").cast("long").alias("tokens"))
    limit = F.lit(max_tokens) if isinstance(max_tokens, int) else F.max(max_tokens)
    grouped = pages.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"), limit.alias("limit"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc.n < max_pages) & (acc.used + x.tokens <= F.col("limit"))
        return F.struct((acc.n + fits.cast("int")).alias("n"), F.when(fits, acc.used + x.tokens).otherwise(acc.used).alias("used"), F.concat(acc.flags, F.array(fits)).alias("flags"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))
    flags = F.aggregate("items", start, step, lambda a: a.flags)
    told = grouped.select(by, F.explode(F.arrays_zip("items", flags.alias("supplied"))).alias("z"))
    return told.select(by, "z.items.paper", "z.items.page", "z.supplied")


def page_demand(citations: DataFrame) -> DataFrame:
    """(paper, page, demand): how often each page is cited."""
    return citations.groupBy("paper", "page").agg(F.count("*").alias("demand"))


def batches(items: DataFrame, size: int, cap: int, by: str = "thread", key: str = "item") -> DataFrame:
    """Batches of `size` items in order of key within each group; beyond `cap` batches they are kept and labelled omitted."""
    told = numbered(items, [by], [key], "_number")
    return told.withColumn("batch", F.floor((F.col("_number") - 1) / size).cast("long")).withColumn("omitted", F.col("batch") >= cap).drop("_number")
