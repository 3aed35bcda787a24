"""Readers of landed artifacts: analyses as JSON, pages as text files, metadata catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import flatten


def analyses(spark: SparkSession, *roots: str) -> DataFrame:
    """(folder, status, sha256, doc): each `<root>/*/paper.json` with its digest; a file that is no analysis is `invalid`, not lost."""
    raw = spark.read.format("binaryFile").load([f"{root}/*/paper.json" for root in roots])
    text = F.decode("content", "UTF-8")
    doc = F.from_json(text, flatten.schema(), {"mode": "PERMISSIVE"})
    valid = F.is_valid_utf8(text) & F.try_parse_json(text).isNotNull()
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.when(valid, "loaded").otherwise("invalid").alias("status"), F.sha2("content", 256).alias("sha256"), F.when(valid, doc).alias("doc"))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the schema, lines (file, line) that hold no such object) of files of one JSON object a line; blank lines are none."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = raw.withColumn("_row", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    return parsed.where(~broken).select("_row.*").drop("_bad"), parsed.where(broken).select("file", "line")


def catalogue(spark: SparkSession, *paths: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(entries, violations) of the first of some paths that there is anything at: metadata in JSON lines, whose entries without a paper_id or with one that repeats are violations."""
    from corpusloom.operators import gates

    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if (found := where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)) is not None and len(found):
            entries, broken = json_lines(spark, path, schema)
            blank = F.coalesce(F.trim("paper_id"), F.lit("")) == ""
            return entries, gates.gate(gates.violations(entries, "no_paper_id", blank, F.col("title")), gates.repeated(entries.where(~blank), ["paper_id"], "repeated_paper"), gates.violations(broken, "broken_line", F.lit(True), F.col("file")))
    raise FileNotFoundError(f"none of {paths}")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(folder, page, text, sha256) of `<root>/*/<number>.md`; of several files for a page the one with the longest name (NN.md before N.md)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{root}/*")
    name = F.element_at(F.split("path", "/"), -1)
    own = raw.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.nullif(F.regexp_extract(name, r"^(\d+)\.md$", 1), F.lit("")).alias("number"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256")).where("number is not null")
    best = own.groupBy("folder", F.col("number").cast("int").alias("page")).agg(F.max_by(F.struct("text", "sha256"), F.struct(F.length("number"), "number")).alias("row"))
    return best.select("folder", "page", "row.*")


def stitched(own: DataFrame) -> DataFrame:
    """(folder, text): the pages of each folder in order, each between PAGE tags."""
    tagged = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.format_string('<PAGE number="%d">\n', x.page), x.text, F.lit("\n</PAGE>")))
    return own.groupBy("folder").agg(F.concat(F.lit("<PAPER>\n"), F.array_join(tagged, "\n"), F.lit("\n</PAPER>")).alias("text"))


def linked(folders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Folders with the catalogue's row: by paper_id first, else by the folder name of its title; an unmatched folder keeps its own name as id."""
    from corpusloom.functions.text import folder_name

    named = catalogue.select(folder_name(F.col("title")).alias("folder"), F.struct("*").alias("by_title")).groupBy("folder").agg(F.min_by("by_title", "by_title.paper_id").alias("by_title"))
    direct = catalogue.select(F.col("paper_id").alias("folder"), F.struct("*").alias("by_id"))
    told = folders.join(direct, "folder", "left").join(named, "folder", "left").withColumn("row", F.coalesce("by_id", "by_title"))
    return told.select(*folders.columns, F.coalesce("row.paper_id", "folder").alias("paper_id"), *(F.col(f"row.{c}").alias(c) for c in catalogue.columns if c != "paper_id"))
