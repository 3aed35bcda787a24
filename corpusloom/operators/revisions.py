"""Revisions: patches at pointers of JSON documents, repairs until nothing changes any more, and runs bound to their ancestors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import gates
from corpusloom.sources.tables import checkpoint_dir, cut, discard

#: Fields that no patch may change: fixed values.
STABLE = ("hypothesis_id", "experiment_id", "evidence_ids", "page_ids", "hypothesis_ids", "stage")


def steps(pointer: str) -> list[str]:
    return [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]


def at(document: object, path: list[str]) -> object:
    """What stands at a path; LookupError where nothing does. Places in lists are plain numbers; an object's keys may be numbers too."""
    for step in path:
        if isinstance(document, list):
            if not (step.isascii() and step.isdigit() and (step == "0" or step[0] != "0")):
                raise LookupError(step)
            document = document[int(step)]
        elif isinstance(document, dict):
            document = document[step]
        else:
            raise LookupError(step)
    return document


def apply_edits(document: str, edits: list[dict]) -> tuple[str | None, list[tuple[str, str]]]:
    """(the new document, none): every edit's old value is compared and the new one set; or (None, the faults (rule, pointer)): then nothing is set."""
    try:
        data = json.loads(document)
    except (TypeError, ValueError):
        return None, [("unreadable", "")]
    faults, due = [], []
    for edit in edits:
        path = steps(edit["field_path"])
        try:
            old, previous, value = at(data, path), json.loads(edit["previous_value"]), json.loads(edit["value"])
        except (LookupError, TypeError, ValueError):
            faults.append(("no_value", edit["field_path"]))
            continue
        same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)  # noqa: E731  1 and true are two values
        if not path or not isinstance(old, (str, list)):
            faults.append(("not_text", edit["field_path"]))
        elif not same(old, previous):
            faults.append(("stale", edit["field_path"]))
        elif same(old, value):
            faults.append(("unchanged", edit["field_path"]))
        else:
            due.append((path, value))
    if faults:
        return None, faults
    for path, value in due:
        node = at(data, path[:-1])
        node[int(path[-1]) if isinstance(node, list) else path[-1]] = value
    return json.dumps(data, ensure_ascii=False), []


def edit_violations(edits: DataFrame, issues: DataFrame, key: str = "proposal") -> DataFrame:
    """(key, rule, detail): what is wrong with a set of edits before any document is opened.

    `edits` (key, field_path, issue_ids), `issues` (key, issue_id, field_path). Paths that repeat or lie within one
    another, edits without an issue or for one that names another path, edits of stable fields, and issues that no edit
    addresses. A path within another is found by its ancestors, so paths are never compared with each other.
    """
    path = F.col("field_path")
    told = edits.select(key, path, "issue_ids")
    repeated = told.groupBy(key, path).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated_path").alias("rule"), path.alias("detail"))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inner = told.select(key, path, F.explode(above).alias("above")).where("above <> ''")
    within = inner.join(told.select(key, path.alias("above")).distinct(), [key, "above"], "left_semi").select(key, F.lit("overlapping_path").alias("rule"), path.alias("detail")).distinct()
    cited = told.select(key, path, F.explode_outer("issue_ids").alias("issue_id"))
    lost = cited.join(issues.select(key, "issue_id", "field_path"), [key, "issue_id", "field_path"], "left_anti").select(key, F.lit("out_of_scope").alias("rule"), path.alias("detail")).distinct()
    stable = told.where(F.arrays_overlap(parts, F.array(*map(F.lit, STABLE)))).select(key, F.lit("stable_field").alias("rule"), path.alias("detail")).distinct()
    open_ = issues.join(told.select(key).distinct(), key, "left_semi").join(cited.select(key, "issue_id").distinct(), [key, "issue_id"], "left_anti").select(key, F.lit("not_addressed").alias("rule"), F.col("issue_id").cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, (repeated, within, lost, stable, open_))


def patched_documents(documents: DataFrame, edits: DataFrame, issues: DataFrame, key: str = "proposal") -> tuple[DataFrame, DataFrame]:
    """(documents with their edits, violations (key, rule, detail)); a document is changed by all of its edits or by none.

    `documents` (key, document), `edits` (key, field_path, previous_value, value, issue_ids), values in JSON. The old
    value is compared and the new one set where the document is; documents without edits stay as they are and are
    not moved through Python.
    """
    wrong = cut(edit_violations(edits, issues, key).unionByName(edits.join(documents.select(key), key, "left_anti").select(key, F.lit("no_document").alias("rule"), F.lit("").alias("detail")).distinct()))
    sound = edits.join(wrong.select(key).distinct(), key, "left_anti")
    lists = sound.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("field_path", "previous_value", "value"))).alias("_edits"))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [apply_edits(d, e) for d, e in zip(batch.column("document").to_pylist(), batch.column("_edits").to_pylist(), strict=True)]
            faults = pa.array([[{"rule": r, "detail": p} for r, p in f] for _, f in out], pa.list_(pa.struct([("rule", pa.string()), ("detail", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([d for d, _ in out], pa.string()), faults], [key, "_new", "_faults"])

    done = cut(documents.join(lists, key).select(key, "document", "_edits").mapInArrow(run, f"`{key}` {kind}, _new string, _faults array<struct<rule:string,detail:string>>"))
    out = documents.join(done.where("_new is not null").select(key, "_new"), key, "left").withColumn("document", F.coalesce("_new", "document")).select(*documents.columns)
    return out, wrong.unionByName(done.select(key, F.explode("_faults").alias("f")).select(key, "f.rule", "f.detail"))


def repair_rounds(records: DataFrame, step: Callable[[DataFrame], DataFrame], due: Column, fingerprint: Column, key: str, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the last version of every record, history (key, version, fingerprint, repeated)): repairs until nothing is due any more.

    `step` gives the next version of the records that it gets, all columns. A record stops on its own: when `due` no
    longer holds, when its new version is one it had before, which still counts, or after `limit` rounds. Rounds are
    checkpointed; the loop ends when no record is left, so it runs `limit` rounds at most.
    """
    active = cut(records.withColumn("_print", fingerprint))
    seen = active.select(key, F.lit(0).alias("version"), F.col("_print").alias("fingerprint"), F.lit(False).alias("repeated"))
    closed = [active.where(~F.coalesce(due, F.lit(False))).drop("_print")]
    active = active.where(due).drop("_print")
    for version in range(1, limit + 1):
        if active.isEmpty():
            break
        fresh = step(active).withColumn("_print", fingerprint)
        known = seen.select(key, F.col("fingerprint").alias("_print")).distinct().withColumn("_seen", F.lit(True))
        fresh = cut(fresh.join(known, [key, "_print"], "left").select(*records.columns, "_print", F.coalesce("_seen", F.lit(False)).alias("_seen")))
        seen = cut(seen.unionByName(fresh.select(key, F.lit(version).alias("version"), F.col("_print").alias("fingerprint"), F.col("_seen").alias("repeated"))))
        over = F.col("_seen") | ~F.coalesce(due, F.lit(False)) | F.lit(version == limit)
        closed.append(fresh.where(over).select(*records.columns))
        active = fresh.where(~over).select(*records.columns)
    return reduce(DataFrame.unionByName, closed), seen


def ancestry(runs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(run, root, depth, state) of runs (run once, parent or null, parent_sha256, sha256): whence each run comes through its recoveries.

    state: `whole`, `missing` (an ancestor that is recorded is not there), `changed` (an ancestor's digest is not the
    one that its child recorded) or `cycle`, the first that holds in the order missing, cycle, changed; root is the last
    run on the way up, null in or behind a cycle; depth counts the steps. Jumps double each round, so a chain of n runs
    takes about log n rounds. A run whose smallest ancestor of one jump is that of the next jump too meets it twice,
    so it leads into a cycle: cycles end their rounds like roots, after about the log of their length. Only runs that
    have not ended go through another round; a round is written to the shared folder of spark.checkpoint.dir and takes the place of the one before.
    """
    spark, folder = runs.sparkSession, f"{checkpoint_dir(runs.sparkSession).rstrip('/')}/ancestry-{uuid.uuid4().hex}"
    parents = runs.select(F.col("run").alias("parent"), F.col("sha256").alias("_own"))
    told = runs.join(parents, "parent", "left")
    gap = F.col("parent").isNotNull() & F.col("_own").isNull()
    top = F.col("parent").isNull() | gap
    first = told.select("run", F.when(~top, F.col("parent")).alias("up"), F.when(~top, F.col("parent")).alias("low"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), gap.alias("missing"), (~top & ~F.col("parent_sha256").eqNullSafe(F.col("_own"))).alias("changed"), F.when(top, F.col("run")).alias("root"), F.lit(False).alias("looped"))
    first.write.parquet(f"{folder}/0")
    jumps = spark.read.schema(first.schema).parquet(f"{folder}/0")
    for turn in range(1, max_rounds + 1):
        going = jumps.where("up is not null")
        if going.isEmpty():
            break
        above = jumps.select(F.col("run").alias("up"), *(F.col(c).alias(f"_{c}") for c in ("up", "low", "depth", "missing", "changed", "root", "looped")))
        looped = F.col("looped") | F.col("_looped") | F.coalesce(F.col("low") == F.col("_low"), F.lit(False))
        both = going.join(above, "up").select("run", F.when(~looped, F.col("_up")).alias("up"), F.when(~looped, F.least("low", "_low")).alias("low"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("missing") | F.col("_missing"), F.col("changed") | F.col("_changed"), "_root", looped.alias("looped"))
        jumps.where("up is null").union(both).write.parquet(f"{folder}/{turn}")
        jumps = spark.read.schema(first.schema).parquet(f"{folder}/{turn}")
        discard(spark, f"{folder}/{turn - 1}")
    state = F.when(F.col("missing"), "missing").when(F.col("root").isNull(), "cycle").when(F.col("changed"), "changed").otherwise("whole")
    return jumps.select("run", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"), state.alias("state"))


def ancestry_violations(runs: DataFrame) -> DataFrame:
    """Runs that are not whole, as violations."""
    return gates.violations(ancestry(runs), "ancestry", F.col("state") != "whole", F.col("run"), F.col("state"))
