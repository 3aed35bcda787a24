"""Queries of patches, repairs, lineage, nested values, extraction and merged clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.jobs.registry import query
from corpusloom.operators import extraction, nested, revisions
from corpusloom.sources.tables import table

# Proposals are customers with three orders or more; their hypotheses are the first three orders.
_PROPOSALS = """h AS (SELECT o_custkey AS proposal, o_orderkey, o_orderpriority AS statement, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
p AS (SELECT proposal FROM h WHERE i = 2),
s AS (SELECT h.* FROM h JOIN p USING (proposal) WHERE i < 3)"""
_FAULT = """CASE WHEN proposal % 7 = 1 THEN 'stale' WHEN proposal % 7 = 2 THEN 'stable_field' WHEN proposal % 7 = 3 THEN 'out_of_scope' WHEN proposal % 7 = 4 THEN 'not_addressed' WHEN proposal % 7 = 5 THEN 'unchanged' END"""


def _proposals(spark: SparkSession, d: str) -> DataFrame:
    """(proposal, statements): customers with the priorities of their first three orders."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    own = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", (F.row_number().over(order) - 1).alias("i")).where("i < 3")
    told = own.groupBy(F.col("o_custkey").alias("proposal")).agg(F.array_sort(F.collect_list(F.struct("i", "o_orderkey", "o_orderpriority"))).alias("own"))
    return told.where(F.size("own") == 3)


@query(f"""WITH {_PROPOSALS}, f AS (SELECT proposal, {_FAULT} AS fault FROM p)
SELECT proposal, i::INT AS place, CASE WHEN fault IS NULL AND i = proposal % 3 THEN 'revised ' || statement || ' "x"/~' ELSE statement END AS statement, coalesce(fault, '') AS fault FROM s JOIN f USING (proposal)""")
def patched_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Statements of proposals after patches at pointers; five of seven proposals have a patch that must be refused, each for another reason."""
    own = _proposals(spark, d)
    hypothesis = lambda x: F.struct(x["o_orderkey"].cast("string").alias("hypothesis_id"), x["o_orderpriority"].alias("statement~/"))
    documents = own.select("proposal", F.to_json(F.struct(F.lit("t").alias("title"), F.transform("own", hypothesis).alias("hypotheses"))).alias("document"))
    i, kind = F.col("proposal") % 3, F.col("proposal") % 7
    old = F.get("own", i.cast("int"))["o_orderpriority"]
    path = F.concat(F.lit("/hypotheses/"), i.cast("string"), F.when(kind == 2, "/hypothesis_id").otherwise("/statement~0~1"))
    new = F.when(kind == 5, old).otherwise(F.concat(F.lit("revised "), old, F.lit(' "x"/~')))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    edits = own.select("proposal", path.alias("field_path"), quoted(F.when(kind == 1, "old").otherwise(old)).alias("previous_value"), quoted(new).alias("value"), F.array(F.when(kind == 3, "issue-9").otherwise("issue-0")).alias("issue_ids"))
    issues = own.select("proposal", F.explode(F.when(kind == 4, F.array(F.lit("issue-0"), F.lit("issue-1"))).when(kind == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("issue-0")))).alias("issue_id"), path.alias("field_path"))
    out, wrong = revisions.patched_documents(documents, edits, issues)
    parsed = F.from_json("document", "title string, hypotheses array<struct<hypothesis_id:string,`statement~/`:string>>")
    told = out.select("proposal", F.posexplode(F.transform(parsed["hypotheses"], lambda h: h["statement~/"])).alias("place", "statement"))
    faults = wrong.groupBy("proposal").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("fault"))
    return told.join(faults, "proposal", "left").select("proposal", "place", "statement", F.coalesce("fault", F.lit("")).alias("fault"))


@query("""WITH RECURSIVE p AS (SELECT l_suppkey * 100000 + l_partkey AS pair, (sum(l_quantity)::BIGINT % 12)::INT AS gaps FROM lineitem GROUP BY ALL),
r AS (SELECT pair, 0 AS version, gaps, [gaps] AS seen, false AS repeated FROM p
UNION ALL SELECT pair, version + 1, n, list_append(seen, n), list_contains(seen, n) FROM (SELECT *, CASE WHEN gaps % 3 = 0 THEN gaps // 3 WHEN gaps % 3 = 1 THEN gaps ELSE (gaps * 5) % 12 END AS n FROM r) WHERE gaps > 0 AND NOT repeated AND version < 3)
SELECT pair, version, gaps, repeated FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY version DESC) AS i FROM r) WHERE i = 1""".replace("sum(l_quantity)::BIGINT % 12)::INT AS gaps FROM lineitem GROUP BY ALL", "sum(l_quantity)::BIGINT % 12)::INT AS gaps FROM lineitem GROUP BY l_suppkey, l_partkey"))
def repair_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Pairs repaired until they have no gap, come back to a version they had, or had three rounds."""
    own = table(spark, d, "lineitem").groupBy(F.struct("l_suppkey", "l_partkey").alias("repaired"))
    pairs = own.agg((F.rint(F.sum("l_quantity")).cast("long") % 12).cast("int").alias("gaps"))
    gaps = F.col("gaps")
    step = lambda rows: rows.withColumn("gaps", F.when(gaps % 3 == 0, F.floor(gaps / 3)).when(gaps % 3 == 1, gaps).otherwise((gaps * 5) % 12).cast("int"))
    last, history = revisions.repair_rounds(pairs, step, gaps > 0, F.sha2(gaps.cast("string"), 256), "repaired")
    told = history.groupBy("repaired").agg(F.max("version").alias("version"), F.bool_or("repeated").alias("repeated"))
    # Numbers of pairs are shared where part keys reach 100,000: the one with most rounds stands for them, of equals the one with most gaps.
    number = F.col("repaired.l_suppkey") * 100_000 + F.col("repaired.l_partkey")
    most = last.join(told, "repaired").groupBy(number.alias("pair")).agg(F.max(F.struct("version", "gaps", "repeated")).alias("most"))
    return most.select("pair", "most.*")


@query("""WITH RECURSIVE r AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 1000 = 7 THEN o_orderkey + 1000000 WHEN o_orderkey % 500 IN (11, 12) THEN o_orderkey + (CASE o_orderkey % 500 WHEN 11 THEN 1 ELSE -1 END) WHEN o_orderkey % 100 <> 0 THEN o_orderkey - 1 END AS parent, o_orderkey % 37 = 5 AS tampered FROM orders),
c AS (SELECT run, run AS now, 0 AS depth, false AS changed FROM r
UNION ALL SELECT c.run, b.run, depth + 1, changed OR a.tampered FROM c JOIN r a ON a.run = c.now JOIN r b ON b.run = a.parent WHERE depth < 600),
top AS (SELECT c.run, arg_max(c.now, depth) AS root, max(depth) AS depth, arg_max(changed, depth) AS changed FROM c GROUP BY c.run)
SELECT top.run, CASE WHEN depth < 600 THEN root END AS root, CASE WHEN depth < 600 THEN depth::BIGINT END AS depth, CASE WHEN depth >= 600 THEN 'cycle' WHEN r.parent IS NOT NULL THEN 'missing' WHEN changed THEN 'changed' ELSE 'whole' END AS state FROM top JOIN r ON r.run = root""")
def run_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Runs (orders) that recover the order before, by hundreds; some name one that is not there, some each other, some a digest of another version."""
    key = F.col("o_orderkey")
    parent = F.when(key % 1000 == 7, key + 1_000_000).when((key % 500).isin(11, 12), key + F.when(key % 500 == 11, 1).otherwise(-1)).when(key % 100 != 0, key - 1)
    own = F.sha2(key.cast("string"), 256)
    said = F.when(key % 37 == 5, "another").otherwise(F.sha2(parent.cast("string"), 256))
    runs = table(spark, d, "orders").select(key.alias("run"), parent.alias("parent"), said.alias("parent_sha256"), own.alias("sha256"))
    return revisions.ancestry(runs)


@query("""WITH e AS (SELECT event_id, user_id, event_type, event_id % 6 AS k FROM events)
SELECT event_id, 'p' || user_id AS paper_id, CASE WHEN k IN (0, 4) THEN 'meta ' || event_type WHEN k = 1 THEN 'inner ' || event_type WHEN k = 2 THEN 'last ' || event_type ELSE 'own ' || event_type END AS title,
CASE WHEN k IN (0, 1) THEN '2024' WHEN k = 2 THEN '1999' END AS year, NULL::VARCHAR AS venue FROM e WHERE k <> 5""")
def harvested_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of papers named at any depth of nested records made of events."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 6).alias("k"))
    pid, title = F.concat(F.lit("p"), F.col("user_id").cast("string")), lambda w: F.concat(F.lit(f"{w} "), F.col("event_type"))
    said = lambda w, year=None: F.struct(title(w).alias("title"), F.lit(year).alias("year"))
    record = (
        F.when(F.col("k") == 0, F.to_json(F.struct(F.array(F.struct(pid.alias("paper_id"), F.struct(said("meta", "2024").alias("paper_metadata")).alias("paper"))).alias("a"))))
        .when(F.col("k") == 1, F.to_json(F.struct(F.struct(F.struct(F.array(F.array(F.struct(pid.alias("paper_id"), said("inner", "2024").alias("metadata")))).alias("d")).alias("c")).alias("b"))))
        .when(F.col("k") == 2, F.to_json(F.struct(F.array(F.struct(pid.alias("paper_id"), title("first").alias("title"), F.lit(None).cast("string").alias("year")), F.struct(pid.alias("paper_id"), title("last").alias("title"), F.lit("1999").alias("year"))).alias("list"))))
        .when(F.col("k") == 3, F.to_json(F.struct(pid.alias("paper_id"), title("own").alias("title"))))
        .when(F.col("k") == 4, F.to_json(F.struct(F.struct(pid.alias("paper_id"), F.struct(F.struct(title("meta").alias("title")).alias("paper_metadata")).alias("paper"), title("own").alias("title")).alias("x"))))
        .otherwise(F.to_json(F.struct(pid.alias("paper_id"), F.lit(3).alias("n"))))
    )
    return nested.harvested(events.select("event_id", F.parse_json(record).alias("record")), "event_id", "record")


@query("""WITH t AS (SELECT conv_id, list(turn ORDER BY turn, text) AS turns, list(text ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, len(turns) AS n, 'src' || (len(turns) - 1) AS last_alias, true AS equal, list_aggregate(list_transform(list_zip(range(len(turns)), turns), lambda x: 'src' || (list_last_place(turns, x[2]))), 'string_agg', ',') AS cited FROM t""".replace("list_last_place(turns, x[2])", "len(turns) - list_position(list_reverse(turns), x[2])"))
def aliased_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets (conversations) whose passages go under short aliases, and whether they come back as they were."""
    passage = F.concat_ws(":", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "text", passage.alias("passage_id")).alias("t"))
    told = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    claim = lambda t: F.struct(t["text"].alias("statement"), F.array(t["passage_id"], F.lit("elsewhere")).alias("passage_ids"), F.struct(t["passage_id"].alias("passage_id"), t["passage_id"].alias("prose")).alias("nested"))
    packets = told.select("conv_id", F.struct(F.transform("turns", claim).alias("claims")).alias("packet"), F.transform("turns", lambda t: t["passage_id"]).alias("ids"))
    short = nested.aliased(packets, "packet", F.col("ids"))
    back = nested.restored(short, "packet").select("conv_id", F.col("packet").alias("back"))
    both = short.join(back, "conv_id").join(packets.select("conv_id", F.col("packet").alias("was")), "conv_id")
    cited = F.array_join(F.transform("packet.claims", lambda c: c["nested"]["passage_id"]), ",")
    intact = F.forall("packet.claims", lambda c: (c["passage_ids"][1] == "elsewhere") & c["nested"]["prose"].startswith("c:") & (c["passage_ids"][0] == c["nested"]["passage_id"]))
    last = F.try_element_at("aliases", F.element_at("ids", -1))
    return both.select("conv_id", F.size("ids").cast("long").alias("n"), last.alias("last_alias"), ((F.to_json("back") == F.to_json("was")) & intact).alias("equal"), cited.alias("cited"))


@query("""WITH s AS (SELECT l_suppkey AS portfolio, count(*) AS n, sum(l_quantity)::BIGINT AS total, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY ALL)
SELECT 'portfolio' AS rule, portfolio::VARCHAR AS key, CASE portfolio % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'value' WHEN 3 THEN 'digest' WHEN 4 THEN 'value' END AS detail,
sha256('{"flags": [' || array_to_string(list_transform(flags, lambda f: '"' || f || '"'), ', ') || '], "n": ' || n || ', "share": ' || CASE WHEN portfolio % 2 = 0 THEN '0.5' ELSE 'null' END || ', "total": ' || total || '}') AS due FROM s WHERE portfolio % 10 IN (1, 2, 3, 4)
UNION ALL SELECT 'portfolio', (portfolio + 1000000)::VARCHAR, 'unexpected', NULL FROM s WHERE portfolio % 10 = 5""".replace("sum(l_quantity)::BIGINT AS total, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY ALL", "sum(l_quantity)::BIGINT AS total, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_suppkey"))
def inexact_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """Stored portfolios (suppliers) that are not what a recomputation gives, by canonical digests: lost, changed, reordered, mislabelled and strange ones."""
    from corpusloom.functions.canonical import digest

    told = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("portfolio")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    value = F.struct(F.col("total"), F.col("flags"), F.col("n"), F.when(F.col("portfolio") % 2 == 0, 0.5).alias("share"))
    due = told.select("portfolio", value.alias("value"))
    kind, k = due.schema["value"].dataType, F.col("portfolio") % 10
    changed = F.struct((F.col("total") + F.when(k == 2, 1).otherwise(0)).alias("total"), F.when(k == 4, F.concat(F.reverse("flags"), F.array(F.lit("Z")))).otherwise(F.col("flags")).alias("flags"), F.col("n"), F.when(F.col("portfolio") % 2 == 0, 0.5).alias("share"))
    stored = told.where("portfolio % 10 <> 1").select("portfolio", changed.alias("value"))
    stored = stored.withColumn("sha256", F.when(k == 3, "0").otherwise(digest(F.col("value"), kind)))
    stored = stored.unionByName(stored.where("portfolio % 10 = 5").withColumn("portfolio", F.col("portfolio") + 1_000_000))
    found = nested.inexact(stored, due, "portfolio", "portfolio")
    return found.join(due.select(F.col("portfolio").cast("string").alias("key"), digest(F.col("value"), kind).alias("due")), "key", "left").select("rule", "key", "detail", "due")


#: Cue words of the invented texts, and what they stand for; `and` names no relation of the vocabulary.
CUES = {"of": "CAUSES", "for": "REDUCES", "with": "DEPENDS_ON", "and": "RELATED_TO"}
CUE_FACETS = {"the": "method", "in": "problem", "to": "topic"}


class HastyExtractor(extraction.CueExtractor):
    """One that gives every fifth quote another ending than its text has."""

    def found(self, text: str) -> list[dict]:
        return [r | {"quote": r["quote"] + " indeed"} if k % 5 == 4 else r for k, r in enumerate(super().found(text))]


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, unnest(x) AS raw, generate_subscripts(x, 1) AS si FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]*[.!?]?') AS x FROM d)),
t AS (SELECT doc_id, text, si, regexp_replace(regexp_replace(raw, '^[\s\x1c-\x1f\x{85}\p{Z}]+', ''), '[\s\x1c-\x1f\x{85}\p{Z}]+$', '') AS sentence FROM s),
m AS (SELECT doc_id, text, si, sentence, 0 AS kind, unnest(x) AS hit, generate_subscripts(x, 1) AS hi FROM (SELECT *, regexp_extract_all(sentence, '(?:^|[^\pL\pN_])((?:in|the|to) [\pL\pN_]+)', 1) AS x FROM t)
UNION ALL SELECT doc_id, text, si, sentence, 1, unnest(x), generate_subscripts(x, 1) FROM (SELECT *, regexp_extract_all(sentence, '[\pL\pN_]+ (?:and|for|of|with) [\pL\pN_]+') AS x FROM t)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY si, kind, hi) - 1 AS k, string_split(hit, ' ') AS w FROM m),
c AS (SELECT doc_id, CASE kind WHEN 0 THEN 'mention' ELSE 'relation' END AS kind, CASE kind WHEN 0 THEN w[2] ELSE w[1] END AS source, CASE WHEN kind = 0 THEN CASE w[1] WHEN 'the' THEN 'method' WHEN 'in' THEN 'problem' ELSE 'topic' END ELSE CASE w[2] WHEN 'of' THEN 'CAUSES' WHEN 'for' THEN 'REDUCES' WHEN 'with' THEN 'DEPENDS_ON' ELSE 'RELATED_TO' END END AS label, k % 5 = 4 AND NOT contains(text, sentence || ' indeed') AS unquoted FROM n)
SELECT doc_id, kind, label, CASE WHEN label = 'topic' THEN 'facet' WHEN label = 'RELATED_TO' THEN 'relation' WHEN unquoted THEN 'quote' ELSE '' END AS why, count(*) AS n FROM c GROUP BY ALL""")
def extracted_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions and relations that an offline extractor finds in every document, and what of them is refused and why."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    kept, rejected = extraction.extracted(texts, HastyExtractor(CUES, CUE_FACETS), "doc_id")
    return kept.withColumn("why", F.lit("")).unionByName(rejected).groupBy("doc_id", "kind", "label", "why").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_partkey % 50 AS cluster, l_orderkey * 10 + l_linenumber AS id, l_shipdate::DATE::VARCHAR || repeat('x', (l_quantity)::INT % 4) AS text, l_suppkey AS paper_id FROM lineitem WHERE l_partkey % 50 > 0 OR l_orderkey % 2 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY length(text), text) AS i FROM s)
SELECT cluster, text AS statement, n_statements, n_papers FROM o JOIN (SELECT cluster, count(*) AS n_statements, count(DISTINCT paper_id) AS n_papers FROM s GROUP BY cluster) USING (cluster) WHERE i = 1""")
def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    """One text for each of fifty large clusters, merged 32 texts at a time."""
    text = F.concat(F.col("l_shipdate").cast("date").cast("string"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int") % 4))
    rows = table(spark, d, "lineitem").where("l_partkey % 50 > 0 or l_orderkey % 2 = 0").select((F.col("l_partkey") % 50).alias("cluster"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), text.alias("text"), F.col("l_suppkey").alias("paper_id"))
    return extraction.cluster_summaries(rows)
