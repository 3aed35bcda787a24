"""WARC archives (operator 13): written through Spark's text sink, read back, and assembled into captures.

A page becomes a request, a response (or a revisit of an equal payload) and a metadata record; the last names
the page. Request and metadata say by WARC-Concurrent-To which capture they belong to. Archives are
gzip files, so a task reads a file from its beginning, in pieces between the words that open a record; a
payload that holds those words is put together again by its Content-Length. Captures are assembled by joins on
record ids, one nested row each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import checkpoint_dir, cut, table

#: What opens a record, between which the reader cuts; the version's last digit follows.
OPENING, VERSION, END = "WARC/1.", "1", "\r\n\r\n"
#: WARC-Date of all records unless another is given: archives of equal pages are equal.
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Equal rows that one row makes at a time.
COPIES = 1 << 14
CAPTURES = ("response", "revisit", "resource")
RECORD = "record_id string, type string, uri string, date string, concurrent_to array<string>, refers_to string, content_type string, payload_digest string, block binary, error string"
FIELDS = {"warc-record-id": "record_id", "warc-type": "type", "warc-target-uri": "uri", "warc-date": "date", "warc-refers-to": "refers_to", "content-type": "content_type", "warc-payload-digest": "payload_digest"}


def base32(hex_digest: Column) -> Column:
    """The base32 form of a digest of 40 hexadecimal digits, five of them (four letters) at a time."""
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _identity(*parts: Column) -> Column:
    """A record id that follows from what it identifies."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, record_id: Column, block: Column, content_type: str, date: str, uri: Column, *more: tuple[str, Column], end: str = END) -> Column:
    """A WARC record; headers whose value is null are left out."""
    headers = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *more, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    lines = F.concat_ws("\r\n", F.lit(OPENING + VERSION), *(F.concat(F.lit(f"{name}: "), value) for name, value in headers))
    return F.concat(lines, F.lit(END), block, F.lit(end))


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def _groups(pages: DataFrame) -> DataFrame:
    """(equal, sha1, page_id, url, n): the equal rows of `pages`, n of each. equal: digest of the payload by which payloads are told apart."""
    narrow = pages.select(F.sha2(_payload(), 256).alias("equal"), F.sha1(_payload()).alias("sha1"), F.octet_length(_payload()).cast("long").alias("size"), "page_id", F.col("url").cast("string").alias("url"))
    return narrow.groupBy("equal", "sha1", "size", "page_id", "url").agg(F.count("*").alias("n"))


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, copy, sha1, size, kind, capture_id, refers_id, html): a row for each row of `pages`, html for responses only.

    Of equal payloads of `least_bytes` or more the row with the largest page_id is the response (null is the smallest,
    of equal ones the largest url), others revisit it. Payloads move once: one text of each digest.
    """
    groups = cut(_groups(pages))
    order = F.struct(F.isnotnull("page_id"), "page_id", F.isnotnull("url"), "url")
    heads = groups.groupBy("equal").agg(F.max_by(F.struct("page_id", "url"), order).alias("head"))
    many = groups.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int")))).repartition("equal", "page_id", "url", "_block")
    copies = many.withColumn("copy", F.explode(F.sequence(F.col("_block") * COPIES + 1, F.least(F.col("n"), (F.col("_block") + 1).cast("long") * COPIES))))
    joined = copies.join(heads, "equal")
    leading = F.col("page_id").eqNullSafe(F.col("head.page_id")) & F.col("url").eqNullSafe(F.col("head.url")) & (F.col("copy") == 1)
    told = joined.withColumn("kind", F.when(leading | (F.col("size") < least_bytes), "response").otherwise("revisit"))
    told = told.withColumn("capture_id", _identity(F.lit("capture"), F.col("page_id"), F.sha1("url"), F.col("sha1"), F.col("copy")))
    told = told.withColumn("refers_id", F.when(F.col("kind") == "revisit", _identity(F.lit("capture"), F.col("head.page_id"), F.sha1("head.url"), F.col("sha1"), F.lit(1).cast("long"))))
    told = cut(told.select("equal", "page_id", "url", "copy", "sha1", "size", "kind", "capture_id", "refers_id"))
    texts = pages.select(F.sha2(_payload(), 256).alias("equal"), _payload().alias("html")).groupBy("equal").agg(F.first("html").alias("html"))
    responses = told.where("kind = 'response'").join(texts, "equal")
    return responses.drop("equal").union(told.where("kind = 'revisit'").withColumn("html", F.lit(None).cast("string")).drop("equal"))


def transactions(found: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the three records of each capture, end to end, but for the line feed that ends the last: the text sink writes it."""
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    path = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    fields = F.concat_ws("\r\n", F.concat(F.lit("page: "), F.to_json(F.struct("page_id", "url"))), F.concat(F.lit("payload-length: "), F.col("size").cast("string")), F.lit(""))
    own, refers = F.col("capture_id"), F.col("refers_id")
    about = [(name, _identity(F.lit(name), own)) for name in ("request", "metadata")]
    request = _record("request", about[0][1], get, "application/http; msgtype=request", date, uri, ("WARC-Concurrent-To", own))
    response = _record("response", own, F.concat(answer, F.coalesce("html", F.lit(""))), "application/http; msgtype=response", date, uri, ("WARC-Payload-Digest", digest))
    profile = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", own, answer, "application/http; msgtype=response", date, uri, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers), ("WARC-Profile", profile))
    metadata = _record("metadata", about[1][1], fields, "application/warc-fields", date, uri, ("WARC-Concurrent-To", own), end=END[:-1])
    return found.select(F.concat(request, F.when(F.col("kind") == "response", response).otherwise(revisit), metadata).alias("value"))


def write_archives(pages: DataFrame, folder: str, date: str = DATE, least_bytes: int = LEAST_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of `pages` (page_id, url, html) to gzip files in `folder`.

    Null html is an empty payload, a null url leaves its headers out, a null page_id its line. Blanks and controls of a
    url are %20 in headers; the metadata record has it whole. Rows that are equal in all three are captures of their own.
    Other columns are ignored. An empty table gives archives without records.
    """
    transactions(captures(pages, least_bytes), date).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


class Reader:
    """Puts the pieces of one file together to records."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.needed, self.head = 0, -1, b""

    def _look(self) -> None:
        """Reads the header once its end is there."""
        if self.needed < 0:
            text = b"".join(self.parts)
            self.parts = [text]
            end = text.find(END.encode())
            if end >= 0:
                self.head, length = text[:end], 0
                for line in self.head.split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length":
                        length = int(value) if value.strip().isdigit() else 0
                self.needed = end + 4 + length

    def feed(self, piece: bytes) -> dict | None:
        """Takes the next piece; a record that it shows to be over comes out."""
        done = None
        if self.parts and self.needed >= 0 and self.size >= self.needed:
            done = self.close()
        if self.parts:
            self.parts += [OPENING.encode(), piece]
            self.size += len(OPENING) + len(piece)
        elif piece:
            self.parts, self.size = [piece], len(piece)
        self._look()
        return done

    def close(self) -> dict | None:
        """The record that the pieces make; one that is cut short or isn't closed by an empty line has an error."""
        if not self.parts:
            return None
        text, needed = b"".join(self.parts), self.needed
        row = dict.fromkeys(("record_id", "type", "uri", "date", "refers_to", "content_type", "payload_digest"))
        row |= {"concurrent_to": [], "block": None, "error": None}
        if needed < 0:
            row["error"] = "no end of the header"
        else:
            start = len(self.head) + 4
            for line in self.head.split(b"\r\n")[1:]:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name, value = name.strip().lower(), value.strip()
                if name == "warc-concurrent-to":
                    row["concurrent_to"].append(value)
                elif name in FIELDS:
                    row[FIELDS[name]] = value
            row["block"] = text[start:needed]
            if len(text) < needed:
                row["error"] = "shorter than its Content-Length"
            elif text[needed:].strip(b"\r\n"):
                row["error"] = "longer than its Content-Length"
        self.__init__()
        return row


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "block" else pa.list_(pa.string()) if n == "concurrent_to" else pa.string()) for n in names])
    reader, file, rows, size = Reader(), None, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for path, piece in zip(batch.column("file"), batch.column("piece"), strict=True):  # a piece at a time becomes an object
            found, path = [], path.as_py()
            if path != file:
                found, file = [reader.close()], path
            found.append(reader.feed(piece.as_py() or b""))
            for row in found:
                if row:
                    rows.append(row)
                    size += len(row["block"] or b"")
            if size > 4 << 20 or len(rows) >= 4096:
                yield out()
                rows, size = [], 0
    if row := reader.close():
        rows.append(row)
    yield out()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of gzip archives: record_id, type, uri, date, concurrent_to, refers_to, content_type, payload_digest, block, error.

    A file is read by one task from its beginning, a piece at a time. A record that breaks its own Content-Length comes
    with an error. Members of one gzip file may be one or many.
    """
    pieces = spark.read.option("lineSep", OPENING).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_parsed, RECORD)


def assembled(records: DataFrame, columns: tuple[str, ...] = ("type", "uri", "date", "refers_to", "payload_digest", "block")) -> DataFrame:
    """A row for each capture (response, revisit, resource): capture_id, its `columns`, and its request and metadata as lists of structs.

    Records belong together that name each other in WARC-Concurrent-To, in either direction, or that name one that
    does. A capture without other records has empty lists; a record that no capture is concurrent to is left out, as is
    one with an error. Records are read several times: cut or write them first. Companions are found by ids alone.
    """
    good = records.where("error is null and record_id is not null")
    captured = good.where(F.col("type").isin(*CAPTURES))
    others = good.where(~F.col("type").isin(*CAPTURES))
    named = good.select("record_id", "type", F.explode("concurrent_to").alias("other"))
    links = named.select("record_id", "other").union(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    anchors = captured.select(F.col("record_id").alias("other"), F.lit(True).alias("is_capture"))
    marked = links.join(anchors, "other", "left")
    near = marked.where("is_capture").groupBy("record_id").agg(F.min("other").alias("capture_id"))
    far = marked.where("is_capture is null").select("record_id", "other").join(near.select(F.col("record_id").alias("other"), F.col("capture_id").alias("over")), "other").groupBy("record_id").agg(F.min("over").alias("far_id"))
    companion = F.struct("record_id", "type", "content_type", "block").alias("record")
    owned = others.join(near, "record_id", "left").join(far, "record_id", "left").select(F.coalesce("capture_id", "far_id").alias("capture_id"), companion).where("capture_id is not null")
    lists = owned.groupBy("capture_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("record.type") == kind, F.col("record")))).alias(kind) for kind in ("request", "metadata")))
    empty = F.array().cast("array<struct<record_id:string,type:string,content_type:string,block:binary>>")
    found = captured.select(F.col("record_id").alias("capture_id"), *columns).join(lists, "capture_id", "left")
    return found.withColumns({kind: F.coalesce(kind, empty) for kind in ("request", "metadata")})


def field_of(metadata: Column, name: str) -> Column:
    """The value of a field in the first metadata record that has it."""
    texts = F.array_join(F.transform(metadata, lambda r: r["block"].cast("string")), "\r\n")
    return F.nullif(F.regexp_extract(texts, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def page_records(records: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all captures; a revisit's payload is that of the response it refers to.

    Payloads are measured and digested where they are read; what is joined holds none.
    """
    full = F.col("type").isin(*CAPTURES) & (F.col("type") != "revisit")
    opened = records.withColumn("body", F.when(full, F.split(F.col("block").cast("string"), END, 2)[1]))
    facts = {"size": F.octet_length("body").cast("long"), "read": F.sha1("body"), "block": F.when(~F.col("type").isin(*CAPTURES), F.col("block"))}
    found = assembled(cut(opened.withColumns(facts).drop("body")), ("type", "refers_to", "payload_digest", "size", "read"))
    page = lambda name: F.get_json_object(field_of(F.col("metadata"), "page"), f"$.{name}")
    told = cut(found.select("capture_id", F.col("type").alias("record_type"), F.col("refers_to").alias("refers_id"), page("page_id").cast(kind).alias("page_id"), "size", F.regexp_replace("payload_digest", "^sha1:", "").alias("said"), "read"))
    responses = told.where("record_type <> 'revisit'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("of"), F.col("size").alias("of_size"))
    direct = told.where("record_type <> 'revisit'").select("page_id", F.col("size").alias("payload_bytes"), base32(F.col("read")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = told.where("record_type = 'revisit'").join(responses, "refers_id", "left").select("page_id", F.col("of_size").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", F.col("of").alias("refers_to"))
    return direct.union(again)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to an archive and read back."""
    pages, folder = table(spark, sf_dir, "pages"), f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return page_records(read_records(spark, folder), pages.schema["page_id"].dataType.simpleString())


_LETTERS = " || ".join(f"substr('{BASE32}', CAST((v[{k + 1}] >> {shift}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
OP13_SQL = f"""
WITH held AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(html, '') AS payload FROM pages),
placed AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, r) AS place, first(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, r) AS head FROM held),
digests AS (SELECT *, list_transform(range(8), lambda k: CAST('0x' || substr(sha1(payload), 1 + 5 * k, 5) AS BIGINT)) AS v FROM placed)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN head END AS refers_to
FROM digests
"""
