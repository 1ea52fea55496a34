"""Web captures as WARC records: archives written and read, records assembled into one row for each capture.

Writing. Every page becomes three records: a request, a response, and metadata with the page's id. Request and
metadata name the response in WARC-Concurrent-To. Of pages with equal payloads of at least ``least_bytes`` the one with
the smallest id is a response; the others are revisits, records without the payload that name the response's
record and its payload digest. Record ids derive from the row's place, so a task that runs again writes the same bytes.
Files are plain WARC/1.1, written by Spark's text writer with the record end as line end, so they go wherever
Spark can write.

Reading. A file is split by Spark at the end of one record and the version line of the next, so one large archive is read
by many tasks, and each piece is checked against its Content-Length. Spark's reader may miss an end, where its buffer ends in
one; such a piece is several records, told apart by their lengths. A payload may hold those bytes itself;
its record then comes up short, and the pieces of a file that has such a record are put together again in order and read by
length alone, a few at once. So are gzipped archives whose names do not say so. Malformed records are an error, never skipped.

Assembly. The links of WARC-Concurrent-To, in either direction and through any number of records, make
components. A record with one link, to a record without any, belongs to that one at once; only records that link to more, or
to one that links on, take rounds of contraction. Each response or revisit of a component, with the component's requests and metadata, is one capture.
A component without one is a capture without a response. A revisit gets the target of its reference: references
are counted first, and responses referred to very often, which are few by their number, need no shuffle.

Defined cases: a null html is an empty payload, a null url has no target; control characters, blanks and non-ASCII
characters of a url are percent-encoded; a null id is larger than any and is left out of the metadata; repeated rows are
captures of their own; an empty table gives no records. Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import sys
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tamarisk.llm.base import join_names, rows_of, table, with_row_numbers
from tamarisk.llm.simhash import components
from tamarisk.session import materialise, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEGIN = b"WARC/1."
VERSION = BEGIN + b"1\r\n"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # where the table has no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
AT_ONCE = 16
RECORDS = ("record_id string, kind string, target string, date string, concurrent_to array<string>, refers_to string, payload_digest string, "
           "content_type string, head string, payload_bytes long, payload binary")


def sha1_digest(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(number: int, kind: str) -> str:
    h = hashlib.md5(f"{kind}:{number}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(kind: str, id_: str, target: str | None, content_type: str, block: bytes, *more: tuple[str, str], date: str = DATE) -> bytes:
    """One record without its end."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", id_), ("WARC-Date", date), *([("WARC-Target-URI", target)] if target is not None else []), *more,
              ("WARC-Block-Digest", f"sha1:{sha1_digest(block)}"), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def capture_records(number: int, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The three records of a page; ``refers_to`` is the number of the response that a revisit repeats."""
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    own = record_id(number, "response")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    same = ("WARC-Payload-Digest", f"sha1:{sha1_digest(payload)}")
    if refers_to is None:
        answer = record("response", own, target, "application/http; msgtype=response", head + payload, same)
    else:
        answer = record("revisit", own, target, "application/http; msgtype=response", head, same,
                        ("WARC-Refers-To", record_id(refers_to, "response")), ("WARC-Profile", PROFILE))
    about = b"" if page_id is None else b"page-id: %d\r\n" % page_id
    asked = f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()
    link = ("WARC-Concurrent-To", own)
    return [record("request", record_id(number, "request"), target, "application/http; msgtype=request", asked, link), answer,
            record("metadata", record_id(number, "metadata"), target, "application/warc-fields", about, link)]


def write(pages: DataFrame, path: str, least_bytes: int = 0, scanned: bool = False) -> None:
    """Pages (page_id, url, html) as archives below ``path``; ``scanned`` as in with_row_numbers."""
    rows = with_row_numbers(pages.select(F.col("page_id").cast("long"), "url", "html"), "number", scanned)
    rows = rows.select("number", "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    marks = materialise(rows.select("number", "page_id", "same", F.octet_length("payload").alias("bytes")))
    # first by id, then by place
    order = F.struct(F.col("page_id").isNull().alias("lost"), "page_id", "number")
    firsts = marks.filter(F.col("bytes") >= least_bytes).groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    firsts = materialise(firsts.filter("copies > 1").select("same", "copies", F.col("first.number").alias("first")))
    repeated = join_names(marks.select("number", "same"), firsts, ["same"], marks.count()).filter("number <> first").select("number", F.col("first").alias("refers_to"))
    placed = rows.drop("same").join(materialise(repeated), "number", "left")
    out = pa.schema([("record", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                made = [r for row in zip(*[c.to_pylist() for c in b.slice(at, AT_ONCE).columns]) for r in capture_records(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=out)

    made = placed.select("number", "page_id", "url", "payload", "refers_to").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).text(path)


def fields_of(head: bytes) -> dict[str, list[str]]:
    """Header fields by lower-case name; a name may repeat."""
    fields: dict[str, list[str]] = {}
    for line in filter(None, head.decode("utf-8", "replace").split("\r\n")):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header field of a WARC record: {line[:80]!r}")
        fields.setdefault(name.strip().lower(), []).append(value.strip())
    return fields


def row_of(fields: dict[str, list[str]], block: bytes) -> tuple:
    """A row of RECORDS; the digest of a whole payload is checked."""
    one = lambda name: fields.get(name, [None])[0]
    bare = lambda d: None if d is None else d.partition(":")[2]
    kind, type_, head, payload = one("warc-type"), one("content-type") or "", None, block
    size, digest = len(block), bare(one("warc-payload-digest"))
    if type_.startswith("application/http"):
        top, _, payload = block.partition(END)
        head = top.decode("utf-8", "replace")
        said = [v for n, _, v in (line.partition(":") for line in head.split("\r\n")) if n.lower() == "content-length"]
        size = len(payload)
        if kind == "revisit":
            size, payload = int(said[0]) if said else None, None
        elif digest is not None and kind == "response" and digest != sha1_digest(payload):
            raise ValueError(f"the payload of {one('warc-record-id')} is not the one of its digest")
    return (one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), fields.get("warc-concurrent-to", []), one("warc-refers-to"),
            digest, type_, head, size, payload)


class _Joined(io.RawIOBase):
    """Pieces of bytes as one stream, a piece at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.left = memoryview(piece)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def records_of(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """The rows of a whole archive, plain or gzipped, by the lengths that it states; ``pieces``: its bytes in order."""
    stream = io.BufferedReader(_Joined(iter(pieces)))
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if stream.peek(2)[:2] == b"\x1f\x8b" else stream
    while line := stream.readline():
        if not line.startswith(BEGIN):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        fields = fields_of(b"".join(head))
        size = int(fields["content-length"][0])
        block = stream.read(size)
        if len(block) < size or stream.read(len(END)) != END:
            raise ValueError(f"the WARC record {fields.get('warc-record-id')} is cut short")
        yield row_of(fields, block)


def _rows(df: DataFrame, read) -> DataFrame:
    """RECORDS from what ``read`` makes of the rows, a few at once."""
    out = to_arrow_schema(StructType.fromDDL(RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for row in read(rows_of(batches, AT_ONCE)):
            made.append(row)
            if len(made) == 4 * AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return df.mapInArrow(run, RECORDS)


def _blocks(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """The fields and the block of each record of a piece; an error if their lengths do not make up the piece."""
    at = len(BEGIN) if content.startswith(BEGIN) else 0
    while at < len(content):
        begin = content.index(END, at) + len(END)
        fields = fields_of(content[at:begin].partition(b"\r\n")[2])
        end = begin + int(fields["content-length"][0])
        if end > len(content) or content[end:end + len(END) + len(BEGIN)] not in (b"", END, END + BEGIN):
            raise ValueError("not a record")
        yield fields, content[begin:end]
        at = end + len(END) + len(BEGIN)  # behind the end of a record that Spark did not split, or of the file's last one


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (content,) in rows:
        for fields, block in _blocks(content):
            yield row_of(fields, block)


def _files(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The rows of whole files from (file, piece) in order."""
    for _, pieces in groupby(rows, lambda r: r[0]):
        yield from records_of(piece if k == 0 else END + BEGIN + piece for k, (_, piece) in enumerate(pieces))


def _odd_files(suspects: DataFrame) -> DataFrame:
    """The files of those pieces (file, value) that are no whole records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content in rows_of(batches, AT_ONCE):
            try:
                for _ in _blocks(content):
                    pass
            except (ValueError, KeyError):
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.string())], names=["file"])

    return suspects.mapInArrow(run, "file string").distinct()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records (RECORDS) of all archives below ``path``; warcinfo records too."""
    cut = spark.read.option("lineSep", (END + BEGIN).decode()).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    head = F.substring_index("value", END.decode(), 1)
    stated = F.regexp_extract(head, r"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", 1).try_cast("bigint")
    rest = F.octet_length("value") - F.octet_length(head) - len(END)
    whole = (rest == stated) | ((rest == stated + len(END)) & F.endswith("value", F.lit(END.decode())))
    value = F.col("value").cast("binary")
    odd = [r.file for r in _odd_files(cut.filter(~F.coalesce(whole, F.lit(False))).select("file", value)).collect()]  # names of files, as in the file index
    found = _rows((cut.filter(~F.col("file").isin(odd)) if odd else cut).select(value), _pieces)
    if not odd:
        return found
    ordered = cut.filter(F.col("file").isin(odd)).select("file", "start", F.monotonically_increasing_id().alias("place"), value.alias("value"))
    ordered = ordered.repartition("file").sortWithinPartitions("file", "start", "place")
    return found.unionAll(_rows(ordered.select("file", "value"), _files))


def _transactions(light: DataFrame) -> DataFrame:
    """Adds ``capture``, the same for all records that links connect."""
    first, count = F.get("concurrent_to", F.lit(0)), F.size("concurrent_to")
    sources = light.filter(count > 0).select(F.col("record_id").alias("to"))
    chained = light.filter(count == 1).select("record_id", first.alias("to")).join(sources, "to", "left_semi").select("record_id")
    odd = materialise(chained.unionAll(light.filter(count > 1).select("record_id")).distinct())
    if odd.isEmpty():
        return light.withColumn("capture", F.coalesce(first, "record_id"))
    marked = light.join(odd.withColumn("odd", F.lit(True)), "record_id", "left")
    hubs = materialise(marked.withColumn("hub", F.when(F.col("odd"), F.col("record_id")).otherwise(F.coalesce(first, "record_id"))))
    ends = hubs.filter("odd").select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("to"))
    edges = ends.join(hubs.select(F.col("record_id").alias("to"), "hub"), "to", "left").select("a", F.coalesce("hub", "to").alias("b"))
    groups = materialise(components(edges))
    return hubs.join(groups.withColumnRenamed("node", "hub"), "hub", "left").select(*light.columns, F.coalesce("root", "hub").alias("capture"))


def captures(records: DataFrame) -> DataFrame:
    """One row for each capture: response (null if there is none), requests, metadata."""
    answer = F.col("kind").isin("response", "revisit", "resource", "conversion", "continuation")
    about = F.col("kind").isin("request", "metadata")
    part = F.struct("record_id", "target", "date", "content_type", "head", "payload")
    light = materialise(records.filter(answer | about).select("record_id", "kind", "concurrent_to", F.when(about, part).alias("part")))
    marked = _transactions(light)
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("part"))))
    beside = marked.filter(about).groupBy("capture").agg(listed("request").alias("requests"), listed("metadata").alias("metadata"))
    around = marked.filter(answer).select("record_id", "capture").join(beside, "capture", "full")
    # payloads are moved once, after everything else is in place
    none = F.array().cast(beside.schema["requests"].dataType)
    full = F.struct("kind", "target", "date", "payload_digest", "payload_bytes", "refers_to", "content_type", "head", "payload")
    answers = records.filter(answer).select("record_id", full.alias("response"))
    return around.join(answers, "record_id", "left").select(
        "capture", "record_id", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def with_originals(rows: DataFrame, value: str) -> DataFrame:
    """Rows (record_id, refers_to, ``value``) with ``original``: the value of the row referred to."""
    referred = rows.filter("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count("*").alias("copies"))
    targets = rows.select(F.col("record_id").alias("refers_to"), F.col(value).alias("original"))
    names = materialise(referred.join(targets, "refers_to", "left"))
    found = join_names(rows.filter("refers_to IS NOT NULL"), names, ["refers_to"], rows.count()).drop("copies")
    plain = rows.filter("refers_to IS NULL").withColumn("original", F.lit(None).cast(rows.schema[value].dataType))
    return plain.unionByName(found)


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path, scanned=True)
    made = captures(read(spark, path))
    page = F.regexp_extract(F.element_at("metadata", 1)["payload"].cast("string"), r"page-id: (-?[0-9]+)", 1).try_cast("bigint")
    rows = materialise(made.select("record_id", page.alias("page_id"), "response.payload_bytes", "response.payload_digest",
                                   F.col("response.kind").alias("record_type"), "response.refers_to"))
    return with_originals(rows, "page_id").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("original").alias("refers_to"))


# base32 of a SHA-1: 40 hex digits are 8 groups of 20 bits, of 4 letters each
_GROUP = "('0x' || substr(h, g * 5 + 1, 5))::BIGINT"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({v} >> {s}) & 31 AS INTEGER) + 1, 1)"
OP13_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT rid, page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS h, first_value(rid) OVER w AS first, first_value(page_id) OVER w AS original
      FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST, rid))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda g: {" || ".join(_LETTER.format(v=_GROUP, s=s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN rid = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rid <> first THEN original END AS refers_to
FROM d
"""
