"""WARC archives: write captures, read records back, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; the
request and the metadata point to the response by WARC-Concurrent-To. Archives are written by Spark's
text writer with the record end as line end, so they go wherever Spark can write and come back from a
lost task whole. Reading parses each archive by Content-Length and joins the records on their ids.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.session import checkpoint_dir

#: Payloads shorter than this are never replaced by a revisit.
LEAST = 1000
#: Payload bytes aimed at in one archive file, and their bound: a file is read back whole by one task.
ARCHIVE_BYTES, ARCHIVE_BOUND = 64 * 2**20, 2**30
_DATE = "2020-01-01T00:00:00Z"
_END = "\r\n\r\n"


def _record(kind: str, ident: str, fields: dict[str, str], kind_of_block: str, block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{ident}>", "WARC-Date": _DATE, **fields, "Content-Type": kind_of_block, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace") + b"\r\n" + block


def _uri(url: str | None) -> str:
    """A header value: line ends and blanks at its ends would break the header."""
    return "".join("%%%02X" % ord(c) if c in "\r\n\t " else c for c in url or "") or "urn:none"


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the captures of all rows as archives under `path`.

    Of the rows with equal payloads of at least LEAST bytes those with the largest key are responses, the others
    revisits without a payload. A null payload is empty; a null url is `urn:none`. Several rows with the largest key
    of their payload are all responses. Every row gets record ids of its own, so repeated rows stay apart.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    slim = pages.select(F.col(key).cast("string").alias("k"), F.col(key).alias("o"), F.col(url).alias("u"), body.alias("b"))
    digest = slim.select("k", "o", F.sha1("b").alias("d"), F.octet_length("b").alias("n"))
    # only payloads that occur again; counted in the map tasks first, so a payload with a third of all rows is one row a task
    again = digest.filter(F.col("n") >= LEAST).groupBy("d").agg(F.max("o").alias("top"), F.count("*").alias("c")).filter("c > 1").select("d", "top")
    size = slim.agg(F.avg(F.octet_length("b")), F.max(F.octet_length("b"))).first()
    captures = max(1, int(min(ARCHIVE_BYTES // max(1.0, size[0] or 1.0), ARCHIVE_BOUND // max(1, size[1] or 1))))
    marked = (slim.withColumn("d", F.sha1("b")).join(again, "d", "left")
              .select("k", "u", F.col("top").cast("string").alias("top"), (F.col("top").isNotNull() & ~F.col("o").eqNullSafe(F.col("top"))).alias("revisit"), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, u, _, revisit, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, uri = str(uuid.uuid4()), _uri(u)
                named = {"WARC-Target-URI": uri}
                link = {**named, "WARC-Concurrent-To": f"<urn:uuid:{own}>"}
                sha = hashlib.sha1(payload)
                mark = {"WARC-Payload-Digest": "sha1:" + base64.b32encode(sha.digest()).decode()}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                target = "/" + uri.split("://", 1)[-1].partition("/")[2]
                out.append(_record("request", str(uuid.uuid4()), link, "application/http; msgtype=request", f"GET {target} HTTP/1.1\r\n\r\n".encode("utf-8", "replace")))
                if revisit:
                    profile = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    out.append(_record("revisit", own, {**named, **profile, **mark}, "application/http; msgtype=response", http))
                else:
                    out.append(_record("response", own, {**named, **mark}, "application/http; msgtype=response", http + payload))
                note = f"pageId: {k}\r\n" if k is not None else ""
                out.append(_record("metadata", str(uuid.uuid4()), link, "application/warc-fields", f"{note}payloadBytes: {len(payload)}\r\n".encode()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 3 * captures).option("lineSep", _END).option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record; lengths decide, whatever a block holds."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        if at > len(data):
            raise ValueError("archive ends inside a record")
        yield head, data[start:at]


RECORDS = ("kind string, id string, concurrent_to string, uri string, payload_digest string, payload_bytes long, page string, payload binary")


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under `path` (columns of RECORDS).

    payload_digest is bare lower-case hex, worked out from the payload where there is one and taken from the header for a revisit; a payload that
    differs from its header's digest is an error. page and payload_bytes come from metadata records. payloads=False leaves the column null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for head, block in parse(gzip.decompress(data) if name.endswith(".gz") else data):
                    kind, digest, page, size, payload = head["warc-type"], None, None, None, None
                    if kind == "metadata":
                        notes = dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n") if ": " in x)
                        page, size = notes.get("pageId"), int(notes.get("payloadBytes", 0))
                    elif kind in ("response", "revisit"):
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                        size = len(payload)
                    rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), digest, size, page, payload if payloads else None))
                if rows:
                    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     ["kind", "id", "concurrent_to", "uri", "payload_digest", "payload_bytes", "page", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: page, request, response (a response or revisit record), metadata, refers_to.

    Records meet through concurrent-to ids. A missing request or metadata record leaves a null; several of one kind count as the one
    with the smallest id. refers_to is the page of the response with the revisit's payload digest, the largest page if there are more.
    """
    full = records.select("kind", "id", "uri", "payload_digest", "payload_bytes", "payload").filter(F.col("kind").isin("response", "revisit"))
    side = lambda kind, *cols: (records.filter(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("id"))
                                .agg(F.min_by(F.struct("id", *cols), "id").alias(kind)))
    rows = (full.withColumn("response", F.struct("kind", "id", "uri", "payload_digest", "payload_bytes", "payload")).select("id", "response")
            .join(side("request", "uri"), "id", "left").join(side("metadata", "page", "payload_bytes"), "id", "left"))
    rows = rows.withColumn("page", F.col("metadata.page"))
    origin = (rows.filter((F.col("response.kind") == "response") & (F.col("response.payload_bytes") >= LEAST))
              .groupBy(F.col("response.payload_digest").alias("d")).agg(F.max(F.col("page").cast("long")).alias("refers_to")))
    wanted = F.when(F.col("response.kind") == "revisit", F.col("response.payload_digest"))
    return rows.withColumn("d", wanted).join(origin, "d", "left").select("page", "request", "response", "metadata", "refers_to")


def archive_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
