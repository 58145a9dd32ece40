"""WARC archives: writing captures, reading them back, assembling transactions.

Writing. A capture is four kinds of record: a request, a response (or a revisit that
refers to the response with an equal payload), and metadata; request and metadata name the
response through WARC-Concurrent-To. Spark's text writer lays the records down, each ended
by the two line breaks the format asks for, so archives go to any file system Spark
reaches and its commit protocol covers lost executors. Each file is one gzip stream.

Reading. Files are parsed by Content-Length, record after record, while they are unpacked,
so payloads may hold anything. Digests are computed again from the bytes read.

Assembly. Request and metadata join their response through the concurrent-to
identifiers, a revisit joins the response it refers to; one nested row per capture.

Equality of payloads is by SHA-256 and length. Of equal payloads of at least ``MIN_REVISIT``
bytes the one with the largest id is the response; smaller ones are all responses.

Defined results: null html is an empty payload; null url is an empty target; a null id
stays null; repeated rows are one capture each, under the same record ids; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import heavy_keys, land, ship, spread_join, work_path

MIN_REVISIT = 1000
#: Record layout; fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payloads per archive file, at most (but for a single one that is larger).
FILE_BYTES = 256 << 20
#: Bounds of the classes of payload size.
SIZES = (16 << 10, 1 << 20, 32 << 20)


def record_id(kind: str, page, sha1):
    """A urn:uuid made from the record's kind, the page id and the payload's digest."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), sha1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(kind: str, headers: list, block):
    """One record without its closing line breaks; ``headers`` are (name, column)."""
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block]
    return F.concat(*lines)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, html, size, sha1, refers): ``refers`` is the response's id for revisits."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20]", "%20").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("size"),
        F.sha1(html.cast("binary")).alias("sha1"),
        F.sha2(html.cast("binary"), 256).alias("sha256"),
    )
    light = rows.filter(F.col("size") >= MIN_REVISIT).select("page", "size", "sha256")
    counts = land(light.groupBy("sha256", "size").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-payloads")
    heavy = heavy_keys(counts.select("sha256", "size", "n"), "n")
    return (
        spread_join(rows, counts.drop("n"), ["sha256", "size"], heavy, "left", ["page", "url"])
        .withColumn("refers", F.when(F.col("first") != F.col("page"), F.col("first")))
        .drop("sha256", "first")
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of ``pages`` below ``path``.

    Files roll by bytes, as a file is one binary cell when it is read: captures are written by
    classes of payload size, so many to a file that even the largest of the class stay within
    ``FILE_BYTES``. Equal payloads are of one class, so each class is written for itself.
    """
    size = F.coalesce(F.octet_length(html_col), F.lit(0))
    bounds = [0, *(b for b in SIZES), None]
    inside = [(size >= lo) & (F.lit(True) if hi is None else size < hi) for lo, hi in zip(bounds[:-1], bounds[1:])]
    counts = pages.agg(*(F.count_if(x).alias(str(k)) for k, x in enumerate(inside))).first()
    for k, x in enumerate(inside):
        if k == 0 or counts[k]:
            _write(pages.filter(x), f"{path}/class={k}", id_col, url_col, html_col, 3 * max(1, FILE_BYTES // bounds[k + 1]) if bounds[k + 1] else 3)


def _write(pages: DataFrame, path: str, id_col: str, url_col: str, html_col: str, per_file: int) -> None:
    c = captures(pages, id_col, url_col, html_col)
    page, url, sha1 = F.col("page"), F.col("url"), F.col("sha1")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    main_id = record_id("capture", page, sha1)
    request = _record(
        "request",
        [("WARC-Record-ID", record_id("request", page, sha1)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    response = _record(
        "response",
        [("WARC-Record-ID", main_id), ("WARC-Target-URI", url), digest, ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.col("html")),
    )
    revisit = _record(
        "revisit",
        [("WARC-Record-ID", main_id), ("WARC-Target-URI", url), digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", record_id("capture", F.col("refers"), sha1)), ("Content-Type", F.lit("application/http; msgtype=response"))],
        http,
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", record_id("metadata", page, sha1)), ("WARC-Target-URI", url), ("WARC-Concurrent-To", main_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = F.array(request, F.when(F.col("refers").isNull(), response).otherwise(revisit), metadata)
    c.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record in a stream of bytes."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while need(2) and held[:2] == b"\r\n":  # line breaks between records
            del held[:2]
        if not need(1):
            return
        end, seen = held.find(b"\r\n\r\n"), 0
        while end < 0:
            seen = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("archive ends inside a record's headers")
            end = held.find(b"\r\n\r\n", seen)
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at this place: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not need(end + 4 + size):
            raise ValueError("archive ends inside a record's block")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def unpacked(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, unpacked piece by piece; any number of gzip members, or none."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        d = zlib.decompressobj(31)
        for i in range(0, len(rest), step):
            out = d.decompress(rest[i : i + step])
            if out:
                yield out
            if d.eof:
                rest = d.unused_data + rest[i + step :]
                break
        else:
            return


RECORDS = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, stated_digest string, block_bytes long, payload_bytes long, payload_sha1 string, fields string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. Without ``payloads`` their bytes are dropped once digested."""
    ship(spark)
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    types = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in parse(unpacked(content.as_py())):
                    kind = h.get("warc-type")
                    http = kind in ("request", "response", "revisit")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    rows.append((
                        h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                        h.get("warc-payload-digest"), len(block), len(payload), hashlib.sha1(payload).hexdigest(),
                        block.decode("utf-8") if kind == "metadata" else None, payload if payloads and kind == "response" else None,
                    ))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: main (response or revisit), request, metadata, original.

    A capture without request or metadata keeps a null there; a request or metadata whose
    capture is missing is dropped. ``original`` is the response a revisit refers to.
    """
    nest = lambda *c: F.struct(*(F.col(x) for x in c))
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", nest("record_id", "type", "target_uri", "date", "refers_to", "stated_digest", "payload_bytes", "payload_sha1", "payload").alias("main")
    )
    side = (
        records.filter(F.col("type").isin("request", "metadata"))
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(
            F.min(F.when(F.col("type") == "request", nest("record_id", "target_uri", "block_bytes"))).alias("request"),
            F.min(F.when(F.col("type") == "metadata", nest("record_id", "fields"))).alias("metadata"),
        )
    )
    whole = main.join(side, "record_id", "left")
    named = records.filter(F.col("type") == "metadata").groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min("fields").alias("named"))
    # only what a revisit refers to, and only revisits look for it: a page that a third of all captures repeat is
    # one heavy key among the revisits, dealt over many tasks
    refers = land(records.filter(F.col("type") == "revisit").groupBy(F.col("refers_to").alias("record_id")).agg(F.count(F.lit(1)).alias("_rows")), "warc-refers")
    originals = (
        records.filter(F.col("type") == "response")
        .join(refers.select("record_id"), "record_id", "left_semi")
        .join(named, "record_id", "left")
        .groupBy(F.col("record_id").alias("_original"))  # repeated rows write a record twice
        .agg(F.min(F.struct("record_id", "payload_bytes", "payload_sha1", F.col("named").alias("fields"))).alias("original"))
    )
    heavy = heavy_keys(refers.withColumnRenamed("record_id", "_original"))
    revisits = whole.filter(F.col("main.type") == "revisit").withColumn("_original", F.col("main.refers_to"))
    revisits = spread_join(revisits, originals, ["_original"], heavy, "left", ["record_id"]).drop("_original", "record_id")
    responses = whole.filter(F.col("main.type") == "response").drop("record_id").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    return revisits.unionByName(responses)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = False) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them and assemble them."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col)
    return transactions(land(read(spark, path, payloads), "warc-records"))


def page_of(fields, kind: str):
    """The page id in a metadata record's block."""
    return F.regexp_extract(fields, r"^id: ([^\r]*)", 1).try_cast(kind)
