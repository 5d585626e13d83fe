"""WARC archives: write captures, read them back, and assemble transactions.

A capture is three records: the response (or a revisit, if an equal payload is archived in full
elsewhere), its request and its metadata; request and metadata name the first as concurrent-to.
Archives are written with Spark's text writer, whose line separator is the mark between records,
one bounded archive a file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.llm.common import as_bytes, staged, work_path

#: Bytes of one archive (or one capture).
ARCHIVE_BYTES = 4 << 20
MARK = b"\r\n\r\n"
_VERSION = b"WARC/1.1"
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _one_line(value: object) -> str:
    return " ".join(str(value).split())


def _record(kind: str, rid: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": _DATE, **fields, "Content-Length": len(block)}
    lines = [_VERSION, *(f"{k}: {_one_line(v)}".encode() for k, v in head.items() if v is not None)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def _host_and_path(target: str | None) -> tuple[str, str]:
    """Those of an absolute url; no host, and the root, of anything else or what cannot be parsed."""
    try:
        parts = urlsplit(target) if target and "://" in target else None
    except ValueError:  # such as an open bracket in the host
        parts = None
    return (parts.netloc, parts.path or "/") if parts else ("", "/")


def capture_records(key: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
                    original: str | None, original_page: int | None) -> bytes:
    """The records of one capture, joined by the mark between records.  ``original`` is the record
    that holds the payload, if this capture is a revisit."""
    rid = record_id("response", key)
    target = _one_line(url) if url else None
    host, path = _host_and_path(target)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    common = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}"}
    if original is None:
        main = _record("response", rid, {**common, "Content-Type": "application/http;msgtype=response"}, http + payload)
    else:
        main = _record("revisit", rid, {**common, "WARC-Refers-To": original, "WARC-Profile": _REVISIT,
                                        "Content-Type": "application/http;msgtype=response"}, http)
    request = _record("request", record_id("request", key), {
        "WARC-Target-URI": target, "WARC-Concurrent-To": rid, "Content-Type": "application/http;msgtype=request"},
        f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    lines = [f"page-id: {'' if page_id is None else page_id}", f"payload-bytes: {len(payload)}",
             f"refers-to-page: {'' if original_page is None else original_page}"]
    metadata = _record("metadata", record_id("metadata", key), {
        "WARC-Target-URI": target, "WARC-Concurrent-To": rid, "Content-Type": "application/warc-fields"},
        "\r\n".join(lines).encode() + b"\r\n")
    return MARK.join([request, main, metadata])


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, by its stated length."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        head_end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head_end].split(b"\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        start = head_end + 4
        end = start + int(fields["content-length"])
        yield fields, archive[start:end]
        if archive[end:end + 4] != MARK:
            raise ValueError(f"record at byte {at} does not end with a blank line")
        at = end + 4


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def image() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([MARK.join(held).decode()])], names=["value"])

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("page_id", "url", "digest", "key", "original", "original_page")]
        for (page, url, digest, key, original, first), payload in zip(zip(*cols, strict=True), as_bytes(b.column("html")), strict=True):
            records = capture_records(key, page, url, payload, digest, original and record_id("response", original), first)
            if held and size + len(records) > ARCHIVE_BYTES:
                yield image()
                held, size = [], 0
            held.append(records)
            size += len(records)
    if held:
        yield image()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        html = as_bytes(b.column("html"))
        yield pa.RecordBatch.from_arrays([
            *b.columns, pa.array([payload_digest(x) for x in html]), pa.array([hashlib.sha256(x).hexdigest() for x in html])],
            names=[*b.schema.names, "digest", "exact"])


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_revisit_bytes: int = 0) -> None:
    """Write the captures of all rows below ``path``.

    Of equal payloads of ``least_revisit_bytes`` or more, that of the largest identifier is archived
    in full and the others revisit it; smaller ones are all archived in full.  Null html is the empty
    payload; null urls have no target; rows that share the largest identifier are all in full, and a
    null identifier is in full only if its payload has no other.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    known = pages.mapInArrow(_digests, "page_id long, url string, html string, digest string, exact string")
    firsts = (known.where(F.octet_length("html") >= least_revisit_bytes).groupBy("exact")
              .agg(F.max("page_id").alias("original_page"), F.count(F.lit(1)).alias("times")).where("times > 1")
              .select(F.col("exact").alias("e"), "original_page"))
    main = F.col("original_page").isNull() | F.col("page_id").eqNullSafe(F.col("original_page"))
    rows = known.join(firsts, F.col("exact") == F.col("e"), "left").select(
        "page_id", "url", "html", "digest",
        F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "exact").alias("key"),
        F.when(~main, F.concat_ws("/", F.col("original_page").cast("string"), "exact")).alias("original"),
        F.when(~main, F.col("original_page")).alias("original_page"))
    (rows.mapInArrow(_archives, "value string").write
     .option("lineSep", MARK.decode()).option("maxRecordsPerFile", 1).option("compression", "gzip").text(path))


_RECORDS = ("warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
            "payload_digest string, content_type string, archive string, position int, block binary, payload_bytes long, found_digest string")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = [x.split()[0] for x in _RECORDS.split(", ")]
    schema = pa.schema([(n, {"position": pa.int32(), "block": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in names])
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows: dict[str, list] = {n: [] for n in names}
            for i, (f, block) in enumerate(parse(gzip.decompress(content))):
                kind = f["warc-type"]
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                for name, v in zip(names, (
                        kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"),
                        f.get("warc-payload-digest"), f.get("content-type"), path, i, block,
                        None if payload is None else len(payload), None if payload is None else payload_digest(payload)), strict=True):
                    rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_parsed, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id`` and structs ``main`` (response or revisit),
    ``request`` and ``metadata``, brought together by concurrent-to identifiers.

    A part that is missing is null; of records of one kind that repeat in a capture (the same rows
    archived again) one is taken.  Each capture has a handful of records, whatever its payload's copies.
    """
    fields = [c for c in records.columns if c not in ("concurrent_to",)]
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).withColumn("r", F.struct(*fields))

    def part(*kinds: str):
        return F.first(F.when(F.col("warc_type").isin(*kinds), F.col("r")), ignorenulls=True)

    return keyed.groupBy("capture_id").agg(
        part("response", "revisit").alias("main"), part("request").alias("request"), part("metadata").alias("metadata"),
        F.sum(F.when(F.col("warc_type").isin("response", "revisit"), 1).otherwise(0)).alias("times"))


def capture_summary(records: DataFrame) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response come from its payload as read; a revisit's come from the response
    that it refers to.
    """
    slim = records.withColumn("block", F.when(F.col("warc_type") == "metadata", F.col("block")))
    captures = assemble(slim)
    notes = F.str_to_map(F.decode(F.col("metadata.block"), "UTF-8"), F.lit("\r\n"), F.lit(": "))
    rows = captures.select(
        "capture_id", notes.alias("notes"), F.col("main.warc_type").alias("record_type"), F.col("main.refers_to").alias("refers"),
        F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.found_digest").alias("found_digest"), "times")
    rows = rows.withColumn("page_id", F.expr("try_cast(notes['page-id'] AS bigint)"))
    # written first: then the join below deals both sides out afresh, and Spark can split a payload
    # that very many captures revisit
    rows = staged(rows.drop("notes").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), "warc-captures")
    full = (rows.where("record_type = 'response' AND copy = 1")
            .select(F.col("capture_id").alias("full_id"), F.col("page_id").alias("full_page"),
                    F.col("payload_bytes").alias("full_bytes"), F.col("found_digest").alias("full_digest")))
    responses = rows.where("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("found_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = (rows.where("record_type = 'revisit'").join(full, F.col("refers") == F.col("full_id"), "left")
                .select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"),
                        "record_type", F.col("full_page").alias("refers_to")))
    return responses.union(revisits)


def warc_round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    least_revisit_bytes: int = 0) -> DataFrame:
    """Write below the shared checkpoint folder, read back, assemble; one row per row of ``df``."""
    path = work_path(df.sparkSession, "warc")
    write_archives(df, path, id_col, url_col, html_col, least_revisit_bytes)
    return capture_summary(read_records(df.sparkSession, path))
