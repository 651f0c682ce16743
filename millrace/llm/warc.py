"""Web archives: writing captures, and putting them together again from their records.

``write_archives`` writes three records per page (request, response or
revisit, metadata), each a gzip member, into archives below a folder that
driver and executors share. ``read_records`` reads any such archives, one
stream per archive, in as many tasks as there are archives; a path that is listed again is read once. An
archive that ends inside a record, or has fewer records than its list says, is an error that names it. ``assemble`` joins request, response and metadata records
through their concurrent-to identifiers and emits one nested row per capture.

Defined results: of pages with equal payloads of at least ``least_bytes`` the
one with the largest page id is the response, the others refer to it; with
repeated ids the last row is; a null page id sorts before all others and gets
its own capture; null html is an empty payload, a null url an empty one;
an empty table gives archives without records. Pages must be a stable input
(files or a written table), as their rows are numbered in file order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.batches import map_task
from millrace.session import cut_lineage, scratch_path
from millrace.sources.writers import open_uri

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of UUIDs
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 64 << 20
ROWS = 2000
MOST_TASKS = 50_000

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, url string, date string, page_id long,"
    " payload_bytes long, payload_digest string, payload string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(row: int, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}/{row}')}>"


def record(headers: dict[str, str], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def capture_records(page_id: int | None, url: str, payload: bytes, row: int, response_row: int) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    url = " ".join(url.split())
    main = record_uri(row, "response")
    common = {"WARC-Target-URI": url, "WARC-Date": DATE}
    path = "/" + url.partition("://")[2].partition("/")[2]
    request = f"GET {path} HTTP/1.1\r\nHost: {url.partition('://')[2].partition('/')[0]}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = common | {"WARC-Record-ID": main, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response"}
    if row == response_row:
        answer = record({"WARC-Type": "response"} | head, http + payload)
    else:
        answer = record({"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_uri(response_row, "response")} | head, http)
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    link = {"WARC-Concurrent-To": main}
    return [
        record({"WARC-Type": "request", "WARC-Record-ID": record_uri(row, "request"), "Content-Type": "application/http; msgtype=request"} | common | link, request),
        answer,
        record({"WARC-Type": "metadata", "WARC-Record-ID": record_uri(row, "metadata"), "Content-Type": "application/warc-fields"} | common | link, fields),
    ]


def _write_task(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, base = open_uri(folder)
        out, path, size, count = None, "", 0, 0

        def close() -> dict:
            out.close()
            return {"path": [path], "records": [count], "bytes": [size]}

        for batch in batches:
            names = ("page_id", "url", "payload", "row", "response_row")
            for page_id, url, payload, row, response_row in zip(*(batch.column(n).to_pylist() for n in names)):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"  # a repeated task writes other files; its list of files counts
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for one in capture_records(page_id, url, payload, row, response_row):
                    size += out.write(gzip.compress(one, 3, mtime=0))
                    count += 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0,
) -> DataFrame:
    """Write all pages below ``folder`` once; returns the list of archives (``path, records, bytes``), itself a written table."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha1("payload"))
    responses = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("last"), F.count("*").alias("n")).where("n > 1")
        .select("digest", F.col("last.row").alias("response_row"))
    )
    # written first: few equal payloads make a small table, and then the pages need no shuffle
    linked = rows.join(cut_lineage(responses), "digest", "left").select(
        "page_id", "url", "payload", "row",
        F.when(F.octet_length("payload") >= least_bytes, F.coalesce("response_row", "row")).otherwise(F.col("row")).alias("response_row"),
    )
    store, base = open_uri(folder)
    store.create_dir(base, recursive=True)
    return cut_lineage(map_task(linked, _write_task(folder), "path string, records long, bytes long"))


def parse_stream(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names; repeated ones joined by a blank) and body of each record; raises where one is cut short."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line.endswith(b"\n"):
                raise EOFError("the archive ends inside the headers of a record")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            headers[name] = f"{headers[name]} {value}" if name in headers else value
        size = int(headers["content-length"])
        body = stream.read(size)
        if len(body) < size:
            raise EOFError(f"the archive ends after {len(body)} of {size} bytes of a record")
        if (end := stream.readline()).strip(b"\r\n") or not end.endswith(b"\n"):
            raise EOFError(f"no line end behind a record of {size} bytes")
        yield headers, body


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = body.partition(b"\r\n\r\n")
    pairs = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in pairs}, payload


def _row(headers: dict[str, str], body: bytes, with_payload: bool) -> dict:
    kind = headers.get("warc-type", "")
    row = {
        "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
        "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "page_id": None, "payload_bytes": None, "payload_digest": None, "payload": None,
    }
    if kind in ("response", "revisit"):
        http, payload = http_parts(body)
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload), "payload": payload.decode("utf-8", "replace") if with_payload else None}
        else:
            row |= {"payload_bytes": int(http.get("content-length", 0)), "payload_digest": headers.get("warc-payload-digest", "").rpartition(":")[2]}
    elif kind == "metadata":
        for line in body.decode("utf-8", "replace").splitlines():
            name, _, value = line.partition(":")
            if name.strip().lower() == "page-id":
                row["page_id"] = int(value)
    return row


def _read_archive(path: str, records: int | None, with_payload: bool) -> Iterator[dict]:
    store, place = open_uri(path)
    found, rows, size = 0, [], 0
    try:
        with store.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for headers, body in parse_stream(stream):
                found += 1
                rows.append(_row(headers, body, with_payload))
                size += len(body) * with_payload
                if len(rows) >= ROWS or size >= 16 << 20:
                    yield {k: [r[k] for r in rows] for k in rows[0]}
                    rows, size = [], 0
    except (EOFError, ValueError, OSError, zlib.error) as e:
        raise RuntimeError(f"{path}: {e}") from e
    if records is not None and found != records:
        raise RuntimeError(f"{path}: {found} records, {records} were written")
    if rows:
        yield {k: [r[k] for r in rows] for k in rows[0]}


def read_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives named in column ``path``; an archive is one stream, never held as a whole.

    Where there is a column ``records``, each archive must have that many.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                yield from _read_archive(path, records, with_payload)

    records = F.max("records") if "records" in archives.columns else F.lit(None)
    listed = archives.groupBy("path").agg(records.cast("long").alias("records"))
    # a number of tasks is named, as adaptive execution would put a few short paths into one
    tasks = max(1, min(MOST_TASKS, archives.count()))
    return map_task(listed.repartition(tasks), read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, page_id, url, request, response, metadata, refers_to``.

    Records whose concurrent-to names no response or revisit belong to no capture.
    """
    linked = records.where("type IN ('request', 'metadata')").withColumn("capture_id", F.explode(F.split("concurrent_to", " ")))
    requests = linked.where("type = 'request'").groupBy("capture_id").agg(F.min(F.struct("record_id", "url", "date")).alias("request"))
    metadata = linked.where("type = 'metadata'").groupBy("capture_id").agg(F.min(F.struct("record_id", "page_id")).alias("metadata"))
    answers = records.where("type IN ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), "url", "refers_to", F.struct("type", "date", "payload_bytes", "payload_digest", "payload").alias("response")
    )
    captures = answers.join(requests, "capture_id", "left").join(metadata, "capture_id", "left")
    named = linked.where("type = 'metadata'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("refers_to_page"))
    return captures.join(named.groupBy("refers_to").agg(F.min("refers_to_page").alias("refers_to_page")), "refers_to", "left").select(
        "capture_id", F.col("metadata.page_id").alias("page_id"), "url", "request", "response", "metadata", "refers_to", "refers_to_page"
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write all pages as archives in the shared folder and assemble the captures that are read back."""
    archives = write_archives(pages, scratch_path(spark, "warc"), least_bytes=least_bytes)
    return assemble(cut_lineage(read_records(archives, with_payload)))
