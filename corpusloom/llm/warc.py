"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: a task writes its rows into archives of about ARCHIVE bytes, and each record is a gzip member of its
own. Which record is the response and which revisit it is found from payload digests and page ids; the largest
page_id of a digest is a partial aggregate, so a payload that a third of all pages share is no hot group. Payloads
meet the table of revisits by broadcast while that is below Spark's threshold; beyond it they are shuffled once,
by page and digest, which no group of copies makes hot.

Reading: archives are cut into byte ranges, dealt out by a number of tasks that grows with the ranges, and a task
scans its range for the gzip magic. A candidate is valid if it decompresses, its first bytes are a WARC version, and
it names the archive it stands in (WARC-Warcinfo-ID), so that an archive stored as a payload is no record of the
one that holds it. The records that start inside a range are the task's, and it reads past the range's end to finish
the last. No task depends on another or on an index.

Archives are files in the folder that driver and executors share; ``pyarrow.fs`` reaches it on a local or
shared mount, HDFS or an object store. They are written under a temporary name and moved, so that a task that
is run again leaves one whole file.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, new_path, read

MIN_PAYLOAD = 1000
#: Bytes: payload an archive, range a task scans, and what a read fetches at once.
ARCHIVE, RANGE, CHUNK = 32 << 20, 4 << 20, 1 << 18
#: Ranges that a reading task takes, where there are more than tasks at once.
RANGES_PER_TASK = 4
LEVEL, MAGIC, VERSION = 6, b"\x1f\x8b\x08", b"WARC/1."
#: Types of record that are read where no others are asked for.
PAGES = ("response", "revisit")
EPOCH = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, archive_id: str = "") -> bytes:
    """A response, or a revisit of ``refers_to`` without the payload. HTTP's Content-Length is the full payload's either way."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    url = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    head += [f"WARC-Date: {EPOCH}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Warcinfo-ID: <urn:uuid:{archive_id}>"] if archive_id else []
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    if refers_to is not None:
        head += [f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def warcinfo(archive_id: str, filename: str) -> bytes:
    """The record that an archive begins with; the others name it."""
    block = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{archive_id}>", f"WARC-Date: {EPOCH}", f"WARC-Filename: {filename}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-cased name, the first of each; lines that go on in the next are joined. What is no field is passed over."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()[1:]:
        key, colon, value = line.partition(":")
        if colon:
            out.setdefault(key.strip().lower(), value.strip())
    return out


def number(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,18}", value) else None


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers and block, and what follows it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(head)
    length = number(fields.get("content-length"))
    length = len(rest) if length is None or length < 0 else length
    return fields, rest[:length], rest[length:].lstrip(b"\r\n")


def read_record(fields: dict[str, str], block: bytes) -> dict:
    """A row of any record. What it doesn't say is null.

    The payload of a response or request over HTTP is what follows the HTTP headers; of other records it is the block, but
    a revisit has none: its length and digest are those that it names.
    """
    kind, http = fields.get("warc-type", "").lower() or None, {}
    payload: bytes | None = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = headers(head)
    length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        payload, length, digest = None, number(http.get("content-length")), fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    return {
        "page_id": number(fields.get("x-page-id")), "url": fields["warc-target-uri"].strip("<>") if "warc-target-uri" in fields else None, "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("x-refers-to-page-id")), "payload": payload,
    }


def with_types(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``; ``refers_to`` is null for responses.

    Of payloads of ``min_payload`` bytes or more that are equal, the largest page_id has the response.
    """
    html = F.coalesce("html", F.lit(""))
    digest = F.sha1(html.cast("binary"))
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("digest"))
    meta = pages.select("page_id", digest.alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= min_payload).select("page_id", "digest")
    copies = meta.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first")
    revisits = meta.join(materialize(copies, "warc_copies"), "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = materialize(revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct(), "warc_revisits")
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, path: str, archive: int = ARCHIVE, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes ``pages`` (``page_id``, ``url``, ``html``) to ``path`` and returns the manifest ``(path, archive_id, bytes, records)``.

    One archive a task; tasks are the input's own splits but for large ones, so that payloads aren't shuffled
    for the archives' sake. An archive's id follows from this call and the archive's name, so a task that is run again
    writes the same bytes.
    """

    manifest = pa.schema([("path", pa.string()), ("archive_id", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
    run_id = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(path)
        where.create_dir(base, recursive=True)
        context, k, done = TaskContext.get(), 0, []
        out, size, records, name, temp, archive_id = None, 0, 0, "", "", ""

        def close() -> None:
            nonlocal out
            out.close()
            where.move(temp, name)
            done.append((name, archive_id, size, records))
            out = None

        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, size, records = f"{base}/part-{context.partitionId():06d}-{k:04d}.warc.gz", 0, 0
                    temp, k, archive_id = f"{base}/.{uuid.uuid4().hex}", k + 1, str(uuid.uuid5(run_id, name.rpartition("/")[2]))
                    out = where.open_output_stream(temp, compression=None)
                    first = member(warcinfo(archive_id, name.rpartition("/")[2]))
                    out.write(first)
                    size = len(first)
                data = member(record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"), row["digest"], row["refers_to"], archive_id))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(manifest.names, x, strict=True)) for x in done], schema=manifest)

    scheme = urlparse(path)
    rows = with_types(pages, min_payload)
    made = materialize(rows.mapInArrow(run, "path string, archive_id string, bytes long, records long"), "warc_manifest")
    prefix = f"{scheme.scheme}://{scheme.netloc}" if scheme.scheme else ""
    return made.withColumn("path", F.concat(F.lit(prefix), "path"))


def scan_range(file, size: int, start: int, end: int, archive_id: str = "") -> Iterator[bytes]:
    """The records whose members start in ``start:end`` of an open archive. False magic inside a member fails to decode.

    With ``archive_id``, only its own warcinfo record and those that name it count.
    """
    marks = [f"\r\nWARC-{name}-ID: <urn:uuid:{archive_id}>\r\n".encode() for name in ("Warcinfo", "Record")] if archive_id else []
    window, base = b"", start

    def more(upto: int) -> None:
        nonlocal window
        want = min(size, upto) - base - len(window)
        if want > 0:
            file.seek(base + len(window))
            window += file.read(max(want, min(CHUNK, size - base - len(window))))

    at = start
    while at < end:
        more(min(size, at + CHUNK))
        found = window.find(MAGIC, at - base)
        if found < 0:
            at = max(at + 1, base + len(window) - len(MAGIC) + 1)
        else:
            at = base + found
            if at >= end:
                return
            data, after = decode(lambda i, n: (more(i + n), window[i - base : i - base + n])[1], at, size)
            if data is None or marks and not any(m in data.partition(b"\r\n\r\n")[0] + b"\r\n" for m in marks):
                at += 1
            else:
                yield data
                at = after
        if at >= size - len(MAGIC):
            return
        window, base = window[at - base :], at


def decode(get, at: int, size: int) -> tuple[bytes | None, int]:
    """The member at ``at`` if it is a whole record, and where the next one starts. Its first bytes are looked at before the rest is read."""
    unpacker, parts, n = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            raw = get(n, CHUNK >> 2)
            if not raw:
                return None, at
            got = unpacker.decompress(raw)
            if not parts and got and not got.startswith(VERSION[: len(got)]):
                return None, at
            if got:
                parts.append(got)
            n += len(raw)
    except zlib.error:
        return None, at
    data = b"".join(parts)
    return (data, n - len(unpacker.unused_data)) if data.startswith(VERSION) else (None, at)


def read_archives(manifest: DataFrame, span: int = RANGE, types: tuple[str, ...] | None = PAGES) -> DataFrame:
    """One row a record of the archives in ``manifest`` (``path``, ``bytes``, ``archive_id`` if known), by byte ranges of ``span``.

    Archives may be anyone's: records of other ``types`` are passed over (None: of none), whatever a record lacks is null, and bytes that
    are no gzip member are passed over.
    """
    archive_id = F.coalesce("archive_id", F.lit("")) if "archive_id" in manifest.columns else F.lit("")
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))
    ranges = manifest.where("bytes > 0").select("path", archive_id.alias("archive_id"), F.col("bytes").alias("size"), F.explode(starts).alias("start"))
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    n = ranges.count()  # a number of tasks that is asked for isn't taken for too many by the size of the ranges' rows
    tasks = max(1, min(n, cores), -(-n // RANGES_PER_TASK))

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def rows_of(members: Iterator[bytes]) -> Iterator[dict]:
        for data in members:
            while data.startswith(VERSION):  # a member may hold several records
                fields, block, data = parse(data)
                row = read_record(fields, block)
                if types is None or row["record_type"] in types:
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                where, name = filesystem(r["path"])
                with where.open_input_file(name) as file:
                    found = rows_of(scan_range(file, r["size"], r["start"], min(r["size"], r["start"] + span), r["archive_id"]))
                    while rows := list(itertools.islice(found, 256)):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.repartition(tasks).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, path: str | None = None) -> DataFrame:
    """``pages`` written as archives and read back: one row a record, with the payload (null for revisits).

    Null html is an empty payload; null url is an empty one. Rows that share the largest page_id of a payload are all
    responses. A null page_id is read back as null, and is a response unless equal payloads have an id. Equal
    payloads of less than MIN_PAYLOAD bytes are all responses. Other columns are left out. Empty table: no archives.
    """
    return read_archives(write_archives(pages.select("page_id", "url", "html"), path or new_path(pages.sparkSession, "warc")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""
