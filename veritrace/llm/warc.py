"""WARC archives: a writer that stores equal payloads once, and a splittable reader."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import map_arrow, salted_join, slices, spread_keys
from veritrace.llm.registry import query
from veritrace.session import materialize, new_folder

#: Payloads shorter than this are stored again each time.
LEAST_SHARED = 100
#: Start of a gzip member with the deflate method.
MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
#: Type given to records that begin well and cannot be read.
DAMAGED = "damaged"
CHUNK = 1 << 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
     f as (select *, strlen(h) >= 100 and page_id > min(page_id) over (partition by h) as again, min(page_id) over (partition by h) as first from p)
select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from f
"""


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}|{digest}'.encode()).digest()[:16])}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One gzip member: the response with its payload, or with ``first`` a revisit that refers to that page."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    block = HTTP_HEAD % len(payload)
    if first is None:
        block += payload
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {first}",
        ]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page (``page_id``, ``url``, ``html``) and return the table of files: path, records, bytes.

    A task writes one file below ``folder``, named by task and attempt; only the files of attempts that succeeded are in
    the table. Of pages with equal payloads of at least ``LEAST_SHARED`` bytes, that with the smallest id is a response
    and those with larger ids are revisits; repeated rows of the smallest id and rows without an id are responses. A null
    html is an empty payload, a null url leaves its header out. An empty table gives no records.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    keys = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = materialize(keys, "shared-payloads")
    total = pages.select("page_id").count()
    joined = salted_join(rows, keys.select("digest", "first"), "digest", "page_id", spread_keys(keys, "digest", "n", total))
    revisit = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    source = joined.select("page_id", "url", "payload", F.lower(F.hex("digest")).alias("digest"), revisit.alias("first"))

    def write(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        records = written = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in slices(batches, 64):
                for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    data = record(*values, date)
                    out.write(data)
                    records, written = records + 1, written + len(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([written], pa.int64())],
            names=["path", "records", "bytes"])

    return materialize(map_arrow(source, write, "path string, records long, bytes long").where("records > 0"), "warc-files")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a decoded member; None unless it is one whole WARC record."""
    if not data.startswith(b"WARC/1."):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, colon, value in lines if colon}
    if not found or not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        return None
    length = int(headers["content-length"])
    return (headers, rest[:length]) if rest[length:] == b"\r\n\r\n" else None


def whole_number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isdecimal() and len(text) < 19 else None


def values(path: str, position: int, headers: dict[str, str], block: bytes) -> tuple:
    """A row of ``read_warc``. A digest is the one of the payload, or for revisits the one their header states."""
    kind, http = headers["warc-type"], headers.get("content-type", "").startswith("application/http")
    payload = size = digest = None
    if kind == "revisit":
        stated = headers.get("warc-payload-digest", "")
        size, digest = whole_number(headers.get("x-payload-length")), stated.removeprefix("sha256:") or None
    elif kind != DAMAGED:
        payload = block.partition(b"\r\n\r\n")[2] if http and kind == "response" else block
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (
        path, position, kind, whole_number(headers.get("x-page-id")), headers.get("warc-target-uri"), payload, size, digest,
        whole_number(headers.get("x-refers-to-page-id")), headers.get("warc-record-id"), headers.get("warc-refers-to"))


def member(file, blob: bytes, start: int, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose member begins at ``blob[at]``, with the member's length; None for bytes that only look like one.

    What decodes to the start of a record and then breaks off, fails its checksum or states a wrong length is a damaged
    record of length 1, so that the search goes on behind its first byte.
    """
    inflate, parts, position = zlib.decompressobj(31), [], at
    damaged = ({"warc-type": DAMAGED}, b"", 1)
    try:
        while not inflate.eof:
            chunk = blob[position:position + CHUNK] if position < len(blob) else file.read_at(CHUNK, start + position)
            if not chunk:
                return damaged if b"".join(parts).startswith(b"WARC/1.") else None
            parts.append(inflate.decompress(chunk))
            position += len(chunk)
            if len(parts) == 1 and len(parts[0]) >= 7 and not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return damaged if b"".join(parts).startswith(b"WARC/1.") or begins_record(blob[at:at + CHUNK]) else None
    data = b"".join(parts)
    parsed = parse(data)
    if parsed is None:
        return damaged if data.startswith(b"WARC/1.") else None
    return (*parsed, position - len(inflate.unused_data) - at)


def begins_record(data: bytes) -> bool:
    """Whether the bytes up to where decoding fails begin like a record."""
    inflate, found = zlib.decompressobj(31), b""
    try:
        for at in range(len(data)):
            found += inflate.decompress(data[at:at + 1])
            if len(found) >= 7:
                break
    except zlib.error:
        pass
    return found.startswith(b"WARC/1.")


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records whose members begin in ``[start, end)``; the last is read on beyond the end."""
    blob = file.read_at(min(end + len(MAGIC) - 1, size) - start, start)
    at = blob.find(MAGIC)
    while at >= 0:
        found = member(file, blob, start, at)
        if found:
            headers, block, length = found
            yield start + at, headers, block
        at = blob.find(MAGIC, at + (found[2] if found else 1))


def read_warc(files: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in ``files`` (``path``, ``bytes``), one row each, of any type and writer.

    Files are cut into byte ranges of ``split_bytes`` that tasks read on their own: a task looks for the magic number of
    a gzip member, decodes what follows to see whether a record begins there, and owns the records that begin in its
    range. Columns: path, position, record_type, page_id, url, payload, payload_bytes, payload_digest, refers_to,
    record_id, refers_to_id.

    The payload of an HTTP response is what follows its HTTP head, that of other records their block. Revisits have no
    payload, and size, digest and target as far as their headers state them (a digest that is not SHA-256 keeps its
    label). A record that cannot be read to its end is listed as ``damaged`` with its position alone. Headers that are
    not UTF-8 keep what can be read; missing ones are null. No files give no rows.
    """
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    fields = {
        "path": pa.string(), "position": pa.int64(), "record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(),
        "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
        "record_id": pa.string(), "refers_to_id": pa.string()}
    names, types = list(fields), list(fields.values())

    def read(batches):
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, place = open_folder(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(place) as file:
                    for position, headers, block in records(file, size, start, min(start + split_bytes, size)):
                        rows.append(values(path, position, headers, block))
                        held += len(block)
                        if held > split_bytes:
                            yield _rows(rows, names, types)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, names, types)

    def _rows(rows, names, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    dealt = splits.repartition(int(min(total, 100_000)), "path", "start")
    return map_arrow(dealt, read, (
        "path string, position long, record_type string, page_id long, url string, payload binary, payload_bytes long, "
        "payload_digest string, refers_to long, record_id string, refers_to_id string"))


@query("op2_warc_round_trip", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(write_warc(pages, new_folder(spark, "warc"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
