"""WARC archives as a chunked record table.

Payloads travel as rows of (record, chunk number, bytes), so neither the writer nor the reader
holds a whole record: the writer compresses chunk after chunk into its archive, and the reader
yields a chunk at a time with the digest of the payload so far.

Each task writes archives of its own, under names that no other attempt uses, and reports them in
a manifest that Spark commits. Readers open what the manifest lists, so a lost or repeated attempt
leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftwright.llm.common import fresh_path, parallelism, stored, table

#: Bytes of a chunk, of what is read at once, and of an archive before the next one begins.
CHUNK, READ, ARCHIVE = 1 << 16, 1 << 16, 1 << 30
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are written out each time.
LEAST_BYTES = 0
LEVEL = 6
_MOST_HEADER = 1 << 20

RECORDS = "record_id string, page_id string, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string"


def filesystem(path: str):
    """The file system and path of a URI, as pyarrow opens it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What to write for each page: page_id, url, payload, payload_bytes, sha1, refers_to.

    Of equal payloads the one with the smallest page_id is written; the others refer to it. Rows
    that repeat the smallest id are all written, and so are rows of a payload that no id has: there
    is nothing to refer to. Only ids and digests are shuffled to find them; payloads move once, by
    page_id and digest, which is even.
    """
    base = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    light = base.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "sha1")
    first = light.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1 AND first_id IS NOT NULL")
    again = light.join(first, "sha1").filter("NOT page_id <=> first_id").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first_id").distinct()
    joined = base.join(again, base["page_id"].eqNullSafe(again["_page"]) & (base["sha1"] == again["_sha1"]), "left")
    return joined.select("page_id", "url", "payload", "payload_bytes", "sha1", F.col("first_id").alias("refers_to"))


def chunked(plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of (page, chunk number, bytes); a page without payload to write has one empty chunk."""
    size: Column = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / chunk).cast("int") - 1))
    rows = plan.select("*", size.alias("size"), F.explode(numbers).alias("chunk_no"))
    return rows.select(
        "page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no",
        ((F.col("chunk_no") + 1) * chunk >= F.col("size")).alias("last"),
        F.when(F.col("size") > 0, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("chunk"),
    )


def _line(value) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def _record_uri(page_id: str | None) -> str:
    """Names a record; that of a row without page_id by a name of its own."""
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def _page_of(uri: str | None) -> str | None:
    known = uri is not None and uri.startswith("<urn:page:")
    return unquote(uri.removeprefix("<urn:page:").removesuffix(">")) if known else None


def header_of(page_id: str | None, url: str | None, payload_bytes: int, sha1: str, refers_to: str | None) -> bytes:
    revisit, uri = refers_to is not None, _record_uri(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {uri}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url) if url is not None else uri[1:-1]}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}", f"X-Payload-Length: {payload_bytes}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_record_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {0 if revisit else payload_bytes}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` and returns the manifest, a stored
    table of (path, records, bytes).

    A null html is an empty payload, a null url becomes the record's own name. Ids are written as
    text, whatever their type. A row without page_id has a record under a name of its own, which is
    read back with a null page_id. Rows that repeat an id are records that share a name. An empty
    table gives an empty manifest. Each record is a gzip member of its own; the digest of what was
    written is carried from chunk to chunk and must be that of its header.
    """
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    rows = chunked(planned(pages, least_bytes)).withColumns(ids).select("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", "last", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, done, gz, digest = None, [], None, None
        for batch in batches:
            for at in range(batch.num_rows):
                *head, chunk_no, last, chunk = (batch.column(i)[at].as_py() for i in range(8))
                if out is None or (chunk_no == 0 and done[-1][2] > ARCHIVE):
                    if out is not None:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                data = b""
                if chunk_no == 0:
                    gz, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    data = gz.compress(header_of(*head))
                digest.update(chunk)
                data += gz.compress(chunk)
                if last:
                    if head[4] is None and digest.hexdigest() != head[3]:
                        raise Corrupt(f"page {head[0]}: its chunks have another digest")
                    data += gz.compress(b"\r\n\r\n") + gz.flush()
                    done[-1][1] += 1
                out.write(data)
                done[-1][2] += len(data)
        if out is not None:
            out.close()
        paths, records, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


class Corrupt(ValueError):
    """A record whose length or digest is not what its header says."""


def parse(read, chunk: int = CHUNK) -> Iterator[tuple[dict, int, bytes, str, bool]]:
    """Streams an archive: (header, chunk number, bytes, digest so far, last) of each chunk.

    ``read(n)`` returns the next bytes, empty at the end. Memory is a few chunks, whatever the
    size of a record.
    """
    buffer, packed, gz, ended = bytearray(), b"", zlib.decompressobj(31), False

    def fill(n: int) -> bool:
        """Holds n decompressed bytes, if there are as many left."""
        nonlocal packed, gz, ended
        while len(buffer) < n and not ended:
            if gz.eof:
                packed, gz = gz.unused_data, zlib.decompressobj(31)
            packed = packed or read(READ)
            out = gz.decompress(packed, chunk)
            buffer.extend(out)
            ended = not packed and not out
            packed = gz.unconsumed_tail
        return len(buffer) >= n

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < _MOST_HEADER and fill(len(buffer) + 1):
            pass
        if not buffer:
            return
        if end < 0:
            raise Corrupt("a record's header does not end")
        lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        del buffer[: end + 4]
        header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        left, digest, number = int(header["content-length"]), hashlib.sha1(), 0
        while True:
            n = min(left, chunk)
            if not fill(n):
                raise Corrupt(f"{header['warc-record-id']} ends early")
            part = bytes(buffer[:n])
            del buffer[:n]
            left -= n
            digest.update(part)
            so_far = base64.b32encode(digest.digest()).decode()
            if not left and header["warc-type"] == "response" and header["warc-payload-digest"] != f"sha1:{so_far}":
                raise Corrupt(f"{header['warc-record-id']} has another digest")
            yield header, number, part, so_far, not left
            number += 1
            if not left:
                break
        if not fill(4) or buffer[:4] != b"\r\n\r\n":
            raise Corrupt(f"{header['warc-record-id']} does not end")
        del buffer[:4]


def read_chunks(manifest: DataFrame, payload: bool = True, kind: str = "bigint") -> DataFrame:
    """The chunked record table of the archives that ``manifest`` lists.

    A row per chunk: record_id, page_id, record_type, refers_to, uri, payload_bytes and
    payload_digest as the header has them, chunk_no, chunk_bytes, digest (of the payload up to and
    with this chunk), last, and the chunk itself unless ``payload`` is false. A revisit has one
    empty chunk. A damaged archive raises ``Corrupt``.
    """
    schema = RECORDS + ", chunk_no int, chunk_bytes long, digest string, last boolean" + ", chunk binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]
    text, number = pa.string(), pa.int64()
    types = [text, text, text, text, text, number, text, pa.int32(), number, text, pa.bool_(), *[pa.binary()] * payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = filesystem(path)
                rows, size = [], 0
                with system.open_input_stream(inner, compression=None) as f:
                    for header, number, part, so_far, last in parse(f.read):
                        rows.append((
                            header["warc-record-id"], _page_of(header["warc-record-id"]), header["warc-type"], _page_of(header.get("warc-refers-to")), header["warc-target-uri"],
                            int(header["x-payload-length"]), header["warc-payload-digest"].removeprefix("sha1:"), number, len(part), so_far, last, *[part] * payload,
                        ))
                        size += len(part) * payload + 300
                        if size > 1 << 23:
                            yield made(rows)
                            rows, size = [], 0
                yield made(rows)

    spread = manifest.select("path").repartition(parallelism(manifest.sparkSession), "path")  # a number, or the few names would gather in one task
    return spread.mapInArrow(run, schema).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def payloads(chunks: DataFrame) -> DataFrame:
    """Whole payloads again, for records that fit in memory: record_id, page_id, payload."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_no", F.hex("chunk").alias("part"))))
    whole = chunks.groupBy("record_id", "page_id").agg(parts.alias("parts"))
    return whole.select("record_id", "page_id", F.unhex(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("payload"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page, reads the archives back, and reports each record."""
    pages = table(spark, sf_dir, "pages")
    manifest = write(pages, fresh_path(spark, "warc"))
    read = read_chunks(manifest, payload=False, kind=dict(pages.dtypes)["page_id"]).filter("last")
    whole = F.col("record_type") == "response"
    return read.select(
        "page_id",
        F.when(whole, F.col("chunk_no").cast("long") * CHUNK + F.col("chunk_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT x, min(page_id) AS first_id FROM h WHERE payload_bytes >= {LEAST_BYTES} GROUP BY x)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g:
    list_aggregate(list_transform(range(0, 4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM h LEFT JOIN f USING (x)"""
