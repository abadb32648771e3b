"""WARC archives: a deterministic sharded writer and a reader.

Records and the revisit decisions are range-sorted together by page id, so the payloads are shuffled once. Each task
writes its range as gzip members, one a record, and rolls to the next file when the compressed size reaches
`roll_bytes`. Headers (ids, digests, lengths) are made anew from the payload alone, so a task that runs again writes the
same bytes; files are committed under temporary names, and a manifest row for each follows.

Of records with equal payloads of `least_payload` bytes or more, the one with the largest page id is the response and
the others are revisits of it; smaller ones are all responses. Digests are counted with partial aggregation, and only
digests that occur twice or more are joined back, as narrow rows, so a payload that a third of all pages share costs no
more than the others.

Cases: null html is an empty payload; very long payloads are written whole, as a file of their own if need be; a null url gives no target header; a null page id sorts first, gets no id header,
and revisits a record with an id where there is one; repeated rows that share the largest page id are all responses; an
empty table gives no file; columns other than the three named are not read; CR and LF in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shards import commit, open_file
from tabulon.session import scratch, shuffle_partitions, small_batches, written

MANIFEST = "shard int, file int, path string, n_records long, n_bytes long"
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha1(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit if refers_to is given."""
    digest = _base32(payload)
    block = _HTTP.format(len(payload)).encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_base32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], out: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Rows by page id, the decisions of an id (kind 0: digest, refers_to) before its pages (kind 1: url, html)."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()

    def members() -> Iterator[bytes]:
        at, refers = None, {}
        for b in batches:
            for page_id, kind, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page_id != at:
                    at, refers = page_id, {}
                if kind == 0:
                    refers[digest] = refers_to
                    continue
                payload = (html or "").encode()
                yield _member(record(page_id, url, payload, refers.get(hashlib.sha1(payload).hexdigest()) if refers else None))

    left = members()
    held = next(left, None)
    number = 0
    while held is not None:
        path, n, size = f"{out}/shard-{shard:05d}-{number:05d}.warc.gz", 0, 0

        def write(stream) -> None:
            nonlocal held, n, size
            while held is not None and (not size or size + len(held) <= roll):
                stream.write(held)
                n, size, held = n + 1, size + len(held), next(left, None)

        commit(path, write)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["shard", "file", "path", "n_records", "n_bytes"])
        number += 1


def revisits(pages: DataFrame, page_id: str, html: str, least_payload: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page answers for."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_payload)
    shared = written(narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1 and refers_to is not null").drop("k"), "warc-digests")
    return narrow.join(shared, "digest").where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to")


def write_warc(pages: DataFrame, out: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_payload: int = 0, roll_bytes: int = 256 << 20, shards: int | None = None) -> DataFrame:
    """Writes the archives and returns their manifest (shard, file, path, n_records, n_bytes)."""
    small_batches(pages.sparkSession)
    n = shards or shuffle_partitions(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.lit(1).alias("kind"), F.col(url).alias("url"), F.col(html).alias("html"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(pages, page_id, html, least_payload).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    ranged = rows.unionByName(marks).repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "kind", "url", "html")
    return written(ranged.mapInArrow(partial(_write, out=out, roll=roll_bytes), MANIFEST), "warc-manifest")


def records(path: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, a member at a time."""
    with open_file(path) as f:
        data, z, raw = f.read(chunk), zlib.decompressobj(31), []
        while data:
            raw.append(z.decompress(data))
            data = z.unused_data if z.eof else f.read(chunk)
            if z.eof:
                head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                yield fields, rest[: int(fields["Content-Length"])]
                z, raw = zlib.decompressobj(31), []
                data = data or f.read(chunk)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
    number = lambda x: None if x is None else int(x)
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            for head, block in records(path):
                if head["WARC-Block-Digest"] != f"sha1:{_base32(block)}":
                    raise ValueError(f"{path}: the block of {head['WARC-Record-ID']} doesn't match its digest")
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                if head["WARC-Type"] == "response" and (len(payload) != size or head["WARC-Payload-Digest"] != f"sha1:{_base32(payload)}"):
                    raise ValueError(f"{path}: the payload of {head['WARC-Record-ID']} doesn't match its headers")
                rows.append((number(head.get("X-Page-ID")), size, head["WARC-Payload-Digest"][5:], head["WARC-Type"], number(head.get("X-Refers-To-Page-ID")), head.get("WARC-Target-URI")))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_warc(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives, with digests and lengths checked."""
    n = shuffle_partitions(spark)
    return manifest.select("path").repartition(n, "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_warc(spark, write_warc(pages, scratch(spark, "warc")))
