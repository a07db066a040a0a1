"""WARC archives written from and read into a table of record chunks.

A payload goes through as rows of record and chunk number, never as one object in a Python
process: the writer compresses chunk by chunk, the reader yields chunk by chunk, and both carry
the digest of the payload so far.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relvalue.llm.arrow import column
from relvalue.llm.files import create, open_stream
from relvalue.llm.scratch import Scratch

CHUNK_BYTES = 1 << 20
ROLL_BYTES = 256 << 20  # a new file from here on
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk long, is_last boolean, payload_bytes long, payload_digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, sha1, refers_to for each page (page_id, url, html).

    A payload of at least ``least_bytes`` that a page with a smaller page_id has as well refers
    to the smallest such page_id; ``refers_to`` is null otherwise. A null html counts as empty;
    null page_ids never are the smallest, repeated rows of the smallest id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    shared = (found.where(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null"))
    return found.join(shared.select("sha1", "n_bytes", "first"), ["sha1", "n_bytes"], "left").select(
        "page_id", "url", "payload", "n_bytes", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _address(url: str | None) -> str:
    """A URL that keeps to its header line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:x-none")


def _head(page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_address(url)}", f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else n_bytes)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(found: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``records`` into ``.warc.gz`` files in ``folder``, one member a record; a row (uri, n_records) for each file."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes)).cast("int")
    numbered = found.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.when(F.col("refers_to").isNull(), chunks).otherwise(1) - 1)))
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = numbered.select("page_id", "url", "n_bytes", "sha1", "refers_to", "chunk", part.alias("bytes"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, written, n_records, member, digest, done = None, None, 0, 0, None, None, []

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        for batch in batches:
            for page_id, url, n_bytes, sha1, refers_to, chunk, data in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    if out is None or written >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                            done.append((uri, n_records))
                        uri, out = create(folder, ".warc.gz")
                        written, n_records = 0, 0
                    member, digest, left = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), n_bytes
                    written += put(member.compress(_head(page_id, url, n_bytes, sha1, refers_to)))
                if refers_to is None:
                    digest.update(data)
                    left -= len(data)
                    written += put(member.compress(data))
                if refers_to is not None or left == 0:
                    if refers_to is None and digest.hexdigest() != sha1:
                        raise ValueError(f"chunks of page {page_id} don't add up to its payload")
                    written += put(member.compress(b"\r\n\r\n") + member.flush())
                    n_records += 1
        if out is not None:
            out.close()
            done.append((uri, n_records))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "n_records"])

    return rows.mapInArrow(write, "uri string, n_records long")


def read_archive(uri: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunks of an archive's records: page_id, url, type, refers_to, chunk number, last or not, bytes so far, digest so far, bytes.

    A revisit has one chunk without bytes; its length and digest are those its heads state.
    """
    page = lambda x: int(x[len("<urn:x-page:") : -1]) if len(x) > len("<urn:x-page:>") else None
    with open_stream(uri) as raw, gzip.GzipFile(fileobj=raw) as stream:

        def head() -> dict[str, str]:
            lines = iter(lambda: stream.readline().rstrip(b"\r\n"), b"")
            return {k.lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}

        while first := stream.readline():
            if first.rstrip() != b"WARC/1.1":
                raise ValueError(f"no record starts here: {first[:40]!r}")
            record, http = head(), None
            stream.readline()
            http = head()
            size = int(http["content-length"])
            stated = record["warc-payload-digest"].removeprefix("sha1:")
            known = (page(record["warc-record-id"]), record["warc-target-uri"], record["warc-type"])
            if record["warc-type"] == "revisit":
                yield *known, page(record["warc-refers-to"]), 0, True, size, stated, b""
            else:
                digest, got, n = hashlib.sha1(), 0, 0
                while True:
                    data = stream.read(min(chunk_bytes, size - got))
                    if not data and got < size:
                        raise ValueError(f"{uri} ends inside a record")
                    digest.update(data)
                    got += len(data)
                    yield *known, None, n, got == size, got, base32(digest.copy().digest()), data
                    n += 1
                    if got == size:
                        break
                if base32(digest.digest()) != stated:
                    raise ValueError(f"payload of {known[0]} doesn't match its digest")
            stream.read(4)


def read_archives(files: DataFrame, payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of each record in ``files`` (uri): ``CHUNKS`` and, unless left out, the chunk's bytes.

    payload_bytes and payload_digest are those of the record up to and with the chunk, so the
    row with ``is_last`` has those of the whole payload.
    """
    names = ["page_id", "url", "record_type", "refers_to", "chunk", "is_last", "payload_bytes", "payload_digest"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in column(batch, "uri").to_pylist():
                rows, size = [], 0
                for row in read_archive(uri, chunk_bytes):
                    rows.append(row[: len(names)])
                    size += 200 + len(row[-1]) * payload
                    if size >= 4 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return files.select("uri").mapInArrow(run, CHUNKS + ", payload binary" * payload)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page into archives and read them back: a row for each record's last chunk."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.keep(write_archives(records(pages, least_bytes), f"{scratch.path}/archives"), "files")
    spread = files.repartition(max(1, files.count()), "uri")
    return read_archives(spread, payload=False).where("is_last")
