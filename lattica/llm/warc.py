"""WARC writing, and a normaliser for monolithic gzip archives.

Records are first written as whole-file gzip streams. The normaliser inflates each stream once, rewrites every record as
its own gzip member, and writes a sidecar index (one JSON line a record: id, type, offset, length), so a reader can seek
to any record. Payloads that occur more than once are stored once: the others are revisit records.

Defined results: null html counts as an empty payload, null url leaves the target out; among equal payloads the smallest
page_id is the response, and rows that repeat that id are responses too; rows of null page_id revisit a response that has
an id, else they are responses; an empty table gives no archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.files import open_file, write_file
from lattica.llm.shared import lookup, new_folder, written

#: Bytes of records, before compression, after which an archive is closed.
ARCHIVE_BYTES, LEVEL, DATE = 16 << 20, 5, "2024-01-01T00:00:00Z"
#: Tasks of a pass over the archives at most.
MOST_TASKS = 20_000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit carries the HTTP head only, with digest and length of the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def inflated(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, as they come; a cut stream raises EOFError."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(chunk):
        while data:
            begun = True
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise EOFError("gzip stream ends early")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of each record in a stream of inflated bytes; no more than one record is held."""
    held = bytearray()
    head, need = None, 0
    for part in parts:
        held += part
        at = 0
        while True:
            if head is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = parse_head(bytes(held[at:end]))
                need = end - at + 4 + int(head["content-length"]) + 4
            if len(held) - at < need:
                break
            yield head, bytes(held[at : at + need])
            at, head = at + need, None
        del held[:at]
    if held:
        raise EOFError("the last record ends early")


def normalise(source: str, target: str) -> tuple[int, int]:
    """Rewrites a gzip WARC with a member for each record, and its index beside it; (records, bytes)."""
    out, index = io.BytesIO(), []
    with open_file(source) as stream:
        for head, data in records(inflated(stream)):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(data) + z.flush()
            index.append({"id": head["warc-record-id"], "type": head["warc-type"], "offset": out.tell(), "length": len(member)})
            out.write(member)
    write_file(target, out.getvalue())
    write_file(f"{target}.idx", "".join(json.dumps(x) + "\n" for x in index).encode())
    return len(index), out.tell()


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, content) of the record that is the member at an offset."""
    file.seek(offset)
    data = zlib.decompress(file.read(length), 31)
    end = data.index(b"\r\n\r\n")
    head = parse_head(data[:end])
    return head, data[end + 4 : end + 4 + int(head["content-length"])]


def payload_of(content: bytes) -> tuple[int, bytes]:
    """(length of the full payload, stored payload) of an HTTP message."""
    end = content.index(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in content[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return length, content[end + 4 :]


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to: the response's page_id for rows whose payload another row holds."""
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_sha", F.sha1(F.encode("html", "UTF-8")))
    groups = hashed.groupBy("_sha").agg(F.count(F.lit(1)).alias("n_rows"), F.min("page_id").alias("first_id"))
    groups = written(groups.where("n_rows > 1"), "warc-groups")
    joined = lookup(hashed, ["_sha"], groups, pages.count())
    other = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "html", other.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes page_id, url, html, refers_to as monolithic gzip archives; returns their paths. Names are unique, so what a
    lost or doubled task leaves behind isn't listed and is never read."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, z, out, size = [], None, None, 0

        def close() -> None:
            path = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz"
            write_file(path, out.getvalue() + z.flush())
            paths.append(path)

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if z is None:
                    z, out, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), io.BytesIO(), 0
                data = record(page, url, html.encode(), refers)
                out.write(z.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    z = None
        if z is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return written(pages.mapInArrow(write, "path string"), "warc-whole")


def _dealt(archives: DataFrame) -> DataFrame:
    """A partition for about each archive: a path is few bytes, so by size Spark would put many archives into one task."""
    return archives.repartition(max(1, min(archives.count(), MOST_TASKS)), "path")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises each archive of a column path; returns path and n_records of the new ones."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                target = f"{folder}/members-{path.rpartition('/whole-')[2]}"
                rows.append((target, normalise(path, target)[0]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "n_records"])

    return written(_dealt(archives).mapInArrow(rewrite, "path string, n_records long"), "warc-members")


def read_archives(archives: DataFrame) -> DataFrame:
    """The rows of SCHEMA from normalised archives, by their indexes; a response's digest comes from its stored payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with open_file(f"{path}.idx") as f:
                    index = [json.loads(line) for line in f.read().splitlines()]
                with open_file(path) as f:
                    for entry in index:
                        head, content = read_member(f, entry["offset"], entry["length"])
                        length, payload = payload_of(content)
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        refers = head.get("warc-refers-to")
                        if refers is None and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{path}: the record at {entry['offset']} is damaged")
                        rows.append((_id(head["warc-record-id"]), length, digest, head["warc-type"], None if refers is None else _id(refers)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return _dealt(archives.select("path")).mapInArrow(read, SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, normalises these, and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(with_revisits(pages), folder), folder))
