"""Operator 4, WARC archives and the normaliser for monolithic gzip.

``write_archives`` writes records as WARC/1.1 into files that are one gzip
stream each, the form that cannot be read at an offset.  ``normalise`` inflates
each such stream once, front to back, rewrites every record as a gzip member of
its own and writes a sidecar index (one JSON line a record: offset, length, id,
type).  ``read_archives`` reads the members at their offsets and checks them.

Payload digests of at least ``MIN_REVISIT`` bytes that occur more than once are
stored once: the record with the smallest id is the response, the others are
revisits that refer to it.

Files carry the task attempt in their name and are listed by the rows the task
returns, so a repeated or lost task leaves nothing that a reader sees.  Archives
lie in the shared folder.  A file holds at least one record and about
``FILE_BYTES`` of records; one record must fit in a task's memory.

Defined cases: a null payload is empty; empty and short payloads are responses;
a null id is written as such and sorts after all others; rows with equal id and
payload are all responses if their id is the smallest; a null url is the empty
one, and bytes of a url that a header cannot hold are percent-encoded; an empty
table gives no files and no rows; other columns are not written, whatever their names.

Archives of other writers are normalised and read too: any record type, header
names in any case, ``Name:value`` without a blank, folded lines, blank lines
between records, several gzip members, ids that are no page (``page_id`` null,
``record_id`` has the id).  A payload is the entity body as stored for
``application/http`` blocks and the whole block otherwise.  A payload digest is
optional; one whose algorithm hashlib knows (hex or base32) must agree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmodes.llm.tables import keep, prepare
from fieldmodes.session import scratch_path

MIN_REVISIT = 100
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20  # payloads handed to Spark at a time
DATE = "1970-01-01T00:00:00Z"  # the tables carry no capture time
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_path(path: str):
    """(file system, path in it) of a URI or a local path."""
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(record: str | None) -> int | None:
    """The page of an id that ``record_id`` made; None for any other."""
    number = (record or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if record == f"<urn:x-page:{number}>" and number.lstrip("-").isdecimal() else None


def format_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    block = HTTP % len(payload)
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line belongs to the field before it
            fields[name] = f"{fields[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields, rest[: int(fields["content-length"])]


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    http = fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    return block.partition(b"\r\n\r\n")[2] if http else block


def digest_agrees(label: str, payload: bytes) -> bool:
    """Is ``algorithm:value`` (hex or base32) the payload's digest?  True where the algorithm is unknown."""
    algorithm, _, value = label.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in hashlib.algorithms_guaranteed or algorithm.startswith("shake"):
        return True
    digest = hashlib.new(algorithm, payload).digest()
    return value.strip().lower() in (digest.hex(), base64.b32encode(digest).decode().lower())


def stated_length(fields: dict[str, str], block: bytes) -> int | None:
    """Payload length of a record without payload: its own field, else that of the HTTP header."""
    if "x-payload-length" in fields:
        return int(fields["x-payload-length"])
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def records_of(stream) -> Iterator[bytes]:
    """The records of a WARC file that is any number of gzip members, inflated as it is read."""
    inflate, buffer, need = zlib.decompressobj(31), bytearray(), None
    while True:
        data = stream.read(CHUNK)
        while data:
            buffer += inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        while True:
            if need is None:
                while buffer.startswith(b"\r\n"):  # blank lines before a record
                    del buffer[:2]
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_record(bytes(buffer[: end + 4]))[0]["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
        if stream.tell() >= stream.size():
            if bytes(buffer).strip(b"\r\n"):
                raise ValueError("the archive ends inside a record")
            return


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row; returns (path, records), kept: the monolithic files."""
    spark = pages.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "warc-monolithic")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Only digests that occur twice: one row each, counted before the shuffle.
    twice = keep(rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
                 .agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "warc-repeats")
    rows = rows.join(twice, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = open_path(folder)
        fs.create_dir(base, recursive=True)
        made, out, size, n = 0, None, 0, 0

        def close():
            out[0].write(out[1].flush())
            out[0].close()
            return pa.RecordBatch.from_arrays([pa.array([out[2]]), pa.array([n], pa.int64())], names=["path", "records"])

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:03d}.warc.gz"
                    out, size, n, made = (fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), f"{folder}/{name}"), 0, 0, made + 1
                record = format_record(r["page"], r["url"], r["payload"], r["digest"], r["first"], r["revisit"])
                out[0].write(out[1].compress(record))
                size, n = size + len(record), n + 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return keep(rows.mapInArrow(write, "path string, records long"), "warc-files")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite monolithic files record by record; returns the index (path, offset, length, record, type), kept.

    Beside each new file lies its sidecar, ``<file>.idx``."""
    spark = files.sparkSession
    prepare(spark)
    folder = scratch_path(spark, "warc-members")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fs, base = open_path(folder)
        fs.create_dir(base, recursive=True)
        for path in (p for b in batches for p in b["path"].to_pylist()):
            name = path.rsplit("/", 1)[1].removesuffix(".warc.gz") + f"-{attempt}.warc.gz"
            index, at = [], 0
            source_fs, source = open_path(path)
            with source_fs.open_input_file(source) as stream, fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for record in records_of(stream):
                    member = gzip.compress(record, 6, mtime=0)
                    out.write(member)
                    fields, _ = parse_record(record)
                    index.append((at, len(member), fields["warc-record-id"], fields["warc-type"].lower()))
                    at += len(member)
            with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as side:
                for x in index:
                    side.write((json.dumps(dict(zip(("offset", "length", "record", "type"), x))) + "\n").encode())
            cols = list(zip(*index))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(index), pa.string()),
                                              *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                                             names=["path", "offset", "length", "record", "type"])

    spread = files.select("path").repartition(max(1, files.count()), "path")  # a stream cannot be split: one task a file
    return keep(spread.mapInArrow(rewrite, "path string, offset long, length long, record string, type string"), "warc-index")


COLUMNS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
           "refers_to": pa.int64(), "payload": pa.binary(), "record_id": pa.string(), "refers_to_id": pa.string()}


def read_archives(index: DataFrame) -> DataFrame:
    """Read the indexed records at their offsets: (page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload, record_id, refers_to_id).

    ``payload`` is null for revisits, whose length and SHA-256 are those the headers state (null if they state none);
    for other records both are recomputed, and what the headers state must agree."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for b in batches:
            out, size = [], 0
            for r in b.to_pylist():
                if r["path"] not in files:
                    fs, inner = open_path(r["path"])
                    files = {r["path"]: fs.open_input_file(inner)}
                fields, block = parse_record(gzip.decompress(files[r["path"]].read_at(r["length"], r["offset"])))
                kind, label = fields["warc-type"].lower(), fields.get("warc-payload-digest", "")
                if kind == "revisit":
                    payload, n = None, stated_length(fields, block)
                    digest = label.removeprefix("sha256:").lower() if label.startswith("sha256:") else None
                    right = True
                else:
                    payload = payload_of(fields, block)
                    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    right = digest_agrees(label, payload) and int(fields.get("x-payload-length", n)) == n
                if not right or fields["warc-record-id"] != r["record"]:
                    raise ValueError(f"record {r['record']} of {r['path']} is damaged")
                refers = fields.get("warc-refers-to") if kind == "revisit" else None
                out.append((page_of(r["record"]), fields.get("warc-target-uri"), n, digest, kind, page_of(refers), payload, r["record"], refers))
                size += len(payload or b"")
                if size >= BATCH_BYTES or len(out) == 4096:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return index.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                            "payload binary, record_id string, refers_to_id string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), COLUMNS.values())], names=list(COLUMNS))
