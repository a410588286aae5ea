"""WARC (operator 10): archives as one gzip stream each, made over into a member for each record with an offset index.

write_archives() gives monolithic files, as a crawler that compresses whole files leaves them; normalise() inflates each once, as a stream, and
writes every record as its own gzip member, with a sidecar index; read_records() opens records by offset. All files are in a
folder that the executors share; a task's file has its attempt's number in its name, so only what a finished attempt reports is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmc.llm.shared import looked_up, opened, shared_dir, stored

CHUNK = 1 << 20
GZIP = 31
#: Bytes of records, before compression, after which a task begins another file.
FILE_BYTES = 256 << 20
END = b"\r\n\r\n"
INDEX = "path string, offset long, length long, page_id long, record_type string"


def removed(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.delete_file(path)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def header(page_id: int | None, url: str | None, kind: str, digest: str, full: int, refers_to: int | None, length: int) -> bytes:
    """Of a record. The URI is percent-encoded where it has blanks or control or other than ASCII characters; a null one is left out, as is a null id."""
    from urllib.parse import quote

    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {full}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {length}")
    return "\r\n".join(lines).encode() + END


def fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)


def page_of(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to: of equal payloads of at least `least` bytes, those that aren't of the
    smallest page_id refer to it. page_ids are whole numbers. Rows with that same page_id are all responses; a null html is an empty payload; a row without a page_id
    refers to the smallest one that there is. Other columns are left out; an empty table gives none."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only payloads that came twice are looked up
    held = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    out = looked_up(rows, "digest", held, "first")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes records as monolithic gzip files, one or more a task; gives their names (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, gz, size, n, path = 0, None, 0, 0, ""
        out, done = None, []
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{folder}/whole-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
                    out, gz, size, n, part = opened(path, "w"), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0, part + 1
                revisit = refers is not None
                body = b"" if revisit else payload
                head = header(page, url, "revisit" if revisit else "response", base32(bytes.fromhex(digest)), len(payload), refers, len(body))
                for x in (head, body, END):
                    if c := gz.compress(x):
                        out.write(c)
                    size += len(x)
                n += 1
                if size >= FILE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
            done.append((path, n))
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return stored(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"), "whole")


def inflated(source) -> Iterator[bytes]:
    """The stream of a gzip file, whether of one member or of several."""
    gz = zlib.decompressobj(GZIP)
    while data := source.read(CHUNK):
        while data:
            x = gz.decompress(data, CHUNK)
            if x:
                yield x
            if gz.eof:
                data, gz = gz.unused_data, zlib.decompressobj(GZIP)
            else:
                data = gz.unconsumed_tail
    if x := gz.flush():
        yield x


def record_chunks(stream: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, piece) of each record in turn: first with the header and no piece, then header b"" with each piece of its body."""
    held = bytearray()

    def more() -> bool:
        x = next(stream, None)
        if x is None:
            return False
        held.extend(x)
        return True

    while True:
        seen = 0
        while (at := held.find(END, seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return
        head = bytes(held[: at + 4])
        del held[: at + 4]
        yield head, b""
        left = int(fields(head)["Content-Length"]) + len(END)
        while left:
            if not held and not more():
                raise ValueError("the archive ends inside a record")
            x = bytes(held[:left])
            del held[: len(x)]
            left -= len(x)
            yield b"", x


def normalise(archives: DataFrame, folder: str, level: int = 1, keep: bool = True) -> DataFrame:
    """Writes each archive (column path) anew with every record as its own gzip member, and beside it <name>.idx, a JSON line for each
    record. Gives the index: path, offset, length (of the member, in bytes), page_id, record_type. keep=False removes what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                to = f"{folder}/record-{path.rpartition('/')[2].split('.')[0]}-{attempt}.warc.gz"
                rows: list[tuple] = []
                at = 0
                with opened(path, "r") as source, opened(to, "w") as out, opened(to + ".idx", "w") as side:
                    gz = None

                    def close() -> None:
                        nonlocal at
                        x = gz.flush()
                        out.write(x)
                        offset, size, head = open_record
                        f = fields(head)
                        rows.append((to, offset, at + len(x) - offset, page_of(f.get("WARC-Record-ID")), f["WARC-Type"]))
                        at += len(x)
                        side.write(json.dumps({"offset": rows[-1][1], "length": rows[-1][2], "page_id": rows[-1][3], "type": rows[-1][4]}).encode() + b"\n")

                    for head, piece in record_chunks(inflated(source)):
                        if head:
                            if gz is not None:
                                close()
                            gz, open_record = zlib.compressobj(level, zlib.DEFLATED, GZIP), (at, 0, head)
                        x = gz.compress(head or piece)
                        if x:
                            out.write(x)
                            at += len(x)
                    if gz is not None:
                        close()
                for a in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 10_000], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "offset", "length", "page_id", "record_type"])

    # a task for each archive or few
    n = max(1, archives.count())
    index = stored(archives.select("path").repartitionByRange(n, "path").mapInArrow(run, INDEX), "index")
    if not keep:

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    removed(path)
            yield pa.record_batch([pa.array([], pa.string())], names=["path"])

        archives.select("path").mapInArrow(drop, "path string").count()
    return index


def read_records(index: DataFrame) -> DataFrame:
    """Records that an index points to, each opened by its offset alone: page_id, url, record_type, payload (null for
    revisits), payload_bytes, payload_digest (of the full payload), refers_to. A response whose digest isn't its payload's is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, source = None, None
        types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != open_path:
                    if source is not None:
                        source.close()
                    open_path, source = path, opened(path, "r")
                source.seek(offset)
                data = zlib.decompress(source.read(length), GZIP)
                cut = data.index(END) + len(END)
                f = fields(data[:cut])
                body = data[cut : cut + int(f["Content-Length"])]
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = f["WARC-Type"] == "revisit"
                if not revisit and base32(hashlib.sha1(body).digest()) != digest:
                    raise ValueError(f"payload of {f.get('WARC-Record-ID')} in {path} isn't what was written")
                out.append((page_of(f.get("WARC-Record-ID")), f.get("WARC-Target-URI"), f["WARC-Type"], None if revisit else body, int(f["X-Payload-Length"]) if revisit else len(body), digest, page_of(f.get("WARC-Refers-To"))))
                held += len(body)
                if held > 16 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return index.select("path", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) written, normalised and read again."""
    folder = folder or shared_dir(pages.sparkSession) + "/warc"
    return read_records(normalise(write_archives(planned(pages, least), folder), folder, keep=False))
