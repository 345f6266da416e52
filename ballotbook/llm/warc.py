"""WARC archives read by index first.

Writing: each task writes one gzip-per-record WARC file into the shared folder, under a name of its own
attempt, and returns one index row per record: file, offset, length, URL, digest. A file begins with a warcinfo
record, which has no index row; record ids are made of page, file and offset, so no two are the same. The index is
written as a table before anything reads it, so a repeated task leaves at most an unreferenced file.

Reading: the selected index rows are sorted by file and offset, near ranges are coalesced to reads of at
most ``read_bytes``, and each read is one task row; records come out of the bytes alone.

Records with equal payloads of at least ``min_revisit_bytes`` bytes: the smallest id is a response, the
others are revisits of it. Null payloads are empty ones; equal empty payloads revisit too. Null URLs are
written as an empty URI. A null id is written as ``-`` and is never a response for others. Repeated
rows: all rows of the smallest id are responses. Very long payloads are one record each, held whole by one task at a
time; all times of a run are the one at which it began, as pages have none. An empty table gives no files and no
rows. Of further columns none is read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

INDEX_SCHEMA = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, intact boolean"
)
_BREAK = b"\r\n"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(raw).decode("ascii")


def packed(whole: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def info_bytes(name: str, date: str) -> bytes:
    """The warcinfo record that begins a file."""
    body = b"software: ballotbook" + _BREAK + b"format: WARC File Format 1.1" + _BREAK
    head = [
        b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:warcinfo:%s>" % name.encode(), b"WARC-Date: " + date.encode(),
        b"WARC-Filename: " + name.encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(body),
    ]
    return packed(_BREAK.join([*head, b"", b""]) + body + _BREAK + _BREAK)


def record_bytes(page_id, url, html: bytes, sha1: bytes, first, place: str, date: str) -> bytes:
    """One record as a gzip member; ``first`` is the id that it revisits, or None for a response."""
    kind = b"response" if first is None else b"revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    body = html if first is None else b""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s:%s>" % (b"-" if page_id is None else b"%d" % page_id, place.encode()),
        b"WARC-Date: " + date.encode(),
        b"X-Page-ID: " + (b"-" if page_id is None else b"%d" % page_id),
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + base32_sha1(sha1).encode(),
        b"X-Payload-Length: %d" % len(html),
        b"Content-Type: text/html; charset=utf-8",
        b"Content-Length: %d" % len(body),
    ]
    if first is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To-Date: " + date.encode(), b"X-Refers-To-Page: %d" % first,
        ]
    return packed(_BREAK.join([*head, b"", b""]) + body + _BREAK + _BREAK)


def parse_record(raw: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields and body of one record without compression."""
    head, _, rest = raw.partition(_BREAK + _BREAK)
    lines = head.split(_BREAK)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.partition(b": ")[::2] for line in lines[1:])
    return fields, rest[: int(fields[b"Content-Length"])]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives below ``folder`` (lazily) and return their index rows.

    ``folder`` is a URI that pyarrow's file systems open, such as file:, hdfs: or s3:.
    """
    import datetime

    ws, date = Workspace(pages.sparkSession, "warc-write"), datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha1"))
    copies = ws.keep(
        rows.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n"),
        "copies",
    )
    if copies.count() <= 500_000:  # 20 bytes and a long each: below 32 MB in memory
        copies = F.broadcast(copies)
    joined = rows.join(copies, "sha1", "left").select(
        "page_id", "url", "html", "sha1",
        F.when(
            F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")
        ).alias("first"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        out, at, name, store = None, 0, "", None
        for batch in batches:
            if out is None:
                task = TaskContext.get()
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                info = info_bytes(name, date)
                out.write(info)
                at = len(info)
            cols = [c.to_pylist() for c in batch.columns]
            found = []
            for page_id, url, body, sha1, first in zip(*cols):
                raw = record_bytes(page_id, url, body, sha1, first, f"{name}:{at}", date)
                out.write(raw)
                found.append(
                    (page_id, name, at, len(raw), url, base32_sha1(sha1), "response" if first is None else "revisit")
                )
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*found), _INDEX_TYPES)] if found else [pa.array([], t) for t in _INDEX_TYPES],
                names=_INDEX_NAMES,
            )
        if out is not None:
            out.close()

    return joined.mapInArrow(write, INDEX_SCHEMA)


_INDEX_NAMES = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
_INDEX_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX_SCHEMA.split(", ")]


def read_records(
    index: DataFrame, folder: str, read_bytes: int = 4 << 20, gap_bytes: int = 64 << 10, payloads: bool = True
) -> DataFrame:
    """The records that ``index`` selects, by coalesced byte-range reads of the archives.

    ``intact``: the bytes of a response have the digest that the index and the record name.
    """
    # Ranges of one file share a window group: a file is one writing task's output, bounded by its input
    # split; the block of read_bytes bounds each read.
    block = F.floor(F.col("offset") / read_bytes)
    by_file = Window.partitionBy("file", "block").orderBy("offset")
    ranges = (
        index.select("file", "offset", "length", "digest")
        .withColumn("block", block)
        .withColumn("end", F.col("offset") + F.col("length"))
        .withColumn("apart", F.col("offset") - F.coalesce(F.lag("end").over(by_file), F.col("offset")))
        .withColumn("run", F.sum((F.col("apart") > gap_bytes).cast("int")).over(by_file))
        .groupBy("file", "block", "run")
        .agg(
            F.min("offset").alias("start"),
            F.max("end").alias("end"),
            F.array_sort(F.collect_list(F.struct("offset", "length", "digest"))).alias("records"),
        )
        .select("file", "start", "end", "records")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        store, path = _store(folder)
        for batch in batches:
            for file, start, end, records in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{path}/{file}") as f:
                    f.seek(start)
                    raw = f.read(end - start)
                rows, held = [], 0
                for r in records:
                    at = r["offset"] - start
                    fields, body = parse_record(zlib.decompress(raw[at : at + r["length"]], 31))
                    kind = fields[b"WARC-Type"].decode()
                    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    page, first = fields[b"X-Page-ID"], fields.get(b"X-Refers-To-Page")
                    sound = digest == r["digest"] and (
                        kind == "revisit" or base32_sha1(hashlib.sha1(body).digest()) == digest
                    )
                    rows.append(
                        (
                            None if page == b"-" else int(page),
                            fields[b"WARC-Target-URI"].decode(),
                            kind,
                            int(first) if first else None,
                            int(fields[b"X-Payload-Length"]),
                            digest,
                            body if payloads and kind == "response" else None,
                            sound,
                        )
                    )
                    held += len(body)
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return ranges.mapInArrow(read, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write archives of all pages and the index table, then read every record back by the index."""
    ws = Workspace(pages.sparkSession, "warc")
    folder = ws.path("archives")
    index = ws.keep(write_archives(pages, folder, min_revisit_bytes), "index")
    found = read_records(index, folder, payloads=False)
    return found.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"
    )
