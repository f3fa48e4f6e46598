"""WARC archives: writing, normalising monolithic gzip files, and reading records by offset.

A crawl often leaves one gzip stream per file, which can only be read from its start. The normaliser inflates such a
file once, as a stream, and rewrites every record as a gzip member of its own beside an index of (offset, length) per
record; readers then fetch any record alone. Files are the unit of work; a record is the most that is held.

Pages become ``response`` records, or ``revisit`` records (identical payload digest) where another page with an equal
payload of at least ``REVISIT_BYTES`` bytes has a larger id. Names carry the task attempt and only files named in the
returned manifest count, so tasks may run again.

Defined cases: a null html is an empty payload; null page ids are written without an id (read back as null) and rank
below all others; rows that repeat an id with an equal payload are all the response, or all revisits; a null url has
no target line and control characters in urls are percent-encoded; a very long html is one record, held whole; an empty
table gives no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_system, materialise, new_path
from .textbytes import slices

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
CHUNK = 1 << 20
FILES = "name string, n_records long"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{PAGE}{page_id}>")
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts a stream of bytes into whole records, without keeping more than one."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (stop := held.find(b"\r\n\r\n")) >= 0:
            need = stop + 4 + int(_headers(bytes(held[:stop]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in chunks of bounded size; a file that ends inside one is an error."""
    engine, whole = zlib.decompressobj(31), True
    while data := source.read(CHUNK):
        while data:
            whole = False
            yield engine.decompress(data, CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine, whole = engine.unused_data, zlib.decompressobj(31), True
    if not whole:
        raise ValueError("the archive ends inside a gzip member")


def deflate(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def page_records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, revisit and refers_to."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"payload_digest": F.sha1(F.encode("html", "UTF-8")), "size": F.octet_length("html")})
    big = pages.filter(F.col("size") >= REVISIT_BYTES)
    owners = materialise(big.groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1").select(F.col("payload_digest").alias("link"), "owner"), "page-owners")
    # small payloads and null ids get a link of their own, so that they don't meet in one task
    link = F.when(F.col("size") >= REVISIT_BYTES, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    joined = pages.withColumn("link", link).join(owners, "link", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("owner")).alias("refers_to"))


def write_archives(records: DataFrame, out: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one monolithic gzip file per task; (name, n_records) of the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n = None, 0
        fs, at = file_system(out)
        context = TaskContext.get()
        name = f"crawl-{context.partitionId():06d}-{context.taskAttemptId()}"
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in slices(batches, text="html"):
            if sink is None:
                fs.create_dir(at, recursive=True)
                sink = fs.open_output_stream(f"{at}/{name}.warc.gz", compression=None)
            for row in batch.to_pylist():
                payload = row["html"].encode()
                sink.write(engine.compress(_record(row["page_id"], row["url"], payload, row["payload_digest"], row["refers_to"], row["revisit"], date)))
                n += 1
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})

    return materialise(records.mapInArrow(run, FILES), "archives")


def one_task_each(files: DataFrame) -> DataFrame:
    """Rows of file names dealt to as many tasks: a number that adaptive execution keeps, as names are short and files
    long."""
    return files.repartitionByRange(max(1, files.count()), "name")


def normalise_archives(files: DataFrame, source: str, out: str) -> DataFrame:
    """Rewrites each file of ``source`` with one gzip member per record, and an index file beside it: a line of offset,
    length and record id per record. Returns (name, n_records). A file with another number of records than ``files`` says
    (null: not known) is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, here), (to, there) = file_system(source), file_system(out)
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("n_records").to_pylist()):
                to.create_dir(there, recursive=True)
                new = f"{name}-{TaskContext.get().taskAttemptId()}"
                with fs.open_input_stream(f"{here}/{name}.warc.gz", compression=None) as data, to.open_output_stream(f"{there}/{new}.warc.gz", compression=None) as sink, to.open_output_stream(f"{there}/{new}.idx") as index:
                    at = n = 0
                    for record in split_records(inflate(data)):
                        member = deflate(record)
                        sink.write(member)
                        head = _headers(record[: record.index(b"\r\n\r\n")])
                        index.write(f"{at} {len(member)} {head.get('warc-record-id', '-')}\n".encode())
                        at, n = at + len(member), n + 1
                if expected is not None and n != expected:
                    raise ValueError(f"{name}: {n} records where {expected} were written")
                yield pa.RecordBatch.from_pydict({"name": [new], "n_records": [n]})

    return materialise(one_task_each(files).mapInArrow(run, FILES), "archives")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long, length long"


def read_archives(files: DataFrame, source: str, with_payload: bool = False) -> DataFrame:
    """Every record, fetched by its index entry; digests of responses are checked against their payloads."""

    def page(value: str | None) -> int | None:
        return int(value.strip("<>").removeprefix(PAGE)) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, here = file_system(source)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{here}/{name}.idx") as f:
                    index = [tuple(map(int, line.split()[:2])) for line in f.read().decode().splitlines()]
                rows = []
                with fs.open_input_file(f"{here}/{name}.warc.gz") as data:
                    for offset, length in index:
                        data.seek(offset)
                        record = zlib.decompress(data.read(length), 31)
                        stop = record.index(b"\r\n\r\n")
                        head, block = _headers(record[:stop]), record[stop + 4 : -4]
                        edge = block.index(b"\r\n\r\n")
                        size = int(_headers(block[:edge])["content-length"])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind, payload = head["warc-type"], None
                        if kind == "response":
                            payload = block[edge + 4 :]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{name}, offset {offset}: the payload doesn't match its digest")
                        rows.append((page(head.get("warc-record-id")), size, digest, kind, page(head.get("warc-refers-to")), head.get("warc-target-uri"), offset, length, payload if with_payload else None))
                        if len(rows) == (64 if with_payload else 4096):
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset", "length", "payload"]
        last = len(names) if with_payload else len(names) - 1
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in list(zip(zip(*rows), kinds))[:last]], names[:last])

    return one_task_each(files).mapInArrow(run, READ + ", payload binary" * with_payload)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages as monolithic archives, normalises these, and reads the records back."""
    raw, out = new_path(spark, "warc-raw"), new_path(spark, "warc")
    files = normalise_archives(write_archives(page_records(pages), raw), raw, out)
    return read_archives(files, out)
