"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, then digest, and streamed into gzip members,
one for each record. A file is rolled when its compressed size reaches `roll_bytes`.
Record ids, digests and headers come from the content alone, so a task that is
run again writes the same bytes. Each file is written under a temporary name
that holds the attempt, then moved to its final name; the list of finished
files (the manifest) goes through Spark's committer, and readers open only
what the manifest lists, so files of lost attempts are never read.

Of pages with equal payloads (of `min_bytes` or more) the one with the smallest
page id is a response; the others are revisits that refer to it and hold no
payload. Only (page id, digest, target) of revisits is shuffled beside the
pages: it is merged into the sorted stream just before its page, so a task holds
one of them.

Defined results: a null html is an empty payload; a null url is `about:blank`;
control characters in urls are percent-encoded; a null page id is written
without an id and read back as null; it is never a response that others refer
to unless all its copies have null ids; repeated rows (same id and payload) are
one response, the rest revisits of it; without pages no file is written. A very
long page is a record like others: memory holds one record and one slice of
rows. Only id, url and html are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import partitions_of
from .batches import slices, written

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("first_page_id", T.LongType()),
        T.StructField("last_page_id", T.LongType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)
#: Fixed value: the profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:nearfield:warc")
_CONTROL = re.compile("[\x00-\x20\x7f]")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}/{copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, copy: int, date: str) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def _filesystem(folder: str):
    """A file system for a URI; paths without a scheme are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class _Roller:
    """Writes gzip members to files of about roll_bytes, temporary name first."""

    def __init__(self, folder: str, part: int, attempt: int, roll_bytes: int):
        self.fs, self.root = _filesystem(folder)
        self.part, self.attempt, self.roll_bytes = part, attempt, roll_bytes
        self.number, self.out = 0, None

    def add(self, page_id: int | None, data: bytes) -> tuple | None:
        done = None
        if self.out is not None and self.size >= self.roll_bytes:
            done = self.close()
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{self.part:05d}-{self.number:05d}-{self.attempt}"
            self.out = self.fs.open_output_stream(self.temporary)
            self.size, self.records, self.first = 0, 0, page_id
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.size += len(member)
        self.records += 1
        self.last = page_id
        return done

    def close(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.number += 1
        return self.name, self.records, self.size, self.first, self.last


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, roll_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", partitions: int | None = None) -> None:
    """Archives under path/archives and their manifest (Parquet) under path/manifest."""
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    # digests as a table, so that they are computed once
    keyed = written(source.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes), "digests")
    # one row for each payload with two pages or more: partial sums first, so a hot payload is a row for each task;
    # a table again, so that the join can split the pages of a hot payload
    firsts = written(keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first"), "firsts")
    revisits = keyed.join(firsts, "digest").groupBy("page_id", "digest").agg(F.first("first").alias("first"))
    merged = source.select("page_id", F.sha1("html").alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html").unionByName(
        revisits.select("page_id", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    )
    # the digest splits an id that very many pages share, as a null one
    ordered = merged.repartitionByRange(partitions or partitions_of(spark), "page_id", "digest").sortWithinPartitions("page_id", "digest", "kind", "url", "html")
    archives = f"{path}/archives"
    fs, root = _filesystem(archives)
    fs.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        roller = _Roller(archives, t.partitionId(), t.taskAttemptId(), roll_bytes)
        done, now, target, copy = [], None, (), -1
        for b in slices(batches):
            for page, digest, kind, first, url, payload in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (page, digest) != now:
                    now, target, copy = (page, digest), (), -1
                if kind == 0:
                    target = (first,)
                    continue
                copy += 1
                # the response is the first copy of the smallest page
                revisit = bool(target) and (target[0] != page or copy > 0)
                data = record(page, url, payload or b"", base64.b32encode(bytes.fromhex(digest)).decode(), target[0] if target else None, revisit, copy, date)
                if file := roller.add(page, data):
                    done.append(file)
        if file := roller.close():
            done.append(file)
        yield _batch(done, MANIFEST)

    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")


def _batch(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(step):
        rest = b""
        out.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(out)
            rest, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("the file ends inside a record")


def parse_record(data: bytes) -> tuple:
    """RECORDS of one record; its digests are computed anew and compared with its headers."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("not a WARC record")
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("a block differs from its digest")
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number("X-Refers-To-Page")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all archives that the manifest lists; a task streams whole files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    files = manifest.where("records > 0").select("file").repartition(partitions_of(spark))
    archives = f"{path}/archives"

    def run(batches):
        fs, root = _filesystem(archives)
        rows = []
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse_record(data))
                        if len(rows) >= 2048:
                            yield _batch(rows, RECORDS)
                            rows = []
        yield _batch(rows, RECORDS)

    return files.mapInArrow(run, RECORDS)
