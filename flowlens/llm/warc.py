"""WARC archives with an index that is written first and read first.

Every page is one record, a gzip member of its own, in archives that tasks write to a shared folder. A page whose payload equals
that of a page with a smaller id (and has at least ``min_bytes`` bytes) is a revisit record without payload. The
index has one row per record: archive, offset, length, URL, digest and what it refers to.

Reading goes by the index: rows are gathered by archive and stretch of it and sorted by offset; ranges that touch or lie close are
read at once, up to ``MOST_BYTES``, and taken apart.

An archive's name holds the task attempt, and an index row names its archive; so what a failed attempt wrote is never read.

Defined results: null html is an empty payload; a null URL is written as "-". Line breaks in a URL become blanks. Rows that repeat an id and a
payload are response records each. Rows without an id are responses, unless a row with one has the same payload. No
rows give no archive. Only the columns named are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, new_folder
from .common import python_tasks

#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 256 << 20
#: Ranges no farther apart are read at once, and so many bytes at most unless one record is longer.
NEAR, MOST_BYTES = 64 << 10, 4 << 20
#: Bytes of an archive that are one unit of reading.
STRETCH = 16 << 20
INDEX = ("archive string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, "
         "record_type string, refers_to long")
DATE = "1970-01-01T00:00:00Z"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    uri = folder if urlsplit(folder).scheme else "file://" + os.path.abspath(folder)
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"), ("WARC-Date", DATE),
              ("WARC-Target-URI", " ".join((url or "-").split("\n")).replace("\r", " ")),
              ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("Content-Type", "text/html"), ("Content-Length", len(block)),
              ("X-Page-ID", "" if page_id is None else page_id), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        fields.append(("X-Refers-To", refers_to))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:n]


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``. Only digests are grouped; payloads move only if too many digests repeat for a broadcast."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_d", F.sha1(F.col("html").cast("binary")))
    repeated = cut(p.groupBy("_d").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).filter("n > 1 AND low IS NOT NULL").drop("n"))
    later = (F.octet_length("html") >= min_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("low")))
    return p.join(repeated, "_d", "left").select("page_id", "url", "html", F.when(later, F.col("low")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives and, as Parquet in ``folder/index``, their index, which is returned."""
    spark = pages.sparkSession
    python_tasks(spark)
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder + "/archives")
        context = TaskContext.get()
        out, number, at, name = None, 0, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                        files.create_dir(base, recursive=True)
                        out, at, number = files.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                    payload = html.encode("utf-8", "replace")
                    member = record(page_id, url, payload, refers_to)
                    out.write(member)
                    rows.append((name, at, len(member), page_id, url, digest(payload), len(payload),
                                 "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                columns = list(zip(*rows)) or [()] * len(names)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if out is not None:
                out.close()

    index = with_references(pages, min_bytes).mapInArrow(run, INDEX)
    index.write.mode("overwrite").parquet(folder + "/index")
    return spark.read.schema(index.schema).parquet(folder + "/index")


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted ``(offset, length)`` in lists that are read at once."""
    group: list[tuple[int, int]] = []
    for offset, length in ranges:
        if group and (offset - sum(group[-1]) > NEAR or offset + length - group[0][0] > MOST_BYTES):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` selects, from the archives' bytes. Payloads of responses are hashed anew and compared with
    the record's digest; ``payload`` is null for revisits, and for all without ``payloads``."""
    spark = index.sparkSession
    python_tasks(spark)
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder + "/archives")
        opened, name = None, None
        for batch in batches:
            wanted: dict[str, list] = {}
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                wanted.setdefault(archive, []).append((offset, length))
            for archive, ranges in wanted.items():
                if archive != name:
                    opened, name = files.open_input_file(f"{base}/{archive}"), archive
                for group in coalesced(sorted(ranges)):
                    start = group[0][0]
                    data = opened.read_at(sum(group[-1]) - start, start)
                    rows = []
                    for offset, length in group:
                        fields, block = parse(data[offset - start:offset - start + length])
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and digest(block) != said:
                            raise ValueError(f"{archive} at {offset}: the payload does not have the record's digest")
                        rows.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Target-URI"],
                                     len(block) if response else int(fields["X-Payload-Length"]), said, fields["WARC-Type"],
                                     None if response else int(fields["X-Refers-To"]), block if response and payloads else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive", F.floor(F.col("offset") / STRETCH))
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    folder = new_folder(pages.sparkSession)
    return read(write(pages, folder), folder, payloads=False)
