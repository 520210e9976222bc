"""WARC archives with a two-level capture index.

Writing: payloads are hashed in the JVM; per payload the smallest id is found by a grouping that combines before
its shuffle, and only payloads that occur under several ids are looked up again, by (id, payload), so that a payload
that most pages share meets no single task.  Pages are then dealt to as many archives as their bytes need; each task
streams gzip members, one per record, into one file in the shared folder and moves it into place.

Index: captures are sorted by reversed-host url key into blocks of lines, each block compressed by itself; the
sparse directory keeps only the first key and place of every block.  A lookup searches the directory, reads one
block range (or the few that a key spans), searches it, and reads one range of an archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.llm.common import file_system, get_range, shared_path
from virocohort.session import cut_lineage

DATE = "2020-01-01T00:00:00Z"
CAPTURES = "key string, file string, offset long, length long, page_id long, type string"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plain(text: str) -> str:
    """White space and control characters escaped: headers and index lines stay whole."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: quote(m[0]), text)


def url_key(url: str | None) -> str:
    """Reversed host, then the rest of the url: keys of one site and its subdomains are neighbours."""
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return plain(",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, copy: int, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; refers_to None makes a response, else a revisit without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{page_id}:{copy}>"), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", plain(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}:0>")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """Page id, url, payload bytes, digest, type, referred page id and payload (None in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    url, digest = fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page, url, size, digest, "revisit", int(fields["WARC-Refers-To"].split(":")[2]), None
    if len(payload) != size or base32_sha1(payload) != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't have its digest")
    return page, url, size, digest, "response", None, payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   archive_bytes: int = 64 << 20, revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write gzip archives below ``folder``; the captures (key, file, offset, length, page_id, type) as a table.

    A payload of at least ``revisit_bytes`` is written once, as the response of its smallest id; all else with it
    are revisits.  Null payloads are empty ones; a null url has an empty key; pages with a null id are stored under no
    id, each as a response.  Repeated rows of the smallest id: the first is the response, the rest revisit it.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    brief = own.select("page_id", "sha", F.octet_length("html").cast("long").alias("size"))
    groups = brief.where(F.col("page_id").isNotNull() & (F.col("size") >= revisit_bytes)).groupBy("page_id", "sha").count()
    many = groups.groupBy("sha").agg(F.min("page_id").alias("first"), F.sum("count").alias("n")).where("n > 1").select("sha", "first")
    twice = cut_lineage(groups.join(many, "sha").select("page_id", "sha", "first"))
    total = brief.agg(F.sum("size")).first()[0] or 0
    n = max(-(-total // archive_bytes), own.sparkSession.sparkContext.defaultParallelism)
    # dealt once, by the join's own key; rows of one id and payload stay side by side
    dealt = own.repartition(n, "page_id", "sha").join(twice, ["page_id", "sha"], "left")
    dealt = dealt.sortWithinPartitions("page_id", "sha", "url").select("page_id", "url", "html", "sha", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        at, out, last, copy, found = 0, None, None, 0, []
        part = f"{base}/{name}.{TaskContext.get().taskAttemptId()}.part"
        for batch in batches:
            for page, url, html, sha, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or system.open_output_stream(part)
                copy = copy + 1 if last == (page, sha) and page is not None else 0
                last = (page, sha)
                refers = None if first is None or (first == page and not copy) else first
                data = gzip.compress(record(page, copy, url, html.encode(), refers), level, mtime=0)
                out.write(data)
                found.append((url_key(url), name, at, len(data), page, "response" if refers is None else "revisit"))
                at += len(data)
        if out:
            out.close()
            system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             names=[c.split()[0] for c in CAPTURES.split(", ")])

    return cut_lineage(dealt.mapInArrow(write, CAPTURES))


def write_index(captures: DataFrame, folder: str, block_lines: int = 3000, file_lines: int = 1_000_000) -> DataFrame:
    """Sorted, compressed blocks of captures below ``folder``; the sparse directory, one row per block, as a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}.gz"
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part = f"{base}/{name}.{TaskContext.get().taskAttemptId()}.part"
        out, at, rows, places = None, 0, [], []

        def flush():
            nonlocal out, at, rows
            out = out or system.open_output_stream(part)
            data = gzip.compress("".join("\t".join(map(str, r)) + "\n" for r in rows).encode(), 6, mtime=0)
            out.write(data)
            places.append((rows[0][0], rows[-1][0], name, at, len(data), len(rows)))
            at, rows = at + len(data), []

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(r)
                if len(rows) == block_lines:
                    flush()
        if rows:
            flush()
        if out:
            out.close()
            system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*places, strict=True), (*[pa.string()] * 3, *[pa.int64()] * 3), strict=True)],
                                             names=[c.split()[0] for c in DIRECTORY.split(", ")])

    names = [c.split()[0] for c in CAPTURES.split(", ")]
    files = max(1, -(-captures.count() // file_lines))
    # the offset joins the range key, so that a key of very many captures still spreads over files
    ordered = captures.select(*names).repartitionByRange(files, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return cut_lineage(ordered.mapInArrow(write, DIRECTORY))


def _block_lines(folder: str, file: str, offset: int, length: int) -> list[list[str]]:
    return [x.split("\t") for x in gzip.decompress(get_range(f"{folder}/{file}", offset, length)).decode().split("\n")[:-1]]


def read_archives(directory: DataFrame, index_folder: str, archive_folder: str, payloads: bool = True) -> DataFrame:
    """All records, found through the index blocks and read by ranges, file by file in order of offset."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                lines = _block_lines(index_folder, file, offset, length)
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in lines]), pa.array([int(x[2]) for x in lines], pa.int64()), pa.array([int(x[3]) for x in lines], pa.int64())],
                                                 names=["file", "offset", "length"])

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(archive_folder)
        name, f = None, None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

        rows, held = [], 0
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, f = file, system.open_input_file(f"{base}/{file}")
                r = parse_record(gzip.decompress(f.read_at(length, offset)))
                rows.append(r if payloads else (*r[:-1], None))
                held += len(r[-1] or b"") if payloads else 100
                if held > 8 << 20 or len(rows) >= 10000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    places = directory.mapInArrow(entries, "file string, offset long, length long")
    return places.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(records, RECORDS)


class Lookup:
    """Finds the captures of one url: the directory's keys are searched, then one block, then the archive."""

    def __init__(self, directory: list[tuple], index_folder: str, archive_folder: str):
        self.rows = sorted(directory)
        self.firsts = [r[0] for r in self.rows]
        self.index_folder, self.archive_folder = index_folder, archive_folder

    @classmethod
    def open(cls, directory: DataFrame, index_folder: str, archive_folder: str) -> Lookup:
        """The sparse directory (one row in thousands of captures) is read by the caller's process alone."""
        return cls([tuple(r) for r in directory.collect()], index_folder, archive_folder)

    def captures(self, url: str) -> list[list[str]]:
        key, found = url_key(url), []
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.rows) and self.rows[at][0] <= key:
            if self.rows[at][1] >= key:
                lines = _block_lines(self.index_folder, *self.rows[at][2:5])
                keys = [x[0] for x in lines]
                found += lines[bisect.bisect_left(keys, key):bisect.bisect_right(keys, key)]
            at += 1
        return found

    def records(self, url: str) -> list[tuple]:
        return [parse_record(gzip.decompress(get_range(f"{self.archive_folder}/{x[1]}", int(x[2]), int(x[3])))) for x in self.captures(url)]


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index to a new shared folder, then read every record back through the index."""
    folder = folder or shared_path(spark, "warc")
    directory = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    return read_archives(directory, f"{folder}/index", f"{folder}/archives", payloads=False)
