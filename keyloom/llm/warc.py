"""WARC archives with a two-level capture index.

Each page becomes one gzip member of a WARC file: a response, or a revisit of the response with an equal payload. The capture
index is sorted by reversed-host URL key: its files hold zlib blocks of lines, each file has a sparse directory of its blocks'
first keys, and a short list has the first key of each file. A lookup is three binary searches (file, block, line) and two range
reads (block, record). Index files are key ranges, so their number, which is all that lookups share, follows the partitions.

Tasks write files of unique names to the shared folder and return what they wrote; files of lost attempts are never referred to.

Defined cases: null html is an empty payload; payloads under 100 bytes are always responses; null or odd URLs have keys as they
stand; rows without page_id are pages like others, though none refers to them; equal rows are records of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.tables import read_table, scratch_path

LEAST_REVISIT = 100
BLOCK_LINES = 256
FILE_BYTES = 256 << 20
TASK_BYTES = 64 << 20
ENTRY = "key string, page_id long, file string, offset long, length long"


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def url_key(url: Column) -> Column:
    """com,example,www)/path?query for http://www.example.com/path?query."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        kind, block = "response", http + payload
    else:
        kind, block = "revisit", http
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = [f"WARC-Type: {kind}", *head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers of a record and its payload."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    return head | {"payload": block.partition(b"\r\n\r\n")[2]}


def write_records(typed: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, key, url, payload, digest, refers_to) as WARC files; gives their index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        out = name = None
        for b in batches:
            rows = []
            for page_id, key, url, payload, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "key", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None or out.tell() > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                packer = zlib.compressobj(1, wbits=31)
                raw = record(page_id.as_py(), url.as_py(), payload.as_py() or b"", digest.as_py(), refers_to.as_py())
                data = packer.compress(raw) + packer.flush()
                rows.append((key.as_py(), page_id.as_py(), name, out.tell(), len(data)))
                out.write(data)
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return typed.mapInArrow(run, ENTRY)


def place(page_id: int | None) -> int:
    """The order of page ids, null before all others as Spark sorts it."""
    return -(1 << 63) if page_id is None else page_id


def tasks_for(entries: DataFrame) -> int:
    """Tasks by the bytes of the records, as the rows that name them are small."""
    total = entries.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Writes sorted entries as index files; gives (first, file, directory) for each: the range of its directory in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = opened(folder)
        name, directory, lines, offset, out = f"{uuid.uuid4().hex}.idx", [], [], 0, None

        def put() -> int:
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], place(lines[0][1]), offset, len(data)])
            out.write(data)
            return offset + len(data)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    offset = put()
                    lines = []
        if out is not None:
            if lines:
                offset = put()
            data = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(data)
            out.close()
            yield pa.record_batch({"first": [directory[0][0]], "page_id": pa.array([directory[0][1]], pa.int64()), "file": [name], "offset": pa.array([offset], pa.int64()), "length": pa.array([len(data)], pa.int64())})

    spread = entries.repartitionByRange(tasks_for(entries), "key", "page_id").sortWithinPartitions("key", "page_id")
    return spread.mapInArrow(run, "first string, page_id long, file string, offset long, length long")


class CaptureIndex:
    """Lookups in index files; `files` is the list that `write_index` gives, sorted by first key."""

    def __init__(self, folder: str, files: list[tuple]):
        self.files = sorted(files)
        self.firsts = [(x[0], x[1]) for x in self.files]
        self.fs, self.at = opened(folder)
        self.directory = lru_cache(4)(self._directory)
        self.block = lru_cache(4)(self._block)
        self.source = lru_cache(16)(lambda name: self.fs.open_input_file(f"{self.at}/{name}"))

    def _directory(self, f: int) -> list:
        _, _, name, offset, length = self.files[f]
        return json.loads(zlib.decompress(self.source(name).read_at(length, offset)))

    def _block(self, f: int, b: int) -> list:
        _, _, offset, length = self.directory(f)[b]
        return [json.loads(x) for x in zlib.decompress(self.source(self.files[f][2]).read_at(length, offset)).decode().split("\n")]

    def find(self, key: str, page_id: int) -> Iterator[tuple]:
        """(file, offset, length) of the captures of a key and page."""
        want = (key, place(page_id))
        f = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while f < len(self.files) and self.firsts[f] <= want:
            starts = [(x[0], x[1]) for x in self.directory(f)]
            b = max(0, bisect.bisect_left(starts, want) - 1)
            while b < len(starts) and starts[b] <= want:
                lines = self.block(f, b)
                i = bisect.bisect_left(lines, want, key=lambda x: (x[0], place(x[1])))
                while i < len(lines) and (lines[i][0], place(lines[i][1])) == want:
                    yield tuple(lines[i][2:])
                    i += 1
                b += 1
            f += 1

    def read(self, file: str, offset: int, length: int) -> dict:
        return parse(zlib.decompress(self.source(file).read_at(length, offset), wbits=31))


def fetch(wanted: DataFrame, folder: str, files: list[tuple]) -> DataFrame:
    """The records of `wanted` (key, page_id), read through the index; payload digests are computed anew and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, files)
        for b in batches:
            rows = []
            for key, page_id in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for where in index.find(key, page_id):
                    r = index.read(*where)
                    size, digest = int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha256:")
                    refers = r.get("WARC-Refers-To")
                    if refers is None and (len(r["payload"]) != size or hashlib.sha256(r["payload"]).hexdigest() != digest):
                        raise ValueError(f"record of page {page_id} is damaged")
                    rows.append((page_id, size, digest, r["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return wanted.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame, list[tuple]]:
    """Writes archives and index of `pages`; gives the folder, the captures (key, page_id), and the index files."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    each = p.select("page_id", "digest", F.octet_length("payload").alias("size")).filter(F.col("size") >= LEAST_REVISIT)
    first = each.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = each.join(first, "digest").filter("page_id is null and first is not null or page_id <> first").select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), F.col("first").alias("refers_to")).distinct()
    typed = p.join(again, p["page_id"].eqNullSafe(F.col("again")) & (p["digest"] == F.col("again_digest")), "left")
    entries_at = f"{folder}/entries"
    write_records(typed.select("page_id", url_key(F.col("url")).alias("key"), "url", "payload", "digest", "refers_to"), folder).write.parquet(entries_at)
    entries = spark.read.parquet(entries_at)
    index_at = f"{folder}/index"
    write_index(entries, folder).write.parquet(index_at)
    files = [tuple(r) for r in spark.read.parquet(index_at).select("first", "page_id", "file", "offset", "length").collect()]  # one a partition
    return folder, entries.select("key", "page_id", "length"), files


def op9_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, captures, files = archive(read_table(spark, sf_dir, "pages"))
    # captures of one key and page are found together; a number of its own, as the records are far larger than the rows that ask for them
    wanted = captures.select("key", "page_id").distinct().repartitionByRange(tasks_for(captures), "key", "page_id").sortWithinPartitions("key", "page_id")
    return fetch(wanted, folder, files)
