"""Deterministic sharded WARC writer and reader.

Records are sorted by page id in shards of about equal size, whose bounds follow
from sizes by id range, not from a sample, so the same pages give the same files on
any cluster.  A task writes its shards in order and starts a new file when the
compressed size reaches the limit.  A file is written under a temporary name and
renamed when complete; a manifest, committed by Spark after all tasks, lists the
files that count, so files of lost or repeated attempts are never read.

Among records of equal payload the one with the largest page id is the response,
the others are revisits that refer to it.  Digests and headers are made anew.

Defined cases: a NULL payload is empty; a NULL url is written as an empty target; a
NULL page id sorts first and has no id header; if one id comes with one payload
several times, the first of these rows is the response (or a revisit, if a larger
id has the payload) and the others revisit; other columns are not read; an empty
table writes an empty manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sectionflow.session import delete_path

SHARD_BYTES = 16 << 20  # payload of a shard, about
FILE_BYTES = 4 << 20  # compressed size at which a file is closed
FILES_PER_TASK = 4  # files that a task reads back, about
SLICES = 16  # id ranges for each shard, from which shards are put together
RECORD_BYTES = 1000  # what a record counts besides its payload
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAYLOAD_BYTES, PAGE_ID, REFERS_TO = "X-Payload-Bytes", "X-Page-Id", "X-Refers-To-Page-Id"

MANIFEST = "file string, records long, bytes long, sha256 string"


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    """Name of a record that follows from its page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    named = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Date": DATE,
        "WARC-Record-ID": record_id(page_id, named + "/again" * (revisit and refers_to == page_id)),
        "WARC-Payload-Digest": f"sha1:{named}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        PAYLOAD_BYTES: len(payload),
        PAGE_ID: page_id,
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to, named) if revisit else None,
        REFERS_TO: refers_to if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that is read as it comes."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


class ShardFiles:
    """Files of one shard: written under temporary names, closed by size, renamed when complete."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.part, self.out = shard, limit, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        """Write a record; yields the manifest row of a file that this completes."""
        if self.out is None:
            self.temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"
            self.out, self.sum, self.records, self.bytes = self.store.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        packed = gzip.compress(data, compresslevel=6, mtime=0)
        self.out.write(packed)
        self.sum.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)
        if self.bytes >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.store.move(self.temporary, f"{self.path}/{name}")
            yield name, self.records, self.bytes, self.sum.hexdigest()
            self.part, self.out = self.part + 1, None


def shard_map(sized: DataFrame, shard_bytes: int) -> tuple[DataFrame, int, int, int, int]:
    """Columns slice, shard; smallest id, slice width as (first, span), number of slices and of shards.

    Id ranges of equal width are put together until they have the size of a shard.
    There are ``SLICES`` ranges for each shard, a few bytes each, so the table is small.
    """
    low, high, total = sized.agg(F.min("page_id"), F.max("page_id"), F.sum("size")).first()
    first, span = low or 0, (high or 0) - (low or 0) + 1
    shards = -(-(total or 1) // shard_bytes)
    slices = min(SLICES * shards, 1 << 20)
    by = sized.groupBy(slice_of(first, span, slices)).agg(F.sum("size").alias("size"))
    until = F.sum("size").over(Window.orderBy("slice")) - F.col("size")
    return by.select("slice", F.floor(until / shard_bytes).cast("int").alias("shard")), first, span, slices, shards


def slice_of(first: int, span: int, slices: int) -> Column:
    """Number of the id range of a page; pages without an id are in the first."""
    at = F.floor((F.col("page_id").cast("double") - first) * slices / span)
    return F.coalesce(F.least(at, F.lit(slices - 1)), F.lit(0)).cast("int").alias("slice")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Columns page_id, sha, winner: pages with a payload that others have too, and the largest id that has it."""
    small = pages.select("page_id", "sha", "size")
    winners = small.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    return small.join(winners.where("n > 1"), "sha").select("page_id", "sha", "winner").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html as archives in ``folder``; returns the manifest.

    ``least_bytes`` is the size from which equal payloads become revisits.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    pages = pages.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    shards_of, first, span, slices, shards = shard_map(pages.select("page_id", (F.col("size") + RECORD_BYTES).alias("size")), shard_bytes)
    decided = revisits(pages, least_bytes)
    nothing = F.lit(None)
    rows = pages.select("page_id", "sha", F.lit(1).alias("kind"), nothing.cast("long").alias("winner"), "url", "payload").union(
        decided.select("page_id", "sha", F.lit(0), "winner", nothing.cast("string"), nothing.cast("binary"))
    )
    rows = rows.withColumn("slice", slice_of(first, span, slices)).join(F.broadcast(shards_of), "slice").drop("slice")
    rows = rows.repartitionById(shards + 1, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, files, told, again, done = None, None, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    done += files.close() if files else ()
                    shard, files = row["shard"], ShardFiles(folder, row["shard"], file_bytes)
                key = (row["page_id"], row["sha"])
                if row["kind"] == 0:
                    told, again = (key, row["winner"]), False
                    continue
                shared = told is not None and told[0] == key
                revisit = shared and (again or row["page_id"] != told[1])
                done += files.add(record(row["page_id"], row["url"], row["payload"], revisit, told[1] if shared else None))
                again = shared
        done += files.close() if files else ()
        columns = list(zip(*done)) or [[], [], [], []]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "records", "bytes", "sha256"])

    _make_folder(spark, f"{folder}/_temporary")
    rows.mapInArrow(kernel, MANIFEST).write.json(f"{folder}/manifest")
    delete_path(spark, f"{folder}/_temporary")  # what lost attempts left
    return manifest(spark, folder)


def _make_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Columns file, records, bytes, sha256 of the archives that count."""
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Columns page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of all records.

    Archives are read as they come, one record in memory at a time; a payload whose
    digest is not that of its header is an error.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        named = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and (digest(payload) != named or len(payload) != int(headers[PAYLOAD_BYTES])):
                            raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} is damaged")
                        rows.append(
                            {
                                "page_id": int(x) if (x := headers.get(PAGE_ID)) else None,
                                "url": headers["WARC-Target-URI"],
                                "record_type": headers["WARC-Type"],
                                "refers_to": int(x) if (x := headers.get(REFERS_TO)) else None,
                                "payload_bytes": int(headers[PAYLOAD_BYTES]),
                                "payload_digest": named,
                                "payload": payload,
                            }
                        )
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    schema = pa.schema(list(zip(names, kinds)))
    files = manifest(spark, folder).select("file")
    tasks = max(1, -(-files.count() // FILES_PER_TASK))  # a number, or the small rows would be put into one task
    files = files.repartition(tasks, "file")
    return files.mapInArrow(
        kernel,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary",
    )
