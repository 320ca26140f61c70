"""Deterministic sharded WARC files, written and read back.

Records are dealt to shards by ranges of their id, cut so that each shard has about the same number of payload bytes
(ranges that weigh too much are cut again, so ids may be spread in any way), and sorted within a shard; a shard's files roll when their compressed size passes `roll_bytes`. Headers and digests are
made anew, dates and record ids follow from the data, and gzip members carry no time, so equal input gives equal files. A
file is written under a temporary name and renamed when whole, and a shard's files are listed in a manifest table that
is committed last; readers take only files in the manifest. A task that is run again writes the same bytes again.

Payloads are equal if their SHA-1, their length and another 64-bit hash are. Of records with equal payloads of at least `dedup_bytes`, that with the smallest page_id is the response and others are
revisits of it. Defined cases: null html is an empty payload; null urls have no target header; records without a
page_id are dealt by their payload, and are never referred to while another is there; repeated rows: one response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, fresh_path, small_or_shuffled, stage

ROLL_BYTES = 64 << 20
#: Payload bytes of a shard: about the first of large archives, at least the second of small ones, which have up to SHARDS.
SHARD_BYTES, LEAST_BYTES, SHARDS = 256 << 20, 4 << 20, 64
#: Id ranges that are weighed at a time to cut shards.
CELLS = 4096
NAMESPACE = uuid.UUID("6c0a4c1e-7b0e-4b1f-9d53-0e6b6f7c2a11")
DATE = "2024-01-01T00:00:00Z"

MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One uncompressed record."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest))]
        if first is not None:
            head.append(("X-Refers-To-Page-Id", str(first)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Shard:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, root: str, shard: int, roll: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.roll, self.number, self.out, self.done = shard, roll, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:04d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.records, self.size, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        data = member(data)
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def shard_starts(pages: DataFrame, shards: int) -> list[int]:
    """First id of each shard but the first, in order; some shards may be empty. pages: page_id, size.

    Ids are cut into equal ranges; a range that weighs more than a shard is cut again, until it is one id or light enough.
    Ranges alone decide, so equal rows give equal shards. At most CELLS weights and as many for each round's heavy ranges
    come to the driver, in at most 1 + 64 / log2(fan) rounds."""
    weighed = pages.where("page_id is not null").select("page_id", (F.col("size") + 512).alias("bytes"))
    lo, hi, total = weighed.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if lo is None or shards < 2:
        return []
    limit, done, todo = max(1, total // shards), [], [(lo, hi + 1)]
    while todo:
        fan = max(16, CELLS // len(todo))
        steps = [max(1, -(-(b - a) // fan)) for a, b in todo]
        found = spans_of(weighed, todo, steps)
        again = []
        for k, cell, size in found:
            a = todo[k][0] + cell * steps[k]
            b = min(a + steps[k], todo[k][1])
            if size > limit and b - a > 1:
                again.append((a, b))
            else:
                done.append((a, size))
        todo = again
    starts, run, number = [], 0, 0
    for a, size in sorted(done):
        while number + 1 < shards and run * shards >= (number + 1) * total:
            number += 1
            starts.append(a)
        run += size
    return starts


def spans_of(weighed: DataFrame, spans: list[tuple[int, int]], steps: list[int]) -> list[tuple[int, int, int]]:
    """(number of the span, cell in it, bytes) of the rows in spans, which are cut into cells of steps ids."""
    first, last = np.array([a for a, _ in spans], dtype=np.int64), np.array([b - 1 for _, b in spans], dtype=np.int64)
    wide = np.array(steps, dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            k = np.searchsorted(first, ids, side="right") - 1
            inside = (k >= 0) & (ids <= last[k])
            k, ids, size = k[inside], ids[inside], size[inside]
            cell = (ids.view(U64) - first[k].view(U64)) // wide[k]  # differences may pass 63 bits
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(size)], names=["k", "cell", "bytes"])

    rows = weighed.mapInArrow(run, "k int, cell long, bytes long").groupBy("k", "cell").agg(F.sum("bytes").alias("bytes")).collect()
    return sorted((r.k, r.cell, r.bytes) for r in rows)


def qualified(spark, root: str) -> str:
    """root with the scheme of the session's default file system, if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html", dedup_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> tuple[str, DataFrame]:
    """(folder, manifest) of the archive of all rows."""
    spark = pages.sparkSession
    root = qualified(spark, (root or fresh_path(spark, "warc")).rstrip("/"))
    fs, at = pafs.FileSystem.from_uri(root)
    fs.create_dir(at)
    same_as = ["digest", "check", "size"]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    keys = [F.sha1("html").alias("digest"), F.xxhash64("html").alias("check"), F.octet_length("html").cast("long").alias("size")]
    keyed = stage(rows.select("page_id", *keys), "digests")
    if shards is None:
        total = keyed.agg(F.sum("size")).first()[0] or 0
        shards = max(-(-total // SHARD_BYTES), min(SHARDS, -(-total // LEAST_BYTES)), 1)
    starts = np.array(shard_starts(keyed, shards), dtype=np.int64)
    same = keyed.where(F.col("size") >= dedup_bytes).groupBy(*same_as).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.select("*", *keys).join(small_or_shuffled(stage(same, "equal")), same_as, "left")
    # Rows that share the smallest id: the first in order is the response.
    twice = stage(keyed.groupBy("page_id", *same_as).agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("t_id"), F.col("digest").alias("t_digest"), F.col("check").alias("t_check")), "twice")
    if twice.isEmpty():
        rows = rows.withColumn("copy", F.lit(1))
    else:
        numbered = rows.join(small_or_shuffled(twice), F.col("page_id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest")) & (F.col("check") == F.col("t_check")), "left")
        many = numbered.where("t_digest is not null").withColumn("salt", F.monotonically_increasing_id())
        best = many.groupBy("page_id", "digest", "check").agg(F.min(F.struct("url", "salt")).alias("best")).select(F.col("page_id").alias("b_id"), F.col("digest").alias("b_digest"), F.col("check").alias("b_check"), F.col("best.url").alias("b_url"))
        # Of rows alike in id and payload the one with the smallest url answers; rows alike in all are told apart by the writer.
        numbered = numbered.join(small_or_shuffled(stage(best, "best")), F.col("page_id").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest")) & (F.col("check") == F.col("b_check")), "left")
        rows = numbered.withColumn("copy", F.when(F.col("t_digest").isNull(), 1).when(F.col("url").eqNullSafe(F.col("b_url")), 0).otherwise(2))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, page_id, side="right"))

    # A null id is no number to search for: such rows are dealt by their payloads, so that equal ones meet in order.
    shard = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")).otherwise(shard_of(F.coalesce("page_id", F.lit(0).cast("long"))))
    dealt = rows.select(shard.alias("shard"), "page_id", "digest", "check", "copy", "url", "html", "first", "n").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "check", "copy", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, last = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                number, page_id, digest, check, copy, target, text, first, n = (batch.column(j)[i].as_py() for j in range(9))
                if own is None or own.shard != number:
                    if own:
                        own.close()
                        done += own.done
                    own = Shard(root, number, roll_bytes)
                again = (page_id, digest, check) == last  # a row alike in id and payload went before
                last = (page_id, digest, check)
                revisit = n is not None and (page_id != first or copy == 2 or (copy == 0 and again))
                own.add(record(page_id, target, text.encode("utf-8", "surrogatepass"), first, revisit))
        if own:
            own.close()
            done += own.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=MANIFEST.names)

    manifest = dealt.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{root}/_manifest")
    return root, spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a file of gzip members, one after another."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        raw = z.decompress(view) + z.flush()
        if not z.eof:
            raise ValueError("a member is cut off")
        view = view[len(view) - len(z.unused_data) :]
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])


def read(spark, root: str, manifest: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """The records of an archive's files that its manifest lists; digests of blocks and payloads are checked. A listed file
    that is not there is an error."""
    root = qualified(spark, root)
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest") if manifest is None else manifest
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(root)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1))
    lost = manifest.join(files.select("file"), "file", "left_anti").limit(1).collect()
    if lost:
        raise FileNotFoundError(f"{lost[0].file} of {root} is in the manifest, but not there")
    listed = files.join(small_or_shuffled(manifest), "file", "left_semi").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for h, block in records(batch.column(0)[i].as_buffer()):
                    if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {h['WARC-Record-ID']}")
                    http, _, body = bytes(block).partition(b"\r\n\r\n")
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']}")
                    n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((number("X-Page-Id"), h.get("WARC-Target-URI"), body if payload and h["WARC-Type"] == "response" else None, n, digest, h["WARC-Type"], number("X-Refers-To-Page-Id")))
                    size += n
                    if size > 1 << 24:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return listed.mapInArrow(run, READ)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=READ.names)
