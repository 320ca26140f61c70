"""What the corpus operators share: batch mapping, shared-folder tables, shingles, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of about so many bytes are handled at once inside a task.
CHUNK_BYTES = 1 << 22
#: Rows of an Arrow batch: several workers of an executor hold one each, with texts and what is made of them.
BATCH_ROWS = 1_000
#: A table of ids of at most so many rows (16 bytes each) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else (local master only) a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="tideglass-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tideglass-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str = "part") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(ids: DataFrame, limit: int = BROADCAST_ROWS, parts: str | None = None) -> DataFrame:
    """ids (already staged) with a broadcast hint only if its counted rows, or the elements of its array column parts,
    are within the limit."""
    if parts is None:
        return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids
    n = ids.agg(F.count("*") + F.coalesce(F.sum(F.size(parts)), F.lit(0))).first()[0]
    return F.broadcast(ids) if n <= limit else ids


def bound_session(spark: SparkSession) -> None:
    """For an application over long texts: its session's Arrow batches hold BATCH_ROWS rows at most, also in maps that run
    after the operators have returned. Operators themselves leave the session as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Within it the session's Arrow batches hold BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name, None)
    now = int(was or "10000")
    if 0 < now <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    fn: Callable[[list], list[pa.Array]],
    arrow: bool = False,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """df with new columns computed by fn over chunks of the input columns, as Arrow batches inside tasks.

    Columns of df that have a new column's name (in either case) are replaced. fn gets Python lists,
    or the Arrow arrays themselves; after runs when a task's rows are done.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    clash = [c for c in inputs if c.lower() in names]
    n, extra = len(kept), [F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(clash)]
    frame = df.select(*[F.col(f"`{f.name}`") for f in kept], *extra)
    at = [next(i for i, f in enumerate(kept) if f.name == c) if c not in clash else n + clash.index(c) for c in inputs]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, at):
                new = fn([piece.column(i) if arrow else piece.column(i).to_pylist() for i in at])
                cols = [piece.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays(cols + new, names=[f.name for f in schema.fields])
        if after:
            after()

    return frame.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, at: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK_BYTES of the read columns each."""
    if not batch.num_rows:
        return
    size = sum(batch.column(i).nbytes for i in at) or 1
    step = max(1, int(batch.num_rows * CHUNK_BYTES / size))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: A-Z lower-cased, words are runs without \\x20 and \\x09-\\x0D."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=len(words))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hash of each shingle of width words in order; fewer words give one shingle; no word gives none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, U64(k))
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019)
        h ^= h >> U64(29)
    return mix64(h)


def circulant_minima(hashes: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """k MinHash coordinates of a set from two permutations of Z/2^32: the first scatters the set once, and the
    second, shifted circularly by i, gives coordinate i."""
    out = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    shifts = np.arange(k, dtype=np.uint32)[:, None]
    scattered = first_permutation(hashes)
    for at in range(0, len(scattered), block):
        np.minimum(out, second_permutation(scattered[None, at : at + block] - shifts).min(axis=1), out=out)
    return out


def first_permutation(hashes: np.ndarray) -> np.ndarray:
    x = hashes.astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def second_permutation(x: np.ndarray) -> np.ndarray:
    """In place where x is a fresh array; a bijection of 32-bit words."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    x ^= x >> np.uint32(15)
    return x


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): comp is the smallest id reachable over the undirected edges, for every id in them.

    Labels fall to the smallest neighbour's and then to their label's own label, so chains halve in each round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stage(both.union(both.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("id")).groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near, F.col("id") == F.col("u")).select("id", F.least("comp", "m").alias("c"), F.col("comp").alias("was"))
        step = stage(step, "step")
        up = step.select(F.col("id").alias("up"), F.col("c").alias("upper"))
        new = stage(step.join(up, F.col("c") == F.col("up")).select("id", F.least("c", "upper").alias("comp"), "was"), "labels")
        labels = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            return labels


def row_key(*columns: str) -> Column:
    """128-bit digest of the columns' values, nulls told apart from all others."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.md5(F.concat(*parts)))


def utf8_length(c: Column | str) -> Column:
    return F.octet_length(c)
