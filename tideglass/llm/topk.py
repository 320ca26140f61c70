"""Exact top-k search by inner product over a bit-sliced index.

Every component becomes floor(scale * x). Rows are cut into blocks; in a block, attribute j is held as bitmaps of the
bits of its value above the block's smallest, most significant slices only (KEEP of them). A query adds the slices
with carry-save bitmap arithmetic, once for each bit of its weight (of the complement for negative weights), which
gives the slices of a quantised score. The k-th largest quantised score is found from the most significant slice
down; rows that lie within the quantisation error of it are the boundary, and their scores are computed exactly.

Every row is indexed (recall 1). Queries are packed into blocks too; blocks of rows are dealt to groups, every block of
queries goes to each group, and the two meet by an equal key of vector length and group. Each pair of blocks returns k
rows a query, and a ranked window merges them. Nothing passes through the driver.
Defined cases: vectors that are null, empty, or hold components that are null or not finite take no part; only vectors of a
query's own dimension are candidates; the query's own row is not; ties go to the smaller id; rows that share an id are each a
candidate and each a query of their own; a null id takes no part; a scaled component or a score that passes 64 bits is held to
their ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, stage

#: Rows of a block, slices kept of each attribute, queries of a block.
BLOCK, KEEP, QUERIES = 16_384, 6, 512

INDEX = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("no", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("rows", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("slices", T.BinaryType()), T.StructField("meta", T.BinaryType())])
PACKED = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("q_ids", T.BinaryType()), T.StructField("q_rows", T.BinaryType()), T.StructField("q", T.BinaryType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    ok = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    ok = ok & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps [attribute, kept slice (least first), word] and meta [attribute]: smallest value, bits left out, bits kept."""
    low = x.min(axis=0)
    u = (x - low).view(U64)  # differences pass 63 bits, but not 64
    bits = np.array([int(v).bit_length() for v in u.max(axis=0)])
    cut = np.maximum(bits - KEEP, 0)
    words = -(-len(x) // 64)
    maps = np.zeros((x.shape[1], KEEP, words * 8), dtype=np.uint8)
    top = (u >> cut.astype(U64)).astype(np.uint8)
    for b in range(KEEP):
        packed = np.packbits((top >> b) & 1, axis=0, bitorder="little")
        maps[:, b, : len(packed)] = packed.T
    return maps.view(U64), np.stack([low, cut, np.minimum(bits, KEEP)], axis=1).astype(np.int64)


def added(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray | None]:
    """Slices (least first) of the sum of bitmaps [row of a stack, word] that are listed by their power of two; all full
    adders of a power work at once."""
    out, power = [], 0
    while any(columns.values()):
        up = columns.setdefault(power + 1, [])
        own = columns[power] = columns.get(power) or []
        stack = np.concatenate(own) if own else None
        while stack is not None and len(stack) >= 3:
            n = len(stack) // 3 * 3
            a, b, c = stack[0:n:3], stack[1:n:3], stack[2:n:3]
            d = a ^ b
            up.append((a & b) | (d & c))
            stack = np.concatenate((d ^ c, stack[n:]))
        if stack is not None and len(stack) == 2:
            up.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(None if stack is None else stack[0])
        columns[power] = []
        power += 1
    return out


def boundary(slices: list[np.ndarray], every: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Rows whose number is at least the k-th largest less slack, from the most significant slice down."""
    sure, equal, value = np.zeros_like(every), every, 0
    for b in range(len(slices) - 1, -1, -1):
        s = slices[b] if slices[b] is not None else np.zeros_like(every)
        high = sure | (equal & s)
        if int(np.bitwise_count(high).sum()) >= k:
            equal, value = equal & s, value | (1 << b)
        else:
            sure, equal = high, equal & ~s
    least = max(0, value - slack)
    above, equal = np.zeros_like(every), every
    for b in range(len(slices) - 1, -1, -1):
        s = slices[b] if slices[b] is not None else np.zeros_like(every)
        if least >> b & 1:
            equal = equal & s
        else:
            above, equal = above | (equal & s), equal & ~s
    return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))


def best(q: np.ndarray, own: int, k: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, maps: np.ndarray, meta: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's k best rows for a query; own is the query's row. maps: the slices [attribute * KEEP + b, word],
    and after them their complements."""
    j = np.flatnonzero(q)
    weight, (_, cut, kept) = np.abs(q[j]).view(U64), meta[j].T
    slack = int(sum(int(w) * ((1 << int(c)) - 1) for w, c in zip(weight, cut, strict=True)))
    at, bit = np.nonzero(weight[:, None] >> np.arange(64, dtype=U64) & U64(1))
    which, b = np.repeat(np.arange(len(at)), kept[at]), np.arange(kept[at].sum()) - np.repeat(np.cumsum(kept[at]) - kept[at], kept[at])
    of = at[which]
    power = bit[which] + b + cut[of]
    line = j[of] * KEEP + b + np.where(q[j[of]] < 0, len(maps) // 2, 0)
    columns = {int(p): [maps[line[power == p]]] for p in np.unique(power)}
    slices = [None if s is None else s & every for s in added(columns)]
    inside = bool((rows == own).any())
    near = boundary(slices, every, k + inside, slack)
    near = near[rows[near] != own]
    if len(q) * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x[near].astype(float)).max(initial=0)) < 2.0**62:
        scores = x[near] @ q
    else:
        whole = x[near].astype(object) @ q.astype(object)
        scores = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in whole], dtype=np.int64)
    order = np.lexsort((ids[near], np.invert(scores)))[:k]
    return ids[near][order], scores[order]


def index(vectors: DataFrame) -> DataFrame:
    """Blocks of all rows of (vec_id, row, x), made where the rows lie, without a shuffle."""

    def block(ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> list:
        maps, meta = sliced(x)
        return [x.shape[1], len(ids), int(rows.min()), ids.tobytes(), rows.tobytes(), x.tobytes(), maps.tobytes(), meta.tobytes()]

    return vectors.mapInArrow(blocked(BLOCK, block, INDEX), INDEX)


def packed(queries: DataFrame) -> DataFrame:
    """Blocks of queries, made where they lie."""
    return queries.mapInArrow(blocked(QUERIES, lambda ids, rows, x: [x.shape[1], ids.tobytes(), rows.tobytes(), x.tobytes()], PACKED), PACKED)


def blocked(size: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray], list], schema: T.StructType) -> Callable:
    """Rows of (vec_id, row, x) gathered by vector length, size at a time, each made into one row."""
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, list[int]]]] = {}
        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = held.setdefault(len(own[2]), [])
                rows.append(own)
                if len(rows) == size:
                    yield one(held.pop(len(own[2])))
        for rows in held.values():
            yield one(rows)

    def one(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
        ids, numbers, x = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(make(ids, numbers, x), kinds, strict=True)], names=schema.names)

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each row whose id is divisible by every."""
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, id_col, vector, scale).select("vec_id", F.monotonically_increasing_id().alias("row"), "x"), "rows")
    blocks = stage(index(rows), "index")
    groups = max(1, min(blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(groups)))
    queries = packed(rows.where(F.col("vec_id") % every == 0)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, n, ids, numbers, x, maps, meta, q_ids, q_rows, q = (c[i].as_py() for c in batch.columns)
                ids, numbers, q_ids, q_rows = (np.frombuffer(v, dtype=np.int64) for v in (ids, numbers, q_ids, q_rows))
                x, meta, q = np.frombuffer(x, dtype=np.int64).reshape(n, dims), np.frombuffer(meta, dtype=np.int64).reshape(dims, 3), np.frombuffer(q, dtype=np.int64).reshape(-1, dims)
                maps = np.frombuffer(maps, dtype=U64).reshape(dims * KEEP, -1)
                whole = np.zeros(maps.shape[1] * 8, dtype=np.uint8)
                bits = np.packbits(np.ones(n, dtype=np.uint8), bitorder="little")
                whole[: len(bits)] = bits
                whole, maps, out = whole.view(U64), np.concatenate((maps, ~maps)), ([], [], [], [])
                for q_id, q_row, one in zip(q_ids, q_rows, q, strict=True):
                    got, scores = best(one, int(q_row), k, ids, numbers, x, maps, meta, whole)
                    for o, v in zip(out, (np.full(len(got), q_id), np.full(len(got), q_row), got, scores), strict=True):
                        o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=FOUND.names)

    with_queries = blocks.join(queries, ["dims", "part"]).select("dims", "n", "ids", "rows", "x", "slices", "meta", "q_ids", "q_rows", "q")
    place = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return with_queries.mapInArrow(run, FOUND).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
