"""Hard negatives by inner product, over a packed R-tree of boxes.

Rows are packed by sort-tile-recursive: range partitions over (vector length, label, the coordinate of greatest variance)
are slabs, range partitions of these over the next coordinate are tiles, and inside a task a tile of at most TILE_VALUES
numbers is packed further, label first and then by the coordinate of greatest spread, into leaves of LEAF rows and nodes of
FAN children. Every node has a minimum bounding box and the interval of its labels. Ties in a coordinate are broken by row, so
equal vectors, however many, are cut over tiles.

For a query q, coordinate i of a box [lo, hi] contributes an interval [min(q*lo, q*hi), max(q*lo, q*hi)]; their sums bound
the scores in the box. A queue holds boxes by their upper bound; a box is dropped if it cannot hold a label that is wanted, if
its interval lies outside every score window, or if its upper bound is strictly below the k-th score of every window. The
rows of a leaf that is popped are scored exactly.

Blocks of queries meet tiles by an equal key of vector length and group, so every query meets every tile once. A task
carries the k best scores of a query from tile to tile, for at most REMEMBERED queries, which only prunes. Ranked windows
with partial limits merge what tasks found. Positives are searched first, and their scores give the windows of the
negatives. Nothing passes through the driver but the sums that size the tiles and the two coordinates.

Defined cases: rows whose id, label or vector is null, or which hold a component that is null or not finite, take no part;
only vectors of an anchor's own length are its candidates (an empty vector scores 0); the anchor's own row is none; rows
that share an id are each a candidate and each an anchor of their own; a score beyond 64 bits is held to their ends, before
it is compared; a double whose scaled value overflows is held to the largest double; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

#: Numbers in a tile (at most), rows of a leaf, children of a node.
TILE_VALUES, LEAF, FAN = 1 << 20, 128, 8
#: Queries of a block, and queries whose best scores a task remembers.
QUERIES, REMEMBERED = 512, 20_000
LEAST, MOST = -(2**63), 2**63 - 1

TILE = T.StructType([T.StructField("dims", T.IntegerType()), T.StructField("no", T.LongType()), T.StructField("kind", T.StringType()), *(T.StructField(c, T.BinaryType()) for c in ("ids", "rows", "labels", "x"))])
BLOCK = T.StructType([T.StructField("dims", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("q_rows", "q_ids", "q_labels", "q", "low", "high", "p_ids", "p_scores"))])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_row", "slot", "anchor_id", "positive_id", "positive_score", "vec_id", "score")])


def participants(vectors: DataFrame, label: Column, id_col: str, vector: str) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; x as it is, of floats or doubles."""
    x = F.col(vector) if vectors.schema[vector].dataType.elementType == T.FloatType() else F.col(vector).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)


def vectors_of(column: pa.ListArray, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of a column's vectors, and for each run of equal lengths the matrix of floor(scale * x)."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return lengths, []
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(flat * scale), -np.finfo(float).max, np.finfo(float).max)
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    out, at = [], 0
    for run in np.split(lengths, cuts):
        size = int(run.sum())
        out.append(flat[at : at + size].reshape(len(run), int(run[0])))
        at += size
    return lengths, out


def packed_order(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Rows in leaf order: slabs along the labels, then along the coordinate of greatest spread, each cut again."""
    out = []

    def cut(rows: np.ndarray) -> None:
        leaves = -(-len(rows) // LEAF)
        if leaves <= 1:
            out.append(rows)
            return
        own = labels[rows]
        if own.min() < own.max():
            key, slabs = own, min(leaves, max(2, len(np.unique(own))))
        else:
            spread = x[rows].max(axis=0) / 2 - x[rows].min(axis=0) / 2 if x.shape[1] else np.zeros(1)
            if not spread.max() > 0:
                out.append(rows)
                return
            key, slabs = x[rows, int(np.argmax(spread))], min(leaves, max(2, math.isqrt(leaves)))
        rows = rows[np.argsort(key, kind="stable")]
        size = -(-leaves // slabs) * LEAF
        for at in range(0, len(rows), size):
            cut(rows[at : at + size])

    cut(np.arange(len(x)))
    return np.concatenate(out)


class Tile:
    """A packed tile: rows in leaf order and, level by level from the root, boxes with the intervals of their labels."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.rows, self.labels, self.x = ids, rows, labels, x
        starts = np.arange(0, len(x), LEAF)
        reduced = lambda f, v, at: f.reduceat(v, at, axis=0)
        levels = [(reduced(np.minimum, x, starts), reduced(np.maximum, x, starts), reduced(np.minimum, labels, starts), reduced(np.maximum, labels, starts))]
        while len(levels[0][0]) > 1:
            lo, hi, first, last = levels[0]
            starts = np.arange(0, len(lo), FAN)
            levels.insert(0, (reduced(np.minimum, lo, starts), reduced(np.maximum, hi, starts), reduced(np.minimum, first, starts), reduced(np.maximum, last, starts)))
        self.lo, self.hi, self.first, self.last = (np.concatenate(v) for v in zip(*levels, strict=True))
        sizes = [len(v[0]) for v in levels]
        self.begins = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        self.level = np.repeat(np.arange(len(sizes)), sizes)
        self.most = float(np.abs(x).max(initial=0))

    def fits(self, q: np.ndarray) -> bool:
        """Whether every score of q is exact in doubles."""
        return self.x.shape[1] * self.most * float(np.abs(q).max(initial=0)) < 2.0**53

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the scores of each box for each query."""
        plus, minus = np.maximum(q, 0).T, np.minimum(q, 0).T
        return self.lo @ plus + self.hi @ minus, self.hi @ plus + self.lo @ minus

    def children(self, i: int) -> tuple[int, int]:
        level = int(self.level[i])
        begin = self.begins[level + 1] + (i - self.begins[level]) * FAN
        return begin, min(begin + FAN, self.begins[level + 2])

    def scores(self, a: int, b: int, q: np.ndarray, exact: bool) -> np.ndarray:
        if exact:
            return (self.x[a:b] @ q).astype(np.int64)
        whole = [sum(int(u) * int(v) for u, v in zip(row, q, strict=True)) for row in self.x[a:b]]
        return np.array([min(max(s, LEAST), MOST) for s in whole], dtype=np.int64)


class Best:
    """The k best (score, id) of each window of one query, with the tile's row of those that this tile gave (else -1)."""

    def __init__(self, windows: int, k: int) -> None:
        self.k = k
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))] * windows
        self.kth = np.full(windows, LEAST, dtype=np.int64)

    def add(self, w: int, scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        s, i, r = (np.concatenate(v) for v in zip(self.held[w], (scores, ids, at), strict=True))
        keep = np.lexsort((i, np.invert(s)))[: self.k]
        self.held[w] = s[keep], i[keep], r[keep]
        if len(keep) == self.k:
            self.kth[w] = s[keep[-1]]

    def forget_rows(self) -> None:
        self.held = [(s, i, np.full(len(s), -1)) for s, i, _ in self.held]


def best_first(tile: Tile, lower: np.ndarray, upper: np.ndarray, q: np.ndarray, label: int, same: bool, own_row: int, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """Puts the tile's rows into best; the number of leaves that were scored."""
    exact = tile.fits(q)
    may = (tile.first <= label) & (label <= tile.last) if same else (tile.first != label) | (tile.last != label)
    top = high.max()
    leaf_level, scored = len(tile.begins) - 2, 0

    def wanted(a: int, b: int) -> np.ndarray:
        if not exact:
            return may[a:b]
        floor = np.maximum(low, best.kth)
        return may[a:b] & ((upper[a:b, None] >= floor) & (lower[a:b, None] <= high)).any(axis=1)

    queue = [(0.0, 0)] if wanted(0, 1)[0] else []
    while queue:
        _, i = heapq.heappop(queue)
        if not wanted(i, i + 1)[0]:
            continue
        if tile.level[i] < leaf_level:
            a, b = tile.children(i)
            for j in np.flatnonzero(wanted(a, b)) + a:
                heapq.heappush(queue, (-min(float(upper[j]), float(top)), int(j)))
            continue
        scored += 1
        a = (i - tile.begins[leaf_level]) * LEAF
        b = min(a + LEAF, len(tile.x))
        s = tile.scores(a, b, q, exact)
        ok = (tile.labels[a:b] == label) == same
        ok &= tile.rows[a:b] != own_row
        for w in range(len(low)):
            got = np.flatnonzero(ok & (s >= max(low[w], best.kth[w])) & (s <= high[w]))
            if len(got):
                best.add(w, s[got], tile.ids[a:b][got], a + got)
    return scored


def tiles(rows: DataFrame, scale: int) -> DataFrame:
    """The packed tiles of (vec_id, row, label, x), which are staged."""
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    count = max(1, -(-values // TILE_VALUES), -(-n // TILE_VALUES))
    spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("s")).orderBy(F.desc_nulls_last("s"), "i").limit(2).collect()
    coordinates = [F.get("x", F.lit(r.i)) for r in spread] + [F.lit(0.0)] * (2 - len(spread))
    keyed = rows.select(F.size("x").alias("dims"), "label", *(c.cast("double").alias(f"c{i}") for i, c in enumerate(coordinates)), "row", "vec_id", "x")
    slabs = keyed.repartitionByRange(max(1, math.isqrt(count)), "dims", "label", "c0", "row").withColumn("slab", F.spark_partition_id())
    order = ["dims", "slab", "c1", "row"]
    dealt = slabs.repartitionByRange(count, "slab", "dims", "c1", "row").sortWithinPartitions(*order)

    def one(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, numbers, labels, x = (np.concatenate(v) for v in zip(*held, strict=True))
        at = packed_order(x, labels)
        most = np.abs(x).max(initial=0)
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        values = [x.shape[1], int(numbers.min()), kind, ids[at].tobytes(), numbers[at].tobytes(), labels[at].tobytes(), x[at].astype(kind).tobytes()]
        types = [pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types, strict=True)], names=TILE.names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            _, runs = vectors_of(batch.column(3), scale)
            ids, numbers, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = 0
            for x in runs:
                if held and held[0][3].shape[1] != x.shape[1]:
                    yield one(held)
                    held = []
                most, done = max(1, TILE_VALUES // max(1, x.shape[1])), 0
                while done < len(x):
                    take = min(len(x) - done, most - sum(len(h[0]) for h in held))
                    a, b = at + done, at + done + take
                    held.append((ids[a:b], numbers[a:b], labels[a:b], x[done : done + take]))
                    done += take
                    if sum(len(h[0]) for h in held) == most:
                        yield one(held)
                        held = []
                at += len(x)
        if held:
            yield one(held)

    return dealt.select("vec_id", "row", "label", "x").mapInArrow(pack, TILE)


def blocks(anchors: DataFrame, scale: int, share: tuple[int, int] | None) -> DataFrame:
    """Blocks of queries from (row, vec_id, label, x) or, with positives, an array of (score, vec_id): one window for each
    positive, from share[0] to share[1] hundredths of its score; without share one open window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, runs = vectors_of(batch.column(3), scale)
            numbers, ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            given = batch.column(4).to_pylist() if share else [[None]] * batch.num_rows
            wide, at = max(map(len, given), default=0), 0
            low, high, p_ids, p_scores = (np.full((batch.num_rows, wide), v, dtype=np.int64) for v in (MOST if share else LEAST, LEAST if share else MOST, 0, 0))
            for r, own in enumerate(given if share else []):
                for w, p in enumerate(own):
                    p_ids[r, w], p_scores[r, w] = p["vec_id"], p["score"]
                    low[r, w] = max(LEAST, min(MOST, -(-share[0] * p["score"] // 100)))
                    high[r, w] = max(LEAST, min(MOST, share[1] * p["score"] // 100))
            for x in runs:
                for a in range(at, at + len(x), QUERIES):
                    cut = slice(a, min(a + QUERIES, at + len(x)))
                    values = [x.shape[1], *(v[cut].tobytes() for v in (numbers, ids, labels)), x[cut.start - at : cut.stop - at].tobytes(), *(v[cut].tobytes() for v in (low, high, p_ids, p_scores))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, [pa.int32(), *[pa.binary()] * 8], strict=True)], names=BLOCK.names)
                at += len(x)

    return anchors.select("row", "vec_id", "label", "x", *(["positives"] if share else [])).mapInArrow(run, BLOCK)


def meet(packed: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """FOUND rows: for each query and window (slot) the k best rows of the same label, or of others."""
    spark = packed.sparkSession
    groups = max(1, min(packed.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = packed.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(groups)))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Best] = {}
        last: tuple[int, Tile] | None = None
        for batch in batches:
            for n in range(batch.num_rows):
                dims, no, kind, ids, rows, labels, x, *query = (c[n].as_py() for c in batch.columns)
                if last is None or last[0] != no:
                    ids, rows, labels = (np.frombuffer(v, dtype=np.int64) for v in (ids, rows, labels))
                    last = no, Tile(ids, rows, labels, np.frombuffer(x, dtype=kind).reshape(len(ids), dims).astype(np.float64))
                tile = last[1]
                q_rows, q_ids, q_labels = (np.frombuffer(v, dtype=np.int64) for v in query[:3])
                q = np.frombuffer(query[3], dtype=np.float64).reshape(len(q_rows), dims)
                low, high, p_ids, p_scores = (np.frombuffer(v, dtype=np.int64).reshape(len(q_rows), -1) for v in query[4:])
                with np.errstate(over="ignore", invalid="ignore"):
                    lower, upper = tile.bounds(q)
                out: list[tuple] = []
                for j, row in enumerate(q_rows.tolist()):
                    open_ = np.flatnonzero(low[j] <= high[j])
                    if not len(open_):
                        continue
                    best = known.get(row) or Best(len(open_), k)
                    if len(known) >= REMEMBERED and row not in known:
                        known.clear()
                    known[row] = best
                    best_first(tile, lower[:, j], upper[:, j], q[j], int(q_labels[j]), same, row, low[j, open_], high[j, open_], best)
                    for w, (s, i, at) in zip(open_.tolist(), best.held, strict=True):
                        for e in np.flatnonzero(at >= 0):
                            out.append((row, w, int(q_ids[j]), int(p_ids[j, w]), int(p_scores[j, w]), int(i[e]), int(s[e])))
                    best.forget_rows()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(FOUND))], names=FOUND.names)

    found = dealt.join(asked, ["dims", "part"]).select(*TILE.names, *BLOCK.names[1:]).mapInArrow(run, FOUND)
    place = F.row_number().over(W.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90),
    id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by every
    and each of its best rows of the same label, the best rows of other labels with a score from share[0] to share[1]
    hundredths of the positive's."""
    own = participants(vectors, F.col("label") if label is None else label, id_col, vector)
    rows = stage(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    packed = stage(tiles(rows, scale), "tiles")
    anchors = rows.where(F.col("vec_id") % every == 0)
    near = meet(packed, blocks(anchors, scale, None), True, positives)
    each = near.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))), lambda p: F.struct(p["score"].alias("score"), p["vec_id"].alias("vec_id"))).alias("positives"))
    known = stage(anchors.join(each, "row"), "anchors")
    far = meet(packed, blocks(known, scale, share), False, negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
