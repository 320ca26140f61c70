"""Benchmark decontamination: short test items inside long documents by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle set into classes of up to 2^c. For class c a document is cut into
blocks of 2^c shingles, and each two neighbouring blocks are a window, so an item copied whole lies within one window
whose size is bounded by the class. An item is a candidate for a document when a MinHash coordinate of the item equals
that of a window (one row a band: at containment 0.8 the Jaccard similarity is at least 0.19, and 64 coordinates all
miss with probability 1e-6). Classes begin at 2^3; items of at most SMALL shingles are candidates where any of their
shingles is found, which misses none. Candidates are verified by exact containment of the item's whole set in the document's
whole set: 100 * shared >= percent * size.

The items' index is made on executors in parts of about ITEMS items and at most BYTES of text, each of which is broadcast;
more items mean more passes over the documents.
Defined cases: null or wordless texts match nothing and items without words are never found; an item or document of
fewer words than the width is one shingle; repeated items and documents give repeated results.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, append_columns, first_permutation, second_permutation, shingle_hashes, stage

U8 = np.uint8
COORDINATES = 64
#: Items of at most so many shingles are looked up by each of them instead.
SMALL = 4
#: Shingles that a task looks at together.
GROUP = 1 << 16
#: Items, and bytes of their texts, of one broadcast index, about: 64 keys of 16 bytes an item, a shingle of 8 bytes for
#: every 5 bytes of text or more, and 2^BITS / 8 bytes for each of at most 30 classes; 100 MB at most.
ITEMS, BYTES, BITS = 50_000, 20_000_000, 23

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_shared", T.LongType())]))


class Index:
    """MinHash values of the items by class and coordinate."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, self.ids, self.sets = width, [], []
        by_class: dict[int, list[int]] = defaultdict(list)
        small: list[int] = []
        for item_id, text in items:
            s = np.unique(shingle_hashes(text, width))
            if len(s):
                if len(s) > SMALL:
                    by_class[int(len(s) - 1).bit_length()].append(len(self.ids))
                else:
                    small.append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(s)
        keys = np.concatenate([self.sets[i] for i in small]) if small else np.zeros(0, dtype=U64)
        order = np.argsort(keys, kind="stable")
        self.small = keys[order], np.repeat(np.array(small, dtype=np.int64), [len(self.sets[i]) for i in small])[order]
        self.classes = {}
        for c, own in sorted(by_class.items()):
            values = np.stack([minima(self.sets[i], np.array([0]))[:, 0] for i in own], axis=1)
            keys = keyed(values).ravel()
            order = np.argsort(keys, kind="stable")
            bits = min(BITS, max(16, int(len(keys) * 32).bit_length()))
            seen = np.zeros(1 << (bits - 3), dtype=np.uint8)
            at = spread(keys, bits)
            np.bitwise_or.at(seen, at >> U64(3), U8(1) << (at & U64(7)).astype(np.uint8))
            self.classes[c] = (keys[order], np.tile(np.array(own), COORDINATES)[order], seen, bits)

    def candidates(self, sets: list[np.ndarray]) -> dict[int, set[int]]:
        """Items that share a coordinate with a window, or a shingle if they are small, by place of the document; all documents go through together."""
        found: dict[int, set[int]] = defaultdict(set)
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        if not sizes.sum():
            return found
        x, blocks, size = np.concatenate(sets), None, None
        keys, own = self.small
        if len(keys):
            lo, hi = np.searchsorted(keys, x), np.searchsorted(keys, x, side="right")
            for i in np.flatnonzero(hi > lo):
                found[int(np.searchsorted(ends, i, side="right"))].update(own[lo[i] : hi[i]].tolist())
        for c, (keys, own, seen, bits) in self.classes.items():
            counts = sizes if blocks is None else n
            step = 1 << (c if blocks is None else c - size)
            n = -(-counts // step)
            starts = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
            blocks, size = minima(x, starts) if blocks is None else np.minimum.reduceat(blocks, starts, axis=1), c
            doc = np.repeat(np.arange(len(sets)), n)
            windows = blocks.copy()
            together = np.flatnonzero(doc[:-1] == doc[1:])
            windows[:, together] = np.minimum(blocks[:, together], blocks[:, together + 1])
            wanted = keyed(windows)
            at = spread(wanted, bits)
            k, w = np.nonzero(seen[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & U8(1))
            hits = wanted[k, w]
            lo, hi = np.searchsorted(keys, hits), np.searchsorted(keys, hits, side="right")
            for i in np.flatnonzero(hi > lo):
                found[int(doc[w[i]])].update(own[lo[i] : hi[i]].tolist())
        return found

    def matches(self, texts: list[str | None], percent: int) -> list[list[dict]]:
        """For each text the items that it contains. Texts go through in groups of about GROUP shingles."""
        out: list[list[dict]] = []
        sets: list[np.ndarray] = []
        total = 0
        for t in texts:
            sets.append(shingle_hashes(t, self.width))
            total += len(sets[-1])
            if total >= GROUP:
                out += self.verified(sets, percent)
                sets, total = [], 0
        return out + self.verified(sets, percent)

    def verified(self, sets: list[np.ndarray], percent: int) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in sets]
        for d, near in self.candidates(sets).items():
            whole = np.unique(sets[d])
            for i in sorted(near):
                s = self.sets[i]
                at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
                shared = int((whole[at] == s).sum())
                if 100 * shared >= percent * len(s):
                    out[d].append({"item_id": self.ids[i], "n_item": len(s), "n_shared": shared})
        return out


def keyed(values: np.ndarray) -> np.ndarray:
    """Values [coordinate, column] with their coordinate in the upper half."""
    return values.astype(U64) | (np.arange(len(values), dtype=U64)[:, None] << U64(32))


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)


def minima(x: np.ndarray, starts: np.ndarray, step: int = 4096) -> np.ndarray:
    """Coordinates of the blocks of hashes that begin at starts."""
    x = first_permutation(x)
    shifts = np.arange(COORDINATES, dtype=np.uint32)
    out = np.empty((COORDINATES, len(starts)), dtype=np.uint32)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(x), step)))
    for a, b in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        if a < b:
            lo, hi = starts[a], starts[b] if b < len(starts) else len(x)
            for k in range(0, COORDINATES, 16):
                values = second_permutation(x[None, lo:hi] - shifts[k : k + 16, None])
                out[k : k + 16, a:b] = np.minimum.reduceat(values, starts[a:b] - lo, axis=1)
    return out


def contained_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80, out: str = "matches") -> DataFrame:
    """docs with out: an array of (item_id, n_item, n_shared), one for each item that the document contains."""
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-size // BYTES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for batch in batches:
            for part, *item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own[part].append(tuple(item))
        for part, rows in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int64()), pa.array([pickle.dumps(Index(rows, width), protocol=5)], type=pa.binary())], names=["part", "index"])

    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"), "item_id", "text").repartition(parts, "part")
    made = stage(dealt.mapInArrow(build, "part long, index binary"), "indexes")
    names = []
    for k in range(parts):
        row = made.where(F.col("part") == k).first()  # one part, bounded as above
        index = docs.sparkSession.sparkContext.broadcast(pickle.loads(row["index"]) if row else Index([], width))

        def fn(cols: list[list], index=index) -> list[pa.Array]:
            return [pa.array(index.value.matches(cols[0], percent), type=pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64())])))]

        names.append(out if k == 0 else f"__{out}_{k}")
        docs = append_columns(docs, [text], [T.StructField(names[-1], MATCH)], fn)
    if parts > 1:
        docs = docs.withColumn(out, F.concat(*names)).drop(*names[1:])
    return docs


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that contain an item."""
    flagged = contained_items(docs, items, out="__matches", **options)
    return flagged.where(F.size("__matches") == 0).select(docs.columns)
