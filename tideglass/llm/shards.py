"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered from 0 in the order of given columns, then of a digest of the whole row, so the numbers depend on the
rows alone and not on files, partitions or executors. A keyed Feistel network of an even number of rounds permutes the
words of just enough bits; a number that falls outside the table walks on along its cycle until it falls inside, which
makes it a permutation of the row numbers themselves. Shard and slot are the remainder and the quotient of the permuted
number by the number of shards: counts differ by one at most, slots have no gaps, and both can be computed from a row
number, and the row number from them, without any table (`place`, `row_number_at`).

Numbering sorts rows once over range partitions and counts each partition; only these counts reach the driver, one for
each partition. Equal keys are told apart by the digest, so a hot or null key is cut over several partitions.

Defined cases: null keys come first; rows that are equal in every column get consecutive numbers, in any order among
themselves; an empty table has no places; columns named row_number, shard or slot (in either case) are replaced; equal
texts are not held together, since the counts of shards may differ by one only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, row_key, stage

#: Rounds of the network (even, so that both halves have their sizes again at its end) and the prime of its round function.
ROUNDS, PRIME = 8, 2**31 - 1


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below 2^30 for each round."""
    words = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(ROUNDS))
    at = [int.from_bytes(words[32 * i + j : 32 * i + j + 4]) >> 2 for i in range(ROUNDS) for j in (0, 8)]
    return list(zip(at[::2], at[1::2], strict=True))


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half for n rows (below 2^60)."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def scrambled(half: np.ndarray, a: int, b: int) -> np.ndarray:
    """The round function; every product stays below 2^62."""
    v = (half + a) % PRIME
    v = (v * v + b) % PRIME
    v = (v * (a | 1) + b) % PRIME
    return v ^ (v >> 15)


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0 to n - 1, or its inverse, of an int64 array."""
    left, right = widths(n)
    keys, out = round_keys(seed), x.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        if not back:
            hi, lo, w = v >> right, v & ((1 << right) - 1), (left, right)
            for a, b in keys:
                hi, lo, w = lo, hi ^ (scrambled(lo, a, b) & ((1 << w[0]) - 1)), (w[1], w[0])
        else:
            hi, lo, w = v >> right, v & ((1 << right) - 1), (left, right)
            for a, b in reversed(keys):
                hi, lo, w = lo ^ (scrambled(hi, a, b) & ((1 << w[1]) - 1)), hi, (w[1], w[0])
        out[todo] = hi << right | lo
        todo = todo[out[todo] >= n]
    return out


def place(row_numbers: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers of a table of n rows."""
    at = permute(np.asarray(row_numbers), n, seed)
    return at % shards, at // shards


def row_number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row numbers that lie at (shard, slot)."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, back=True)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int], int]:
    """rows with __at, whose upper bits name a range partition and whose lower 33 bits count in it; the row number at
    which each partition begins; the number of rows."""
    keys = [*(F.asc_nulls_first(f"`{c}`") for c in order), F.asc("__key")]
    keyed = rows.withColumn("__key", row_key(*rows.columns))
    ordered = stage(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__key").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    starts, n = {}, 0
    for part, count in sorted(ordered.groupBy(F.shiftright("__at", 33).alias("part")).count().collect()):
        starts[part], n = n, n + count
    return ordered, starts, n


def assign(rows: DataFrame, shards: int = 16, order: list[str] | None = None, seed: int = 0) -> DataFrame:
    """rows with row_number, shard and slot; order: the columns that number them (all, if not given)."""
    if shards < 1:
        raise ValueError("at least one shard")
    named = [c for c in rows.columns if c.lower() not in ("row_number", "shard", "slot")]
    ordered, starts, n = numbered(rows.select(*(f"`{c}`" for c in named)), order if order is not None else named)
    base = np.zeros(max(starts, default=0) + 1, dtype=np.int64)
    for part, at in starts.items():
        base[part] = at

    def places(columns: list[pa.Array]) -> list[pa.Array]:
        at = columns[0].to_numpy(zero_copy_only=False)
        numbers = base[at >> 33] + (at & ((1 << 33) - 1))
        shard, slot = place(numbers, n, shards, seed)
        return [pa.array(numbers), pa.array(shard.astype(np.int32)), pa.array(slot)]

    fields = [T.StructField("row_number", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return append_columns(ordered, ["__at"], fields, places, arrow=True).drop("__at")


def write(placed: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of slots over its files; replaces what lies at path."""
    order = ["shard", "slot"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shard").mode("overwrite").parquet(path)
