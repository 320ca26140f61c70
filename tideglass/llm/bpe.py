"""Byte-level BPE encoding and decoding.

encode() splits each text by the tokenizer's pattern. A pre-token that is itself in the vocabulary is resolved by a
minimal perfect hash over the vocabulary; any other is merged by a heap of adjacent pairs over its linked bytes.
A null text counts as empty (no ids); repeated rows give repeated results; other columns pass through, and a column
with the name of an output is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import U64, append_columns, mix64

#: Pre-tokens whose ids a task remembers (about 80 MB).
MEMO = 400_000
MASK = (1 << 64) - 1


class Memory(dict):
    """Ids of pre-tokens; one that is not there is resolved when it is asked for. A full memory begins anew."""

    def __init__(self, resolve: Callable[[str], bytes]):
        super().__init__()
        self.resolve = resolve

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = out = self.resolve(piece)
        return out


@dataclass
class Vocabulary:
    """Tokens by id, and a minimal perfect hash from a token's bytes to its id."""

    tokens: list[bytes]
    pattern: str
    shift: list[int]
    slot_id: list[int]
    ranks: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.tokens, self.pattern, self.shift, self.slot_id

    def __setstate__(self, state):
        self.tokens, self.pattern, self.shift, self.slot_id = state
        self.ranks, self.memo = {}, {}

    def ready(self) -> Vocabulary:
        if not self.ranks:
            self.ranks = {t: i for i, t in enumerate(self.tokens) if t is not None}
            self.split = regex.compile(self.pattern).findall
            self.packed = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
            self.memo = Memory(self.resolve)
        return self

    def lookup(self, piece: bytes) -> int:
        """Id of a piece that is a token, else -1: its bucket's shift names the one slot where it can be."""
        h = xxhash.xxh64_intdigest(piece)
        d = self.shift[h % len(self.shift)]
        if d < 0:
            slot = -d - 1
        else:
            x = (h + d * 0x9E3779B97F4A7C15) & MASK
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
            slot = (x ^ (x >> 31)) % len(self.slot_id)
        i = self.slot_id[slot]
        return i if self.tokens[i] == piece else -1

    def resolve(self, piece: str) -> bytes:
        """Ids of a pre-token, four bytes each."""
        raw = piece.encode("utf-8", "surrogatepass")
        i = self.lookup(raw)
        return self.packed[i] if i >= 0 else b"".join([self.packed[i] for i in merge(raw, self.ranks)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))


def slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix64(h + d.astype(U64) * U64(0x9E3779B97F4A7C15)) % U64(n)).astype(np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank, leftmost first, is joined until no pair is a token.

    Bytes are linked both ways; an entry of the heap holds a pair's rank, start and end, and is stale once they moved."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get, live = ranks.get, n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue
        far = after[i] = after[j]
        end[i], end[j] = stop, 0
        live -= 1
        if far < n:
            before[far] = i
            if (r := get(piece[i : end[far]])) is not None:
                heappush(heap, (r, i, end[far]))
        b = before[i]
        if b >= 0 and (r := get(piece[b:stop])) is not None:
            heappush(heap, (r, b, stop))
    out, i = [], 0
    for _ in range(live):
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a file of base64 tokens with ranks, and build the hash: keys fall into buckets of about three; buckets
    take, largest first, the first shift that sends their keys to free slots; single keys take the slots left."""
    with open(path, "rb") as f:
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
    tokens: list = [None] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[rank] = token
    keys = [t for t, _ in pairs]
    ids = np.array([r for _, r in pairs], dtype=np.int64)
    h, n = np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=U64, count=len(keys)), len(keys)
    m = n // 3 + 1
    bucket = (h % U64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(m + 1))
    members = sorted((order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a), key=len, reverse=True)
    shift, slot_id, free = np.zeros(m, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.ones(n, dtype=bool)
    rest: list[np.ndarray] = []
    for own in members:
        if len(own) == 1:
            rest.append(own)
            continue
        start = 0
        while True:
            d = np.arange(start, start + 256, dtype=np.int64)
            s = slots(h[own][None, :], d[:, None], n)
            fits = free[s].all(axis=1)
            for i in np.flatnonzero(fits):
                if len(set(s[i].tolist())) == len(own):
                    break
            else:
                start += 256
                continue
            free[s[i]], slot_id[s[i]], shift[bucket[own[0]]] = False, ids[own], d[i]
            break
    for own, s in zip(rest, np.flatnonzero(free), strict=False):
        slot_id[s], shift[bucket[own[0]]] = ids[own[0]], -s - 1
    return Vocabulary(tokens, pattern, shift.tolist(), slot_id.tolist())


def list_array(rows: list[bytes]) -> pa.Array:
    """Rows of four-byte ids as lists."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with out: the ids of every whole text, as array<int>. The vocabulary, a fixed file, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def fn(cols: list[list]) -> list[pa.Array]:
        v = shared.value.ready()
        return [list_array([v.encode(t) if t else b"" for t in cols[0]])]

    return append_columns(df, [text], [T.StructField(out, T.ArrayType(T.IntegerType(), True))], fn, after=lambda: shared.value.memo.clear())


def bytes_array(rows: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    """The bytes that each row's ids stand for."""
    edge = rows.offsets.to_numpy()
    flat, edge = rows.values.to_numpy(zero_copy_only=False)[edge[0] : edge[-1]].tolist(), (edge - edge[0]).tolist()
    return pa.array([b"".join(map(tokens.__getitem__, flat[a:b])) for a, b in zip(edge, edge[1:], strict=False)], type=pa.binary())


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with out: the bytes that the ids stand for (null ids: no bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def fn(cols: list[pa.Array]) -> list[pa.Array]:
        return [bytes_array(cols[0].fill_null([]) if cols[0].null_count else cols[0], shared.value.tokens)]

    return append_columns(df, [ids], [T.StructField(out, T.BinaryType())], fn, arrow=True)


def encode_and_decode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with encode's and decode's column. One after the other they hold two Python workers a task; here one makes the
    ids and then decodes them."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    fields = [T.StructField(out, T.ArrayType(T.IntegerType(), True)), T.StructField(decoded, T.BinaryType())]

    def fn(cols: list[list]) -> list[pa.Array]:
        v = shared.value.ready()
        ids = list_array([v.encode(t) if t else b"" for t in cols[0]])
        return [ids, bytes_array(ids, v.tokens)]

    return append_columns(df, [text], fields, fn, after=lambda: shared.value.memo.clear())
