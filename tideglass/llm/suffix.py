"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if it lies in a string of `length` bytes that starts at two places or more of the corpus (the same
document included; strings never cross documents and are judged on the input).

Every start has a bucket: first that of its 8-byte gram, then, again and again, that of its bucket and the bucket at the
offset where the gram ends, so a bucket of 16, 32, 64 and 128 bytes is made from two of half the size, and one of any
length up to 384 from three that overlap. Buckets are named by two 64-bit fingerprints of what they refine instead of
ranks, so tasks need no common order and Spark's shuffle by name takes the place of sorting within a bucket.

Texts move once: one row of each distinct text is written to a table that is bucketed by the text's key. Whatever is
then asked of the texts goes to their buckets. Refinement goes only where it can matter:
1. Each window of `length` bytes has an anchor, its least 32-byte gram; windows with one anchor are an item. Equal windows
   have equal anchors at equal offsets. Items whose anchor's bucket is alone in the corpus are done: nothing repeats.
2. Items of one anchor bucket are refined to the bucket of their whole hull (all bytes of all their windows). A hull
   that occurs twice: all its windows repeat.
3. One item of each hull, where a bucket has several, is refined by chunks of CHUNK offsets: a chunk whose common core
   occurs once has no repeat, one whose hull occurs twice repeats throughout.
4. Chunks that are neither are refined to their windows.
Defined cases: null and empty texts, and those shorter than length, keep everything; a text that occurs twice goes
whole; a user's columns stay, but for kept, n_bytes, n_removed and n_spans, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, bounded_batches, chunks, discard, fresh_path, mix64, stage

GRAM, CHUNK = 32, 8
#: Bytes of a text that are looked at together; longer texts go through in pieces that overlap.
PIECE = 1 << 20
#: Bytes of several texts that are looked at together.
GROUP = 1 << 18
#: Bytes of texts in a bucket of the table, about.
BUCKET = 1 << 27
#: Bytes of an item's windows at most: they all hold one gram.
HULL = 2 * 208 - GRAM

SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
LONG = T.LongType()
KEY = ["k1", "k2"]


def buckets(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Names of the buckets of all strings of size (8, 16, ... 128) bytes."""
    n, width = len(data), 8
    out = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = mix64(out ^ SEEDS[seed])
    while width < size:
        a, b = out[:-width], out[width:]
        out = (a ^ (a >> U64(29))) * SEEDS[seed] + b * U64(0xC2B2AE3D27D4EB4F)
        out ^= out >> U64(32)
        width *= 2
    return out


def identity(level: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Names of the strings of 128 to 384 bytes at start, from the 128-byte buckets."""
    size = np.asarray(size)
    second = start + np.minimum(128, size - 128)
    name = mix64(level[start] * U64(0xFF51AFD7ED558CCD) + level[second])
    return mix64(name + level[start + size - 128] * U64(0xC4CEB9FE1A85EC53) + size.astype(U64))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Items of the parts of data that stop at ends: (gram buckets, part, first window, last window, anchor), one for
    each run of windows with one anchor; ties go to the leftmost gram. Windows do not cross parts."""
    grams, sizes = buckets(data, GRAM, 0), np.diff(ends, prepend=0)
    width, span = length - GRAM + 1, 1
    key = (mix64(grams) & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=U64)
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    part = np.repeat(np.arange(len(ends)), sizes)[: len(key)]
    start = np.flatnonzero(np.arange(len(key)) + length <= ends[part])
    at, part = (key[start] & U64(0xFFFFFF)).astype(np.int64), part[start]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return grams, part[first], start[first], start[last], at[first]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each begins (and the last stops); nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), at


def pieces(at: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last): rows of about GROUP bytes together, or a part of a
    long row with overlap bytes of the next part."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > PIECE + overlap:
            for lo in range(at[i], at[i + 1] - overlap, PIECE):
                yield i, i + 1, lo, min(lo + PIECE + overlap, at[i + 1])
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(at, at[i] + GROUP, "right")) - 1)
            yield i, j, at[i], at[j]
            i = j


def mapped(df: DataFrame, names: list[str], fn: Callable[..., Iterator[list[np.ndarray]]], text: int) -> DataFrame:
    """Rows of longs that fn makes of a batch's columns, group by group."""
    schema = T.StructType([T.StructField(n, LONG) for n in names])

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, [text]):
                for out in fn(*piece.columns):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64, copy=False)) for x in out], names=names)

    return df.mapInArrow(run, schema)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, step): which counts times each, with steps 0, 1, ... of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def asked(texts: pa.Array, own: pa.Array, need: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row, place in them, place in the text, asked value) of the values asked of each text, by pieces of the texts.
    The high bits of a value are where it begins; need bytes from there are at hand, or all to the text's end."""
    data, at = raw_bytes(texts)
    value = own.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
    begin = value >> 20
    for i, j, lo, hi in pieces(at, need):
        last = hi == at[j]
        one = (row >= i) & (row < j) & (at[row] + begin >= lo) & ((at[row] + begin < lo + PIECE) | last)
        if one.any():
            r = row[one]
            yield data[lo:hi], r, at[r] + begin[one] - lo, begin[one], value[one]


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def key_of(text: Column) -> dict[str, Column]:
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)}


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2, text, copies: each distinct text once, in a table bucketed by its key. Copies meet before the shuffle."""
    spark, at = docs.sparkSession, fresh_path(docs.sparkSession, "texts")
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A multiple of the shuffle's partitions: every bucket is written by one task.
    parts *= max(1, -(-size // (BUCKET * parts)))
    own = own.withColumns(key_of(F.col("text"))).groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"tideglass_{uuid.uuid4().hex}"
    with bounded_batches(spark):
        own.write.bucketBy(parts, *KEY).option("path", at).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2, spans: lo << 32 | hi for windows from lo to hi that occur twice among distinct texts; some more than once."""
    spark, made = texts.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        made.append(out)
        return out

    def grams_only(text):
        data, at = raw_bytes(text)
        for i, j, lo, hi in pieces(at, length - 1):
            grams, _, _, _, anchor = anchors(data[lo:hi], np.minimum(at[i + 1 : j + 1], hi) - lo, length)
            yield [grams[anchor]]

    def items(k1, k2, text):
        k1, k2, (data, at) = numbers(k1), numbers(k2), raw_bytes(text)
        for i, j, from_, to in pieces(at, length - 1):
            own = data[from_:to]
            grams, part, lo, hi, anchor = anchors(own, np.minimum(at[i + 1 : j + 1], to) - from_, length)
            names = [identity(buckets(own, 128, s), lo, hi - lo + length) for s in (0, 1)]
            row = part + i
            yield [k1[row], k2[row], grams[anchor], *names, (lo + from_ - at[row]) << 20 | (hi - lo) << 12 | (anchor - lo) << 4]

    known = mapped(texts.select("text"), ["gram"], grams_only, 0).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    rows = kept(mapped(texts.select(*KEY, "text"), [*KEY, "gram", "h1", "h2", "place"], items, 2).join(kept(known, "grams"), "gram"), "items")

    begin, span, twice = F.shiftright("place", 20), F.shiftright("place", 12).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(1))
    found_at = lambda: (F.shiftleft(begin, 32).bitwiseOR(begin + span)).alias("span")
    ref = F.xxhash64(*KEY, "place")
    hull = ["gram", "h1", "h2"]
    counts = kept(rows.groupBy(*hull).agg(F.count("*").alias("n"), F.min(ref).alias("of")), "hulls")
    several = counts.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram", F.lit(True).alias("several"))
    counts = counts.join(several, "gram", "left").where("n > 1 or several").select(*hull, (F.col("n") > 1).alias("again"), F.when(F.col("several"), F.col("of")).alias("of"))
    both = rows.join(counts, hull).select(*KEY, "place", "again", F.coalesce(ref == F.col("of"), F.lit(False)).alias("one"))
    both = kept(both.where("again or one"), "refined")
    found = both.where("again").select(*KEY, found_at())
    # One item of each hull, where its anchor's bucket has several.
    wanted = both.where("one").select(*KEY, (F.col("place") + F.col("again").cast("long")).alias("place"))

    def parts(k1, k2, text, own):
        k1, k2 = numbers(k1), numbers(k2)
        for data, row, place, start, value in asked(text, own, HULL):
            levels = [buckets(data, 128, s) for s in (0, 1)]
            a, b, p = place, place + (value >> 12 & 255), place + (value >> 4 & 255)
            low = (p - b) // CHUNK
            which, step = spread((p - a) // CHUNK + 1 - low)
            c, a, b, p, row = low[which] + step, a[which], b[which], p[which], row[which]
            core = p - c * CHUNK
            lo, hi = np.maximum(a, core - CHUNK + 1), np.minimum(b, core)
            names = [identity(levels[0], core, length - CHUNK + 1) + c.astype(U64) * SEEDS[1], *[identity(v, lo, hi - lo + length) for v in levels]]
            yield [k1[row], k2[row], *names, (start - place)[which] + lo << 20 | hi - lo << 12 | (value & 1)[which]]

    def of_texts(places: DataFrame) -> DataFrame:
        own = places.groupBy(*KEY).agg(F.collect_list("place").alias("own"))
        return texts.join(own, KEY).select(*KEY, "text", "own")

    chunk = kept(mapped(of_texts(wanted), [*KEY, "c", "w1", "w2", "place"], parts, 2), "chunks")
    cores = chunk.groupBy("c").agg(F.sum(1 + twice).alias("n"), F.min("w1").alias("low"), F.max("w1").alias("high")).where("n > 1").select("c", (F.col("low") != F.col("high")).alias("kinds"))
    chunk = kept(chunk.join(cores, "c").select(*KEY, "w1", "w2", "place", "kinds"), "cores")
    wholes = chunk.groupBy("w1", "w2").agg(F.sum(1 + twice).alias("n"), F.min(ref).alias("of"))
    both = chunk.join(wholes, ["w1", "w2"]).where("n > 1 or kinds")
    both = kept(both.select(*KEY, "place", (F.col("n") > 1).alias("again"), (F.col("kinds") & (ref == F.col("of"))).alias("left")), "wholes")
    found = found.union(both.where("again").select(*KEY, found_at()))
    # What may hold a window of a chunk that is not yet decided: one chunk of each hull, where a core has several.
    left = both.where("left").select(*KEY, F.when(F.col("again"), F.col("place").bitwiseOR(F.lit(1))).otherwise(F.col("place")).alias("place"))

    def windows(k1, k2, text, own):
        k1, k2 = numbers(k1), numbers(k2)
        for data, row, place, start, value in asked(text, own, CHUNK + length):
            span = value >> 12 & 255
            which, step = spread(span + length)
            near = data[place[which] + step]
            at = np.cumsum(span + length) - span - length
            which, step = spread(span + 1)
            names = [identity(buckets(near, 128, s), at[which] + step, length) for s in (0, 1)]
            yield [k1[row][which], k2[row][which], *names, start[which] + step << 20 | (value & 1)[which]]

    window = kept(mapped(of_texts(left), [*KEY, "x1", "x2", "place"], windows, 2), "windows")
    again = window.groupBy("x1", "x2").agg(F.sum(1 + twice).alias("n")).where("n > 1").select("x1", "x2")
    found = found.union(window.join(again, ["x1", "x2"], "left_semi").select(*KEY, F.shiftleft(begin, 32).bitwiseOR(begin)))
    out = stage(found.groupBy(*KEY).agg(F.collect_list("span").alias("spans")), "spans")
    for df in made:
        discard(df)
    return out


def kept_texts(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """One row of each distinct text (null is empty): k1, k2, kept (the bytes that stay, joined), n_bytes, n_removed and n_spans
    (maximal removed runs)."""
    if not 143 <= length <= 208:
        raise ValueError("length must be 143 to 208 bytes")
    texts = distinct_texts(docs, text)
    spans = repeated_spans(texts.where(F.octet_length("text") >= length), length)
    schema = T.StructType([*[T.StructField(k, LONG) for k in KEY], T.StructField("kept", T.BinaryType()), *[T.StructField(n, LONG) for n in ("n_bytes", "n_removed", "n_spans")]])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, [2]):
                data, at = raw_bytes(part.column(2))
                out: list[list] = [[], [], [], []]
                for i, (copies, own) in enumerate(zip(part.column(3).to_pylist(), part.column(4), strict=True)):
                    raw = data[at[i] : at[i + 1]]
                    gone = np.full(len(raw), copies > 1 and len(raw) >= length)
                    if own.is_valid and not gone.any():
                        value = numbers(own.values)
                        edge = np.bincount(value >> 32, minlength=len(raw) + 1) - np.bincount((value & 0xFFFFFFFF) + length, minlength=len(raw) + 1)
                        gone = np.cumsum(edge[:-1]) > 0
                    starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    for o, x in zip(out, (raw[~gone].tobytes(), len(raw), int(gone.sum()), starts), strict=True):
                        o.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out[0], type=pa.binary()), *[pa.array(o, type=pa.int64()) for o in out[1:]]], names=schema.names)

    return texts.join(spans, KEY, "left").select(*KEY, "text", "copies", "spans").mapInArrow(run, schema)


def join_texts(docs: DataFrame, by_text: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of by_text (k1, k2 and more), which holds each distinct text once."""
    new = [c for c in by_text.columns if c not in KEY]
    own = docs.drop(*[c for c in docs.columns if c.lower() in new])
    keys = key_of(F.coalesce(F.col(text), F.lit("")))
    keyed = own.select(F.struct("*").alias("row"), *[k.alias(n) for n, k in keys.items()])
    return keyed.join(by_text, KEY).select(*[F.col("row").getField(c).alias(c) for c in own.columns], *new)


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """docs with kept, n_bytes, n_removed and n_spans."""
    return join_texts(docs, kept_texts(docs, text, length), text)
