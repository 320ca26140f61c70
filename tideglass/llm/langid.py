"""Language identification by rank-order profiles of character n-grams.

A text's most frequent n-grams (n = 1..3 over lower-cased letters, words bounded by one blank) are ranked; its distance
to a language is the sum over them of how far each is out of place in that language's profile, with the profile's
length as the penalty for n-grams that it lacks. The nearest language wins, ties to the smaller name.

Profiles are counted by grouped aggregation over a sample of the labelled rows: of each language those whose hash falls
below a fraction chosen so that about SAMPLE of them stay (all, if there are fewer), so rare languages are learned too.
The profiles are one broadcast table of grams with the languages that rank them, LANGUAGES * TOP entries at most.
Defined cases: null texts and texts without a letter give und and score 0; rows with null text or label are not learned
from; with nothing to learn from every prediction is und.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, append_columns

#: N-grams of a profile, and of a document that are compared.
TOP = 400
#: Labelled rows of a language that are learned from, about.
SAMPLE = 2_000
#: Languages that fit one broadcast table of profiles (50 MB); more are an error.
LANGUAGES = 10_000


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters as one blank, and one at each end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = points < 0x250
    keep = np.where(small, LETTER[np.where(small, points, 0)], points > 0x36F)
    if not small.all():
        odd = np.flatnonzero(~small)
        keep[odd] = [chr(p).isalpha() for p in points[odd].tolist()]
    out = np.zeros(len(points) + 2, dtype=U64)
    out[1:-1] = np.where(keep, points, 0)
    blank = out == 0
    return out[~(blank & np.concatenate(([False], blank[:-1])))]


LETTER = np.array([chr(p).isalpha() for p in range(0x250)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed as 21 bits a letter (a blank is 0, so one before a gram adds nothing), and how often each occurs."""
    x = letters(text)
    if len(x) < 3:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    two = (x[:-1] << U64(21)) | x[1:]
    three = (two[:-1] << U64(21)) | x[2:]
    return np.unique(np.concatenate((x[x > 0], two, three)), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:top]]


def profiles(rows: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank) of the top n-grams of each language over all rows given."""
    fields = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in batches:
            own: dict[str, list] = {}
            for name, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                own.setdefault(name, []).append(grams(t))
            for name, found in own.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.zeros(len(keys), dtype=np.int64)
                np.add.at(counts, at, np.concatenate([n for _, n in found]))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), type=pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=SENT)

    counted = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null").mapInArrow(run, fields)
    sums = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", place - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


SENT = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def sampled(rows: DataFrame, key: str, lang: str, limit: int = SAMPLE) -> DataFrame:
    """About limit rows of each language, chosen by the hash of their key, spread over all partitions."""
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    shares = [(k, int(1_000_000 * limit / n)) for k, n in counts.items() if n > limit]
    if not shares:
        return rows
    known = F.from_json(F.lit(json.dumps(dict(shares))), "map<string, int>")
    least = F.coalesce(F.try_element_at(known, F.col(lang)), F.lit(1_000_000))
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("profile")), F.lit(1_000_000)) < least)


def predict(docs: DataFrame, learned: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """docs with lang_pred and score (0 to 1: how much nearer the best language is than the worst distance there can be)."""
    found = sorted((r.gram, r.lang, r.rank) for r in learned.collect())  # bounded: sampled() holds the languages, profiles() their grams
    names = sorted({lang for _, lang, _ in found})
    number = {name: i for i, name in enumerate(names)}
    keys = np.array([g for g, _, _ in found], dtype=np.int64).view(U64)
    order = np.argsort(keys, kind="stable")
    vocabulary, first = np.unique(keys[order], return_index=True)
    langs, ranks = (np.array(x, dtype=np.int32)[order] for x in ([number[lang] for _, lang, _ in found], [rank for *_, rank in found]))
    shared = docs.sparkSession.sparkContext.broadcast((names, vocabulary, np.append(first, len(keys)), langs, ranks))

    def one(t: str | None) -> tuple[str, float]:
        names, vocabulary, edge, langs, ranks = shared.value
        mine = ranked(*grams(t), top) if t and names else ()
        if not len(mine):
            return "und", 0.0
        at = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
        have = np.flatnonzero(vocabulary[at] == mine)
        counts = (edge[1:] - edge[:-1])[at[have]]
        place = np.repeat(edge[at[have]] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        # Every gram that a profile lacks is top places out; those that it has are nearer.
        nearer = np.bincount(langs[place], weights=top - np.abs(ranks[place] - np.repeat(have, counts)), minlength=len(names))
        best = int(nearer.argmax())
        return names[best], float(nearer[best] / (top * len(mine)))

    def fn(cols: list[list]) -> list[pa.Array]:
        out = [one(t) for t in cols[0]]
        return [pa.array([x[0] for x in out], type=pa.string()), pa.array([x[1] for x in out], type=pa.float64())]

    return append_columns(docs, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], fn)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from labelled rows that are not held out."""
    known = docs.where(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    learned = profiles(sampled(known.select(id_col, text, lang), id_col, lang), text, lang)
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), held_out(id_col).alias("held_out"))
    return predict(mine, learned, "text").select("doc_id", "held_out", "lang_pred", "score")
