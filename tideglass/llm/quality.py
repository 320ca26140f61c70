"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence of a document is the log-likelihood ratio of its features (shares of byte classes, word and line statistics),
each cut into bins whose rates are counted over all labelled rows by grouped aggregation. Its site gives the prior:
host and path rates are posteriors of a Beta prior centred on the level above (global, then host), with the prior's
weight M fitted by moments from how much hosts (paths) differ, so sparse sites fall back to the level above.

A site is the part of `source` before the first '/', a path the whole of it. Document probabilities count as soft
observations where no label is known. Only the site's prior counts are shuffled, pre-aggregated. A document's own observation is left out of the
rates that are its prior, so it is not counted twice.
Defined cases: null or empty text has all features in their lowest bin; null sources form one site; rows whose label is
null, and labels of rows that are not there, teach nothing; several labels of one doc_id count as their mean, and
without labels every probability is 0.5 and every document is accepted.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, stage

#: Edges of the bins of each feature.
EDGES = {
    "upper": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "digit": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "marks": (0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4),
    "odd": (0.0005, 0.005, 0.02, 0.05, 0.1, 0.2),
    "word": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "fresh": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "lines": (0.2, 0.4, 0.6, 0.8, 0.95, 0.999),
    "size": (3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0),
}
NAMES = tuple(EDGES)
CLASS = np.zeros(256, dtype=np.int64)
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
CLASS[[9, 10, 11, 12, 13, 32]] = 5


def measured(text: str | None) -> list[int]:
    """The bin of each feature."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = np.bincount(CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=6)
    total = max(1, len(raw) - int(n[5]))
    words, lines = raw.split(), raw.split(b"\n")
    values = (
        n[1] / total, n[2] / total, n[3] / total, n[4] / total, total / max(1, len(words)) if words else 0.0,
        len(set(words)) / len(words) if words else 0.0, len(set(lines)) / len(lines), math.log1p(len(words)),
    )
    return [sum(v >= e for e in EDGES[name]) for name, v in zip(NAMES, values, strict=True)]


def features(docs: DataFrame, text: str = "text", out: str = "bins") -> DataFrame:
    def fn(cols: list[list]) -> list[pa.Array]:
        return [pa.array([measured(t) for t in cols[0]], type=pa.list_(pa.int32()))]

    return append_columns(docs, [text], [T.StructField(out, T.ArrayType(T.IntegerType(), True))], fn)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def weight(rates: DataFrame, good: str, n: str, center: str) -> float:
    """Weight of the Beta prior by moments: how far site rates spread beyond what their counts explain."""
    r = rates.where(f"{n} > 1").agg(
        F.sum(F.col(n)).alias("n"), F.count("*").alias("sites"),
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - F.col(center), 2)).alias("spread"),
        F.sum(F.col(n) * F.col(center) * (1 - F.col(center))).alias("within"), F.sum(F.pow(F.col(n), 2)).alias("n2"),
    ).first()
    if not r or not r.n or r.sites < 2 or not r.within:
        return 10.0
    p = r.within / r.n
    between = (r.spread - p * r.sites) / max(r.n - r.n2 / r.n, 1e-9)
    return float(min(max(p / between - 1, 1.0), 1e4)) if between > 1e-9 else 1e4


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", label: str = "quality", threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, host, evidence, host_rate, path_rate, probability, accepted, and the columns of docs to carry."""
    site = F.coalesce(F.col(source), F.lit(""))
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("__text"), F.substring_index(site, "/", 1).alias("host"), site.alias("path"), *carry)
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    rows = features(small, "__text").drop("__text")
    rows = stage(rows.join(known, F.col("doc_id") == F.col("of_id"), "left").drop("of_id"), "features")

    taught = rows.where("label is not null")
    rates = taught.select("label", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()  # bins of EDGES only
    totals = {f: (sum(r.good for r in own), sum(r.bad for r in own)) for f, own in ((f, list(g)) for f, g in groupby(sorted(rates, key=lambda r: r.f), key=lambda r: r.f))}
    table = [[0.0] * (len(EDGES[n]) + 1) for n in NAMES]
    for r in rates:
        good, bad = totals[r.f]
        bins = len(table[r.f])
        table[r.f][r.bin] = math.log((r.good + 0.5) / (good + 0.5 * bins)) - math.log((r.bad + 0.5) / (bad + 0.5 * bins))
    both = totals.get(0, (0, 0))
    center = (both[0] + 1) / (sum(both) + 2)
    if not sum(both):
        table = [[0.0] * len(t) for t in table]
    ratios = F.array(*[F.array(*[F.lit(float(x)) for x in t]) for t in table])
    evidence = F.aggregate(F.zip_with("bins", ratios, lambda b, t: F.get(t, b)), F.lit(0.0), lambda s, x: s + x)
    scored = rows.withColumn("evidence", F.round(evidence, 9)).drop("bins")
    scored = scored.withColumn("seen", F.coalesce("label", 1 / (1 + F.exp(-(F.col("evidence") + math.log(center / (1 - center)))))))

    counts = stage(scored.groupBy("host", "path").agg(F.sum("seen").alias("good"), F.count("*").alias("n")), "sites")
    hosts = counts.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    mean = counts.agg(F.sum("good") / F.sum("n")).first()[0] if sum(both) else 0.5
    mean = 0.5 if mean is None else float(mean)
    m = weight(hosts.withColumn("center", F.lit(mean)), "good", "n", "center") if sum(both) else 10.0
    hosts = hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n"), ((F.col("good") + m * mean) / (F.col("n") + m)).alias("host_rate"))
    paths = counts.join(hosts, "host")
    k = weight(paths, "good", "n", "host_rate") if sum(both) else 10.0
    paths = stage(paths.select("path", "good", "n", "host_good", "host_n", "host_rate", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "paths")
    others = (F.col("host_good") - F.col("seen") + m * mean) / (F.col("host_n") - 1 + m)
    prior = (F.col("good") - F.col("seen") + k * others) / (F.col("n") - 1 + k)
    out = scored.join(paths, "path").withColumn("probability", F.round(1 / (1 + F.exp(-(F.col("evidence") + logit(prior)))), 6))
    return out.select("doc_id", "host", "evidence", F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), "probability", (F.col("probability") >= threshold).alias("accepted"), *carry)
