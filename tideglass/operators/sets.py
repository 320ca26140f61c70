"""Comparisons of two sets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flagged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side with in_a and in_b."""
    both = a.select(*keys, F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select(*keys, F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    return both.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts on one side only and on both; Jaccard, recall of a and precision of b."""
    x, y = F.col("in_a"), F.col("in_b")
    own = flagged(a, b, keys).agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y).alias("both_sides"))
    share = lambda n: F.round(F.try_divide(F.col("both_sides"), n), 9)
    c = F.col("both_sides")
    return own.withColumns({"jaccard": share(c + F.col("only_a") + F.col("only_b")), "recall": share(c + F.col("only_a")), "precision": share(c + F.col("only_b"))})


def union_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all parts, one a key: the first part that has it, and of its rows the smallest."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("src", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in rows.columns if c not in keys and c != "src"]
    best = rows.groupBy(*keys).agg(F.min(F.struct("src", *rest)).alias("x"))
    return best.select(*keys, "x.*")
