"""Exact order statistics of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_statistic(rows: DataFrame, column: str, rank: int, bins: int = 1_024, few: int = 10_000) -> float:
    """The value with `rank` smaller places before it (from 0), by repeated histograms.

    Each round counts the values of a range in `bins` equal parts, with partial sums in every task, and goes on in the part
    that holds the rank, from its least to its largest value. At most `bins` counts or `few` values reach the driver. Values are
    finite and not null; rows should be staged, since they are read in each round."""
    own = rows.select(F.col(column).cast("double").alias("v"))
    low, high = own.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        inside = own.where(F.col("v").between(low, high))
        part = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * bins))
        for _, n, low, high in sorted(map(tuple, inside.groupBy(part.alias("part")).agg(F.count("*"), F.min("v"), F.max("v")).collect())):
            if rank < below + n:
                break
            below += n
        if n <= few:
            left = own.where(F.col("v").between(low, high)).collect()
            return sorted(r.v for r in left)[rank - below]
    return low


def exact_quantile(rows: DataFrame, column: str, share: float = 0.5, bins: int = 1_024, few: int = 10_000) -> float | None:
    """The quantile of the values that are finite, interpolated between the two next to it; null without any."""
    own = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(F.col(column).cast("double")) < float("inf")))
    n = own.count()
    if not n:
        return None
    at = share * (n - 1)
    a = order_statistic(own, column, math.floor(at), bins, few)
    if at == math.floor(at):
        return a
    b = order_statistic(own, column, math.ceil(at), bins, few)
    return a + (b - a) * (at - math.floor(at))
