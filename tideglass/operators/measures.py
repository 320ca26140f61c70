"""Measurements of sources, candidates and lift: what they cover, agree on, miss and where they settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import attention as A
from .lift import match_orgs


def coverage_span(parts: DataFrame, strict: bool = True) -> DataFrame:
    """(first_day, last_day, holes) of parts (first_day, last_day; one row a loaded part): both null if any part does not say.
    A hole of more than a day between a part and the next fails the job, or is counted."""
    order = F.array_sort(F.collect_list(F.struct("first_day", "last_day")))
    own = parts.agg(order.alias("p"), F.count_if(F.col("first_day").isNull() | F.col("last_day").isNull()).alias("unknown"))
    hole = lambda x, i: F.coalesce(F.datediff(F.get("p", i + 1)["first_day"], x["last_day"]) > 1, F.lit(False))
    known = F.col("unknown") == 0
    holes = F.when(known, F.size(F.filter("p", hole))).otherwise(0)
    holes = F.when(holes > 0, F.raise_error(F.lit("days are missing between loaded parts")).cast("int")).otherwise(holes) if strict else holes
    day = lambda i, c: F.when(known, F.try_element_at("p", F.lit(i))[c])
    return own.select(day(1, "first_day").alias("first_day"), day(-1, "last_day").alias("last_day"), holes.alias("holes"))


def titles_by_hour(edits: DataFrame, since: str, until: str) -> tuple[DataFrame, DataFrame]:
    """(hour, title) of human edits of the days, and the numbers of rows that were read and that bots made."""
    own = A.humans(edits).where(F.to_date("event_ts").between(since, until))
    titles = own.select(S.hour_floor(F.col("event_ts")).alias("hour"), S.canonical_title(F.col("title")).alias("title")).distinct()
    return titles, edits.agg(F.count("*").alias("read"), F.count_if(F.coalesce("is_bot", F.lit(False))).alias("bots"))


def low_mobile_by_floor(hourly: DataFrame, floors: list[int], least: float = 0.25) -> DataFrame:
    """By floor of views: pages and hours at or above it, those of them with a mobile share under least, and their share."""
    low = F.coalesce(S.mobile_ratio(F.col("mobile_views"), F.col("views")), F.lit(0.0)) < least
    each = [F.struct(F.lit(f).cast("long").alias("floor"), F.count_if(F.col("views") >= f).alias("rows"), F.count_if((F.col("views") >= f) & low).alias("low")) for f in floors]
    own = hourly.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return own.withColumn("share", F.try_divide("low", "rows"))


def match_coverage(lifts: DataFrame, stocks: DataFrame, aliases: DataFrame, blocked: list[str]) -> DataFrame:
    """Organisations (org, lift) with the ticker that aliases give and how they came to it: before, newly, or unmatched."""
    before = match_orgs(lifts, stocks, aliases.limit(0), []).withColumnRenamed("ticker", "plain")
    both = match_orgs(before, stocks, aliases, blocked)
    kind = F.when(F.col("plain").isNotNull(), "before").when(F.col("ticker").isNotNull(), "newly").otherwise("unmatched")
    return both.select("org", "lift", "ticker", kind.alias("kind"))


def settled_slot(curve: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """(final, first_slot) of a lift curve (slot, lift): its last value, and the first slot within the tolerance of it; both null if
    the last slot has none. One row of totals is joined."""
    last = curve.agg(F.max_by("lift", "slot").alias("final"))
    near = F.abs(F.col("lift") - F.col("final")) <= tolerance * F.greatest("final", F.lit(1e-9))
    return curve.join(F.broadcast(last)).agg(F.max("final").alias("final"), F.min(F.when(near, F.col("slot"))).alias("first_slot"))


def top_orgs(mentions: DataFrame, n: int) -> DataFrame:
    """The n organisations of the highest lift of each cluster; ties by name."""
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc_nulls_last("lift"), "org"))
    return mentions.withColumn("place", place).where(F.col("place") <= n)


def topk_overlap(a: DataFrame, b: DataFrame, answers: DataFrame, group: str, item: str, ks: list[int]) -> DataFrame:
    """For each group and k, of the first k of two ranked lists (place from 1): how many are in both, answers that each has, items of a
    alone and the share of them that are no answer (noise), answers in neither (missed)."""
    kind = lambda df, x, y, z: df.select(group, item, x.alias("pa"), y.alias("pb"), z.alias("answer"))
    none, place = F.lit(None).cast("int"), F.col("place").cast("int")
    rows = kind(a, place, none, F.lit(False)).unionByName(kind(b, none, place, F.lit(False))).unionByName(kind(answers, none, none, F.lit(True)))
    own = rows.groupBy(group, item).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.max("answer").alias("answer"))
    own = own.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    in_a, in_b, hit = (F.coalesce(c, F.lit(False)) for c in (F.col("pa") <= F.col("k"), F.col("pb") <= F.col("k"), F.col("answer")))
    out = own.groupBy(group, "k").agg(
        F.count_if(in_a & in_b).alias("overlap"), F.count_if(in_a & hit).alias("answers_a"), F.count_if(in_b & hit).alias("answers_b"),
        F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_a & ~in_b & ~hit).alias("noise_a"), F.count_if(hit & ~in_a & ~in_b).alias("missed"),
    )
    return out.withColumn("noise", F.try_divide("noise_a", "only_a")).drop("noise_a")


def one_sided_samples(a: DataFrame, b: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n keys, in order, of either side alone."""
    own = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("a")).unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("b")))
    return own.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy(key))).where(F.col("place") <= n)
