"""Plans of time slots: which are there, and runs of those that are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slot_plan(existing: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Every slot from the first to the last with whether it exists."""
    ends = existing.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null")
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("slot"))
    known = existing.select(F.col(ts).alias("slot")).distinct().withColumn("present", F.lit(True))
    return grid.join(known, "slot", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def coalesce_gaps(missing: DataFrame, seconds: int) -> DataFrame:
    """Runs of neighbouring slots as (gap_start, gap_end, slots). Slots are numbered within days, so a day is one group,
    and the runs of days that meet are joined over the far fewer runs."""
    at = F.floor(F.unix_timestamp("slot") / seconds)
    day = missing.select("slot", at.alias("at"), F.to_date("slot").alias("day"))
    runs = day.withColumn("g", F.col("at") - F.row_number().over(W.partitionBy("day").orderBy("at"))).groupBy("day", "g").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n"))
    w = W.orderBy("a")  # a row for each run of a day
    first = F.unix_timestamp("a") - F.unix_timestamp(F.lag("b").over(w)) != seconds
    joined = runs.withColumn("first", F.coalesce(first, F.lit(True)).cast("int")).withColumn("run", F.sum("first").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return joined.groupBy("run").agg(F.min("a").alias("gap_start"), F.max("b").alias("gap_end"), F.sum("n").alias("slots")).drop("run")
