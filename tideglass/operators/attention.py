"""Edit windows, views, baselines, decisions and what follows a decision, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S

PAGE = ["wiki", "title"]


def humans(df: DataFrame) -> DataFrame:
    """Without bots; a missing flag is a human."""
    return df.where(~F.coalesce(F.col("is_bot"), F.lit(False)))


def edit_windows_exact(events: DataFrame) -> DataFrame:
    """Hourly windows of human edits: edits, distinct named editors, bytes, last edit, last revision."""
    return (
        humans(events).groupBy("wiki", S.canonical_title(F.col("title")).alias("title"), S.hour_floor(F.col("event_ts")).alias("window_start"))
        .agg(F.count("*").alias("edit_count"), F.count_distinct(F.nullif(F.trim("usr"), F.lit(""))).alias("editor_count"), F.sum("byte_delta").alias("byte_delta"), F.max("event_ts").alias("last_edit_ts"), F.max("rev_id").alias("max_rev_id"))
    )


def sum_views(views: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """Views of a page and hour, over all agents or those named."""
    own = views.where(F.col("agent").isin(*agents)) if agents else views
    return own.groupBy(*PAGE, "ts_hour").agg(F.sum("views").alias("views"))


def hourly_from_daily(daily: DataFrame, date: Column) -> DataFrame:
    """Hourly views from rows with a sparse hour string, summed over access methods."""
    hours = daily.select("wiki", S.canonical_title(F.col("title")).alias("title"), date.cast("timestamp").alias("day"), F.explode(S.decode_hourly(F.col("hours"))).alias("x"))
    at = F.timestamp_seconds(F.unix_timestamp("day") + F.col("x.h") * 3600)
    return hours.where("title <> ''").groupBy(*PAGE, at.alias("ts_hour")).agg(F.sum("x.v").alias("views"))


def hourly_views(rows: DataFrame, floor: int = 0, candidates: DataFrame | None = None) -> DataFrame:
    """Views and their mobile part from (wiki, title, ts_hour, views, is_mobile); small titles stay only as candidates."""
    out = rows.groupBy(*PAGE, "ts_hour").agg(F.sum("views").alias("views"), F.sum(F.when(F.col("is_mobile"), F.col("views")).otherwise(0)).alias("mobile_views"))
    if candidates is None:
        return out.where(F.col("views") >= floor)
    known = candidates.select(*PAGE).distinct().withColumn("known", F.lit(True))
    return out.join(known, PAGE, "left").where((F.col("views") >= floor) | F.col("known")).drop("known")


def join_windows(edits: DataFrame, views: DataFrame) -> DataFrame:
    """Edits and views of a page and hour: missing edits are zero, missing views unknown."""
    both = edits.join(views.withColumnRenamed("ts_hour", "window_start"), [*PAGE, "window_start"], "full")
    return both.select(*PAGE, "window_start", F.coalesce("edit_count", F.lit(0)).alias("edit_count"), F.coalesce("editor_count", F.lit(0)).alias("editor_count"), F.coalesce("byte_delta", F.lit(0)).alias("byte_delta"), "max_rev_id", "views")


def ewma_baseline(windows: DataFrame, as_of: str, half_life: float = 14, days: int = 28) -> DataFrame:
    """By page and hour of day: half-life weighted mean and population deviation of edits, and of known views.

    The deviation takes a second pass over the mean; both passes run on one shuffle by page and hour.
    """
    own = windows.withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.to_date("window_start"))).where((F.col("age") >= 0) & (F.col("age") < days))
    own = own.withColumn("hour_of_day", S.hour_of_day(F.col("window_start"))).withColumn("w", S.decay_weight(F.col("age"), half_life))
    known = F.when(F.col("views").isNotNull(), F.col("w"))
    slot = W.partitionBy(*PAGE, "hour_of_day")
    mean = own.withColumn("edit_mean", F.sum(F.col("w") * F.col("edit_count")).over(slot) / F.sum("w").over(slot))
    mean = mean.withColumn("view_mean", F.sum(known * F.col("views")).over(slot) / F.sum(known).over(slot))
    square = lambda c, m: F.pow(F.col(c) - F.col(m), 2)
    return mean.groupBy(*PAGE, "hour_of_day").agg(
        F.max("edit_mean").alias("edit_ewma"), F.sqrt(F.sum(F.col("w") * square("edit_count", "edit_mean")) / F.sum("w")).alias("edit_stddev"),
        F.max("view_mean").alias("view_ewma"), F.sqrt(F.sum(known * square("views", "view_mean")) / F.sum(known)).alias("view_stddev"),
        F.count_distinct(F.to_date("window_start")).alias("sample_days"),
    )


def baseline_from_views(views: DataFrame, as_of: str, half_life: float = 14, days: int = 28) -> DataFrame:
    """Baseline from view history alone: edits are zero."""
    return ewma_baseline(views.select(*PAGE, F.col("ts_hour").alias("window_start"), F.lit(0).alias("edit_count"), "views"), as_of, half_life, days)


def compare_halflives(windows: DataFrame, as_of: str, half_lives: list[float]) -> DataFrame:
    """By half-life: slots, mean of the weighted means, and their mean distance from the plain mean."""
    own = windows.withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.to_date("window_start"))).where("age >= 0 and age < 28")
    each = own.withColumn("half_life", F.explode(F.array(*[F.lit(float(h)) for h in half_lives])))
    w = F.pow(F.lit(0.5), F.col("age") / F.col("half_life"))
    slot = each.groupBy("half_life", *PAGE, F.hour("window_start").alias("hour_of_day")).agg((F.sum(w * F.col("edit_count")) / F.sum(w)).alias("ewma"), F.avg("edit_count").alias("plain"))
    return slot.groupBy("half_life").agg(F.count("*").alias("slots"), F.avg("ewma").alias("mean_ewma"), F.avg(F.abs(F.col("ewma") - F.col("plain"))).alias("mean_difference"))


def may_spike(windows: DataFrame) -> DataFrame:
    """What can be confirmed or pending at all, before any baseline is read."""
    return windows.where((F.col("edit_count") >= S.MIN_EDITS) & (F.col("views").isNull() | (F.col("views") >= S.MIN_VIEWS)))


def with_baseline(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Windows with the baseline of their page and hour, and whether it is there, thin or absent."""
    out = windows.withColumn("hour_of_day", S.hour_of_day(F.col("window_start"))).join(baseline, [*PAGE, "hour_of_day"], "left")
    label = F.when(F.col("sample_days").isNull(), "absent").when(F.col("sample_days") < S.MIN_DAYS, "thin").otherwise("db")
    return out.withColumn("baseline", label)


def decide(windows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Windows with their decision."""
    own = with_baseline(windows, baseline)
    d = S.detect(F.col("edit_count"), F.col("views"), F.col("edit_ewma"), F.col("edit_stddev"), F.col("view_ewma"), F.col("view_stddev"), F.col("sample_days"))
    return own.withColumn("d", d).select(*PAGE, "window_start", "edit_count", "editor_count", "views", "max_rev_id", "baseline", "view_ewma", "d.*")


def decision_summary(decisions: DataFrame) -> DataFrame:
    one = lambda c: F.count_if(c)
    s, b = F.col("status"), F.col("baseline")
    return decisions.agg(F.count("*").alias("evaluated"), one(s == "CONFIRMED").alias("confirmed"), one(s == "PENDING_VIEWS").alias("pending"), one(s == "REJECTED").alias("rejected"), one(b == "db").alias("baseline_db"), one(b == "thin").alias("baseline_thin"), one(b == "absent").alias("baseline_absent"))


def arrived(rows: DataFrame, hours: DataFrame) -> DataFrame:
    """Arrival ledger: rows of each hour that came, also when there were none."""
    n = rows.groupBy("wiki", "ts_hour").agg(F.count("*").alias("rows"))
    return hours.select("wiki", "ts_hour").distinct().join(n, ["wiki", "ts_hour"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def due_candidates(pending: DataFrame, ledger: DataFrame, views: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending windows whose hour arrived, with their views (a missing row is zero); with a limit the oldest."""
    hours = ledger.select("wiki", F.col("ts_hour").alias("window_start")).distinct()
    own = views.select(*PAGE, F.col("ts_hour").alias("window_start"), F.col("views").alias("v"))
    out = pending.drop("views").join(hours, ["wiki", "window_start"], "left_semi").join(own, [*PAGE, "window_start"], "left")
    out = out.withColumn("views", F.coalesce("v", F.lit(0))).drop("v")
    return out if limit is None else out.orderBy("window_start", *PAGE).limit(limit)


def missing_hours(pending: DataFrame, views: DataFrame, now: str, hours: int) -> DataFrame:
    """Hours, oldest first, for which pending windows at least three hours old have no views, with their titles."""
    old = pending.where(F.col("window_start") <= F.lit(now).cast("timestamp") - F.expr("interval 3 hours"))
    none = old.join(views.select(*PAGE, F.col("ts_hour").alias("window_start")), [*PAGE, "window_start"], "left_anti")
    return none.groupBy("wiki", "window_start").agg(F.array_sort(F.collect_set("title")).alias("titles")).orderBy("window_start", "wiki").limit(hours)


def expired(pending: DataFrame, ledger: DataFrame, now: str, hours: int = 36) -> DataFrame:
    """Pending windows past their time, if any hour from theirs on has arrived for the wiki."""
    newest = ledger.groupBy("wiki").agg(F.max("ts_hour").alias("newest"))
    old = pending.where(F.col("window_start") < F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours"))
    return old.join(newest, "wiki").where("newest >= window_start").drop("newest")


def pending_update(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending windows after new decisions: decided ones leave, pending ones stay once with one recheck more."""
    key = [*PAGE, "window_start"]
    d = decisions.select(*key, "status")
    new = d.where("status = 'PENDING_VIEWS'").join(pending, key, "left_anti").select(*key, F.lit(0).alias("rechecks"))
    old = pending.join(d, key, "left").where("status is null or status = 'PENDING_VIEWS'").select(*key, (F.col("rechecks") + F.col("status").isNotNull().cast("int")).alias("rechecks"))
    return old.unionByName(new)


def rolling_baseline(daily: DataFrame, value: str, half_life: float = 14, days: int = 28) -> DataFrame:
    """For each page and day: weighted mean and deviation of value over the days before it that have one.

    A day's past is a range of one window, at most `days` values, so a page's work is linear in its days."""
    d = daily.select(*PAGE, "day", F.col(value).cast("double").alias("v"))
    w = W.partitionBy(*PAGE).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    d = d.withColumn("past", F.collect_list(F.when(F.col("v").isNotNull(), F.struct("day", "v"))).over(w))
    weight = lambda x: S.decay_weight(F.datediff(F.col("day"), x["day"]) - 1, half_life)
    total = lambda f: F.aggregate("past", F.lit(0.0), lambda s, x: s + f(x))
    d = d.withColumn("sw", total(weight)).withColumn("mean", F.try_divide(total(lambda x: weight(x) * x["v"]), F.col("sw")))
    dev = F.sqrt(F.try_divide(total(lambda x: weight(x) * F.pow(x["v"] - F.col("mean"), 2)), F.col("sw")))
    return d.withColumns({"deviation": dev, "seen": F.size("past").cast("long")}).drop("past", "sw")


def co_spikes(daily: DataFrame, floor: float = 100, times: float = 2, days: int = 28, least: int = 14) -> DataFrame:
    """By day: how many pages have at least `times` the median of their days with views among the `days` before it, of which
    there are `least`, if that median is floor or more. A day's past is a range of one window, at most `days` values."""
    past = W.partitionBy(*PAGE).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    own = daily.withColumn("past", F.sort_array(F.collect_list(F.when(F.col("views") > 0, F.col("views"))).over(past)))
    n = F.size("past")
    median = (F.get("past", F.floor((n - 1) / 2).cast("int")) + F.get("past", F.floor(n / 2).cast("int"))) / 2
    return own.where((n >= least) & (median >= floor) & (F.col("views") / median >= times)).groupBy("day").agg(F.count("*").alias("titles"))


def by_floor(rows: DataFrame, floors: list[float], value: str = "views", page: str = "title") -> DataFrame:
    """For each floor the rows with at least that value, and the pages that have any; one pass over the rows."""
    at = [F.count_if(F.col(value) >= f).alias(f"n{i}") for i, f in enumerate(floors)]
    own = rows.groupBy(page).agg(*at)
    sums = own.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(floors))], *[F.count_if(F.col(f"n{i}") > 0).alias(f"p{i}") for i in range(len(floors))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.col(f"n{i}").alias("rows"), F.col(f"p{i}").alias("pages")) for i, f in enumerate(floors)])).alias("x")).select("x.*")


def view_signals(daily: DataFrame, floor: float) -> DataFrame:
    """Days on which views stand out: z of 3, twice the mean, at least floor, with two earlier days and a mean."""
    b = rolling_baseline(daily, "views")
    z = S.z_score(F.col("v"), F.col("mean"), F.col("deviation"))
    return b.where((F.col("seen") >= 2) & (F.col("mean") > 0) & (F.col("v") >= floor) & (F.col("v") / F.col("mean") >= 2) & (z >= 3)).select(*PAGE, "day", F.col("v").alias("views"))


def first_view_signal(daily: DataFrame, not_before: str, floor: float) -> DataFrame:
    return view_signals(daily, floor).where(F.col("day") >= F.lit(not_before).cast("date")).groupBy(*PAGE).agg(F.min("day").alias("first_day"))


def first_detection(decisions: DataFrame) -> DataFrame:
    """Earliest confirmed and earliest candidate window of each page."""
    s = F.col("status")
    return decisions.groupBy(*PAGE).agg(F.min(F.when(s == "CONFIRMED", F.col("window_start"))).alias("first_confirmed"), F.min(F.when(s != "REJECTED", F.col("window_start"))).alias("first_candidate"))


def recall(decisions: DataFrame, targets: DataFrame, controls: DataFrame) -> DataFrame:
    """Share of target pages with a confirmed window; confirmed windows and pages among controls."""
    hit = decisions.where("status = 'CONFIRMED'").groupBy(*PAGE).agg(F.count("*").alias("windows"))
    marked = targets.select(*PAGE, F.lit(True).alias("target")).unionByName(controls.select(*PAGE, F.lit(False).alias("target"))).join(hit, PAGE, "left")
    t = F.col("target")
    return marked.agg(F.count_if(t).alias("targets"), F.count_if(t & F.col("windows").isNotNull()).alias("found"), F.coalesce(F.sum(F.when(~t, F.col("windows"))), F.lit(0)).alias("control_windows"), F.count_if(~t & F.col("windows").isNotNull()).alias("control_pages"))
