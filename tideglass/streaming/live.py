"""The live cycle over stored tables: fetch the hours that are due, judge again, expire, and exchange the baseline once a day.

Three versioned stores hold the state. `views` has a part for each wiki and hour, and its pointers are the arrival ledger: an hour that
came without rows is registered as such. `state` has pending windows and spikes by source and day; a window leaves the one and
enters the other with one pointer. `baseline` has a part for each wiki, whose rows say of which day they are.

Every step derives what is to do from what is stored, and commits by a pointer. So a cycle that is repeated, or that is
started again after it broke off anywhere, makes nothing twice and leaves the same tables; two cycles at once conflict, and
one fails. A new baseline is made after the decisions of its cycle, so a decision that is repeated sees the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import attention as A
from ..sources.versions import Versions

KEY = ["wiki", "title", "window_start"]
VIEWS = "wiki string, ts_hour timestamp, title string, views long, mobile_views long"
PENDING = "source string, day date, wiki string, title string, window_start timestamp, edit_count long, editor_count long, max_rev_id long, rechecks long"
SPIKES = "source string, day date, wiki string, title string, window_start timestamp, edit_count long, editor_count long, views long, max_rev_id long, view_ratio double, view_z double, spike_score double"
BASELINE = "wiki string, as_of date, title string, hour_of_day int, edit_ewma double, edit_stddev double, view_ewma double, view_stddev double, sample_days long"

#: fetch(hours): of hours (wiki, ts_hour, titles) those that have come, and their rows (wiki, title, ts_hour, views, is_mobile).
Fetch = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Live:
    """The tables of one source under a path of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, source: str = "live"):
        self.spark, self.source = spark, source
        self.views = Versions(spark, f"{path}/views", {"views": VIEWS}, ("wiki", "ts_hour"))
        self.state = Versions(spark, f"{path}/state", {"pending": PENDING, "spikes": SPIKES}, ("source", "day"))
        self.baseline = Versions(spark, f"{path}/baseline", {"baseline": BASELINE}, ("wiki",))

    def ledger(self) -> DataFrame:
        """Hours (wiki, ts_hour) that have arrived, also without rows."""
        return self.views.pointers().select("wiki", "ts_hour")

    def pending(self) -> DataFrame:
        return self.state.read("pending").where(F.col("source") == self.source)

    def spikes(self) -> DataFrame:
        return self.state.read("spikes").where(F.col("source") == self.source)

    def put_baseline(self, baseline: DataFrame, as_of: str) -> None:
        """Exchange the baseline of the wikis that it has."""
        own = baseline.withColumn("as_of", F.lit(as_of).cast("date"))
        self.baseline.replace(own.select("wiki").distinct(), {"baseline": own})

    def _exchange(self, days: DataFrame, pending: DataFrame, spikes: DataFrame) -> None:
        """Replace the pending windows and spikes of the days."""
        days = days.select(F.lit(self.source).alias("source"), "day").distinct()
        if not days.isEmpty():
            own = lambda df: df.withColumn("source", F.lit(self.source)).withColumn("day", F.to_date("window_start")).join(days, ["source", "day"], "left_semi")
            self.state.replace(days, {"pending": own(pending), "spikes": own(spikes)})

    def add(self, decisions: DataFrame) -> None:
        """Decisions of the stream: confirmed windows become spikes, pending ones wait; a repeated batch changes nothing."""
        d = decisions.where("status in ('CONFIRMED', 'PENDING_VIEWS')").withColumn("day", F.to_date("window_start")).checkpoint()
        new = d.where("status = 'PENDING_VIEWS'").withColumn("rechecks", F.lit(0).cast("long"))
        known = self.pending().select(*KEY, F.col("rechecks").alias("was"))
        new = new.join(known, KEY, "left").withColumn("rechecks", F.coalesce("was", "rechecks")).join(self.spikes().select(KEY), KEY, "left_anti")
        confirmed = d.where("status = 'CONFIRMED'")
        waiting = self.pending().join(d.select(KEY), KEY, "left_anti").unionByName(new.select(self.pending().columns[2:] + ["day"]).withColumn("source", F.lit(self.source)))
        self._exchange(d.select("day"), waiting, self._with(confirmed))

    def _with(self, confirmed: DataFrame) -> DataFrame:
        """Spikes with confirmed windows put in by key."""
        columns = self.spikes().columns
        new = confirmed.withColumn("source", F.lit(self.source)).withColumn("day", F.to_date("window_start")).select(columns)
        return self.spikes().join(new.select(KEY), KEY, "left_anti").unionByName(new)

    def due_hours(self, now: str, most: int) -> DataFrame:
        """Hours (wiki, ts_hour, titles) that pending windows wait for and that have not arrived, oldest first, at most `most`."""
        none = self.ledger().withColumnRenamed("ts_hour", "window_start")
        waiting = self.pending().where(F.col("window_start") == F.date_trunc("hour", "window_start")).join(none, ["wiki", "window_start"], "left_anti")
        return A.missing_hours(waiting, self.views.read("views"), now, most).withColumnRenamed("window_start", "ts_hour")

    def ingest(self, now: str, fetch: Fetch, most: int = 24, floor: int | None = None) -> int:
        """Fetch due hours; of their rows the titles that are waited for stay, and with a floor all of so many views. How many
        hours came; one that did not is due again."""
        hours = self.due_hours(now, most).checkpoint()
        arrived, rows = fetch(hours)
        parts = arrived.join(hours, ["wiki", "ts_hour"], "left_semi").select("wiki", "ts_hour").distinct().checkpoint()
        n = parts.count()
        if n:
            named = hours.select("wiki", "ts_hour", F.explode("titles").alias("title")).withColumn("known", F.lit(True))
            own = A.hourly_views(rows.join(parts, ["wiki", "ts_hour"], "left_semi")).join(named, ["wiki", "ts_hour", "title"], "left")
            kept = F.col("known").isNotNull() if floor is None else F.col("known").isNotNull() | (F.col("views") >= floor)
            self.views.replace(parts, {"views": own.where(kept)})
        return n

    def recheck(self, now: str, limit: int | None = None) -> dict[str, int]:
        """Judge pending windows whose hour has arrived, and expire old ones; how many of each kind."""
        pending = self.pending().checkpoint()
        due = A.due_candidates(pending, self.ledger(), self.views.read("views"), limit)
        decided = A.decide(due, self.baseline.read("baseline").drop("as_of")).checkpoint()
        after = A.pending_update(pending.select(*KEY, "rechecks"), decided)
        gone = A.expired(after, self.ledger(), now).checkpoint()
        left = pending.drop("rechecks").join(after, KEY).join(gone.select(KEY), KEY, "left_anti")
        confirmed = decided.where("status = 'CONFIRMED'")
        days = decided.select("window_start").unionByName(gone.select("window_start")).select(F.to_date("window_start").alias("day"))
        counts = decided.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("CONFIRMED", "confirmed"), ("REJECTED", "rejected"), ("PENDING_VIEWS", "still_pending")))).first().asDict()
        self._exchange(days, left, self._with(confirmed))
        return counts | {"expired": gone.count()}

    def refresh(self, now: str, days: int = 28) -> bool:
        """Exchange the baseline if its day is not that of now: from the views of the days before."""
        at = self.spark.range(1).select(S.baseline_as_of(F.lit(now).cast("timestamp")).cast("string")).first()[0]
        if not self.baseline.read("baseline").where(F.col("as_of") >= F.lit(at).cast("date")).isEmpty():
            return False
        new = A.baseline_from_views(self.views.read("views"), at, days=days)
        if new.isEmpty():
            return False
        self.put_baseline(new, at)
        return True

    def cycle(self, now: str, fetch: Fetch, most: int = 24, floor: int | None = None, limit: int | None = None) -> dict[str, int]:
        """One round; what it did."""
        out = {"hours": self.ingest(now, fetch, most, floor)} | self.recheck(now, limit)
        return out | {"baseline": int(self.refresh(now))}
