"""The live job: deduplicated edits, windows, and decisions for each micro-batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import scalar as S
from ..operators import attention as A

DELAY = "10 minutes"


def with_event_time(df: DataFrame, delay: str = DELAY) -> DataFrame:
    """The one watermark, shared by deduplication and windows."""
    return df.withWatermark("event_ts", delay)


def dedup_events(df: DataFrame) -> DataFrame:
    """Without repeated ids: within the watermark on a stream, entirely on a table."""
    return df.dropDuplicatesWithinWatermark(["meta_id"]) if df.isStreaming else df.dropDuplicates(["meta_id"])


def edit_windows(df: DataFrame, size: str = "1 hour", slide: str = "5 minutes", user: str = "usr") -> DataFrame:
    """Sliding (or tumbling: slide = size) windows of human edits with an estimate of distinct editors."""
    own = A.humans(df).withColumn("title", S.canonical_title(F.col("title")))
    w = own.groupBy(F.window("event_ts", size, slide).alias("w"), "wiki", "title").agg(
        F.count("*").alias("edit_count"), F.approx_count_distinct(F.nullif(F.trim(user), F.lit("")), 0.01).alias("editor_count"),
        F.sum("byte_delta").alias("byte_delta"), F.max("event_ts").alias("last_edit_ts"), F.max("rev_id").alias("max_rev_id"),
    )
    return w.select("wiki", "title", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "edit_count", "editor_count", "byte_delta", "last_edit_ts", "max_rev_id")


def on_the_hour(windows: DataFrame) -> DataFrame:
    """Windows that a baseline can be compared with."""
    return windows.where(F.col("window_start") == F.date_trunc("hour", "window_start"))


def judge(windows: DataFrame, views: DataFrame, baseline: DataFrame) -> DataFrame:
    own = on_the_hour(windows).join(views.select("wiki", "title", F.col("ts_hour").alias("window_start"), "views"), ["wiki", "title", "window_start"], "left")
    return A.decide(own, baseline)


def start_spike_stream(edits: DataFrame, views: Callable[[], DataFrame], baseline: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "30 seconds", size: str = "1 hour", slide: str = "1 hour") -> StreamingQuery:
    """Judge the windows of every micro-batch with the views and baseline of that moment; write(decisions, batch) must
    be an upsert by key, since a window comes again whenever it changes or a batch is repeated."""

    def each(batch: DataFrame, number: int) -> None:
        write(judge(batch, views(), baseline()), number)

    own = edit_windows(dedup_events(with_event_time(edits)), size, slide)
    out = own.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (out.trigger(processingTime=trigger) if trigger else out.trigger(availableNow=True)).start()


def start_diagnostic_stream(windows: DataFrame, name: str, kind: str = "memory") -> StreamingQuery:
    out = windows.writeStream.outputMode("update").format(kind)
    return (out.queryName(name) if kind == "memory" else out).start()


class LateRows(StreamingQueryListener):
    """Rows of each query that came behind the watermark, added up over all of its batches while this listens; a query
    itself remembers the last hundred only. Progress that comes again, such as that of an idle query, counts once."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.batch: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        key, n = str(p.id), sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if p.batchId > self.batch.get(key, -1):
            self.dropped[key] = self.dropped.get(key, 0) + n
            self.batch[key] = p.batchId

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def of(self, query: StreamingQuery, seconds: float = 30) -> int:
        """The rows of a query up to its last batch; listeners run behind, so it waits for that batch for some seconds."""
        last, until = query.lastProgress, time.monotonic() + seconds
        while last is not None and self.batch.get(str(query.id), -1) < last.batchId and time.monotonic() < until:
            time.sleep(0.05)
        return self.dropped.get(str(query.id), 0)


def count_late_rows(spark: SparkSession) -> LateRows:
    """A listener on all queries of the session from now on."""
    out = LateRows()
    spark.streams.addListener(out)
    return out


def parity(stream: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows that differ between the last state of stream windows and batch windows; empty if they agree."""
    columns = ["wiki", "title", "window_start", "edit_count", "byte_delta", "max_rev_id"]
    last = stream.groupBy("wiki", "title", "window_start").agg(F.max(F.struct("edit_count", "byte_delta", "max_rev_id")).alias("x")).select("wiki", "title", "window_start", "x.*")
    a, b = last.select(columns), batch.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("stream")).unionByName(b.exceptAll(a).withColumn("side", F.lit("batch")))


def live_cycle(pending: DataFrame, ledger: DataFrame, views: DataFrame, baseline: DataFrame, now: str, limit: int | None = None) -> dict[str, DataFrame]:
    """One round of the batch side: hours to fetch, windows that are due and their decisions, and windows that expire."""
    due = A.due_candidates(pending, ledger, views, limit)
    return {"missing": A.missing_hours(pending, views, now, 24), "decisions": A.decide(due, baseline), "expired": A.expired(pending, ledger, now)}
