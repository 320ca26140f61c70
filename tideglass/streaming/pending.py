"""Pending windows as keyed state of a stream: kept, rechecked, dropped, and expired by timers that the arrival ledger gates.

The state is keyed by wiki and one of BUCKETS hashes of the title, so a large wiki is spread over tasks; a row of the ledger
goes to each bucket of its wiki. A bucket holds its pending windows with their rechecks, and the newest hour that arrived. A
timer in event time wakes it when a window is past its hours; the window then goes only if an hour from its own on has
arrived, else with the first such row of the ledger. What happens to a window is emitted as a change, so the state as a table
is the last change of each window (`pending_table`), and it comes from the checkpoint alone after a restart.

Defined cases: a window that is pending again counts one recheck more; a decision about an unknown window says nothing; rows
of one micro-batch are taken in the order of their time, decisions before the ledger; rows without wiki, title or window are
left out; rows at or behind the newest time of earlier micro-batches are late, and the engine drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Parts of a wiki's pending windows, and hours after which one expires.
BUCKETS, HOURS = 64, 36
MILLIS = 3_600_000

#: What the stream takes. status: of a decision; null for a row of the ledger, whose hour is in `at_hour`.
ROWS = "wiki string, title string, window_start timestamp, status string, at_hour timestamp, at timestamp"
CHANGES = "wiki string, title string, window_start timestamp, action string, rechecks long, at timestamp"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Pending(StatefulProcessor):
    def __init__(self, hours: int = HOURS) -> None:
        self.millis = hours * MILLIS

    def init(self, handle) -> None:
        window = StructType([StructField("title", StringType()), StructField("start", LongType())])
        self.handle = handle
        self.rechecks = handle.getMapState("rechecks", window, StructType([StructField("n", LongType())]))
        self.newest = handle.getValueState("newest", StructType([StructField("hour", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows))
        whole["ledger"] = whole["status"].isna()
        out = []
        for r in whole.sort_values(["at", "ledger"], kind="stable").itertuples():
            if r.ledger:
                hour = int(r.at_hour.timestamp() * 1000)
                if not self.newest.exists() or self.newest.get()[0] < hour:
                    self.newest.update((hour,))
                continue
            window = (r.title, int(r.window_start.timestamp() * 1000))
            known = self.rechecks.containsKey(window)
            if r.status == "PENDING_VIEWS":
                n = self.rechecks.getValue(window)[0] + 1 if known else 0
                self.rechecks.updateValue(window, (n,))
                if not known:
                    self.handle.registerTimer(window[1] + self.millis + 1)
                out.append((*window, "bump" if known else "keep", n, r.at))
            elif known:
                out.append((*window, "drop", self.rechecks.getValue(window)[0], r.at))
                self.rechecks.removeKey(window)
        yield self.changes(key, out)
        yield self.changes(key, self.gone(timerValues.getCurrentWatermarkInMs(), whole["at"].max()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.changes(key, self.gone(timerValues.getCurrentWatermarkInMs()))

    def gone(self, now: int, at: pd.Timestamp | None = None) -> list[tuple]:
        """Windows that are past their hours and whose hour, or a later one, has arrived; they went after rows of time at."""
        if not self.newest.exists():
            return []
        newest = self.newest.get()[0]
        old = [(w, n[0]) for w, n in self.rechecks.iterator() if w[1] + self.millis < now and w[1] <= newest]
        for w, _ in old:
            self.rechecks.removeKey(w)
        return [(*w, "expire", n, max(pd.Timestamp(now, unit="ms"), at or pd.Timestamp(0))) for w, n in old]

    @staticmethod
    def changes(key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["title", "window_start", "action", "rechecks", "at"])
        out.insert(0, "wiki", key[0])
        out["window_start"] = pd.to_datetime(out["window_start"], unit="ms")
        out["at"] = pd.to_datetime(out["at"])
        return out.astype({"title": "object", "rechecks": "int64"})

    def close(self) -> None:
        pass


def changes(rows: DataFrame, hours: int = HOURS, buckets: int = BUCKETS) -> DataFrame:
    """The changes (CHANGES) of a stream of ROWS; `at` is its event time."""
    own = rows.where("wiki is not null and (at_hour is not null or (title is not null and window_start is not null and status is not null))")
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    to = F.when(F.col("status").isNull(), every).otherwise(F.array(F.pmod(F.xxhash64("title"), F.lit(buckets)).cast("int")))
    dealt = own.withWatermark("at", "0 seconds").withColumn("bucket", F.explode(to))
    return dealt.groupBy("wiki", "bucket").transformWithStateInPandas(Pending(hours), CHANGES, "Append", "EventTime")


def start_pending_stream(rows: DataFrame, path: str, checkpoint: str, trigger: str | None = "30 seconds", hours: int = HOURS, buckets: int = BUCKETS) -> StreamingQuery:
    """Write the changes as Parquet under path. Keyed state needs the RocksDB provider, which is set for this stream only."""
    spark, name = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        out = changes(rows, hours, buckets).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=trigger) if trigger else out.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(name, before)


def pending_table(spark: SparkSession, path: str) -> DataFrame:
    """Pending windows with their rechecks, from the changes that were written."""
    rows = spark.read.schema(CHANGES).parquet(path)
    rank = F.struct("at", F.col("action").isin("drop", "expire"), "rechecks")
    last = rows.groupBy("wiki", "title", "window_start").agg(F.max_by(F.struct("action", "rechecks"), rank).alias("x"))
    return last.where("x.action in ('keep', 'bump')").select("wiki", "title", "window_start", "x.rechecks")


def decision_rows(decisions: DataFrame, at: str) -> DataFrame:
    """Decisions that were made at a time, as ROWS."""
    none = F.lit(None).cast("timestamp")
    return decisions.select("wiki", "title", "window_start", "status", none.alias("at_hour"), F.lit(at).cast("timestamp").alias("at"))


def ledger_rows(ledger: DataFrame, at: str) -> DataFrame:
    """Hours (wiki, ts_hour) that were known to have arrived at a time, as ROWS."""
    none = F.lit(None)
    return ledger.select("wiki", none.cast("string").alias("title"), none.cast("timestamp").alias("window_start"), none.cast("string").alias("status"), F.col("ts_hour").alias("at_hour"), F.lit(at).cast("timestamp").alias("at"))
