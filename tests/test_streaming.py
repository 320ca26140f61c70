"""Watermark, late rows and repeated ids on a stream of files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideglass.plans import QUERIES, io
from tideglass.streaming import jobs as J

KIND = "wiki string, title string, usr string, is_bot boolean, byte_delta int, rev_id long, event_ts timestamp, meta_id string"


def put(spark, path, *rows):
    spark.createDataFrame([("w", "a_b", "u", None, 1, i, ts, m) for i, (ts, m) in enumerate(rows)], KIND).coalesce(1).write.mode("append").parquet(path)


def test_late_and_repeated_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, (datetime(2024, 1, 1, 10, 5), "1"), (datetime(2024, 1, 1, 10, 6), "1"), (datetime(2024, 1, 1, 10, 59, 59), "2"))
    own = J.edit_windows(J.dedup_events(J.with_event_time(spark.readStream.schema(KIND).parquet(path))), "1 hour", "1 hour")
    late = J.count_late_rows(spark)
    query = J.start_diagnostic_stream(own, "late_rows")
    try:
        query.processAllAvailable()
        put(spark, path, (datetime(2024, 1, 1, 15, 0), "3"))
        query.processAllAvailable()
        put(spark, path, (datetime(2024, 1, 1, 10, 30), "4"), (datetime(2024, 1, 1, 15, 1), "5"))
        query.processAllAvailable()
        assert late.of(query) == 1
        rows = spark.table("late_rows").groupBy("window_start").agg(F.max("edit_count").alias("n")).orderBy("window_start").collect()
        assert [(r.window_start.hour, r.n) for r in rows] == [(10, 2), (15, 2)]
    finally:
        query.stop()
        spark.streams.removeListener(late)


def test_one_watermark(spark, tmp_path):
    put(spark, str(tmp_path / "in"), (datetime(2024, 1, 1, 10, 5), "1"))
    own = J.edit_windows(J.dedup_events(J.with_event_time(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")))))
    assert own._jdf.queryExecution().analyzed().toString().count("EventTimeWatermark") == 1


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    path, hour = str(tmp_path / "in"), datetime(2024, 1, 1, 10)
    put(spark, path, (datetime(2024, 1, 2), "first"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    late = J.count_late_rows(spark)
    query = None
    try:
        rows = spark.createDataFrame([("w", "a", "u", None, 1, i, hour, str(i)) for i in range(150)], KIND).withColumn("n", F.col("rev_id"))
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
        query = J.dedup_events(J.with_event_time(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        rows.repartitionByRange(150, "n").drop("n").write.mode("append").parquet(path)  # 150 batches of one late row each
        query.processAllAvailable()
        assert late.of(query) == 150
        assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) < 150
    finally:
        if query:
            query.stop()
        spark.streams.removeListener(late)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["str03_sliding_windows", "str04_tumbling_windows"])
def test_state_of_a_window_has_only_what_is_read(spark, monkeypatch, name):
    seen = []
    monkeypatch.setattr(io, "streamed", lambda t, df, keys: seen.append(df) or df)
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "editor_count" not in seen[0].columns and set(io.WINDOW) < set(seen[0].columns)
