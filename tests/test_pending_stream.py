"""Pending windows as keyed state, against the batch form, with restarts from the checkpoint."""

import random
from datetime import datetime, timedelta


from tideglass.operators import attention as A
from tideglass.streaming import pending as P

START = datetime(2024, 1, 1)
DECISIONS = "wiki string, title string, window_start timestamp, status string"


def test_state_survives_restarts_and_agrees_with_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    windows = [(w, f"T{k}", START + timedelta(hours=h)) for w in ("enwiki", "dewiki") for k in range(4) for h in range(0, 60, 5)]
    state = spark.createDataFrame([], "wiki string, title string, window_start timestamp, rechecks int")
    ledger = spark.createDataFrame([], "wiki string, ts_hour timestamp")
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "state"))
    for step in range(6):
        now = START + timedelta(hours=20 + 12 * step)
        judged = [(*w, rng.choice(["PENDING_VIEWS", "PENDING_VIEWS", "CONFIRMED", "REJECTED"])) for w in windows if w[2] < now and rng.random() < 0.5]
        # dewiki's hours stop arriving for a while: nothing of it may expire meanwhile.
        arrived = [(w, now - timedelta(hours=h)) for w in ("enwiki", "dewiki") for h in range(3) if w == "enwiki" or step in (0, 5)]
        decisions = spark.createDataFrame(judged, DECISIONS)
        hours = spark.createDataFrame(arrived, "wiki string, ts_hour timestamp")
        rows = P.decision_rows(decisions, str(now)).unionByName(P.ledger_rows(hours, str(now)))
        tick = P.ledger_rows(hours.where("wiki = 'enwiki'"), str(now + timedelta(milliseconds=1)))  # moves the clock past now
        odd = spark.createDataFrame([(None, "a", now, "PENDING_VIEWS", None, now), ("enwiki", None, now, "PENDING_VIEWS", None, now), ("enwiki", "a", None, None, None, now)], P.ROWS)
        for part in (rows.unionByName(odd), tick):
            part.coalesce(1).write.mode("append").parquet(source)
            query = P.start_pending_stream(spark.readStream.schema(P.ROWS).parquet(source), out, check, None, buckets=4)  # goes on from the checkpoint
            query.awaitTermination()
            assert query.exception() is None
        ledger = spark.createDataFrame(ledger.unionByName(hours).collect(), "wiki string, ts_hour timestamp")
        after = A.pending_update(state, decisions)
        left = after.join(A.expired(after, ledger, str(now + timedelta(milliseconds=1))), ["wiki", "title", "window_start"], "left_anti")
        state = spark.createDataFrame(left.collect(), "wiki string, title string, window_start timestamp, rechecks int")
        got = sorted(map(tuple, P.pending_table(spark, out).collect()))
        assert got == sorted((r.wiki, r.title, r.window_start, r.rechecks) for r in state.collect()), (step, set(got) ^ {tuple(r) for r in state.collect()})
    kinds = {r.action for r in spark.read.schema(P.CHANGES).parquet(out).select("action").distinct().collect()}
    assert kinds == {"keep", "bump", "drop", "expire"}


def test_provider_is_set_for_the_stream_only(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.createDataFrame([("w", "t", START, "PENDING_VIEWS", None, START)], P.ROWS).write.parquet(str(tmp_path / "in"))
    P.start_pending_stream(spark.readStream.schema(P.ROWS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), None).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert [r.rechecks for r in P.pending_table(spark, str(tmp_path / "out")).collect()] == [0]
