"""The live cycle: what it fetches, judges, expires and exchanges; repeated and broken off."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.streaming.live import Live

AT = datetime(2024, 3, 10, 0)
NOW = "2024-03-12 12:00:00"
DECIDED = "wiki string, title string, window_start timestamp, edit_count long, editor_count long, views long, max_rev_id long, status string, view_ratio double, view_z double, spike_score double"


def hour(h):
    return AT + timedelta(hours=h)


def decided(spark, *rows):
    return spark.createDataFrame([("w", t, hour(h), 2, 1, None, 7, s, None, None, 0.0) for t, h, s in rows], DECIDED)


@pytest.fixture
def live(spark, tmp_path):
    out = Live(spark, str(tmp_path))
    out.add(decided(spark, ("Hot", 40, "PENDING_VIEWS"), ("Cold", 40, "PENDING_VIEWS"), ("Silent", 41, "PENDING_VIEWS"), ("Lost", 5, "PENDING_VIEWS"), ("Young", 59, "PENDING_VIEWS"), ("Done", 40, "CONFIRMED"), ("Not", 40, "REJECTED")))
    return out


def fetch(spark):
    rows = [("w", "Hot", hour(40), 300, True), ("w", "Hot", hour(40), 60, False), ("w", "Cold", hour(40), 3, False), ("w", "Other", hour(40), 900, False), ("w", "Small", hour(40), 1, False)]

    def get(hours):
        due = {r.ts_hour for r in hours.collect()}
        assert hour(59) not in due  # not three hours old
        come = spark.createDataFrame([("w", hour(h)) for h in (40, 41) if hour(h) in due], "wiki string, ts_hour timestamp")  # the hour of Lost never comes
        return come, spark.createDataFrame(rows, "wiki string, title string, ts_hour timestamp, views long, is_mobile boolean").join(come, ["wiki", "ts_hour"], "left_semi")

    return get


def content(live):
    tables = (live.pending(), live.spikes(), live.views.read("views"), live.ledger(), live.baseline.read("baseline"))
    return [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in tables]


def test_cycle_twice_gives_equal_tables(spark, live):
    did = live.cycle(NOW, fetch(spark), floor=100)
    assert did == {"hours": 2, "confirmed": 1, "rejected": 2, "still_pending": 0, "expired": 1, "baseline": 0}
    assert {(r.title, r.rechecks) for r in live.pending().collect()} == {("Young", 0)}
    assert {(r.title, r.views) for r in live.spikes().collect()} == {("Hot", 360), ("Done", None)}
    assert {(r.title, r.views, r.mobile_views) for r in live.views.read("views").collect()} == {("Hot", 360, 300), ("Cold", 3, 0), ("Other", 900, 0)}
    assert {r.ts_hour for r in live.ledger().collect()} == {hour(40), hour(41)}  # the second has no rows
    first = content(live)
    assert live.cycle(NOW, fetch(spark), floor=100) == {"hours": 0, "confirmed": 0, "rejected": 0, "still_pending": 0, "expired": 0, "baseline": 0}
    assert content(live) == first
    live.add(decided(spark, ("Young", 59, "PENDING_VIEWS"), ("Done", 40, "CONFIRMED")))  # a batch of the stream again
    assert content(live) == first


@pytest.mark.parametrize("step", ["recheck", "refresh"])
def test_cycle_goes_on_where_it_broke_off(spark, live, tmp_path, monkeypatch, step):
    def broken(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(live, step, broken)
        live.cycle(NOW, fetch(spark), floor=100)
    live.cycle(NOW, fetch(spark), floor=100)
    got = content(live)
    other = Live(spark, str(tmp_path / "other"))
    other.add(decided(spark, ("Hot", 40, "PENDING_VIEWS"), ("Cold", 40, "PENDING_VIEWS"), ("Silent", 41, "PENDING_VIEWS"), ("Lost", 5, "PENDING_VIEWS"), ("Young", 59, "PENDING_VIEWS"), ("Done", 40, "CONFIRMED")))
    other.cycle(NOW, fetch(spark), floor=100)
    assert got == content(other)


def test_no_hour_comes_nothing_expires(spark, live):
    none = lambda hours: (hours.select("wiki", "ts_hour").limit(0), spark.createDataFrame([], "wiki string, title string, ts_hour timestamp, views long, is_mobile boolean"))
    before = content(live)
    assert live.cycle(NOW, none) == {"hours": 0, "confirmed": 0, "rejected": 0, "still_pending": 0, "expired": 0, "baseline": 0}
    assert content(live) == before


def test_baseline_is_exchanged_once_a_day(spark, live):
    live.cycle(NOW, fetch(spark), floor=100)
    days = lambda: {str(r.as_of) for r in live.baseline.read("baseline").collect()}
    assert not days()  # no view is as old as the day before yesterday
    none = lambda hours: (hours.select("wiki", "ts_hour").limit(0), fetch(spark)(hours.limit(0))[1])
    assert live.cycle("2024-03-14 16:00:00", none)["baseline"] == 1 and days() == {"2024-03-12"}
    assert live.cycle("2024-03-14 17:00:00", none)["baseline"] == 0 and days() == {"2024-03-12"}
    assert live.refresh("2024-03-15 16:00:00") and days() == {"2024-03-13"}
    slots = {(r.title, r.hour_of_day, r.view_ewma) for r in live.baseline.read("baseline").collect()}
    assert slots == {("Hot", 16, 360.0), ("Cold", 16, 3.0), ("Other", 16, 900.0)}
