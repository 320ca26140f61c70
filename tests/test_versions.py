"""Snapshots as versions with pointers: what readers see, empty rewrites, refusals, conflicts, leftovers."""

from datetime import datetime

import pytest

from tideglass.sources.versions import Conflict, Versions, WouldOrphan

CLUSTERS, MEMBERS = "source string, snapshot_ts timestamp, id long, label string", "source string, snapshot_ts timestamp, id long, page_id long"


def at(hour):
    return datetime(2024, 1, 1, hour)


def parts(spark, *hours):
    return spark.createDataFrame([("live", at(h)) for h in hours], "source string, snapshot_ts timestamp")


def clusters(spark, hour, *ids, label="a"):
    return spark.createDataFrame([("live", at(hour), i, label) for i in ids], CLUSTERS)


def members(spark, hour, *ids):
    return spark.createDataFrame([("live", at(hour), i, 10 * i + k) for i in ids for k in range(2)], MEMBERS)


@pytest.fixture
def store(spark, tmp_path):
    v = Versions(spark, str(tmp_path), {"clusters": CLUSTERS, "members": MEMBERS})
    v.replace(parts(spark, 1, 2), {"clusters": clusters(spark, 1, 1, 2).union(clusters(spark, 2, 3)), "members": members(spark, 1, 1, 2).union(members(spark, 2, 3))})
    return v


def ids(store, table="clusters"):
    return sorted(r.id for r in store.read(table).collect())


def test_empty_store(spark, tmp_path):
    v = Versions(spark, str(tmp_path), {"clusters": CLUSTERS})
    assert v.read("clusters").count() == 0 and v.pointers().count() == 0


def test_empty_rewrite_leaves_no_old_row(spark, store):
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1)})
    assert ids(store) == [3] and ids(store, "members") == [3, 3]
    assert {(r.snapshot_ts.hour, r.generation, r.rows["clusters"]) for r in store.pointers().collect()} == {(1, 1, 0), (2, 0, 1)}
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 7)})
    assert ids(store) == [3, 7]


def test_registered_without_rows(spark, store):
    store.replace(parts(spark, 5), {})
    assert {(r.snapshot_ts.hour, r.rows["clusters"]) for r in store.pointers().collect()} == {(1, 2), (2, 1), (5, 0)}


def test_readers_never_see_a_half(spark, store, monkeypatch):
    def cut_off(pointer):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(store, "_point", cut_off)
        store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 8, 9), "members": members(spark, 1, 8)})
    assert ids(store) == [1, 2, 3] and ids(store, "members") == [1, 1, 2, 2, 3, 3]
    # A pointer that was being written when its writer died.
    fs, path = store._at(store._folder({"source": "live", "snapshot_ts": str(int(at(1).timestamp()) * 10**6)}) + "/000000000001.json")
    out = fs.create(path, False)
    out.write(b'{"key": {"source": "live", "snapshot_ts": "17040')
    out.close()
    assert ids(store) == [1, 2, 3]
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 4)})
    assert ids(store) == [3, 4]


def test_guard_refuses_and_changes_nothing(spark, store):
    stock = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C"), (3, "D")], "cluster_id long, ticker string")
    report = spark.createDataFrame([(2, "x")], "cluster_id long, body string")
    new = {"clusters": clusters(spark, 1, 2, label="b"), "members": members(spark, 1, 2)}
    guard = {"dependants": {"stock": stock, "report": report}, "table": "clusters"}
    with pytest.raises(WouldOrphan) as refused:
        store.replace(parts(spark, 1), new, **guard)
    assert refused.value.counts == {"stock": 2, "report": 0}
    assert ids(store) == [1, 2, 3] and {r.label for r in store.read("clusters").collect()} == {"a"}
    assert store.vacuum(0) == []  # what was refused is gone
    store.replace(parts(spark, 1), new, **guard, allow=True)
    assert ids(store) == [2, 3]
    assert sorted(r.ticker for r in store.kept(stock, "clusters").collect()) == ["C", "D"]
    store.replace(parts(spark, 1), new, **guard)  # nothing is lost: no refusal


def test_second_writer_fails(spark, store, monkeypatch):
    monkeypatch.setattr(store, "_last", lambda key: -1)  # started before the first had finished
    with pytest.raises(Conflict):
        store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 5)})
    assert ids(store) == [1, 2, 3]


def test_rows_of_other_parts_are_an_error(spark, store):
    with pytest.raises(ValueError, match="not replaced"):
        store.replace(parts(spark, 1), {"clusters": clusters(spark, 2, 5)})
    assert ids(store) == [1, 2, 3]


def test_reads_before_and_after_in_one_plan(spark, store):
    before = store.read("clusters")
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 4)})
    assert sorted(r.id for r in before.exceptAll(store.read("clusters")).collect()) == [1, 2]


def test_vacuum_keeps_what_is_read(spark, store):
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 4)})
    store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 6)})
    assert len(store.vacuum(0)) == 1 and store.vacuum(0) == []  # the first version still has hour 2
    assert ids(store) == [3, 6] and ids(store, "members") == [3, 3]


def test_rows_keys_are_not_broadcast(spark, store, monkeypatch):
    """Keys of rows look small when they are compressed; their table must not be built on the driver."""
    seen = []
    plain = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: (plain(df), seen.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    stocks = spark.createDataFrame([(1, "A"), (2, "B"), (2, "C"), (3, "D")], "cluster_id long, ticker string")
    with pytest.raises(WouldOrphan) as refused:
        store.replace(parts(spark, 1), {"clusters": clusters(spark, 1, 1)}, {"stocks": stocks, "others": stocks.where("cluster_id = 3")}, "clusters")
    assert refused.value.counts == {"stocks": 2, "others": 0}
    assert sorted(r.ticker for r in store.kept(stocks, "clusters").collect()) == ["A", "B", "C", "D"]
    joins = [line for plan in seen for line in plan.splitlines() if "Join" in line and ("[cluster_id" in line or "LeftAnti" in line)]
    assert joins and all("SortMergeJoin" in line for line in joins)
