"""Maps, their audit, details and report inputs on rows made for them; maps of really cut clusters against plain rows."""

import re
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tideglass.operators import documents as O
from tideglass.operators import graph as G
from tideglass.plans import documents as P
from tideglass.plans.graph import links, roots
from tideglass.plans.registry import QUERIES, SQL, Tables

SF = "/root/testdata/sf0.001"
AT = datetime(2024, 1, 2)
NODE = "struct<page_id:string,wiki:string,title:string,is_seed:boolean,edit_count:long,views:long,edit_baseline:double,view_baseline:double,spike_score:double,size_score:double,completeness:string,window_start:timestamp,window_end:timestamp>"
EDGE = "struct<id:string,source_page_id:string,target_page_id:string,kind:string,directed:boolean,weight:double,evidence:struct<label:string,month:string,observed:timestamp>>"
CLUSTER = f"struct<id:string,issue_key:string,label:string,category:string,first_detected:timestamp,hot:boolean,pulse_score:double,status:string,member_count:int,nodes:array<{NODE}>,edges:array<{EDGE}>>"
MAP = f"source string, snapshot_ts timestamp, registered int, meta struct<score_version:string,new_window_hours:int,cluster_count:int,node_count:int,edge_count:int,truncated:boolean>, clusters array<{CLUSTER}>"


def node(page="1", **change):
    own = dict(page_id=page, wiki="w", title="T", is_seed=True, edit_count=1, views=1, edit_baseline=None, view_baseline=None, spike_score=1.0, size_score=None, completeness="complete", window_start=datetime(2024, 1, 1), window_end=AT)
    return tuple((own | change).values())


def edge(a, b):
    return (f"{a}-{b}", a, b, "link", True, 1.0, ("T", "2024-01", AT))


def cluster(nodes, edges=(), **change):
    own = dict(id="c", issue_key=None, label="L", category="etc", first_detected=None, hot=True, pulse_score=1.0, status="CONFIRMED", member_count=len(nodes))
    return (*(own | change).values(), list(nodes), list(edges))


def a_map(clusters, source="live", registered=None, meta=None):
    n = len(clusters)
    meta = meta or (n, sum(len(c[-2]) for c in clusters), sum(len(c[-1]) for c in clusters))
    return (source, AT, n if registered is None else registered, ("v1", 24, *meta, False), list(clusters))


@pytest.mark.parametrize(
    ("document", "want"),
    [
        (a_map([cluster([node("1"), node("2")], [edge("1", "2")])]), []),
        (a_map([]), []),
        (a_map([], registered=1), [("count", None, "registered")]),
        (a_map([cluster([node()])], meta=(2, 3, 4)), [("count", None, "clusters"), ("count", None, "nodes"), ("count", None, "edges")]),
        (a_map([cluster([node()], member_count=2)]), [("count", "c", "members")]),
        (a_map([cluster([node(), node()])]), [("unique", "c", "1")]),
        (a_map([cluster([node()], issue_key="k"), cluster([node()], issue_key="k")]), [("unique", None, "c"), ("unique", None, "k")]),
        (a_map([cluster([node("1")], [edge("1", "2"), edge("3", "1")])]), [("edge_ends", "c", "1-2"), ("edge_ends", "c", "3-1")]),
        (a_map([cluster([node(window_end=datetime(2024, 1, 3))])]), [("window_after_snapshot", "c", "1")]),
        (a_map([cluster([node(window_start=AT)])]), [("window_order", "c", "1")]),
        (a_map([cluster([node(window_start=None)])]), [("window_order", "c", "1")]),
        (a_map([cluster([node()], first_detected=datetime(2024, 1, 3))]), [("first_detected", "c", None)]),
        (a_map([cluster([node(completeness="odd")], status="DISCARDED", category="x")], source="test"), [("domain", None, "source"), ("domain", "c", "status"), ("domain", "c", "category"), ("domain", "c", "completeness of 1")]),
        (a_map([cluster([node(size_score=1.01), node("2", size_score=1.0)])]), [("size_over_one", "c", "1")]),
    ],
)
def test_every_rule_of_a_map(spark, document, want):
    found = O.map_violations(spark.createDataFrame([document], MAP), ("etc",))
    assert [tuple(r)[2:] for r in found.collect()] == want


def test_audit_reads_maps_once(spark, tmp_path):
    spark.createDataFrame([a_map([cluster([node()])])], MAP).write.parquet(str(tmp_path / "maps"))
    plan = O.map_violations(spark.read.parquet(str(tmp_path / "maps")), ("etc",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") == 1 and "Exchange" not in plan


def test_maps_of_cut_clusters(spark):
    t = Tables(spark, SF)
    clusters, people, edges, registry = (df.cache() for df in P.store(t, focus=0.05, detach=2))
    assert O.map_violations(O.pulse_map(clusters.drop("comp"), people, edges, registry), ("etc",)).where("rule <> 'unique'").isEmpty()  # one lead may have two clusters
    linked = defaultdict(set)
    named = {(r.snapshot_ts, r.link_key): r.page_id for r in roots(t).collect()}
    for r in links(t).collect():
        if (r.snapshot_ts, r.target) in named:
            linked[r.snapshot_ts, r.page_id].add(named[r.snapshot_ts, r.target])
    kept = {(r.snapshot_ts, r.page_id): set(r.kept) for r in G.core_links(roots(t), links(t), 0.05, 2).collect()}
    cuts = 0
    for m in O.pulse_map(clusters, people, edges, registry).collect():
        for c in m.clusters:
            pages = {int(n.page_id) for n in c.nodes}
            want = {(a, b) for a in pages for b in kept[m.snapshot_ts, a] if a < b}
            got = {}
            for e in c.edges:
                a, b = int(e.source_page_id), int(e.target_page_id)
                assert b in linked[m.snapshot_ts, a]  # evidence comes from the side that links
                assert e.directed == (a not in linked[m.snapshot_ts, b]) and (e.directed or a < b)
                got[min(a, b), max(a, b)] = e.evidence.label
            assert set(got) == want
            cuts += sum(len(linked[m.snapshot_ts, a] & pages) for a in pages) > 2 * len(want)
            order = [(not n.is_seed, -n.spike_score, int(n.page_id)) for n in c.nodes]
            assert order == sorted(order)
        assert m.meta.edge_count == sum(len(c.edges) for c in m.clusters)
    assert kept and sum(map(len, kept.values())) < sum(len(b & {p for s, p in kept if s == k[0]}) for k, b in linked.items()) * 2


def test_report_sections(spark):
    texts = [None, "", "{", "[]", "[1", '{"id":"a","title":"b"}', '[{"id":"a","title":"b"}]', '[{"id":" ","title":"b"},{"id":"a"},{"title":"b"}]', '[{"id":"a","title":"b","evidenceIds":["x"],"new":1},{"id":"c","title":"d","body":"e"}]']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", O.sections_of(F.col("t")).alias("s")).collect()
    got = {r.i: r.s and [(s.id, s.title, s.body, s.evidence_ids) for s in r.s] for r in rows}
    assert got[6] == [("a", "b", None, [])] and got[8] == [("a", "b", None, ["x"]), ("c", "d", "e", [])]
    assert all(got[i] is None for i in (0, 1, 2, 3, 4, 7))


def test_best_stocks_are_cut_before_they_are_gathered(spark):
    rows = [(1, f"S{i}", "BOTH" if i % 3 else "GDELT_ONLY", float(i % 7), None, i != 5) for i in range(40)] + [(2, "A", "BOTH", None, None, False)]
    df = spark.createDataFrame(rows, "cluster_id long, ticker string, tier string, gdelt_lift double, similarity double, verified boolean")
    best = O.best_stocks(df)
    want = sorted((r for r in rows if r[5] and r[0] == 1), key=lambda r: (r[2] != "BOTH", -(r[3] or 0), r[1]))[:5]
    assert [(r.cluster_id, [s.ticker for s in r.stocks]) for r in best.collect()] == [(1, [w[1] for w in want])]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan)


def test_exact_quantiles_in_several_rounds(spark):
    import random
    import statistics

    from tideglass.operators.statistics import exact_quantile, order_statistic

    rng = random.Random(4)
    for values in ([rng.choice([rng.gauss(0, 1), 0.0, 1e300, -1e300, 5.0]) for _ in range(1001)], [7.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(2)
        assert exact_quantile(df, "x", bins=64, few=20) == pytest.approx(statistics.median(values), rel=1e-15)
    own = spark.createDataFrame([(2.0 ** rng.randrange(-60, 60),) for _ in range(500)], "x double")
    assert order_statistic(own, "x", 100, bins=8, few=20) == sorted(r.x for r in own.collect())[100]
    assert exact_quantile(df.where("false"), "x") is None


def test_audit_of_a_month_without_live_clusters_equals_sql(spark, tmp_path):
    """March 1995 has one cluster, of pages 9 and 19, which is discarded; the audit plants no wrong count there."""
    duckdb = pytest.importorskip("duckdb")
    rows = ", ".join(f"({order}, {part}, 1, date '1995-{month}-05')" for order, part, month in ((19, 9, "03"), (9, 19, "03"), (4, 2, "04"), (2, 4, "04")))
    c = duckdb.connect()
    c.execute(f"copy (select order_id::bigint as l_orderkey, part::bigint as l_partkey, quantity::double as l_quantity, day as l_shipdate from (values {rows}) as v(order_id, part, quantity, day)) to '{tmp_path}/lineitem.parquet'")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = c.execute(SQL["dqc02b_map_audit"]).fetchall()
    got = [tuple(r) for r in QUERIES["dqc02b_map_audit"](spark, str(tmp_path)).collect()]
    assert sorted((str(a)[:10], *x) for a, *x in got) == sorted((str(a)[:10], *x) for a, *x in want)
    assert {str(a)[:7] for a, rule, _ in want if rule == "count"} == {"1995-04"}
