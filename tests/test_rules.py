"""Rules on rows made for them: decisions, titles, graphs, root selection, sources and sinks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.functions import scalar as S
from tideglass.operators import attention as A
from tideglass.operators import graph as G
from tideglass.operators import lift as L
from tideglass.operators import serving as V
from tideglass.sources import readers as R
from tideglass.sources import sinks as K


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("Page__a_ b", "Page a b"), ("_", ""), (" x", " x"), ("  a  ", "a")])
def test_titles(spark, raw, want):
    assert one(spark, raw, S.canonical_title) == want


def test_link_keys_and_links(spark):
    assert one(spark, "eBay_ inc", S.link_key) == "EBay inc"
    text = "[[alpha|x]] [[Alpha#s]] [[File:a]] [[de:b]] [[:Category:c]] [[#d]] [[Bang: The Story]] [[ beta__two ]] [[pt-br:e]]"
    assert one(spark, text, S.wikitext_links) == ["Alpha", "Bang: The Story", "Beta two"]


def test_content_titles(spark):
    own = spark.createDataFrame([("-",), ("Talk:a",), ("Bang:_The_Story",), ("User_talk:b",), ("a",), ("WP:x",)], "t string")
    assert [r.t for r in own.where(S.is_content_title(F.col("t"))).collect()] == ["Bang:_The_Story", "a"]


def test_small_functions(spark):
    assert one(spark, "pageviews-20240901-000000.gz", S.file_hour) == datetime(2024, 8, 31, 23)
    assert one(spark, "zh_min_nanwiki", S.domain_of_wiki) == "zh-min-nan.wikipedia.org" and one(spark, "commonswiki", S.domain_of_wiki) is None
    assert one(spark, "The Acme Group Co., Inc.", S.org_key) == "acme" and one(spark, "The Company", S.org_key) == ""
    assert one(spark, "Effects of Hurricane Milton (2024) in Florida", S.title_terms) == ["hurricane", "milton", "florida"]
    assert [(x.h, x.v) for x in one(spark, "C2G1C3", S.decode_hourly)] == [(2, 2), (6, 1), (2, 3)] and one(spark, "C2?", S.decode_hourly) is None
    assert one(spark, "a. b. c...", lambda c: S.first_sentences(c, 2)) == "a. b"
    assert one(spark, "one. two two. three. four", lambda c: S.fit_lead(c, 17)) == "one. three. four"
    html = "<table><p>no</p></table><p class=x>A&amp;lt; <b>b</b><sup>1</sup></p><p>c&nbsp;d</p>"
    assert one(spark, html, S.lead_from_html) == "A&lt; b c d"


CASES = [
    # edits, views, view mean, view deviation, days -> status
    (0, 500, 10.0, 1.0, 20, "REJECTED"), (1, None, 10.0, 1.0, 20, "PENDING_VIEWS"), (1, 100, 10.0, 1.0, 6, "CONFIRMED"), (1, 99, 10.0, 1.0, 6, "REJECTED"),
    (1, 100, None, None, None, "CONFIRMED"), (1, 100, 0.0, 0.0, 20, "CONFIRMED"), (1, 120, 60.0, 0.0, 20, "CONFIRMED"), (1, 119, 60.0, None, 20, "REJECTED"),
    (1, 130, 60.0, 20.0, 20, "CONFIRMED"), (1, 119, 40.0, 40.0, 20, "REJECTED"), (1, 0, 10.0, 1.0, 20, "REJECTED"),
]


def test_decision_branches(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, e int, v int, m double, s double, d int, want string")
    none = F.lit(1.0)
    out = rows.withColumn("r", S.detect(F.col("e"), F.col("v"), none, none, F.col("m"), F.col("s"), F.col("d"))).collect()
    assert [(r.i, r.r.status) for r in out] == [(r.i, r.want) for r in out]
    assert all((r.r.spike_score > 0) == (r.r.status == "CONFIRMED" and r.v > (r.m or 0)) for r in out)


def test_old_windows_stay_out_of_the_baseline(spark):
    at = datetime(2024, 1, 31, 5)
    rows = [("w", "t", at - timedelta(days=d), 1 if d < 28 else 1000, float(d)) for d in (0, 1, 27, 28, 29, -1)]
    b = A.ewma_baseline(spark.createDataFrame(rows, "wiki string, title string, window_start timestamp, edit_count long, views double"), "2024-01-31").first()
    assert b.sample_days == 3 and b.edit_ewma == pytest.approx(1.0) and b.edit_stddev == pytest.approx(0.0)


def test_bots_without_flag_are_humans(spark):
    assert A.humans(spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, is_bot boolean")).count() == 2


def greedy(rows, limit, hours):
    last, taken, out = {}, {}, set()
    for at, page, views in sorted(rows, key=lambda r: (r[0], -(r[2] or 0), r[1])):
        if limit is not None and taken.get(at, 0) >= limit or page in last and at - last[page] < timedelta(hours=hours):
            continue
        last[page], taken[at] = at, taken.get(at, 0) + 1
        out.add((at, page))
    return out


@pytest.mark.parametrize(("limit", "hours", "seed"), [(2, 24, 1), (3, 5, 2), (None, 24, 3), (2, 0, 4), (1, 48, 5)])
def test_root_selection(spark, limit, hours, seed):
    rng = random.Random(seed)
    rows = sorted({(datetime(2024, 1, 1) + timedelta(hours=rng.randrange(80)), rng.randrange(12)): rng.choice([None, 0, 5, 9, 9, 20]) for _ in range(300)}.items())
    rows = [(a, p, v) for (a, p), v in rows]
    df = spark.createDataFrame([("live", *r) for r in rows], "source string, snapshot_ts timestamp, page_id long, views int")
    assert {(r.snapshot_ts, r.page_id) for r in G.select_roots(df, limit, hours).collect()} == greedy(rows, limit, hours)


def test_root_selection_goes_on_from_earlier_picks(spark):
    rng = random.Random(9)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=7 * h + 200 * (h > 12)), p, rng.randrange(30)) for h in range(25) for p in range(9) if rng.random() < 0.7]
    df = spark.createDataFrame([(s, *r) for s in ("live", "replay") for r in rows], "source string, snapshot_ts timestamp, page_id long, views int")
    whole = {(r.source, r.snapshot_ts, r.page_id) for r in G.select_roots(df, 2, 24).collect()}
    assert whole == {(s, *x) for s in ("live", "replay") for x in greedy(rows, 2, 24)}
    for cut in (rows[40][0], rows[90][0]):
        first = G.select_roots(df.where(F.col("snapshot_ts") < cut), 2, 24)
        then = G.select_roots(df.where(F.col("snapshot_ts") >= cut), 2, 24, first)
        assert {(r.source, r.snapshot_ts, r.page_id) for r in first.union(then).collect()} == whole
    alone = G.select_roots(df.where(F.col("snapshot_ts") >= cut), None, 24, G.select_roots(df.where(F.col("snapshot_ts") < cut), None, 24))
    assert {(r.snapshot_ts, r.page_id) for r in alone.collect()} == {x for x in greedy(rows, None, 24) if x[0] >= cut}


def test_root_selection_of_one_unbroken_run_in_blocks(spark):
    rng = random.Random(11)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=6 * h), p, rng.randrange(40)) for h in range(240) for p in range(14) if rng.random() < 0.6]
    df = spark.createDataFrame([(s, *r) for s in ("live", "replay") for r in rows], "source string, snapshot_ts timestamp, page_id long, views int")
    for span in (1, 3):
        rounds = []
        got = {(r.source, r.snapshot_ts, r.page_id) for r in G.select_roots(df, 3, 24, span=span, rounds=rounds).collect()}
        assert got == {(s, *x) for s in ("live", "replay") for x in greedy(rows, 3, 24)}
        assert 120 // span <= rounds[0] <= 120 // span + 4 and 1 < len(rounds) <= 60 // span + 1  # all blocks at once, then those that changed
        assert sum(rounds[1:]) < rounds[0] * len(rounds)


def plain_core(pages, links, outlinks, focus, detach):
    """The two suppressions by sets of pages, each step from the beginning. pages: (page, views, score) in order."""
    order = [p for p, _, _ in sorted(pages, key=lambda x: (-x[2], x[0]))]
    views, rank = {p: v for p, v, _ in pages}, {p: i for i, p in enumerate(order)}
    edges = {frozenset(e) for e in links}
    degree = {p: sum(p in e for e in edges) for p in order}

    def reach(p, without=None):
        seen = {p}
        while more := {x for e in edges for x in e if e & seen and without not in e} - seen:
            seen |= more
        return seen

    def split(v):
        out = []
        for x in [x for x in order if frozenset((v, x)) in edges]:
            if not any(x in o for o in out):
                out.append(reach(x, v))
        return sorted(out, key=lambda o: min(rank[x] for x in o))

    n = lambda v, o: sum(frozenset((v, x)) in edges for x in o)
    best = lambda v, parts: max(parts, key=lambda o: (n(v, o), max(views[x] for x in o)))
    lost = {"weak": set(), "unvouched": set()}

    def step(kind):
        deg = {p: sum(p in e for e in edges) for p in order}
        if kind == "weak":
            own = sorted((degree[p] / outlinks[p], -deg[p], rank[p], p) for p in order if outlinks[p] and degree[p] / outlinks[p] < focus)
        else:
            own = sorted((-len(split(p)), -deg[p], rank[p], p) for p in order)
        for *_, v in own:
            parts = split(v)
            if len(parts) < 2:
                continue
            kept = [best(v, parts)] if kind == "weak" else [o for o in parts if any((v, x) in links for x in o if frozenset((v, x)) in edges)] or [best(v, parts)]
            rest = [o for o in parts if o not in kept]
            if kind == "weak" or len(rest) >= detach:
                cut = {e for e in edges for o in rest if v in e and e & o}
                edges.difference_update(cut)
                lost[kind] |= cut
                return True
        return False

    for kind in lost:
        while step(kind):
            pass
    return {p: min(reach(p)) for p in order}, edges, lost


def test_core_clusters_against_a_plain_version(spark):
    rng = random.Random(4)
    roots, links, want = [], [], {}
    for k in range(60):
        at, n = datetime(2024, 1, 1) + timedelta(hours=k), rng.randrange(3, 12)
        pages = [(p, rng.choice([0, 5, 5, 9]), rng.choice([1.0, 2.0, 3.0])) for p in rng.sample(range(40), n)]
        ids = [p for p, _, _ in pages]
        own = {(a, b) for _ in range(rng.randrange(2, 2 * n)) for a, b in [rng.sample(ids, 2)]}
        more = {p: rng.choice([0, 0, 3, 30]) for p in ids}
        outlinks = {p: sum(a == p for a, _ in own) + more[p] for p in ids}
        roots += [("live", at, p, f"P{p}", v, s) for p, v, s in pages]
        links += [("live", at, a, f"P{b}") for a, b in own] + [("live", at, p, f"x{i}") for p in ids for i in range(more[p])]
        want[at] = plain_core(pages, own, outlinks, 0.1, 2)
    roots = spark.createDataFrame(roots, "source string, snapshot_ts timestamp, page_id long, link_key string, views int, score double")
    links = spark.createDataFrame(links, "source string, snapshot_ts timestamp, page_id long, target string")
    out = G.core_links(roots, links, 0.1, 2)
    comp = {(r.snapshot_ts, r.page_id): r.comp for r in out.collect()}
    assert comp == {(at, p): c for at, (own, *_) in want.items() for p, c in own.items()}
    edges = {(r.snapshot_ts, r.fate, frozenset((r.a, r.b))) for r in G.core_edges(out).collect()}
    assert edges == {(at, "kept", e) for at, (_, kept, _) in want.items() for e in kept} | {(at, k, e) for at, (_, _, lost) in want.items() for k, es in lost.items() for e in es}
    assert {f for _, f, _ in edges} == {"kept", "weak", "unvouched"}


def graph_of(spark, pages, links):
    roots = spark.createDataFrame([("live", datetime(2024, 1, 1), p, f"P{p}", v, s) for p, v, s in pages], "source string, snapshot_ts timestamp, page_id long, link_key string, views int, score double")
    own = spark.createDataFrame([("live", datetime(2024, 1, 1), a, t) for a, t in links], "source string, snapshot_ts timestamp, page_id long, target string")
    return {r.page_id: r.comp for r in G.core(roots, own).collect()}


def test_page_of_low_focus_does_not_bridge(spark):
    pages = [(i, 10 * i, float(10 - i)) for i in range(1, 6)]
    around = [(1, f"x{i}") for i in range(1000)]
    links = [(1, "P2"), (1, "P4"), (2, "P3"), (3, "P1"), (4, "P5")]
    assert graph_of(spark, pages, links) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert graph_of(spark, pages, links + around) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_pieces_that_only_link_in_do_not_join(spark):
    pages = [(i, 10, float(10 - i)) for i in range(1, 5)]
    assert graph_of(spark, pages, [(2, "P1"), (3, "P1"), (4, "P1")]) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert graph_of(spark, pages, [(1, "P2"), (1, "P3"), (4, "P1")]) == {1: 1, 2: 1, 3: 1, 4: 1}


def test_places_match_as_words(spark):
    rows = spark.createDataFrame([(1, ["HURRICANE"], ["floridablanca, colombia"]), (2, ["TAX_HURRICANE"], ["florida, united states"])], "i int, themes array<string>, locations array<string>")
    assert [r.i for r in rows.where(L.match_issue(["hurricane"], ["florida"])).collect()] == [2]
    with pytest.raises(ValueError, match="theme or a place"):
        L.match_issue([], [])


def test_history_width_is_fatal_in_strict_mode(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("\t".join(["x"] * 78) + "\n" + "\t".join(["y"] * 77) + "\n")
    good, bad = R.read_history(spark, str(tmp_path), {"a": 0}, "quarantine")
    assert [r.a for r in good.collect()] == ["x"] and bad.first().error == "77 columns instead of 78"
    with pytest.raises(Exception, match="77 columns"):
        R.read_history(spark, str(tmp_path), {"a": 0})[0].collect()


def test_hourly_views_of_a_midnight_file(spark, tmp_path):
    (tmp_path / "pageviews-20240901-000000").write_text("en A__b 3 0\nen.m A_b 4 0\nde A 9 0\nen Talk:A 9 0\nen _ 5 0\nen - 5 0\n")
    good, _ = R.read_hourly_views(spark, str(tmp_path), {"en": False, "en.m": True})
    out = A.hourly_views(good.withColumn("wiki", F.lit("enwiki"))).collect()
    assert [(r.title, r.ts_hour, r.views, r.mobile_views) for r in out] == [("A b", datetime(2024, 8, 31, 23), 7, 4)]


def test_archives_with_a_broken_one(spark, tmp_path):
    import zipfile

    row = [""] * 27
    row[0], row[4], row[7], row[9], row[13], row[14] = "r1", "http://x", "a;B;", "1#Paris, France#FR#", "Acme;", "acme,10;Beta,20"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "\t".join(row) + "\nshort\trow\n")
    (tmp_path / "b.zip").write_bytes(b"PK broken")
    good, broken = R.read_gkg(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in broken.collect()] == ["b.zip"]
    out = good.collect()
    assert [(r.doc_id, r.orgs, r.themes, r.locations) for r in out] == [("http://x", ["acme", "beta"], ["A", "B"], ["paris, france"])]


def test_edit_stream_asks_for_offsets_and_parses(spark):
    asked = {}

    class Reader:  # stands for a broker
        def format(self, kind):
            asked["format"] = kind
            return self

        def option(self, name, value):
            asked[name] = value
            return self

        def load(self):
            return spark.createDataFrame([('{"meta_id":"1","wiki":"w","title":"T","is_bot":false,"event_ts":"2024-01-01T00:00:00.000Z"}',), ("broken",), ('{"meta_id":" "}',)], "value string").select(F.encode("value", "UTF-8").alias("value"))

    class Session:
        readStream = Reader()  # noqa: N815

    out = R.read_edit_stream(Session(), "host:9092", "edits", "earliest", 7)
    assert asked == {"format": "kafka", "kafka.bootstrap.servers": "host:9092", "subscribe": "edits", "startingOffsets": "earliest", "maxOffsetsPerTrigger": 7}
    assert {f.name for f in R.EDIT.fields} <= set(out.columns)
    assert [r.meta_id for r in out.collect()] == ["1"]


def plain_lead(text, budget):
    head, *rest = text.split(". ")
    used, kept = len(head), []
    for s in reversed(rest):
        if used + len(s) + 2 > budget:
            break
        used, kept = used + len(s) + 2, [s, *kept]
    return ". ".join([head, *kept])[:budget]


def test_leads_of_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", S.fit_lead(F.col("text"), 300).alias("lead")).collect()
    assert [r.lead for r in rows] == [r.text and plain_lead(r.text, 300) for r in rows]


def test_listing_with_trailer(spark, tmp_path):
    (tmp_path / "l.txt").write_text("Symbol|Security Name|Test Issue|ETF\nABC|Abc Inc. - Common Stock|N|N\nDEF|Def Trust|N|Y\nG$|G Common Stock|N|N\nFile Creation Time: 1|||\n")
    assert [r.ticker for r in R.common_stock(R.read_listing(spark, str(tmp_path))).collect()] == ["ABC"]


def test_finished_shards_are_left_alone(spark, tmp_path):
    first = K.write_shards(spark.range(25), str(tmp_path / "s"), 10)
    again = K.write_shards(spark.range(3), str(tmp_path / "s"), 10)
    assert first.agg(F.sum("records")).first()[0] == again.agg(F.sum("records")).first()[0] == 25


#: Queries that join one row of totals; in jon04 it is a row a wiki, and the tables have one wiki.
ONE_ROW = {"agg10_org_lift", "ord05_page_with_total", "jon04_expire", "win03c_history_page", "ord10c_stock_directory", "win10b_settled_slot"}


def test_plans_pair_no_rows_and_hold_no_table_in_one_window(spark):
    import re

    from tideglass.plans import QUERIES

    for name, query in QUERIES.items():
        if name.startswith(("str", "snk", "src")) or name in ONE_ROW:  # written tables; what they read is planned above
            continue
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert not re.search(r"Window \[.*\n.*Sort.*\n.*Exchange SinglePartition", plan), name


def test_lift_curve_over_blocks(spark):
    rng = random.Random(3)
    rows = [(s, *[rng.randrange(5) for _ in range(4)]) for s in sorted(rng.sample(range(900), 300))]
    got = {r.slot: r.lift for r in L.lift_curve(spark.createDataFrame(rows, "slot long, articles long, issue_articles long, org_articles long, both long"), block=8).collect()}
    sums = [0] * 4
    for slot, *own in rows:
        sums = [a + b for a, b in zip(sums, own, strict=True)]
        n, i, o, b = sums
        want = (b / i) / (o / n) if i and n and o else None
        assert got[slot] == (None if want is None else pytest.approx(want)), slot


def test_asof_takes_the_latest_fact_of_another_owner(spark):
    from tideglass.operators.serving import asof_reuse

    rng = random.Random(9)
    facts = [(rng.choice("ab"), rng.randrange(8), rng.randrange(4), i) for i in range(60)]
    targets = [(k, ts, own) for k in "abc" for ts in range(-1, 10) for own in range(5)]
    f = spark.createDataFrame(facts, "k string, fts int, owner int, v int")
    got = asof_reuse(spark.createDataFrame(targets, "k string, ts int, me int"), f, ["k"], "ts", "fts", "me", "owner", ["v"], ["v"]).collect()
    for r in got:
        past = [(ts, v) for k, ts, own, v in facts if k == r.k and ts <= r.ts and own != r.me]
        assert r.v == (max(past)[1] if past else None), r
    assert len(got) == len(targets)


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_asof_with_a_hot_key_in_blocks(spark, hot):
    from tideglass.operators.serving import asof_reuse

    rng = random.Random(10)
    facts = [(rng.choice("aaaab"), rng.randrange(300), rng.choice([1, 1, 1, 2, None]), i) for i in range(150)]
    targets = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(-5, 320), own) for own in (1, 2, 3) for _ in range(150)]
    f = spark.createDataFrame(facts, "k string, fts int, owner int, v int").repartition(3)
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(targets)], "i int, k string, ts int, me int").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_reuse(df, f, ["k"], "ts", "fts", "me", "owner", ["v"], ["v"], hot=hot, blocks=16).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in got:
        past = [(ts, v) for k, ts, own, v in facts if k == r.k and ts <= r.ts and own != r.me]
        assert r.v == (max(past)[1] if past else None), r
    assert sorted((r.i, r.k, r.ts, r.me) for r in got) == [(i, *t) for i, t in enumerate(targets)]
    assert (len({r.task for r in got if r.k == "a"}) > 4) == (hot == 10)  # one key over many tasks


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_asof_within_one_table(spark, hot):
    rng = random.Random(11)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = [(i, some(rng.choice("aaab")), some(rng.randrange(90)), rng.choice([1, 2, 3, None]), rng.choice([True, True, False, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, ts int, me int, told boolean").repartition(3)
    got = V.asof_within(df, ["k"], "ts", "me", ["i"], {"i": "earlier", "ts": "earlier_ts"}, F.col("told"), hot=hot, blocks=16)
    assert got.columns == [*df.columns, "earlier", "earlier_ts"]
    known = [r for r in rows if r[4] and r[1] is not None and r[2] is not None]
    want = []
    for r in rows:
        past = [(ts, i) for i, k, ts, own, _ in known if k == r[1] and r[2] is not None and ts <= r[2] and own != r[3]]
        want.append((*r, *(max(past)[::-1] if past else (None, None))))
    assert sorted(map(tuple, got.collect())) == want


def test_asof_finds_no_fact_without_time(spark):
    facts = spark.createDataFrame([("a", None, 1, 7)], "k string, fts int, owner int, v int")
    targets = spark.createDataFrame([("a", None, 2), ("a", 5, 2)], "k string, ts int, me int")
    got = V.asof_reuse(targets, facts, ["k"], "ts", "fts", "me", "owner", ["v"], ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 5, 2, None), ("a", None, 2, None)]


def test_rows_of_an_asof_join_within_a_table_are_dealt_once(spark, monkeypatch):
    from tideglass.plans import QUERIES, registry

    monkeypatch.setattr(registry, "TASK_ROWS", 200)
    monkeypatch.setattr(V, "TASK_ROWS", 100, raising=False)
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    plan = QUERIES["jon10_asof_verdict"](spark, t.sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [line for line in plan if "FileScan" in line and "l_orderkey" in line]
    dealt = [line for line in plan if "Exchange hashpartitioning" in line and "o_orderkey" not in line]
    assert len(scans) == 1 and len(dealt) == 2  # lines by order, then rows by key
    assert [line.partition(")")[0].rpartition(" ")[2] for line in dealt] == [str(-(-n // m)) for n, m in ((t.f_cluster_stock.count(), 100), (t.lineitem.count(), 200))]


def plain_cosines(rows, queries, k, digits=9):
    out = []
    for q, u in queries:
        def cos(v):
            if len(u) != len(v) or not any(u) or not any(v):
                return None
            return round(sum(a * b for a, b in zip(u, v, strict=True)) / (sum(a * a for a in u) * sum(b * b for b in v)) ** 0.5, digits)

        scored = sorted(((cos(v), i) for i, v in rows if i != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
        out += [(q, i, s, n + 1) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_cosine_topk_skips_blocks_and_loses_nothing(spark):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.03) for c in centres[i % 12]]) for i in range(600)]
    rows += [(700, [0.0] * 6), (701, rows[5][1]), (702, [3 * x for x in rows[5][1]]), (703, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [(i, v) for i, v in rows if i % 50 == 0 or i >= 700]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    trace = {}
    got = V.cosine_topk(queries, items, 4, trace=trace)
    assert [r[:2] + (r[2] if r[2] is None else pytest.approx(r[2], abs=2e-9), r[3]) for r in sorted(map(tuple, got.select("query_id", "item_id", "similarity", "place").collect()))] == plain_cosines(rows, asked, 4)
    assert trace["read"] < 0.6 * trace["pairs"]  # two queries without a direction read all
    assert V.cosine_topk(queries, items.where("false"), 4).count() == 0 and V.cosine_topk(queries.where("false"), items, 4).count() == 0


def test_cosine_topk_takes_any_number_of_queries(spark):
    rng = random.Random(7)
    items = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)], "vec_id long, embedding array<double>").repartition(5)
    queries = items.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    whole, blocks = V.cosine_topk(queries, items, 4), V.cosine_topk(queries, items, 4, pivots=1)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 40 * 4


def test_cosine_topk_meets_in_slices_without_pairs(spark, monkeypatch):
    """Many equal vectors, nulls and vectors without an angle, cut into several slices and parts; no join makes a row a pair."""
    rng = random.Random(13)
    rows = [(i, [1.0, 2.0, 2.0] if i % 3 else [rng.choice((-1.0, 0.0, 1.0, 3.0)) for _ in range(3)]) for i in range(150)]
    rows += [(150, [0.0, 0.0, 0.0]), (151, [1.0, 2.0]), (152, [2.0, 4.0, 4.0])]
    asked = [(i, v) for i, v in rows if i % 7 == 0 or i > 149]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    monkeypatch.setattr(V, "SIDE", 10, raising=False)
    got = V.cosine_topk(queries, items, 5, pivots=4)
    assert [r[:2] + (r[2] if r[2] is None else pytest.approx(r[2], abs=2e-9), r[3]) for r in sorted(map(tuple, got.select("query_id", "item_id", "similarity", "place").collect()))] == plain_cosines(rows, asked, 5)
    assert "[block" not in "".join(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line)


def test_tasks_of_a_dealt_view_grow_with_its_rows(spark, monkeypatch):
    from tideglass.plans import QUERIES, registry

    monkeypatch.setattr(registry, "TASK_ROWS", 100, raising=False)
    plan = QUERIES["agg12_lift_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(dealt) == 1 and "hashpartitioning(l_orderkey" in dealt[0] and f", {-(-rows // 100)})" in dealt[0]


@pytest.mark.parametrize("most", [0, 10**6])
def test_article_rows_come_over_as_many_tasks_as_they_need(spark, monkeypatch, most):
    from tideglass.plans import QUERIES, graph, registry

    monkeypatch.setattr(registry, "TASK_ROWS", 300)
    monkeypatch.setattr(graph, "BROADCAST_PARTS", most, raising=False)
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    tasks = -(-t.lineitem.count() // 300)
    plan = QUERIES["ord09_top_orgs"](spark, t.sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    wide = [line for line in dealt if "hashpartitioning(theme" not in line]
    assert wide and all(f", {tasks})" in line for line in wide)
    assert not any("doc_id" in line.partition("hashpartitioning(theme")[2].partition("REQUIRE")[0] for line in dealt)  # counts of (theme, org) alone
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "org", "theme", "location").collect()))
    assert rows(graph.article_rows(t)) == rows(t.f_article_rows)
