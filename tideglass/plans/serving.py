"""Queries that serve issues, candidates, prices and snapshots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import serving as V
from ..sources import sinks as K
from .registry import STEPS, query

STEPS["s_stable"] = "SELECT *, coalesce(nullif(issue_key, ''), '#' || id) AS k FROM f_clusters"
STEPS["s_doc"] = "SELECT *, CASE WHEN issue_key LIKE 'live:_%:_%' OR issue_key LIKE 'replay:_%:_%' THEN substr(issue_key, instr(issue_key, ':') + 1) ELSE issue_key END AS document FROM f_clusters"
TIER = "CASE tier WHEN 'BOTH' THEN 0 WHEN 'GDELT_ONLY' THEN 1 ELSE 2 END"


@query("prj12_scope_filter", "SELECT id FROM f_clusters WHERE status <> 'DISCARDED' AND source = 'live' AND (CAST(snapshot_ts AS DATE) IN (DATE '1996-01-02', DATE '1997-05-05') OR snapshot_ts = TIMESTAMP '1998-01-01 00:00:00')")
def prj12(t):
    return V.scope(t.f_clusters, source="live", days=["1996-01-02", "1997-05-05"], times=["1998-01-01 00:00:00"]).select("id")


@query("prj13_escaped_like", """
WITH c AS (SELECT id, label || CASE id % 4 WHEN 0 THEN ' 50%' WHEN 1 THEN ' a_b' WHEN 2 THEN ' 500' ELSE ' a!b' END AS label FROM f_clusters)
SELECT id, 'per' AS q FROM c WHERE label ILIKE '%50!%%' ESCAPE '!' UNION ALL SELECT id, 'low' FROM c WHERE label ILIKE '%A!_B%' ESCAPE '!' UNION ALL SELECT id, 'bang' FROM c WHERE label ILIKE '%A!!B%' ESCAPE '!'""")
def prj13(t):
    tail = F.when(F.col("id") % 4 == 0, " 50%").when(F.col("id") % 4 == 1, " a_b").when(F.col("id") % 4 == 2, " 500").otherwise(" a!b")
    c = t.f_clusters.where("label is not null").select("id", F.concat("label", tail).alias("label"))
    found = [V.search(c, ["label"], q).select("id", F.lit(name).alias("q")) for name, q in (("per", "50%"), ("low", "A_B"), ("bang", "A!B"))]
    return found[0].union(found[1]).union(found[2])


@query("prj14_literal_search", "SELECT page_id FROM pages WHERE contains(lower(concat_ws(' ', url, html)), '?page=2&ref')")
def prj14(t):
    return V.search(t.pages, ["url", "html"], "?PAGE=2&ref").select("page_id")


@query("prj15_epoch_projection", "SELECT id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_epoch FROM f_clusters")
def prj15(t):
    return t.f_clusters.select("id", F.unix_timestamp("snapshot_ts").alias("snapshot_epoch"))


@query("prj16_missing_attribute_queue", "SELECT id, issue_key FROM f_clusters WHERE label IS NULL")
def prj16(t):
    return t.f_clusters.where(F.col("label").isNull()).select("id", "issue_key")


@query("prj17_skip_accounting", "SELECT coalesce(CASE WHEN is_bot THEN 'bot' WHEN byte_delta > 300 THEN 'large' WHEN event_type = 'new' THEN 'new' END, 'written') AS reason, count(*) AS n FROM f_edit_events GROUP BY 1")
def prj17(t):
    reason = F.when(F.col("is_bot"), "bot").when(F.col("byte_delta") > 300, "large").when(F.col("event_type") == "new", "new").otherwise("written")
    return t.f_edit_events.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("prj18_title_queue", "SELECT DISTINCT r.page_id, r.title FROM f_root_rows r WHERE NOT EXISTS (SELECT 1 FROM f_links l WHERE l.page_id = r.page_id AND l.target = 'Page 7') ORDER BY 1 LIMIT 20")
def prj18(t):
    known = t.f_links.where("target = 'Page 7'").select("page_id")
    return t.f_root_rows.select("page_id", "title").distinct().join(known, "page_id", "left_anti").orderBy("page_id").limit(20)


@query("fun09_document_key", "SELECT id, document FROM s_doc")
def fun09(t):
    return t.f_clusters.select("id", S.document_key(F.col("issue_key")).alias("document"))


@query("fun18_size_score", "SELECT id, round(pulse_score / (pulse_score + 5), 4) AS size FROM f_clusters")
def fun18(t):
    return t.f_clusters.select("id", S.size_score(F.col("pulse_score")).alias("size"))


@query("fun18b_pulse_score", "SELECT source, snapshot_ts, round(max(pulse_score), 3) AS pulse FROM f_clusters GROUP BY 1, 2")
def fun18b(t):
    return t.f_clusters.groupBy("source", "snapshot_ts").agg(F.round(F.max("pulse_score"), 3).alias("pulse"))


@query("fun24_new_badge", "WITH f AS (SELECT id, snapshot_ts, min(snapshot_ts) OVER (PARTITION BY issue_key) AS f FROM f_clusters) SELECT id, snapshot_ts - f < INTERVAL 24 HOUR AS new FROM f")
def fun24(t):
    return V.first_detected(t.f_clusters).select("id", S.is_new(F.col("first_detected"), F.col("snapshot_ts")).alias("new"))


@query("fun25_display_title", "SELECT id, coalesce(nullif(trim(label), ''), issue_key) AS shown FROM f_clusters")
def fun25(t):
    none = F.lit(None).cast("string")
    return t.f_clusters.select("id", S.display_title(F.col("label"), none, none, F.col("issue_key")).alias("shown"))


@query("fun27_ranking_window", "SELECT DISTINCT snapshot_ts, snapshot_ts - INTERVAL 30 DAY AS month_from, (snapshot_ts + INTERVAL 9 HOUR) - INTERVAL 12 MONTH - INTERVAL 9 HOUR AS year_from FROM f_clusters")
def fun27(t):
    return t.f_clusters.select("snapshot_ts", S.ranking_window(F.col("snapshot_ts")).alias("w")).select("snapshot_ts", "w.month_from", "w.year_from").distinct()


@query("fun28_baseline_as_of", "SELECT DISTINCT snapshot_ts, CAST(snapshot_ts - INTERVAL 38 HOUR AS DATE) - 1 AS as_of FROM f_clusters")
def fun28(t):
    return t.f_clusters.select("snapshot_ts", S.baseline_as_of(F.col("snapshot_ts")).alias("as_of")).distinct()


ASOF = """
WITH v AS (SELECT s.cluster_id, s.ticker, s.verified, s.similarity, c.issue_key, c.snapshot_ts FROM f_cluster_stock s JOIN f_clusters c ON c.id = s.cluster_id),
j AS (SELECT t.cluster_id, t.ticker, v.verified, v.similarity, row_number() OVER (PARTITION BY t.cluster_id, t.ticker ORDER BY v.snapshot_ts DESC, v.cluster_id DESC) AS n
  FROM v t LEFT JOIN v ON v.issue_key = t.issue_key AND v.ticker = t.ticker AND v.cluster_id <> t.cluster_id AND v.snapshot_ts <= t.snapshot_ts)
SELECT cluster_id, ticker, verified AS earlier_verified, similarity AS earlier_similarity FROM j WHERE n = 1"""


@query("jon10_asof_verdict", ASOF)
def jon10(t):
    own = t.dealt("lineitem", "l_orderkey")
    v = own.f_cluster_stock.join(own.f_clusters.select(F.col("id").alias("cluster_id"), "issue_key", "snapshot_ts"), "cluster_id")
    v = v.select("cluster_id", "ticker", "issue_key", "snapshot_ts", "verified", "similarity")
    out = V.asof_within(v, ["issue_key", "ticker"], "snapshot_ts", "cluster_id", ["cluster_id"], {"verified": "earlier_verified", "similarity": "earlier_similarity"})
    return out.select("cluster_id", "ticker", "earlier_verified", "earlier_similarity")


@query("jon11_asof_summary", """
SELECT id, earlier FROM (SELECT c.id, p.label AS earlier, row_number() OVER (PARTITION BY c.id ORDER BY p.snapshot_ts DESC, p.id DESC) AS n
FROM f_clusters c LEFT JOIN (SELECT * FROM f_clusters WHERE status = 'CONFIRMED') p ON p.issue_key = c.issue_key AND p.id <> c.id AND p.snapshot_ts <= c.snapshot_ts) WHERE n = 1""")
def jon11(t):
    c = t.f_clusters.select("id", "issue_key", "snapshot_ts", "label", "status")
    return V.asof_within(c, ["issue_key"], "snapshot_ts", "id", ["id"], {"label": "earlier"}, F.col("status") == "CONFIRMED").select("id", "earlier")


@query("jon12_asof_intro", """
SELECT page_id, snapshot_ts, rev FROM (SELECT r.page_id, r.snapshot_ts, i.max_rev_id AS rev, row_number() OVER (PARTITION BY r.page_id, r.snapshot_ts ORDER BY i.snapshot_ts DESC) AS n
FROM f_root_rows r LEFT JOIN (SELECT * FROM f_root_rows WHERE views % 3 = 0) i ON i.page_id = r.page_id AND i.snapshot_ts <= r.snapshot_ts) WHERE n = 1""")
def jon12(t):
    r = t.f_root_rows
    intros = r.where("views % 3 = 0").select("page_id", F.col("snapshot_ts").alias("rev_ts"), F.lit(-1).cast("long").alias("owner"), F.col("max_rev_id").alias("rev"))
    return V.asof_reuse(r.select("page_id", "snapshot_ts"), intros, ["page_id"], "snapshot_ts", "rev_ts", "page_id", "owner", ["owner"], ["rev"]).select("page_id", "snapshot_ts", "rev")


@query("jon14_tier_union", f"""
WITH e AS (SELECT cluster_id, ticker, similarity FROM f_cluster_stock WHERE similarity >= 0.05), l AS (SELECT cluster_id, ticker, gdelt_lift FROM f_cluster_stock WHERE gdelt_lift >= 4),
b AS (SELECT *, CASE WHEN similarity IS NOT NULL AND gdelt_lift IS NOT NULL THEN 'BOTH' WHEN gdelt_lift IS NOT NULL THEN 'GDELT_ONLY' ELSE 'EMBEDDING_ONLY' END AS tier FROM e FULL JOIN l USING (cluster_id, ticker))
SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {TIER}, gdelt_lift DESC NULLS LAST, similarity DESC NULLS LAST, ticker) AS INT) AS place FROM b""")
def jon14(t):
    s = t.f_cluster_stock
    return V.combine(s.where("similarity >= 0.05").select("cluster_id", "ticker", "similarity"), s.where("gdelt_lift >= 4").select("cluster_id", "ticker", "gdelt_lift"), ["cluster_id"])


@query("jon15_cosine_topk", """
WITH p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda k: CAST(q.embedding[k] AS DOUBLE) * i.embedding[k]))
  / sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(i.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS similarity
FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings i ON q.vec_id <> i.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place FROM p)
SELECT query_id, item_id, similarity, CAST(place AS INT) AS place FROM r WHERE place <= 20""")
def jon15(t):
    e = t.embeddings
    return V.cosine_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 20, digits=6).select("query_id", "item_id", "similarity", "place")


@query("jon17_completed_only", "SELECT id FROM f_clusters c WHERE EXISTS (SELECT 1 FROM f_clusters r WHERE r.source = c.source AND r.snapshot_ts = c.snapshot_ts AND r.status = 'CONFIRMED')")
def jon17(t):
    registry = t.f_clusters.where("status = 'CONFIRMED'").select("source", "snapshot_ts")
    return t.f_clusters.join(registry, ["source", "snapshot_ts"], "left_semi").select("id")


@query("jon18_without_children", "SELECT id FROM f_clusters c WHERE NOT EXISTS (SELECT 1 FROM f_cluster_stock s WHERE s.cluster_id = c.id AND s.verified)")
def jon18(t):
    return t.f_clusters.join(t.f_cluster_stock.where("verified").select(F.col("cluster_id").alias("id")), "id", "left_anti").select("id")


@query("jon19_scalar_counts", "SELECT id, (SELECT count(*) FROM f_cluster_stock s WHERE s.cluster_id = c.id) AS candidates, (SELECT count(*) FROM f_cluster_stock s WHERE s.cluster_id = c.id AND verified) AS verified FROM f_clusters c")
def jon19(t):
    return V.with_counts(t.f_clusters, t.f_cluster_stock).select("id", "candidates", "verified")


@query("jon19b_last_close", "SELECT ticker, arg_max(close, trade_date) AS last_close FROM f_prices GROUP BY 1")
def jon19b(t):
    return t.f_prices.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("last_close"))


@query("jon22_saved_items", "SELECT o_custkey AS member, id, label, (SELECT count(*) FROM f_cluster_stock s WHERE s.cluster_id = id) AS candidates FROM orders JOIN f_clusters ON id = o_orderkey")
def jon22(t):
    saved = t.orders.select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("id"))
    return saved.join(V.with_counts(t.f_clusters, t.f_cluster_stock), "id").select("member", "id", "label", "candidates")


@query("agg12_lift_topk", "SELECT * FROM (SELECT cluster_id, ticker, max(gdelt_lift) AS lift, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY max(gdelt_lift) DESC, ticker) AS INT) AS place FROM f_cluster_stock GROUP BY 1, 2) WHERE place <= 3")
def agg12(t):
    m = t.dealt("lineitem", "l_orderkey").f_cluster_stock.groupBy("cluster_id", "ticker").agg(F.max("gdelt_lift").alias("lift"))
    return m.withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("lift"), "ticker"))).where("place <= 3")


@query("agg13_first_detected", "SELECT id, min(snapshot_ts) OVER (PARTITION BY issue_key) AS first_detected FROM f_clusters")
def agg13(t):
    return V.first_detected(t.f_clusters).select("id", "first_detected")


@query("agg19_verification_progress", "SELECT cluster_id, count(*) AS n, count_if(verified IS NULL) AS pending, count_if(coalesce(verified, false) AND tier IN ('BOTH', 'GDELT_ONLY')) AS passes, count_if(verified IS NULL) = 0 AS complete FROM f_cluster_stock GROUP BY 1")
def agg19(t):
    return V.verification_state(t.f_cluster_stock)


@query("agg20_last_trade_date", "SELECT ticker, max(trade_date) AS last_date FROM f_prices GROUP BY 1")
def agg20(t):
    return t.f_prices.groupBy("ticker").agg(F.max("trade_date").alias("last_date"))


@query("agg22_size_distribution", """
WITH s AS (SELECT cluster_id, count(*) AS n FROM f_cluster_stock GROUP BY 1)
SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' WHEN n <= 7 THEN '5-7' WHEN n <= 12 THEN '8-12' ELSE '13+' END AS bucket, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest FROM s GROUP BY 1""")
def agg22(t):
    from ..operators.graph import size_buckets

    return size_buckets(t.f_cluster_stock, "cluster_id")


@query("agg28_calendar_counts", """
WITH d AS (SELECT CAST(unnest(generate_series(DATE '1996-02-01', DATE '1996-02-29', INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT CAST(snapshot_ts + INTERVAL 9 HOUR AS DATE) AS day, count(DISTINCT issue_key) AS issues FROM f_clusters GROUP BY 1)
SELECT day, coalesce(issues, 0) AS issues FROM d LEFT JOIN n USING (day)""")
def agg28(t):
    return V.issues_by_day(t.f_clusters, "1996-02-01")


@query("win01_top_n_per_snapshot", "SELECT id, place FROM (SELECT id, CAST(row_number() OVER (PARTITION BY source, snapshot_ts ORDER BY pulse_score DESC, id) AS INT) AS place FROM f_clusters) WHERE place <= 2")
def win01(t):
    return V.top_per_snapshot(t.f_clusters, 2).select("id", "place")


@query("win02_peak_rankings", """
SELECT id, issue_key, pulse_score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pulse_score DESC, snapshot_ts DESC, id DESC) AS n FROM s_stable WHERE snapshot_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01')
WHERE n = 1 ORDER BY pulse_score DESC, snapshot_ts DESC, id DESC LIMIT 10""")
def win02(t):
    return V.rankings(t.f_clusters, "1996-01-01", "1998-01-01").select("id", "issue_key", "pulse_score")


@query("win03_history_groups", """
SELECT document, arg_max(id, (snapshot_ts, id)) AS id, max(snapshot_ts) AS last_seen, min(snapshot_ts) AS first_seen, count(*) AS occurrences,
  coalesce(arg_max(coalesce(label, ''), (snapshot_ts, id)), '') AS lbl FROM s_doc GROUP BY 1""".replace("coalesce(arg_max(coalesce(label, ''), (snapshot_ts, id)), '') AS lbl", "coalesce(nullif(arg_max(coalesce(label, ''), (snapshot_ts, id)), ''), substr(document, instr(document, ':') + 1)) AS label"))
def win03(t):
    return V.history_groups(t.f_clusters).drop("pulse_score")


@query("win04_distinct_on_latest", "SELECT issue_key, id FROM (SELECT *, row_number() OVER (PARTITION BY issue_key ORDER BY snapshot_ts DESC, id DESC) AS n FROM f_clusters) WHERE n = 1")
def win04(t):
    return V.latest_per_key(t.f_clusters, F.col("issue_key"), [F.desc("snapshot_ts"), F.desc("id")]).select("issue_key", "id")


@query("win13_timeline_merge", "SELECT snapshot_ts, min(source) AS source FROM f_clusters GROUP BY 1")
def win13(t):
    return V.timeline(t.f_clusters.select("snapshot_ts", "source").distinct()).select("snapshot_ts", "source")


@query("win14_preferred_report", "SELECT document, id FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY CASE WHEN status = 'CONFIRMED' THEN 0 WHEN label IS NOT NULL THEN 1 ELSE 2 END, snapshot_ts DESC, id DESC) AS n FROM s_doc) WHERE n = 1")
def win14(t):
    own = t.f_clusters.withColumn("document", S.document_key(F.col("issue_key")))
    rank = F.when(F.col("status") == "CONFIRMED", 0).when(F.col("label").isNotNull(), 1).otherwise(2)
    return V.latest_per_key(own, F.col("document"), [rank, F.desc("snapshot_ts"), F.desc("id")]).select("document", "id")


@query("win15_closest_snapshot", "SELECT DISTINCT source, snapshot_ts, abs(epoch(snapshot_ts) - epoch(TIMESTAMP '1997-03-03 11:00:00')) AS far FROM f_clusters ORDER BY far, snapshot_ts, source LIMIT 1".replace("SELECT DISTINCT source, snapshot_ts, abs(", "SELECT source, snapshot_ts FROM (SELECT DISTINCT source, snapshot_ts, abs(").replace("AS far FROM f_clusters ORDER", "AS far FROM f_clusters) ORDER"))
def win15(t):
    return V.closest(t.f_clusters.select("source", "snapshot_ts").distinct(), "1997-03-03 11:00:00")


@query("win16_issue_recurrence", "SELECT id, source, snapshot_ts FROM s_doc WHERE document = 'enwiki:Page 5' ORDER BY snapshot_ts DESC, id DESC LIMIT 20 OFFSET 5")
def win16(t):
    own = t.f_clusters.where(S.document_key(F.col("issue_key")) == "enwiki:Page 5").select("id", "source", "snapshot_ts")
    return V.page(own, [F.desc("snapshot_ts"), F.desc("id")], 5, 20)[0]


@query("win11_cooldown_violations", "SELECT * FROM (SELECT issue_key, id, date_diff('day', lag(snapshot_ts) OVER (PARTITION BY issue_key ORDER BY snapshot_ts, id), snapshot_ts) AS gap FROM f_clusters) WHERE gap < 3")
def win11(t):
    before = F.lag("snapshot_ts").over(W.partitionBy("issue_key").orderBy("snapshot_ts", "id"))
    return t.f_clusters.select("issue_key", "id", F.datediff("snapshot_ts", before).cast("long").alias("gap")).where("gap < 3")


@query("win08_gaps_islands", """
WITH e AS (SELECT unnest(generate_series((SELECT min(ts_hour) FROM f_arrival), (SELECT max(ts_hour) FROM f_arrival), INTERVAL 1 HOUR)) AS slot), m AS (SELECT slot FROM e WHERE slot NOT IN (SELECT ts_hour FROM f_arrival)),
g AS (SELECT slot, epoch(slot) // 3600 - row_number() OVER (ORDER BY slot) AS g FROM m) SELECT min(slot) AS gap_start, max(slot) AS gap_end, count(*) AS slots FROM g GROUP BY g""")
def win08(t):
    from ..operators.slots import coalesce_gaps, slot_plan

    return coalesce_gaps(slot_plan(t.f_arrival, "ts_hour", 3600).where("not present"), 3600)


@query("set01_slot_plan", "WITH e AS (SELECT unnest(generate_series((SELECT min(ts_hour) FROM f_arrival), (SELECT max(ts_hour) FROM f_arrival), INTERVAL 15 MINUTE)) AS slot) SELECT slot, slot IN (SELECT ts_hour FROM f_arrival) AS present FROM e")
def set01(t):
    from ..operators.slots import slot_plan

    return slot_plan(t.f_arrival, "ts_hour", 900)


@query("ord01_snapshot_list", "SELECT DISTINCT source, snapshot_ts FROM f_clusters WHERE source = 'live' AND snapshot_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-01' ORDER BY snapshot_ts DESC")
def ord01(t):
    s = t.f_clusters.select("source", "snapshot_ts").distinct()
    return s.where((F.col("source") == "live") & F.col("snapshot_ts").between("1996-01-01", "1996-03-01")).orderBy(F.desc("snapshot_ts"))


@query("ord02_latest_snapshot", "SELECT source, max(snapshot_ts) AS snapshot_ts FROM f_clusters WHERE source = 'live' GROUP BY 1")
def ord02(t):
    return t.f_clusters.select("source", "snapshot_ts").orderBy(F.when(F.col("source") == "live", 0).otherwise(1), F.desc("snapshot_ts")).limit(1)


@query("ord03_verified_stocks", f"SELECT cluster_id, ticker, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {TIER}, coalesce(gdelt_lift, 0) DESC, coalesce(similarity, 0) DESC, ticker) AS INT) AS place FROM f_cluster_stock WHERE verified) WHERE place <= 5")
def ord03(t):
    order = [V.tier_order(F.col("tier")), F.desc(F.coalesce("gdelt_lift", F.lit(0))), F.desc(F.coalesce("similarity", F.lit(0))), "ticker"]
    return t.f_cluster_stock.where("verified").withColumn("place", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order))).where("place <= 5").select("cluster_id", "ticker", "place")


@query("ord04_nulls_last", "SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN label IS NULL THEN NULL ELSE pulse_score END DESC NULLS LAST, id) AS INT) AS place FROM f_clusters WHERE source = 'live' ORDER BY place LIMIT 50")
def ord04(t):
    own = t.f_clusters.where("source = 'live'").withColumn("p", F.when(F.col("label").isNotNull(), F.col("pulse_score")))
    top = own.orderBy(F.desc_nulls_last("p"), "id").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("p"), "id"))).select("id", "place")


@query("ord05_page_with_total", "SELECT id, (SELECT count(*) FROM f_clusters WHERE status = 'DETECTED') AS total FROM f_clusters WHERE status = 'DETECTED' ORDER BY pulse_score DESC, id LIMIT 100 OFFSET 30")
def ord05(t):
    rows, total = V.page(t.f_clusters.where("status = 'DETECTED'"), [F.desc("pulse_score"), F.col("id")], 30, 500)
    return rows.select("id").join(F.broadcast(total))


@query("ord06_issues_by_ticker", "SELECT c.id, c.snapshot_ts FROM f_clusters c JOIN f_cluster_stock s ON s.cluster_id = c.id WHERE s.ticker = 'S7' AND s.verified AND c.status <> 'DISCARDED' ORDER BY c.snapshot_ts DESC, c.id DESC LIMIT 50")
def ord06(t):
    own = t.f_cluster_stock.where("ticker = 'S7' and verified").select(F.col("cluster_id").alias("id"))
    return t.f_clusters.where("status <> 'DISCARDED'").join(own, "id", "left_semi").select("id", "snapshot_ts").orderBy(F.desc("snapshot_ts"), F.desc("id")).limit(50)


@query("ord07_price_range", "SELECT * FROM f_prices WHERE ticker = 'S5' AND trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' ORDER BY trade_date")
def ord07(t):
    return t.f_prices.where((F.col("ticker") == "S5") & F.col("trade_date").between("1997-01-01", "1997-12-31")).orderBy("trade_date")


@query("ord08_multi_source_page", "SELECT c.id FROM f_clusters c JOIN (SELECT source, max(snapshot_ts) AS m FROM f_clusters GROUP BY 1) x ON x.source = c.source AND x.m = c.snapshot_ts ORDER BY pulse_score DESC, id LIMIT 20")
def ord08(t):
    latest = t.f_clusters.groupBy("source").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return V.page(t.f_clusters.join(F.broadcast(latest), ["source", "snapshot_ts"], "left_semi"), [F.desc("pulse_score"), F.col("id")], 0, 20)[0].select("id")


@query("ord10_stock_directory", """
SELECT s_name AS name, ticker, n_issues, last_close FROM (SELECT s_name, 'S' || s_suppkey AS ticker FROM supplier) JOIN (SELECT ticker, count(*) AS n_issues FROM f_cluster_stock WHERE verified GROUP BY 1) USING (ticker)
LEFT JOIN (SELECT ticker, arg_max(close, trade_date) AS last_close FROM f_prices GROUP BY 1) USING (ticker) WHERE contains(lower(s_name), '1') ORDER BY ticker LIMIT 40""")
def ord10(t):
    stock = t.supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    n = t.f_cluster_stock.where("verified").groupBy("ticker").agg(F.count("*").alias("n_issues"))
    close = t.f_prices.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("last_close"))
    return V.page(V.search(stock, ["name"], "1").join(n, "ticker").join(close, "ticker", "left"), [F.col("ticker")], 0, 40)[0]


@query("dqc03_freshness", "SELECT max(snapshot_ts) AS newest, max(snapshot_ts) < TIMESTAMP '2001-09-01' - INTERVAL 48 HOUR AS stale FROM f_clusters WHERE source = 'live'")
def dqc03(t):
    return t.f_clusters.where("source = 'live'").agg(F.max("snapshot_ts").alias("newest")).withColumn("stale", F.col("newest") < F.lit("2001-09-01").cast("timestamp") - F.expr("interval 48 hours"))


@query("dqc05_source_domain", "SELECT id, source FROM (SELECT id, CASE WHEN id % 97 = 0 THEN upper(source) ELSE source END AS source FROM f_clusters) WHERE source NOT IN ('live', 'replay')")
def dqc05(t):
    odd = t.f_clusters.select("id", F.when(F.col("id") % 97 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"))
    return odd.where(~F.col("source").isin("live", "replay"))


@query("dqc08_status_flow", "SELECT c.id, c.status, CASE WHEN status <> 'DETECTED' THEN status WHEN n IS NULL THEN 'DETECTED' WHEN p = 0 THEN 'CONFIRMED' ELSE 'VERIFYING' END AS next_status FROM f_clusters c LEFT JOIN (SELECT cluster_id, count(*) AS n, count_if(verified IS NULL) AS p FROM f_cluster_stock GROUP BY 1) s ON s.cluster_id = c.id")
def dqc08(t):
    return V.next_status(t.f_clusters, t.f_cluster_stock)


@query("dqc09_duplicate_identity", "SELECT lower(trim(split_part(url, '/', 3))) AS host, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def dqc09(t):
    host = F.lower(F.trim(F.split_part("url", F.lit("/"), F.lit(3))))
    return t.pages.groupBy(host.alias("host")).agg(F.count("*").alias("n")).where("n > 1")


@query("snk05_downstream_guard", """
WITH c AS (SELECT id FROM f_clusters WHERE CAST(snapshot_ts AS DATE) = DATE '1996-01-02') SELECT 'stocks' AS "table", count(*) AS rows FROM f_cluster_stock WHERE cluster_id IN (SELECT id FROM c)
UNION ALL SELECT 'labels', count(*) FROM f_clusters WHERE label IS NOT NULL AND id IN (SELECT id FROM c)""")
def snk05(t):
    own = t.f_clusters.where(F.to_date("snapshot_ts") == "1996-01-02").select(F.col("id").alias("cluster_id"))
    return K.dependants(own, {"stocks": t.f_cluster_stock, "labels": t.f_clusters.where("label is not null").select(F.col("id").alias("cluster_id"))})
