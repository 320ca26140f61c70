"""Queries over lists, queues and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import directory as R
from ..operators import measures as M
from ..operators import quality as D
from .graph import win10
from .registry import STEPS, Tables, query

STEPS["s_l_members"] = "SELECT l_orderkey AS cluster_id, l_partkey AS page_id, 'part ' || l_partkey AS title, min(l_linenumber) = 1 AS is_seed, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2"
STEPS["s_l_groups"] = """
WITH e AS (SELECT *, CASE WHEN issue_key LIKE source || ':_%:_%' THEN substr(issue_key, len(source) + 2) ELSE '#' || id END AS document FROM f_clusters WHERE status <> 'DISCARDED' AND extract(day FROM snapshot_ts) <= 25),
g AS (SELECT document, arg_max(id, (snapshot_ts, id)) AS id, min(snapshot_ts) AS first_seen, count(*) AS occurrences, arg_max(id, (id % 8 = 1, snapshot_ts, id)) FILTER (id % 4 > 0) AS default_report_id FROM e GROUP BY 1),
l AS (SELECT cluster_id, arg_min(title, (NOT is_seed, -weight, page_id)) AS lead FROM s_l_members GROUP BY 1)
SELECT g.*, coalesce(nullif(e.label, ''), lead, '(untitled)') AS label, e.snapshot_ts, e.source, e.status, CASE WHEN g.id % 4 > 0 THEN 'about ' || g.id END AS summary,
  (SELECT count(*) FROM s_l_members m WHERE m.cluster_id = g.id) AS member_count, (SELECT count(*) FROM f_cluster_stock s WHERE s.cluster_id = g.id AND s.verified) AS stock_count
FROM g JOIN e USING (id) LEFT JOIN l ON l.cluster_id = g.id"""


def people(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("page_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title")).agg((F.min("l_linenumber") == 1).alias("is_seed"), F.max("l_quantity").alias("weight"))


def groups(t: Tables) -> DataFrame:
    c = t.f_clusters
    told = c.where("id % 4 > 0").select(F.col("id").alias("cluster_id"), F.concat(F.lit("about "), F.col("id").cast("string")).alias("summary"), (F.col("id") % 8 == 1).alias("has_sections"))
    return R.history_groups(c, c.where(F.dayofmonth("snapshot_ts") <= 25), people(t), t.f_cluster_stock, told)


HISTORY = ("document", "id", "label", "snapshot_ts", "source", "status", "first_seen", "occurrences", "default_report_id", "summary", "member_count", "stock_count")


@query("win03b_history_documents", "SELECT document, id, label, snapshot_ts, source, status, first_seen, occurrences, default_report_id, summary, member_count, stock_count FROM s_l_groups")
def win03b(t):
    return groups(t).select(*HISTORY)


@query("win03c_history_page", "SELECT id, label, (SELECT count(*) FROM s_l_groups WHERE contains(lower(label), 'part 1') AND status = 'CONFIRMED') AS total FROM s_l_groups WHERE contains(lower(label), 'part 1') AND status = 'CONFIRMED' ORDER BY snapshot_ts DESC, id LIMIT 30 OFFSET 1")
def win03c(t):
    rows, total = R.history_page(groups(t), "Part 1", "CONFIRMED", 1, 30)
    return rows.select("id", "label").join(F.broadcast(total))


@query("jon22b_saved_pages", """
WITH i AS (SELECT id, label, CASE WHEN id % 4 > 0 THEN 'about ' || id END AS summary, status, (SELECT count(*) FROM s_l_members m WHERE m.cluster_id = id) AS member_count, (SELECT count(*) FROM f_cluster_stock s WHERE s.cluster_id = id AND verified) AS stock_count FROM f_clusters),
s AS (SELECT o_custkey AS member, o_orderdate AS added_at, i.* FROM orders JOIN i ON id = o_orderkey WHERE contains(lower(coalesce(label || ' ', '') || coalesce(summary, '')), 'e 1')),
r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY added_at DESC, id) AS place, count(*) OVER (PARTITION BY member) AS total FROM s)
SELECT member, id, label, summary, status, member_count, stock_count, CAST(place AS INT) AS place, total FROM r WHERE place BETWEEN 2 AND 4""")
def jon22b(t):
    saved = t.orders.select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("added_at"))
    items = t.f_clusters.withColumn("summary", F.when(F.col("id") % 4 > 0, F.concat(F.lit("about "), F.col("id").cast("string"))))
    out = R.saved_pages(saved, R.with_counts_of(items, people(t), t.f_cluster_stock), "id", ["label", "summary"], " e 1", 1, 3)
    return out.select("member", "id", "label", "summary", "status", "member_count", "stock_count", "place", "total")


STEPS["s_cards"] = """
SELECT 'S' || s_suppkey AS ticker, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'NYSE' END AS exchange, 'sector ' || s_nationkey % 5 AS sector,
  (SELECT count(DISTINCT cluster_id) FROM f_cluster_stock cs JOIN f_clusters c ON c.id = cs.cluster_id WHERE cs.ticker = 'S' || s_suppkey AND verified AND status <> 'DISCARDED') AS issue_count,
  (SELECT arg_max(close, trade_date) FROM f_prices p WHERE p.ticker = 'S' || s_suppkey) AS last_close FROM supplier"""


def cards(t: Tables) -> DataFrame:
    nation = F.col("s_nationkey")
    stocks = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("name"), F.when(nation % 2 == 0, "NASDAQ").otherwise("NYSE").alias("exchange"), F.concat(F.lit("sector "), (nation % 5).cast("string")).alias("sector"))
    return R.stock_cards(stocks, t.f_cluster_stock.where("ticker <> 'S3'"), t.f_clusters, t.f_prices)


@query("ord10b_stock_cards", "SELECT * REPLACE (CASE ticker WHEN 'S3' THEN 0 ELSE issue_count END AS issue_count) FROM s_cards")
def ord10b(t):
    return cards(t).select("ticker", "name", "exchange", "sector", "issue_count", "last_close")


@query("ord10c_stock_directory", "WITH f AS (SELECT ticker, name FROM s_cards WHERE exchange = 'NYSE' AND issue_count > 0 AND ticker <> 'S3' AND (contains(lower(name), '1') OR contains(lower(ticker), '1'))) SELECT ticker, name, (SELECT count(*) FROM f) AS total FROM f ORDER BY ticker LIMIT 40")
def ord10c(t):
    rows, total = R.stock_directory(cards(t), "1", exchange="NYSE", has_issues=True, limit=40)
    return rows.select("ticker", "name").join(F.broadcast(total))


@query("win01b_to_judge", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_ts ORDER BY pulse_score DESC, id) AS place FROM f_clusters), s AS (SELECT DISTINCT cluster_id, verified FROM f_cluster_stock WHERE cluster_id % 3 = 0),
j AS (SELECT issue_key, min(snapshot_ts) AS judged FROM f_clusters WHERE id IN (SELECT cluster_id FROM s WHERE verified) GROUP BY 1)
SELECT id, CAST(place AS INT) AS place, coalesce(judged <= snapshot_ts, false) AS exempt FROM r LEFT JOIN j USING (issue_key)
WHERE status <> 'DISCARDED' AND id NOT IN (SELECT cluster_id FROM s) AND (place <= 1 OR coalesce(judged <= snapshot_ts, false))""")
def win01b(t):
    stocks = t.f_cluster_stock.where("cluster_id % 3 = 0").select("cluster_id", F.col("verified").alias("done"))
    return R.to_judge(t.f_clusters, stocks, 1).select("id", "place", "exempt")


@query("agg16b_coverage", """
WITH p AS (SELECT date_trunc('week', event_ts) AS w, CAST(min(event_ts) AS DATE) AS first_day, CAST(max(event_ts) AS DATE) AS last_day FROM f_edit_events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY w) AS n FROM p),
h AS (SELECT *, lead(first_day) OVER (ORDER BY first_day) AS nxt FROM o WHERE n <> 2)
SELECT 'whole' AS kind, min(first_day) AS first_day, max(last_day) AS last_day, 0 AS holes FROM p UNION ALL SELECT 'hole', min(first_day), max(last_day), CAST(count_if(date_diff('day', last_day, nxt) > 1) AS INT) FROM h UNION ALL SELECT 'unknown', NULL, NULL, 0""")
def agg16b(t):
    w = F.date_trunc("week", "event_ts").alias("w")
    parts = t.f_edit_events.groupBy(w).agg(F.to_date(F.min("event_ts")).alias("first_day"), F.to_date(F.max("event_ts")).alias("last_day"))
    second = parts.select("w").orderBy("w").limit(2).agg(F.max("w")).first()[0]
    kinds = {"whole": M.coverage_span(parts), "hole": M.coverage_span(parts.where(F.col("w") != F.lit(second)), strict=False), "unknown": M.coverage_span(parts.withColumn("last_day", F.when(F.col("w") != F.lit(second), F.col("last_day"))))}
    rows = [df.withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("agg17b_titles_by_hour", """
WITH e AS (SELECT date_trunc('hour', event_ts) AS hour, trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title FROM f_edit_events WHERE NOT is_bot AND CAST(event_ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')
SELECT 'hour' AS kind, hour, count(DISTINCT title) AS n FROM e GROUP BY 2 UNION ALL SELECT 'read', NULL, count(*) FROM f_edit_events UNION ALL SELECT 'bots', NULL, count_if(is_bot) FROM f_edit_events""")
def agg17b(t):
    titles, counts = M.titles_by_hour(t.f_edit_events, "2024-01-10", "2024-01-20")
    hours = titles.groupBy("hour").agg(F.count("*").alias("n")).select(F.lit("hour").alias("kind"), "hour", "n")
    return hours.unionByName(counts.select(F.explode(F.create_map(F.lit("read"), "read", F.lit("bots"), "bots")).alias("kind", "n"), F.lit(None).cast("timestamp").alias("hour")))


@query("agg27c_low_mobile", "SELECT CAST(f AS BIGINT) AS floor, count(*) AS rows, count_if(coalesce(mobile_views / nullif(views, 0), 0) < 0.25) AS low, round(count_if(coalesce(mobile_views / nullif(views, 0), 0) < 0.25) / count(*), 9) AS share FROM (VALUES (50), (100), (200)) x(f) JOIN f_hourly_views v ON v.views >= f GROUP BY 1")
def agg27c(t):
    return M.low_mobile_by_floor(t.f_hourly_views, [50, 100, 200]).withColumn("share", F.round("share", 9))


@query("agg31b_matches_by_lift", "SELECT s_name AS org, s_acctbal AS lift, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'A' || s_suppkey END AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN 'before' WHEN s_suppkey % 3 = 0 THEN 'newly' ELSE 'unmatched' END AS kind FROM supplier")
def agg31b(t):
    s = t.supplier
    name = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias("ticker")
    stocks, aliases = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), name("S")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), name("A"))
    return M.match_coverage(s.select(F.col("s_name").alias("org"), F.col("s_acctbal").alias("lift")), stocks, aliases, [])


@query("ord09b_top_orgs_by_lift", "SELECT * FROM (SELECT cluster_id, ticker AS org, gdelt_lift AS lift, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY gdelt_lift DESC, ticker) AS INT) AS place FROM f_cluster_stock) WHERE place <= 3")
def ord09b(t):
    return M.top_orgs(t.f_cluster_stock.select("cluster_id", F.col("ticker").alias("org"), F.col("gdelt_lift").alias("lift")), 3)


@query("win10b_settled_slot", """
WITH s AS (SELECT doc_id // 1000 AS slot, count(*) AS na, count_if(list_contains(locations, 'nation_3')) AS ni, count_if(list_contains(orgs, 'brand#11')) AS no, count_if(list_contains(locations, 'nation_3') AND list_contains(orgs, 'brand#11')) AS nb FROM s_articles GROUP BY 1),
c AS (SELECT slot, round((sum(nb) OVER w / nullif(sum(ni) OVER w, 0)) / nullif(sum(no) OVER w / sum(na) OVER w, 0), 9) AS lift FROM s WINDOW w AS (ORDER BY slot)), f AS (SELECT arg_max(lift, slot) AS final FROM c WHERE lift IS NOT NULL)
SELECT final, min(CASE WHEN abs(lift - final) <= 0.2 * greatest(final, 1e-9) THEN slot END) AS first_slot FROM c, f GROUP BY 1""")
def win10b(t):
    return M.settled_slot(win10(t).where("lift is not null"))


@query("set04b_topk_answers", """
WITH r AS (SELECT snapshot_ts, page_id, row_number() OVER (PARTITION BY snapshot_ts ORDER BY views DESC, page_id) AS pa, row_number() OVER (PARTITION BY snapshot_ts ORDER BY max_rev_id DESC, page_id) AS pb, page_id % 7 = 0 AS hit FROM f_root_rows),
x AS (SELECT *, pa <= k AS a, pb <= k AS b FROM r, (VALUES (5), (10), (20)) v(k))
SELECT snapshot_ts, CAST(k AS INT) AS k, count_if(a AND b) AS overlap, count_if(a AND hit) AS answers_a, count_if(b AND hit) AS answers_b, count_if(a AND NOT b) AS only_a, count_if(hit AND NOT a AND NOT b) AS missed,
  round(count_if(a AND NOT b AND NOT hit) / nullif(count_if(a AND NOT b), 0), 9) AS noise FROM x GROUP BY 1, 2""")
def set04b(t):
    ranked = lambda c: t.f_root_rows.select("snapshot_ts", "page_id", F.row_number().over(W.partitionBy("snapshot_ts").orderBy(F.desc(c), "page_id")).alias("place"))
    out = M.topk_overlap(ranked("views"), ranked("max_rev_id"), t.f_root_rows.where("page_id % 7 = 0"), "snapshot_ts", "page_id", [5, 10, 20])
    return out.withColumn("noise", F.round("noise", 9))


@query("set07b_one_sided_samples", """
WITH a AS (SELECT DISTINCT title FROM f_root_rows WHERE views > 150), b AS (SELECT DISTINCT title FROM f_root_rows WHERE views % 2 = 0), u AS (SELECT 'a' AS side, title FROM a WHERE title NOT IN (SELECT title FROM b) UNION ALL SELECT 'b', title FROM b WHERE title NOT IN (SELECT title FROM a))
SELECT * FROM (SELECT side, title, CAST(row_number() OVER (PARTITION BY side ORDER BY title) AS INT) AS place FROM u) WHERE place <= 5""")
def set07b(t):
    return M.one_sided_samples(t.f_root_rows.where("views > 150"), t.f_root_rows.where("views % 2 = 0"), "title")


@query("dqc04b_window_rules", """
WITH w AS (SELECT title, window_start AS s, CASE WHEN extract(hour FROM window_start) % 5 = 0 THEN window_start ELSE window_start + INTERVAL 1 HOUR END AS e, last_edit_ts + CASE WHEN extract(hour FROM window_start) % 7 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS l, window_start + CASE WHEN extract(hour FROM window_start) % 3 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END AS d FROM s_edit)
SELECT title, s AS window_start, 'end' AS rule FROM w WHERE NOT e > s UNION ALL SELECT title, s, 'last_edit' FROM w WHERE l >= e UNION ALL SELECT title, s, 'detected' FROM w WHERE d <= s""")
def dqc04b(t):
    from ..operators import attention as A

    h, hour = F.hour("window_start"), F.expr("interval 1 hour")
    w = A.edit_windows_exact(t.f_edit_events)
    odd = w.withColumns({
        "window_end": F.when(h % 5 == 0, F.col("window_start")).otherwise(F.col("window_start") + hour), "last_edit_ts": F.when(h % 7 == 0, F.col("last_edit_ts") + hour).otherwise(F.col("last_edit_ts")),
        "detected_at": F.when(h % 3 == 0, F.col("window_start")).otherwise(F.col("window_start") + hour),
    })
    return D.window_violations(odd).select("title", "window_start", "rule")


@query("dqc06b_answer_schemas", """
WITH c AS (SELECT c_custkey AS k, c_acctbal > 0 AS yes FROM customer)
SELECT * FROM (SELECT 'answer' AS kind, k AS id, CASE WHEN k % 7 = 0 THEN 'not_object' WHEN k % 11 = 0 THEN 'keys' WHEN k % 13 = 0 THEN 'verified' WHEN k % 5 = 0 THEN 'issue_class' WHEN yes AND k % 17 = 0 THEN 'match_path' WHEN yes AND k % 3 = 0 THEN 'rationale_ko' WHEN NOT yes AND k % 3 = 1 THEN 'not_null' END AS error FROM c
  UNION ALL SELECT 'summary', k, CASE WHEN k % 7 = 0 THEN 'not_object' WHEN yes AND k % 3 = 0 THEN 'summary' WHEN NOT yes AND k % 3 = 1 THEN 'not_null' END FROM c) WHERE error IS NOT NULL""")
def dqc06b(t):
    k, yes = F.col("c_custkey"), F.col("c_acctbal") > 0
    null = F.lit("null")
    flag = F.when(yes, "true").otherwise("false")
    path = F.when(yes & (k % 17 == 0), F.lit('"ODD"')).when(yes, F.lit('"REGION"')).otherwise(null)
    some, last = F.when(yes, F.lit('"because"')).otherwise(null), F.when(k % 3 == 0, F.when(yes, F.lit('" "')).otherwise(null)).when(yes | (k % 3 == 1), F.lit('"so"')).otherwise(null)
    answer = F.concat(F.lit('{"issue_class":'), F.when(k % 5 == 0, F.lit('"ODD"')).otherwise(F.lit('"SINGLE_COMPANY_EVENT"')), F.lit(',"verified":'), F.when(k % 13 == 0, F.concat(F.lit('"'), flag, F.lit('"'))).otherwise(flag), F.lit(',"match_path":'), path, F.lit(',"confidence":'), F.when(yes, F.lit('"weak"')).otherwise(null), F.lit(',"rationale_en":'), some, F.when(k % 11 == 0, F.lit("}")).otherwise(F.concat(F.lit(',"rationale_ko":'), last, F.lit("}"))))
    summary = F.concat(F.lit('{"sufficient_context":'), flag, F.lit(',"summary_ko":'), last, F.lit("}"))
    body = lambda text: t.customer.select(k.alias("id"), F.when(k % 7 == 0, F.lit("[1]")).otherwise(text).alias("body"))
    a, s = D.answer_violations(body(answer)), D.summary_violations(body(summary))
    return a.select(F.lit("answer").alias("kind"), "id", "error").unionByName(s.select(F.lit("summary").alias("kind"), "id", "error"))
