"""Queries over snapshot graphs, neighbours, news lift and set comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import lift as L
from . import scratch
from .registry import STEPS, query

STEPS["s_ranked"] = "SELECT *, row_number() OVER (PARTITION BY source, snapshot_ts ORDER BY views DESC, page_id) AS n FROM f_root_rows"
STEPS["s_roots"] = "SELECT source, snapshot_ts, page_id, title, views, 'Page ' || page_id AS link_key, round(ln(1 + views), 3) AS score FROM s_ranked WHERE n <= 20"
STEPS["s_out"] = "SELECT DISTINCT l.snapshot_ts, l.page_id, r2.page_id AS dst FROM f_links l JOIN s_roots r1 ON r1.snapshot_ts = l.snapshot_ts AND r1.page_id = l.page_id JOIN s_roots r2 ON r2.snapshot_ts = l.snapshot_ts AND r2.link_key = l.target WHERE l.page_id <> r2.page_id"
STEPS["s_edges"] = "SELECT DISTINCT snapshot_ts, least(page_id, dst) AS a, greatest(page_id, dst) AS b FROM s_out"
STEPS["s_articles"] = "SELECT doc_id, list(DISTINCT org) AS orgs, list(DISTINCT theme) AS themes, list(DISTINCT location) AS locations FROM f_article_rows GROUP BY 1"


def roots(t):
    rank = F.row_number().over(W.partitionBy("source", "snapshot_ts").orderBy(F.desc("views"), "page_id"))
    own = t.f_root_rows.withColumn("n", rank).where("n <= 20")
    return own.select("source", "snapshot_ts", "page_id", "title", "views", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("link_key"), F.round(F.log1p("views"), 3).alias("score"))


def links(t):
    return t.f_links.withColumn("source", F.lit("replay"))


#: A part takes about 100 bytes; at most so many are broadcast.
BROADCAST_PARTS = 200_000


def article_rows(t):
    """f_article_rows, by joins over as many tasks as the line items need. It comes dealt by doc_id."""
    tasks = t.tasks("lineitem")
    located = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.lower("n_name").alias("location"))
    ordered = t.orders.select("o_orderkey", "o_custkey").repartition(tasks, "o_custkey").join(located, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("doc_id"), "location")
    lines, parts = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_partkey"), t.part.select("p_partkey", F.lower("p_brand").alias("org"), F.upper("p_type").alias("theme"))
    if parts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS:
        named = lines.repartition(tasks, "doc_id").join(F.broadcast(parts), F.col("p_partkey") == F.col("l_partkey"))
    else:
        met = lines.repartition(tasks, "l_partkey").join(parts.repartition(tasks, "p_partkey"), F.col("p_partkey") == F.col("l_partkey"))
        named = met.select("doc_id", "org", "theme").repartition(tasks, "doc_id")
    return named.join(ordered.repartition(tasks, "doc_id"), "doc_id").select("doc_id", "org", "theme", "location")


def articles(t):
    return article_rows(t).groupBy("doc_id").agg(*[F.collect_set(c).alias(f"{c}s") for c in ("org", "theme", "location")])


@query("win09_root_selection_no_cooldown", "SELECT source, snapshot_ts, page_id FROM s_ranked WHERE n <= 20")
def win09_rank(t):
    return G.select_roots(t.f_root_rows, 20, 0)


@query("win09_root_selection")
def win09(t):
    scratch.path(t.spark, "picks")  # names the checkpoint folder of a local run
    return G.select_roots(t.f_root_rows, 20, 24 * 62)


@query("jon06_seeds_at_snapshot", "SELECT r.snapshot_ts, r.page_id, r.title, r.views, r.max_rev_id FROM f_root_rows r JOIN s_roots USING (source, snapshot_ts, page_id)".replace("r.snapshot_ts, r.page_id", "snapshot_ts, page_id"))
def jon06(t):
    return t.f_root_rows.join(roots(t).select("source", "snapshot_ts", "page_id"), ["source", "snapshot_ts", "page_id"], "left_semi").select("snapshot_ts", "page_id", "title", "views", "max_rev_id")


@query("jon13_root_link_edges", "SELECT * FROM s_edges")
def jon13(t):
    return G.root_edges(roots(t), links(t)).select("snapshot_ts", "a", "b")


@query("grf01_components", """
WITH RECURSIVE e AS (SELECT snapshot_ts, a, b FROM s_edges UNION SELECT snapshot_ts, b, a FROM s_edges),
r AS (SELECT snapshot_ts, page_id AS x, page_id AS y FROM s_roots UNION SELECT r.snapshot_ts, r.x, e.b FROM r JOIN e ON e.snapshot_ts = r.snapshot_ts AND e.a = r.y)
SELECT snapshot_ts, x AS page_id, min(y) AS comp FROM r GROUP BY 1, 2""")
def grf01(t):
    scratch.path(t.spark, "components")  # names the checkpoint folder of a local run
    return G.components(roots(t), G.root_edges(roots(t), links(t))).select("snapshot_ts", "page_id", "comp")


@query("grf02_focus_ratio", """
WITH d AS (SELECT snapshot_ts, p AS page_id, count(*) AS degree FROM (SELECT snapshot_ts, a AS p FROM s_edges UNION ALL SELECT snapshot_ts, b FROM s_edges) GROUP BY 1, 2), o AS (SELECT snapshot_ts, page_id, count(DISTINCT target) AS outlinks FROM f_links GROUP BY 1, 2)
SELECT snapshot_ts, page_id, coalesce(degree, 0) AS degree, outlinks, round(CASE WHEN outlinks > 0 THEN coalesce(degree, 0) / outlinks END, 9) AS ratio FROM s_roots LEFT JOIN d USING (snapshot_ts, page_id) LEFT JOIN o USING (snapshot_ts, page_id)""")
def grf02(t):
    own = G.focus_ratios(roots(t), G.root_edges(roots(t), links(t)), links(t))
    return own.select("snapshot_ts", "page_id", "degree", "outlinks", F.round("ratio", 9).alias("ratio"))


@query("grf03_suppress_focus")
def grf03(t):
    return G.core(roots(t), links(t), focus=0.5, detach=10**9).select("snapshot_ts", "page_id", "comp", "degree", "kept_degree")


@query("grf04_suppress_directional")
def grf04(t):
    return G.core(roots(t), links(t), focus=0.0).select("snapshot_ts", "page_id", "comp", "degree", "kept_degree")


@query("grf05_core_clusters")
def grf05(t):
    return G.core(roots(t), links(t))


@query("grf09_build_snapshots")
def grf09(t):
    own = G.core(roots(t), links(t)).join(roots(t).drop("link_key").withColumn("wiki", F.lit("enwiki")), ["source", "snapshot_ts", "page_id"])
    return G.build_snapshots(own)


STEPS["s_pairs"] = "SELECT snapshot_ts, a, b FROM s_edges UNION SELECT snapshot_ts, b, a FROM s_edges"
STEPS["s_reach"] = "SELECT snapshot_ts, page_id AS x, page_id AS y FROM s_roots UNION SELECT r.snapshot_ts, r.x, e.b FROM s_reach r JOIN s_pairs e ON e.snapshot_ts = r.snapshot_ts AND e.a = r.y"
STEPS["s_members"] = "SELECT snapshot_ts, comp, page_id, title, link_key, score, views FROM s_roots JOIN (SELECT snapshot_ts, x AS page_id, min(y) AS comp FROM s_reach GROUP BY 1, 2) USING (snapshot_ts, page_id)"


def members(t):
    """Roots with their cluster; no link is cut, so that SQL can say the same."""
    own = roots(t)
    return own.join(G.core(own, links(t), focus=0.0, detach=10**9).select("source", "snapshot_ts", "page_id", "comp"), ["source", "snapshot_ts", "page_id"])


@query("win12_lead_member", "SELECT snapshot_ts, comp, arg_max(page_id, (score, title)) AS lead_page, max(score) AS pulse, count(*) AS members FROM s_members GROUP BY 1, 2")
def win12(t):
    return G.lead_of(members(t), ["snapshot_ts", "comp"])


@query("grf09b_issue_rows", """
WITH g AS (SELECT snapshot_ts, comp, arg_max(title, (score, title)) AS label, round(max(score), 3) AS pulse_score, count_if(score >= 5) > 0 AS hot, count(*) AS member_count FROM s_members GROUP BY 1, 2),
k AS (SELECT *, 'replay:enwiki:' || label AS issue_key FROM g) SELECT k.*, min(snapshot_ts) OVER (PARTITION BY issue_key) AS first_detected, 'replay' AS source FROM k""")
def grf09b(t):
    return G.build_snapshots(members(t).withColumn("wiki", F.lit("enwiki")))


@query("grf10_pulse_map", """
WITH n AS (SELECT snapshot_ts, comp, list_transform(list(page_id ORDER BY page_id), lambda x: CAST(x AS VARCHAR)) AS nodes, count(*) AS node_count, CAST(sum(views) AS BIGINT) AS views FROM s_members GROUP BY 1, 2),
e AS (SELECT snapshot_ts, comp, list(a || '-' || b ORDER BY a, b) AS edges, count(*) AS edge_count FROM s_edges e JOIN s_members m USING (snapshot_ts) WHERE m.page_id = e.a GROUP BY 1, 2)
SELECT snapshot_ts, comp, nodes, node_count, views, coalesce(edges, []) AS edges, coalesce(edge_count, 0) AS edge_count FROM n LEFT JOIN e USING (snapshot_ts, comp)""")
def grf10(t):
    own = roots(t)
    clusters = G.core_links(own, links(t), focus=0.0, detach=10**9)
    nodes = clusters.join(own.select("snapshot_ts", "page_id", "views"), ["snapshot_ts", "page_id"])
    ends = F.transform(F.filter("kept", lambda b: b > F.col("page_id")), lambda b: F.struct("page_id", b.alias("b")))
    out = nodes.groupBy("snapshot_ts", "comp").agg(F.sort_array(F.collect_list("page_id")).alias("p"), F.count("*").alias("node_count"), F.sum("views").alias("views"), F.sort_array(F.flatten(F.collect_list(ends))).alias("e"))
    edge = F.transform("e", lambda e: F.concat_ws("-", e["page_id"].cast("string"), e["b"].cast("string")))
    return out.select("snapshot_ts", "comp", F.transform("p", lambda x: x.cast("string")).alias("nodes"), "node_count", "views", edge.alias("edges"), F.size("e").cast("long").alias("edge_count"))


@query("grf05b_core_edges", "SELECT snapshot_ts, a, b, 'kept' AS fate FROM s_edges")
def grf05b(t):
    return G.core_edges(G.core_links(roots(t), links(t), focus=0.0, detach=10**9)).drop("source")


@query("grf11_issue_detail", """
SELECT c.id, c.label, coalesce(list(s.ticker ORDER BY s.gdelt_lift DESC, s.ticker) FILTER (s.verified), []) AS stocks FROM f_clusters c LEFT JOIN f_cluster_stock s ON s.cluster_id = c.id GROUP BY 1, 2""")
def grf11(t):
    s = t.f_cluster_stock.where("verified").groupBy(F.col("cluster_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("gdelt_lift")).alias("l"), "ticker"))).alias("s"))
    own = t.f_clusters.join(s, "id", "left")
    return own.select("id", "label", F.coalesce(F.transform("s", lambda x: x["ticker"]), F.array().cast("array<string>")).alias("stocks"))


@query("grf13_report_input", "SELECT snapshot_ts, comp, string_agg(title, ', ' ORDER BY score DESC, title) AS titles FROM s_members GROUP BY 1, 2")
def grf13(t):
    own = members(t).groupBy("snapshot_ts", "comp").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "title"))).alias("x"))
    return own.select("snapshot_ts", "comp", F.array_join(F.transform("x", lambda x: x["title"]), ", ").alias("titles"))


STEPS["s_near"] = """
SELECT seed, neighbour, CAST(sum(o) + sum(i) AS BIGINT) AS n, sum(o) >= sum(i) AS directed FROM (
SELECT prev AS seed, curr AS neighbour, n AS o, 0 AS i FROM f_clicks WHERE kind = 'link' AND prev <> curr UNION ALL SELECT curr, prev, 0, n FROM f_clicks WHERE kind = 'link' AND prev <> curr) GROUP BY 1, 2"""


def near(t):
    """Neighbours of every page that readers left."""
    return G.neighbours(t.f_clicks, t.f_clicks.where("kind = 'link'").select(F.explode(F.array("prev", "curr")).alias("title")))


@query("jon07_neighbours", "SELECT * FROM s_near")
def jon07(t):
    return near(t)


STEPS["s_created"] = "SELECT 'Page ' || (page_id % 40) AS title, CAST(min(snapshot_ts) AS DATE) AS created FROM f_root_rows WHERE page_id % 40 < 30 GROUP BY 1"


def created(t):
    own = t.f_root_rows.where("page_id % 40 < 30")
    return own.groupBy(F.concat(F.lit("Page "), (F.col("page_id") % 40).cast("string")).alias("title")).agg(F.to_date(F.min("snapshot_ts")).alias("created"))


@query("jon08_creation_lookup", "SELECT seed, neighbour, created FROM s_near LEFT JOIN s_created ON title = neighbour")
def jon08(t):
    return near(t).join(created(t).withColumnRenamed("title", "neighbour"), "neighbour", "left").select("seed", "neighbour", "created")


STEPS["s_res"] = """
SELECT seed, neighbour, n, CAST(coalesce(sum(CASE WHEN day >= DATE '2024-01-20' AND day < DATE '2024-01-25' THEN e END), 0) AS BIGINT) AS event_edits, CAST(coalesce(sum(CASE WHEN day >= DATE '2024-01-15' AND day < DATE '2024-01-20' THEN e END), 0) AS BIGINT) AS base_edits
FROM s_near LEFT JOIN (SELECT trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title, CAST(event_ts AS DATE) AS day, count(*) AS e FROM f_edit_events GROUP BY 1, 2) d ON d.title = neighbour GROUP BY 1, 2, 3"""


def resurgent(t):
    daily = t.f_edit_events.groupBy(S.canonical_title(F.col("title")).alias("title"), F.to_date("event_ts").alias("day")).agg(F.count("*").alias("n"))
    pairs = near(t).select("seed", "neighbour", "n", F.lit("2024-01-20").cast("date").alias("event_start"), F.lit("2024-01-25").cast("date").alias("event_end"))
    return G.resurgence(pairs, daily)


@query("jon09_interval_edit_sums", "SELECT * FROM s_res")
def jon09(t):
    return resurgent(t).drop("event_start", "event_end")


@query("grf07_resurgence_gate", "SELECT seed, neighbour, event_edits >= 20 AND base_edits >= 5 AND event_edits >= 5 * base_edits AS passes FROM s_res")
def grf07(t):
    return resurgent(t).select("seed", "neighbour", G.passes_resurgence().alias("passes"))


GATED = """
WITH p AS (SELECT r.*, c.created, m.snapshot_ts, m.comp, m.score AS seed_score, CAST(m.snapshot_ts AS DATE) AS seen_day, CAST(date_trunc('month', m.snapshot_ts) - CAST(r.n % 2 AS INT) * INTERVAL 1 MONTH AS DATE) AS month,
  EXISTS (SELECT 1 FROM s_members o WHERE o.snapshot_ts = m.snapshot_ts AND o.comp = m.comp AND o.link_key = r.neighbour) AS is_member FROM s_res r JOIN s_members m ON m.link_key = r.seed LEFT JOIN s_created c ON c.title = r.neighbour),
g AS (SELECT *, CASE WHEN is_member THEN 'duplicate' WHEN n < 10 THEN 'few_clicks' WHEN created > seen_day THEN 'future' WHEN NOT month < date_trunc('month', seen_day) THEN 'open_month' WHEN abs(date_diff('day', created, seen_day)) <= 30 THEN 'new_page'
  WHEN event_edits >= 20 AND base_edits >= 5 AND event_edits >= 5 * base_edits THEN 'resurgence' ELSE 'quiet' END AS gate FROM p)
"""


def gated(t):
    """Neighbours of every root of every snapshot, with what their gates need. An odd count of clicks is of the month before."""
    m = members(t)
    own = resurgent(t).join(m.select("snapshot_ts", "comp", F.col("link_key").alias("seed"), F.col("score").alias("seed_score")), "seed")
    inside = m.select("snapshot_ts", "comp", F.col("link_key").alias("neighbour"), F.lit(True).alias("inside"))
    own = own.join(created(t).withColumnRenamed("title", "neighbour"), "neighbour", "left").join(inside, ["snapshot_ts", "comp", "neighbour"], "left")
    month = F.add_months(F.trunc("snapshot_ts", "month"), -(F.col("n") % 2).cast("int"))
    return own.select("seed", "neighbour", "n", "event_edits", "base_edits", "created", "snapshot_ts", "comp", "seed_score", month.alias("month"), F.coalesce("inside", F.lit(False)).alias("is_member"))


@query("grf06_expansion", GATED + "SELECT snapshot_ts, comp, neighbour, seed, n, gate FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_ts, comp, neighbour ORDER BY seed_score DESC, seed) AS k FROM g WHERE gate IN ('new_page', 'resurgence')) WHERE k = 1")
def grf06(t):
    return G.expand(gated(t)).select("snapshot_ts", "comp", "neighbour", "seed", "n", "gate")


@query("agg21_neighbour_funnel", GATED + "SELECT count(DISTINCT seed) AS seeds, count(*) AS candidates, count_if(created IS NULL) AS unknown_creation, count_if(n >= 10) AS enough_clicks, count_if(n >= 10 AND event_edits >= 20 AND base_edits >= 5 AND event_edits >= 5 * base_edits) AS resurgent FROM g")
def agg21(t):
    return G.funnel(gated(t))


@query("grf08_relation_edges", """
WITH m AS (SELECT snapshot_ts, 1 AS comp, title, row_number() OVER (PARTITION BY snapshot_ts ORDER BY score DESC, page_id) AS rank FROM s_roots), r AS (SELECT DISTINCT 'page_' || (l_partkey % 300) AS subject, 'page_' || (l_suppkey % 300) AS object, l_linestatus AS relation, CAST(l_shipdate AS TIMESTAMP) AS observed FROM lineitem)
SELECT DISTINCT a.snapshot_ts, subject, object, relation FROM r JOIN m a ON a.title = subject JOIN m b ON b.snapshot_ts = a.snapshot_ts AND b.title = object WHERE observed <= a.snapshot_ts AND b.rank <= a.rank AND subject <> object""")
def grf08(t):
    rank = F.row_number().over(W.partitionBy("snapshot_ts").orderBy(F.desc("score"), "page_id"))
    m = roots(t).select("snapshot_ts", F.lit(1).alias("comp"), "title", rank.alias("rank"))
    name = lambda c: F.concat(F.lit("page_"), (F.col(c) % 300).cast("string"))
    r = t.lineitem.select(name("l_partkey").alias("subject"), name("l_suppkey").alias("object"), F.col("l_linestatus").alias("relation"), F.col("l_shipdate").cast("timestamp").alias("observed")).distinct()
    return G.relation_edges(r, m).select("snapshot_ts", "subject", "object", "relation").distinct()


@query("agg14_creation_index", "SELECT title, arg_max(created, (event_ts, -log_id)) AS created, count(DISTINCT created) > 1 AS changed FROM (SELECT title, CAST(event_ts AS DATE) - CAST(rev_id % 3 AS INT) AS created, event_ts, rev_id AS log_id FROM f_edit_events) GROUP BY 1")
def agg14(t):
    own = t.f_edit_events.select("title", F.date_sub(F.to_date("event_ts"), (F.col("rev_id") % 3).cast("int")).alias("created"), "event_ts", F.col("rev_id").alias("log_id"))
    return own.groupBy("title").agg(F.max_by("created", F.struct("event_ts", -F.col("log_id"))).alias("created"), (F.count_distinct("created") > 1).alias("changed"))


@query("agg10_org_lift", """
WITH a AS (SELECT *, len(list_filter(themes, lambda x: contains(x, 'ECONOMY'))) > 0 AND list_contains(locations, 'nation_3') AS hit FROM s_articles), n AS (SELECT count(*) AS nc, count_if(hit) AS ni FROM a),
o AS (SELECT org, count(*) AS cc, count_if(hit) AS ic FROM (SELECT hit, unnest(orgs) AS org FROM a) GROUP BY 1)
SELECT org, ic AS issue_count, cc AS corpus_count, round((ic / ni) / (cc / nc), 9) AS lift FROM o, n WHERE ic >= 3""")
def agg10(t):
    return L.org_lift(articles(t), L.match_issue(["economy"], ["nation_3"])).withColumn("lift", F.round("lift", 9))


@query("prj10_issue_predicate", "SELECT doc_id FROM s_articles WHERE len(list_filter(themes, lambda x: contains(x, 'ECONOMY'))) > 0 AND list_contains(locations, 'nation_3')")
def prj10(t):
    return articles(t).where(L.match_issue(["ECONOMY"], ["nation_3"])).select("doc_id")


@query("agg11_vocabulary", "SELECT 'theme' AS axis, theme AS term, count(DISTINCT doc_id) AS support FROM f_article_rows GROUP BY 2 UNION ALL SELECT 'location', location, count(DISTINCT doc_id) FROM f_article_rows GROUP BY 2")
def agg11(t):
    return L.vocabulary(articles(t))


STEPS["s_words"] = "SELECT 'theme' AS axis, theme AS term, count(DISTINCT doc_id) AS support FROM f_article_rows GROUP BY 2 UNION ALL SELECT 'location', location, count(DISTINCT doc_id) FROM f_article_rows GROUP BY 2"


@query("grf12_derive_predicate", """
WITH m AS (SELECT p_partkey % 50 AS cluster_id, lower(p_type) AS word FROM part UNION SELECT n_nationkey % 50, lower(n_name) FROM nation), w AS (SELECT DISTINCT cluster_id, word FROM m WHERE len(word) >= 4),
t AS (SELECT cluster_id, 'theme' AS axis, word, (SELECT sum(support) FROM s_words WHERE axis = 'theme' AND contains(term, upper(word))) AS support FROM w),
l AS (SELECT cluster_id, 'location' AS axis, word, (SELECT sum(support) FROM s_words WHERE axis = 'location' AND regexp_matches(term, '\\b' || word || '\\b')) AS support FROM w),
u AS (SELECT * FROM t UNION ALL SELECT * FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, axis ORDER BY support DESC, word) AS place FROM u WHERE support >= 14 AND support <= 0.5 * (SELECT count(DISTINCT doc_id) FROM f_article_rows))
SELECT cluster_id, axis, word, CAST(support AS BIGINT) AS support, CAST(place AS INT) AS place FROM k WHERE place <= CASE axis WHEN 'theme' THEN 2 ELSE 3 END""".replace("\\\\b", "\\b"))
def grf12(t):
    return L.derive_predicates(*news_terms(t))


def news_terms(t):
    a = articles(t)
    members = t.part.select((F.col("p_partkey") % 50).alias("cluster_id"), F.col("p_type").alias("title")).union(t.nation.select((F.col("n_nationkey") % 50).cast("long"), "n_name")).distinct().withColumn("is_seed", F.lit(True))
    return members, L.vocabulary(a), a.count()


@query("grf12b_rejected_terms", """
WITH m AS (SELECT p_partkey % 50 AS cluster_id, lower(p_type) AS title FROM part UNION SELECT n_nationkey % 50, lower(n_name) FROM nation), n AS (SELECT count(DISTINCT doc_id) AS n, greatest(3, CAST(floor(0.001 * count(DISTINCT doc_id)) AS BIGINT)) AS least FROM f_article_rows),
w AS (SELECT cluster_id, unnest(string_split_regex(title, '[^0-9a-z]+')) AS word FROM m), k AS (SELECT DISTINCT cluster_id, word FROM w WHERE len(word) >= 4 AND NOT regexp_full_match(word, '[0-9]+')),
t AS (SELECT cluster_id, 'theme' AS axis, word, (SELECT sum(support) FROM s_words WHERE axis = 'theme' AND contains(term, upper(word))) AS support FROM k),
l AS (SELECT cluster_id, 'location' AS axis, word, (SELECT sum(support) FROM s_words WHERE axis = 'location' AND regexp_matches(term, '\\b' || word || '\\b')) AS support FROM (SELECT * FROM k UNION SELECT cluster_id, trim(title) FROM m))
SELECT cluster_id, axis, word, CAST(coalesce(support, 0) AS BIGINT) AS support, CASE WHEN support IS NULL THEN 'unseen' WHEN support < least THEN 'rare' ELSE 'general' END AS reason
FROM (SELECT * FROM t UNION ALL SELECT * FROM l), n WHERE support IS NULL OR support < least OR support > 0.5 * n""")
def grf12b(t):
    own = L.judged_terms(*news_terms(t)).where("reason is not null")
    return own.select("cluster_id", "axis", "word", "support", "reason")


@query("jon16_org_to_ticker", """
WITH k AS (SELECT lower(s_name) AS key, min('S' || s_suppkey) AS ticker FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1), a AS (SELECT lower(s_name) AS key, min('A' || s_suppkey) AS ticker FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey <> 9 GROUP BY 1)
SELECT s_name || ' Inc' AS org, coalesce(k.ticker, a.ticker) AS ticker FROM supplier s LEFT JOIN k ON k.key = trim(regexp_replace(lower(s.s_name), '[^\\w\\s]', ' ', 'g')) LEFT JOIN a ON a.key = trim(regexp_replace(lower(s.s_name), '[^\\w\\s]', ' ', 'g'))""".replace("lower(s_name) AS key", "trim(regexp_replace(lower(s_name), '[^\\w\\s]', ' ', 'g')) AS key"))
def jon16(t):
    s = t.supplier
    name = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias("ticker")
    stocks, aliases = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), name("S")), s.where("s_suppkey % 3 = 0 and s_suppkey <> 9").select(F.col("s_name").alias("name"), name("A"))
    return L.match_orgs(s.select(F.concat("s_name", F.lit(" Inc")).alias("org")), stocks, aliases, [])


@query("agg31_match_coverage", "SELECT count(*) AS orgs, count_if(s_suppkey % 2 = 0) AS before, count_if(s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AS after, count_if(s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0) AS newly FROM supplier")
def agg31(t):
    s = t.supplier
    name = lambda p: F.concat(F.lit(p), F.col("s_suppkey").cast("string")).alias("ticker")
    stocks, aliases = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), name("S")), s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"), name("A"))
    orgs = s.select(F.col("s_name").alias("org"))
    both = L.match_orgs(orgs, stocks, aliases.limit(0), []).withColumnRenamed("ticker", "x").join(L.match_orgs(orgs, stocks, aliases, []), "org")
    return both.agg(F.count("*").alias("orgs"), F.count("x").alias("before"), F.count("ticker").alias("after"), F.count_if(F.col("x").isNull() & F.col("ticker").isNotNull()).alias("newly"))


@query("ord09_top_orgs", "SELECT * FROM (SELECT theme, org, count(DISTINCT doc_id) AS n, CAST(row_number() OVER (PARTITION BY theme ORDER BY count(DISTINCT doc_id) DESC, org) AS INT) AS place FROM f_article_rows GROUP BY 1, 2) WHERE place <= 3")
def ord09(t):
    n = article_rows(t).groupBy("theme", "org").agg(F.count_distinct("doc_id").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("theme").orderBy(F.desc("n"), "org"))).where("place <= 3")


@query("win10_cumulative_lift", """
WITH s AS (SELECT doc_id // 1000 AS slot, count(*) AS na, count_if(list_contains(locations, 'nation_3')) AS ni, count_if(list_contains(orgs, 'brand#11')) AS no, count_if(list_contains(locations, 'nation_3') AND list_contains(orgs, 'brand#11')) AS nb FROM s_articles GROUP BY 1)
SELECT slot, round((sum(nb) OVER w / nullif(sum(ni) OVER w, 0)) / nullif(sum(no) OVER w / sum(na) OVER w, 0), 9) AS lift FROM s WINDOW w AS (ORDER BY slot)""")
def win10(t):
    i, o = F.array_contains("locations", "nation_3"), F.array_contains("orgs", "brand#11")
    s = articles(t).groupBy(F.floor(F.col("doc_id") / 1000).alias("slot")).agg(F.count("*").alias("articles"), F.count_if(i).alias("issue_articles"), F.count_if(o).alias("org_articles"), F.count_if(i & o).alias("both"))
    return L.lift_curve(s).withColumn("lift", F.round("lift", 9))


@query("set03_seam_compare", """
WITH a AS (SELECT rev_id, date_trunc('second', event_ts) AS ts FROM f_edit_events WHERE rev_id % 5 <> 0 AND event_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'), b AS (SELECT rev_id, date_trunc('second', event_ts) AS ts FROM f_edit_events WHERE rev_id % 7 <> 0 AND event_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20')
SELECT count_if(b.rev_id IS NULL) AS only_a, count_if(a.rev_id IS NULL) AS only_b, count_if(a.rev_id IS NOT NULL AND b.rev_id IS NOT NULL) AS both_sides FROM a FULL JOIN b ON a.rev_id = b.rev_id AND a.ts = b.ts""")
def set03(t):
    from ..operators.sets import agreement

    own = t.f_edit_events.where(F.col("event_ts").between("2024-01-10", "2024-01-20")).select("rev_id", S.to_second(F.col("event_ts")).alias("ts"))
    return agreement(own.where("rev_id % 5 <> 0"), own.where("rev_id % 7 <> 0"), ["rev_id", "ts"]).select("only_a", "only_b", "both_sides")


@query("set04_topk_overlap", "WITH a AS (SELECT page_id FROM f_root_rows GROUP BY 1 ORDER BY sum(views) DESC, page_id LIMIT 50), b AS (SELECT page_id FROM f_root_rows GROUP BY 1 ORDER BY max(views) DESC, page_id LIMIT 50) SELECT count(*) AS overlap FROM a JOIN b USING (page_id)")
def set04(t):
    g = t.f_root_rows.groupBy("page_id").agg(F.sum("views").alias("s"), F.max("views").alias("m"))
    a, b = g.orderBy(F.desc("s"), "page_id").limit(50), g.orderBy(F.desc("m"), "page_id").limit(50)
    return a.select("page_id").join(b.select("page_id"), "page_id").agg(F.count("*").alias("overlap"))


@query("set05_union_sources", "SELECT ticker, min(src) AS src FROM (SELECT 'S' || s_suppkey AS ticker, 0 AS src FROM supplier UNION ALL SELECT ticker, 1 FROM f_prices) GROUP BY 1")
def set05(t):
    from ..operators.sets import union_first

    a = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return union_first([a, t.f_prices.select("ticker")], ["ticker"]).select("ticker", "src")


@query("set06_selection_diff", "WITH a AS (SELECT snapshot_ts, page_id FROM s_ranked WHERE n <= 20), b AS (SELECT snapshot_ts, page_id FROM s_ranked WHERE n BETWEEN 3 AND 22) SELECT a.page_id IS NOT NULL AS in_a, b.page_id IS NOT NULL AS in_b, count(*) AS n FROM a FULL JOIN b USING (snapshot_ts, page_id) GROUP BY 1, 2")
def set06(t):
    from ..operators.sets import flagged

    rank = F.row_number().over(W.partitionBy("source", "snapshot_ts").orderBy(F.desc("views"), "page_id"))
    own = t.f_root_rows.withColumn("n", rank)
    return flagged(own.where("n <= 20"), own.where("n between 3 and 22"), ["snapshot_ts", "page_id"]).groupBy("in_a", "in_b").agg(F.count("*").alias("n"))


@query("set07_set_agreement", "WITH a AS (SELECT DISTINCT title FROM f_root_rows WHERE views > 150), b AS (SELECT DISTINCT title FROM f_root_rows WHERE views % 2 = 0) SELECT count_if(b.title IS NULL) AS only_a, count_if(a.title IS NULL) AS only_b, count_if(coalesce(a.title = b.title, false)) AS both_sides, round(count_if(coalesce(a.title = b.title, false)) / count(*), 9) AS jaccard, round(count_if(coalesce(a.title = b.title, false)) / count(a.title), 9) AS recall, round(count_if(coalesce(a.title = b.title, false)) / count(b.title), 9) AS precision FROM a FULL JOIN b ON a.title = b.title")
def set07(t):
    from ..operators.sets import agreement

    a, b = t.f_root_rows.where("views > 150").select("title").distinct(), t.f_root_rows.where("views % 2 = 0").select("title").distinct()
    return agreement(a, b, ["title"])


@query("dqc02_map_contract", """
SELECT 'edge_without_node' AS rule, count(*) AS n FROM s_edges e WHERE NOT EXISTS (SELECT 1 FROM s_roots r WHERE r.snapshot_ts = e.snapshot_ts AND r.page_id = e.a AND r.page_id % 11 <> 0)
UNION ALL SELECT 'duplicate_node', count(*) FROM (SELECT snapshot_ts, page_id FROM s_roots GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'size_over_one', count(*) FROM s_roots WHERE score / (score + 5) > 0.5""")
def dqc02(t):
    r, e = roots(t), G.root_edges(roots(t), links(t))
    lost = e.join(r.where("page_id % 11 <> 0").select("snapshot_ts", F.col("page_id").alias("a")), ["snapshot_ts", "a"], "left_anti").agg(F.lit("edge_without_node").alias("rule"), F.count("*").alias("n"))
    twice = r.groupBy("snapshot_ts", "page_id").count().where("count > 1").agg(F.lit("duplicate_node").alias("rule"), F.count("*").alias("n"))
    return lost.unionByName(twice).unionByName(r.where("score / (score + 5) > 0.5").agg(F.lit("size_over_one").alias("rule"), F.count("*").alias("n")))


@query("dqc11_hour_alignment", """
WITH d AS (SELECT title, ts_hour, views + (ts_hour < TIMESTAMP '2024-01-10')::INT AS dv FROM f_hourly_views), j AS (SELECT h.title, abs(h.views - a.dv) AS same, abs(h.views - b.dv) AS nxt FROM f_hourly_views h JOIN d a ON a.title = h.title AND a.ts_hour = h.ts_hour JOIN d b ON b.title = h.title AND b.ts_hour = h.ts_hour + INTERVAL 1 HOUR)
SELECT title, count(*) AS n, count_if(same < nxt) AS same_hour, count_if(nxt < same) AS next_hour FROM j GROUP BY 1""")
def dqc11(t):
    from ..operators.quality import hour_alignment

    d = t.f_hourly_views.select("title", "ts_hour", (F.col("views") + (F.col("ts_hour") < "2024-01-10").cast("int")).alias("views"))
    return hour_alignment(t.f_hourly_views.select("title", "ts_hour", "views"), d)
