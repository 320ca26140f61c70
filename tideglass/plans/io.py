"""Queries that write what Spark derives from the tables, read it back or stream it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import attention as A
from ..operators import quality as D
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.versions import Versions, WouldOrphan
from ..streaming import jobs as J
from ..streaming import pending as P
from ..streaming.live import Live
from . import scratch
from .registry import Tables, query

CANON = "trim(regexp_replace(title, '[ _]+', ' ', 'g'))"


def as_json(t: Tables) -> DataFrame:
    e = t.f_edit_events
    kind = F.struct("wiki", "title", "event_type", "rev_id", "byte_delta", F.col("usr").alias("user"), "is_bot", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_ts"), F.when(F.col("rev_id") % 11 == 0, " ").otherwise(F.col("meta_id")).alias("meta_id"))
    return e.select(F.to_json(kind).alias("value"))


@query("src02_parse_edit_json", "SELECT meta_id, title, rev_id, is_bot, date_trunc('millisecond', event_ts) AS event_ts FROM f_edit_events WHERE rev_id % 11 <> 0")
def src02(t):
    return R.parse_edits(as_json(t)).select("meta_id", "title", "rev_id", "is_bot", "event_ts")


@query("src03_jsonl_gz", "SELECT meta_id, title, rev_id FROM f_edit_events")
def src03(t):
    path = scratch.path(t.spark, "jsonl")
    t.f_edit_events.select("meta_id", "title", "rev_id").write.option("compression", "gzip").json(f"{path}/a")
    return R.read_jsonl(t.spark, path).select("meta_id", "title", "rev_id")


@query("src04_history_tsv", "SELECT 'revision' AS entity, CAST(rev_id AS VARCHAR) AS rev_id, title AS title_then FROM f_edit_events WHERE rev_id % 10 <> 0")
def src04(t):
    path = scratch.path(t.spark, "history")
    pad = F.repeat(F.lit("\t"), 75)
    line = F.concat(F.lit("revision\t"), F.col("rev_id").cast("string"), F.lit("\t"), F.col("title"), F.when(F.col("rev_id") % 10 == 0, F.lit("")).otherwise(pad))
    t.f_edit_events.select(line.alias("value")).write.option("compression", "bzip2").text(path)
    return R.read_history(t.spark, path, {"entity": 0, "rev_id": 1, "title_then": 2}, "quarantine")[0]


@query("src05_recentchange_ndjson", "SELECT rev_id AS revid, title FROM f_edit_events")
def src05(t):
    path = scratch.path(t.spark, "rc")
    t.f_edit_events.select(F.lit("edit").alias("type"), F.lit(0).alias("ns"), "title", F.col("rev_id").alias("revid")).write.json(path)
    return R.read_recent_changes(t.spark, path).select("revid", "title")


@query("src06_hourly_views_txt", "SELECT title, ts_hour, views - mobile_views AS views, false AS is_mobile FROM f_hourly_views UNION ALL SELECT title, ts_hour, mobile_views, true FROM f_hourly_views")
def src06(t):
    path = scratch.path(t.spark, "views")
    rows = t.f_hourly_views
    both = rows.select("title", "ts_hour", F.lit("en").alias("p"), (F.col("views") - F.col("mobile_views")).alias("n")).unionByName(rows.select("title", "ts_hour", F.lit("en.m").alias("p"), F.col("mobile_views").alias("n")))
    end = F.date_format(F.col("ts_hour") + F.expr("interval 1 hour"), "yyyyMMdd-HHmmss")
    lines = both.select(F.concat_ws(" ", "p", F.replace("title", F.lit(" "), F.lit("_")), F.col("n").cast("string"), F.lit("0")).alias("value"), end.alias("hour"))
    lines.repartition("hour").write.partitionBy("hour").text(path)
    # The hour is taken from a file's name; Spark names its own files, so here it stands in the folder.
    return R.read_hourly_views(t.spark, path, {"en": False, "en.m": True}, named_by="folder")[0].select("title", "ts_hour", "views", "is_mobile")


@query("prj07_project_filter", "SELECT DISTINCT title FROM f_hourly_views")
def prj07(t):
    path = scratch.path(t.spark, "views")
    p = F.when(F.col("views") % 3 == 0, "en").when(F.col("views") % 3 == 1, "en.m").otherwise("de")
    t.f_hourly_views.select(F.concat_ws(" ", p, F.replace("title", F.lit(" "), F.lit("_")), F.col("views").cast("string"), F.lit("0")).alias("value")).write.text(path)
    return R.read_hourly_views(t.spark, path, {"en": False, "en.m": True})[0].select("title").distinct()


@query("src07_daily_views_txt", "SELECT 'Page_' || (event_id % 20) AS title, CAST(floor(value) AS BIGINT) AS total FROM events WHERE event_type = 'view' AND event_id % 9 <> 0")
def src07(t):
    path = scratch.path(t.spark, "daily")
    n = F.floor("value").cast("string")
    total = F.when(F.col("event_id") % 9 == 0, F.lit("-1")).otherwise(n)
    hours = F.concat(F.chr(F.hour(F.col("ts").cast("timestamp")).cast("long") + 65), n)
    line = F.concat_ws(" ", F.lit("en.wikipedia"), F.concat(F.lit("Page_"), (F.col("event_id") % 20).cast("string")), F.lit("1"), F.lit("desktop"), total, hours)
    t.events.where("event_type = 'view'").select(line.alias("value")).write.text(path)
    return R.read_daily_views(t.spark, path, "en.wikipedia", "quarantine")[0].select("title", "total")


@query("dqc01_width_and_sum_checks", "SELECT 'hours do not sum to the total' AS error, count(*) AS n FROM events WHERE event_type = 'view' AND event_id % 9 = 0")
def dqc01(t):
    n = F.floor("value").cast("long")
    own = t.events.where("event_type = 'view'").select(F.when(F.col("event_id") % 9 == 0, n + 1).otherwise(n).alias("total"), n.alias("sum"))
    bad = D.check_rows(own, F.when(F.col("total") != F.col("sum"), F.lit("hours do not sum to the total")))[1]
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query("src08_clickstream_tsv", "SELECT prev, curr, n FROM f_clicks WHERE kind = 'link' AND n % 7 <> 0")
def src08(t):
    path = scratch.path(t.spark, "clicks")
    n = F.when(F.col("n") % 7 == 0, F.lit("many")).otherwise(F.col("n").cast("string"))
    t.f_clicks.select(F.concat_ws("\t", "prev", "curr", "kind", n).alias("value")).write.text(path)
    return R.read_clickstream(t.spark, path)[0].select("prev", "curr", "n")


@query("src10_listing_pipe", "SELECT 'S' || chr(CAST(65 + s_suppkey % 26 AS INT)) AS ticker, count(*) AS n FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1")
def src10(t):
    path = scratch.path(t.spark, "listing")
    row = t.supplier.select(F.concat(F.lit("S"), F.chr((F.col("s_suppkey") % 26 + 65).cast("long"))).alias("Symbol"), F.concat("s_name", F.lit(" Common Stock")).alias("Security Name"), F.when(F.col("s_suppkey") % 4 == 0, "Y").otherwise("N").alias("Test Issue"), F.lit("N").alias("ETF"))
    row.write.option("sep", "|").option("header", "true").csv(path)
    return R.common_stock(R.read_listing(t.spark, path)).groupBy("ticker").agg(F.count("*").alias("n"))


@query("prj11_common_stock", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0")
def prj11(t):
    row = t.supplier.select(F.concat(F.lit("A."), F.chr((F.col("s_suppkey") % 26 + 65).cast("long"))).alias("Symbol"), F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " Ordinary Shares").otherwise(" Warrant")).alias("Security Name"), F.when(F.col("s_suppkey") % 4 == 0, "Y").otherwise("N").alias("Test Issue"), F.lit("N").alias("ETF"))
    return R.common_stock(row).select(F.split_part("name", F.lit(" "), F.lit(1)).cast("long").alias("id"))


@query("src11_ticker_json", "SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS title FROM supplier")
def src11(t):
    path = scratch.path(t.spark, "tickers")
    entry = F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit(" s"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title"))
    own = t.supplier.groupBy(F.floor(F.col("s_suppkey") / 500)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), entry))).alias("x"))
    own.select(F.to_json("x").alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # an object a file
    return R.read_ticker_index(t.spark, path)


@query("jon20_enrich_names", "SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'plain' END AS name FROM supplier")
def jon20(t):
    stock = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit("plain").alias("name"), F.lit("NYSE").alias("exchange"))
    index = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title"), F.lit("0").alias("cik"))
    return R.universe([stock, stock], index).select("ticker", "name")


@query("src12_price_rows", "SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(14,4)) AS close, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DECIMAL(14,4)) END AS open, replace('A.' || o_custkey, '.', '-') AS symbol FROM orders WHERE o_orderkey % 7 <> 0")
def src12(t):
    p = F.col("o_totalprice")
    bars = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("A."), F.col("o_custkey").cast("string")).alias("ticker"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("nan"))).otherwise(p).alias("open"), p.alias("high"), F.lit(1e12).alias("low"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("inf"))).otherwise(p).alias("close"), F.lit(5.0).alias("volume"))
    return R.clean_prices(bars).select("id", "close", "open", "symbol")


@query("src13_parquet_windows", "SELECT CAST(max(window_start) AS DATE) AS as_of, count(*) AS n FROM s_windows")
def src13(t):
    from .attention import windows

    path = scratch.path(t.spark, "windows")
    windows(t).write.parquet(path)
    return t.spark.read.parquet(path).agg(F.to_date(F.max("window_start")).alias("as_of"), F.count("*").alias("n"))


@query("src14_latest_complete_partition", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(DISTINCT o_orderpriority) AS shards FROM orders WHERE o_orderdate < TIMESTAMP '1997-05-01' GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def src14(t):
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("file")).agg(F.count("*").alias("bytes"))
    files = m.where("not (month in ('1997-05', '1997-06') and file like '1%')")
    return R.pick_complete_month(m, files, "1997-06")


@query("prj01_normalize_stream_event", f"SELECT meta_id, {CANON} AS title, event_type, byte_delta FROM f_edit_events WHERE rev_id % 4 <> 0")
def prj01(t):
    e = t.f_edit_events
    raw = e.select(F.struct(F.col("meta_id").alias("id"), F.col("event_ts").cast("string").alias("dt"), F.lit("en.wikipedia.org").alias("domain")).alias("meta"), "wiki", F.when(F.col("rev_id") % 4 == 0, 1).otherwise(0).alias("namespace"), F.col("event_type").alias("type"), "title",
        F.struct(F.when(F.col("byte_delta") % 2 == 0, F.lit(7)).alias("old"), F.when(F.col("byte_delta") % 2 == 0, F.col("byte_delta") + 7).otherwise(F.col("byte_delta")).alias("new")).alias("length"), F.struct((F.col("rev_id") - 1).alias("old"), F.col("rev_id").alias("new")).alias("revision"), F.col("usr").alias("user"), F.col("is_bot").alias("bot"), F.lit(False).alias("minor"))
    return R.normalize_changes(raw, ["enwiki"]).select("meta_id", "title", "event_type", "byte_delta")


@query("prj02_normalize_dump_event", f"SELECT 'dump:enwiki:' || rev_id AS meta_id, {CANON} AS title, CASE WHEN rev_id % 5 = 0 THEN 'new' ELSE 'edit' END AS event_type, nullif(rev_id % 3, 0) AS rev_parent_id FROM f_edit_events")
def prj02(t):
    ts = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.S")
    raw = t.f_edit_events.select("wiki", F.lit("revision").alias("entity"), F.lit("create").alias("event"), F.lit("0").alias("namespace_then"), F.col("title").alias("title_then"), ts.alias("event_timestamp"), F.when(F.col("rev_id") % 5 == 0, ts).otherwise(F.lit("2001-01-01 00:00:00.0")).alias("first_edit_timestamp"), F.col("rev_id").cast("string").alias("rev_id"), (F.col("rev_id") % 3).cast("string").alias("parent_id"), F.lit("1").alias("bytes_diff"), F.col("usr").alias("user"))
    return R.normalize_history(raw).select("meta_id", "title", "event_type", "rev_parent_id")


def changes(t: Tables) -> DataFrame:
    e = t.f_edit_events
    log = F.col("rev_id") % 6 == 0
    return e.select(F.when(log, "log").otherwise("edit").alias("type"), F.lit(0).alias("ns"), "title", F.col("rev_id").alias("rcid"), F.col("rev_id").alias("revid"), F.col("usr").alias("user"), F.col("is_bot").alias("bot"), F.lit(10).alias("oldlen"), (F.col("byte_delta") + 10).alias("newlen"), F.col("event_ts").cast("string").alias("timestamp"), F.when(log, "move").alias("logtype"), F.struct(F.when(log, F.concat("title", F.lit(" moved"))).alias("target_title")).alias("logparams"))


@query("prj03_normalize_recent_change", f"SELECT 'rc:' || rev_id AS meta_id, {CANON} AS title, byte_delta FROM f_edit_events WHERE rev_id % 6 <> 0")
def prj03(t):
    return R.normalize_rc(changes(t)).select("meta_id", "title", "byte_delta")


@query("prj04_log_fanout", f"SELECT 'rc:' || rev_id AS meta_id, {CANON} AS title FROM f_edit_events WHERE rev_id % 6 = 0 UNION ALL SELECT 'rc:' || rev_id, {CANON} || ' moved' FROM f_edit_events WHERE rev_id % 6 = 0")
def prj04(t):
    return R.fan_out_logs(changes(t)).select("meta_id", "title")


@query("agg18_rc_windows", f"""
WITH r AS (SELECT {CANON} AS title, event_ts, usr, rev_id FROM f_edit_events WHERE rev_id % 6 <> 0 AND NOT is_bot UNION ALL SELECT {CANON}, event_ts, usr, NULL FROM f_edit_events WHERE rev_id % 6 = 0 AND NOT is_bot UNION ALL SELECT {CANON} || ' moved', event_ts, usr, NULL FROM f_edit_events WHERE rev_id % 6 = 0 AND NOT is_bot)
SELECT title, date_trunc('hour', event_ts) AS window_start, count(*) AS edit_count, count(DISTINCT usr) AS editor_count, max(rev_id) AS max_rev_id FROM r GROUP BY 1, 2""")
def agg18(t):
    c = changes(t)
    return A.edit_windows_exact(R.normalize_rc(c).unionByName(R.fan_out_logs(c))).select("title", "window_start", "edit_count", "editor_count", "max_rev_id")


@query("snk01_sharded_jsonl", "SELECT count(*) AS records FROM f_edit_events")
def snk01(t):
    return K.write_shards(t.f_edit_events.select("meta_id", "title"), scratch.path(t.spark, "shards"), 1000).agg(F.sum("records").alias("records"))


@query("snk02_upsert_keyed", "SELECT ticker, trade_date, CASE WHEN extract(day FROM trade_date) = 1 THEN CAST(close + 1 AS DECIMAL(14,4)) ELSE close END AS close FROM f_prices UNION ALL SELECT 'NEW', DATE '2000-01-01', CAST(1 AS DECIMAL(14,4))")
def snk02(t):
    p = t.f_prices
    new = p.where(F.dayofmonth("trade_date") == 1).select("ticker", "trade_date", (F.col("close") + 1).cast("decimal(14,4)").alias("close"))
    more = t.spark.range(1).select(F.lit("NEW").alias("ticker"), F.lit("2000-01-01").cast("date").alias("trade_date"), F.lit(1).cast("decimal(14,4)").alias("close"))
    return K.upsert(p, new.unionByName(more), ["ticker", "trade_date"])


@query("snk03_get_or_create_ids", f"SELECT count(*) AS pages, count(DISTINCT page_id) AS ids FROM (SELECT DISTINCT title AS page_id FROM f_hourly_views UNION SELECT DISTINCT {CANON} || ' new' FROM f_edit_events)")
def snk03(t):
    dim = t.f_hourly_views.select(F.xxhash64("wiki", "title").alias("page_id"), "wiki", "title").distinct()
    keys = t.f_edit_events.select("wiki", F.concat(S.canonical_title(F.col("title")), F.lit(" new")).alias("title"))
    return K.resolve_pages(dim, keys.unionByName(dim.select("wiki", "title"))).agg(F.count("*").alias("pages"), F.count_distinct("page_id").alias("ids"))


@query("snk04_replace_partition", "SELECT year(snapshot_ts) AS y, count(*) AS n, count_if(label = 'again') AS again FROM (SELECT snapshot_ts, CASE WHEN year(snapshot_ts) = 1996 THEN 'again' ELSE label END AS label FROM f_clusters WHERE year(snapshot_ts) <> 1996 OR id % 2 = 0) GROUP BY 1")
def snk04(t):
    path = scratch.path(t.spark, "clusters")
    c = t.f_clusters.select("id", "label", "snapshot_ts", F.year("snapshot_ts").alias("y"))
    c.write.partitionBy("y").parquet(path)
    K.replace_partitions(c.where("y = 1996 and id % 2 = 0").withColumn("label", F.lit("again")), path, ["y"])
    return t.spark.read.parquet(path).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "again").alias("again"))


CLUSTERS = "source string, snapshot_ts timestamp, id long, label string"


def versioned(t: Tables) -> tuple[Versions, DataFrame]:
    """All clusters by month, committed, and the months."""
    store = Versions(t.spark, scratch.path(t.spark, "versions"), {"clusters": CLUSTERS})
    c = t.f_clusters.select("source", F.date_trunc("month", "snapshot_ts").alias("snapshot_ts"), "id", "label")
    months = c.select("source", "snapshot_ts").distinct()
    store.replace(months, {"clusters": c})
    return store, months


@query("snk04b_snapshot_versions", """
WITH c AS (SELECT source, date_trunc('month', snapshot_ts) AS ts, id FROM f_clusters),
r AS (SELECT source, year(ts) AS y, count(DISTINCT ts) AS snapshots FROM c GROUP BY 1, 2),
n AS (SELECT source, year(ts) AS y, count(*) AS n, sum(id) AS ids FROM c WHERE year(ts) <> 1997 AND (year(ts) <> 1996 OR id % 3 = 0) GROUP BY 1, 2)
SELECT source, y, snapshots, CASE y WHEN 1996 THEN 1 WHEN 1997 THEN 1 ELSE 0 END AS generation, coalesce(n, 0) AS n, coalesce(n, 0) AS registered, CAST(coalesce(ids, 0) AS BIGINT) AS ids FROM r LEFT JOIN n USING (source, y)""")
def snk04b(t):
    """1996 is rewritten with a third of its rows and 1997 with none."""
    store, months = versioned(t)
    store.replace(months.where("year(snapshot_ts) = 1996"), {"clusters": store.read("clusters").where("year(snapshot_ts) = 1996 and id % 3 = 0")})
    store.replace(months.where("year(snapshot_ts) = 1997"), {})
    parts = store.pointers().groupBy("source", F.year("snapshot_ts").alias("y")).agg(F.count("*").alias("snapshots"), F.max("generation").cast("int").alias("generation"), F.sum(F.col("rows")["clusters"]).alias("registered"))
    rows = store.read("clusters").groupBy("source", F.year("snapshot_ts").alias("y")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    return parts.join(rows, ["source", "y"], "left").fillna(0, ["n", "ids"])


@query("snk05b_guarded_replacement", """
WITH c AS (SELECT id, year(snapshot_ts) = 1996 AND id % 3 <> 0 AS gone FROM f_clusters)
SELECT s.tier, count(*) AS n, count_if(NOT gone) AS kept, count_if(gone) AS refused FROM f_cluster_stock s JOIN c ON c.id = s.cluster_id GROUP BY 1""")
def snk05b(t):
    """A rewrite of 1996 with a third of its clusters is refused while stocks hang on the others; allowed, it drops them."""
    store, months = versioned(t)
    own, new = months.where("year(snapshot_ts) = 1996"), {"clusters": store.read("clusters").where("year(snapshot_ts) = 1996 and id % 3 = 0")}
    tiers = {r.tier: t.f_cluster_stock.where(F.col("tier") == r.tier) for r in t.f_cluster_stock.select("tier").distinct().collect()}
    refused = {}
    try:
        store.replace(own, new, tiers, "clusters")
    except WouldOrphan as e:
        refused = e.counts
    before = store.kept(t.f_cluster_stock, "clusters").groupBy("tier").agg(F.count("*").alias("n"))
    store.replace(own, new, tiers, "clusters", allow=bool(refused))
    after = store.kept(t.f_cluster_stock, "clusters").groupBy("tier").agg(F.count("*").alias("kept"))
    counted = F.create_map(*(F.lit(x) for kv in refused.items() for x in kv)) if refused else F.create_map().cast("map<string,int>")
    return before.join(after, "tier", "left").select("tier", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce(counted[F.col("tier")].cast("long"), F.lit(0)).alias("refused"))


@query("snk06_replace_by_key", """
WITH n AS (SELECT cluster_id, ticker, 0.5 AS similarity FROM f_cluster_stock WHERE cluster_id % 10 = 0 AND ticker > 'S5')
SELECT cluster_id, ticker, similarity FROM f_cluster_stock WHERE cluster_id NOT IN (SELECT cluster_id FROM n) UNION ALL SELECT * FROM n""")
def snk06(t):
    s = t.f_cluster_stock.select("cluster_id", "ticker", "similarity")
    return K.replace_where(s, s.where("cluster_id % 10 = 0 and ticker > 'S5'").withColumn("similarity", F.lit(0.5)), "cluster_id")


@query("snk09_hourly_title_lists", f"SELECT strftime(event_ts, '%Y-%m-%d') AS day, CAST(strftime(event_ts, '%H') AS INT) AS hour, {CANON} AS title FROM f_edit_events GROUP BY 1, 2, 3")
def snk09(t):
    path = scratch.path(t.spark, "titles")
    K.write_titles_by_hour(t.f_edit_events.select(S.canonical_title(F.col("title")).alias("title"), S.hour_floor(F.col("event_ts")).alias("hour")), path)
    return t.spark.read.text(path).select(F.col("day").cast("string").alias("day"), F.col("hour").cast("int").alias("hour"), F.col("value").alias("title"))


@query("snk11_copy_days_with_remap", "SELECT page_id, snapshot_ts, views FROM f_root_rows WHERE page_id < 50 UNION ALL SELECT page_id + 1000, snapshot_ts, views FROM f_root_rows WHERE page_id BETWEEN 100 AND 150 AND snapshot_ts = TIMESTAMP '1996-01-01'")
def snk11(t):
    r = t.f_root_rows.select("page_id", "snapshot_ts", "views")
    ids = r.where("page_id between 100 and 150").select(F.col("page_id").alias("from_id"), (F.col("page_id") + 1000).alias("to_id")).distinct()
    return K.copy_days(r, r.where("page_id < 50"), ids, ["1996-01-01"])


def edit_stream(t: Tables) -> DataFrame:
    """Events as a stream of files, in the shape of edits."""
    return shaped(t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parq*"))


def shaped(raw: DataFrame) -> DataFrame:
    e = raw.where("event_type <> 'click'")
    return e.select(F.lit("enwiki").alias("wiki"), F.concat(F.lit("Page__"), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("title"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("usr"), (F.col("event_type") == "error").alias("is_bot"), F.floor("value").cast("int").alias("byte_delta"), F.col("event_id").alias("rev_id"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").cast("string").alias("meta_id"))


def streamed(t: Tables, df: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of what a stream in update mode emits, gathered as Parquet by micro-batch. df has only columns that are
    read: its state holds each of them, and the estimate of distinct editors alone takes 13 KB a window."""
    path = scratch.path(t.spark, "stream")

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/b={number}")

    df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    rows = t.spark.read.parquet(f"{path}/out").drop("b")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("x")).select(*keys, "x.*")


WINDOW = ["wiki", "title", "window_start"]


@query("str04_tumbling_windows", "SELECT wiki, title, window_start, edit_count, byte_delta, max_rev_id FROM s_edit")
def str04(t):
    return streamed(t, J.edit_windows(J.dedup_events(J.with_event_time(edit_stream(t))), "1 hour", "1 hour").select(*WINDOW, "edit_count", "byte_delta", "max_rev_id"), WINDOW)


@query("str03_sliding_windows", f"""
WITH x AS (SELECT wiki, {CANON} AS title, time_bucket(INTERVAL 5 MINUTE, event_ts) - k * INTERVAL 5 MINUTE AS window_start FROM f_edit_events CROSS JOIN range(12) r(k) WHERE NOT is_bot)
SELECT wiki, title, window_start, count(*) AS edit_count FROM x GROUP BY 1, 2, 3""")
def str03(t):
    return streamed(t, J.edit_windows(J.dedup_events(J.with_event_time(edit_stream(t)))).select(*WINDOW, "edit_count"), WINDOW)


@query("str02_dedup", "SELECT meta_id FROM f_edit_events")
def str02(t):
    own = edit_stream(t)
    twice = own.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    path = scratch.path(t.spark, "dedup")
    J.dedup_events(J.with_event_time(twice)).select("meta_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


@query("agg01_stream_edit_windows", "SELECT wiki, title, window_start, edit_count, byte_delta, last_edit_ts, max_rev_id FROM s_edit")
def agg01(t):
    return J.edit_windows(J.dedup_events(t.f_edit_events), "1 hour", "1 hour").select(*WINDOW, "edit_count", "byte_delta", "last_edit_ts", "max_rev_id")


@query("str08_judge_batch", "SELECT wiki, title, window_start, status, spike_score FROM s_dec WHERE edit_count >= 1")
def str08(t):
    from .attention import AS_OF, JUDGED, windows

    path = scratch.path(t.spark, "judged")
    A.ewma_baseline(windows(t), AS_OF).write.parquet(f"{path}/baseline")
    t.f_hourly_views.write.parquet(f"{path}/views")
    query = J.start_spike_stream(edit_stream(t).where(F.col("event_ts") >= JUDGED), lambda: t.spark.read.parquet(f"{path}/views"), lambda: t.spark.read.parquet(f"{path}/baseline"), lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/b={n}"), f"{path}/state", trigger=None)
    query.awaitTermination()
    rows = t.spark.read.parquet(f"{path}/out")
    return rows.groupBy(*WINDOW).agg(F.max_by(F.struct("status", "spike_score"), "batch").alias("x")).select(*WINDOW, "x.*")


@query("str11_stream_batch_parity", "SELECT 0 AS differences, count(*) AS windows FROM s_edit")
def str11(t):
    from .attention import A as batch

    exact = batch.edit_windows_exact(t.f_edit_events)
    diff = J.parity(streamed(t, J.edit_windows(J.dedup_events(J.with_event_time(edit_stream(t))), "1 hour", "1 hour"), WINDOW), exact)
    return diff.agg(F.count("*").cast("int").alias("differences")).join(exact.agg(F.count("*").alias("windows")))


@query("str10_live_cycle", """
WITH p AS (SELECT w.wiki, w.title, w.window_start, coalesce(v.views, 0) AS views, b.sample_days, b.view_ewma AS m, b.view_stddev AS d, coalesce(sample_days >= 7 AND view_ewma > 0, false) AS u
FROM s_windows w JOIN f_arrival a ON a.wiki = w.wiki AND a.ts_hour = w.window_start LEFT JOIN f_hourly_views v ON v.wiki = w.wiki AND v.title = w.title AND v.ts_hour = w.window_start
LEFT JOIN s_base b ON b.wiki = w.wiki AND b.title = w.title AND b.hour_of_day = extract(hour FROM w.window_start) WHERE w.edit_count >= 1 AND w.views IS NULL AND w.window_start >= TIMESTAMP '2024-01-20')
SELECT wiki, title, window_start, views, CASE WHEN views >= 100 AND (NOT u OR (views / m >= 2 AND (d IS NULL OR d = 0 OR (views - m) / d >= 3))) THEN 'CONFIRMED' ELSE 'REJECTED' END AS status FROM p""")
def str10(t):
    from .attention import AS_OF, NOW, windows

    w = windows(t)
    pending = w.where((F.col("edit_count") >= 1) & F.col("views").isNull() & (F.col("window_start") >= "2024-01-20"))
    return J.live_cycle(pending, t.f_arrival, t.f_hourly_views, A.ewma_baseline(w, AS_OF), NOW)["decisions"].select("wiki", "title", "window_start", "views", "status")


@query("str10b_live_cycle_twice", """
WITH p AS (SELECT w.wiki, w.title, w.window_start, w.edit_count, a.ts_hour IS NOT NULL AS came, coalesce(v.views, 0) AS views, b.view_ewma AS m, b.view_stddev AS d, coalesce(sample_days >= 7 AND view_ewma > 0, false) AS u
  FROM s_windows w LEFT JOIN f_arrival a ON a.wiki = w.wiki AND a.ts_hour = w.window_start AND w.window_start <= TIMESTAMP '2024-01-30 09:00:00' LEFT JOIN f_hourly_views v ON v.wiki = w.wiki AND v.title = w.title AND v.ts_hour = w.window_start
  LEFT JOIN s_base b ON b.wiki = w.wiki AND b.title = w.title AND b.hour_of_day = extract(hour FROM w.window_start) WHERE w.edit_count >= 1 AND w.window_start >= TIMESTAMP '2024-01-28'),
j AS (SELECT *, CASE WHEN came THEN CASE WHEN views >= 100 AND (NOT u OR (views / m >= 2 AND (d IS NULL OR d = 0 OR (views - m) / d >= 3))) THEN 'CONFIRMED' ELSE 'REJECTED' END
  WHEN window_start < TIMESTAMP '2024-01-29 00:00:00' AND EXISTS (SELECT 1 FROM p q WHERE q.came AND q.wiki = p.wiki AND q.window_start >= p.window_start) THEN 'EXPIRED' ELSE 'PENDING' END AS kind FROM p)
SELECT kind, title, window_start, CASE kind WHEN 'CONFIRMED' THEN views END AS views, edit_count, 0 AS rechecks FROM j WHERE kind IN ('CONFIRMED', 'PENDING')""")
def str10b(t):
    """All windows of the last days wait for views; the cycle fetches their hours, judges, expires; then once more."""
    from .attention import AS_OF, JUDGED, NOW, windows

    live = Live(t.spark, scratch.path(t.spark, "live"))
    w = windows(t)
    live.put_baseline(A.ewma_baseline(w, AS_OF), AS_OF)
    waiting = w.where((F.col("edit_count") >= 1) & (F.col("window_start") >= JUDGED))
    live.add(waiting.withColumns({"status": F.lit("PENDING_VIEWS"), "view_ratio": F.lit(0.0), "view_z": F.lit(0.0), "spike_score": F.lit(0.0)}))
    rows = t.f_hourly_views.select("wiki", "title", "ts_hour", "views", F.lit(False).alias("is_mobile"))
    for _ in range(2):
        live.cycle(NOW, lambda hours: (t.f_arrival, rows), most=1_000)
    spikes = live.spikes().select(F.lit("CONFIRMED").alias("kind"), "title", "window_start", "views", "edit_count", F.lit(0).alias("rechecks"))
    return spikes.unionByName(live.pending().select(F.lit("PENDING").alias("kind"), "title", "window_start", F.lit(None).cast("long").alias("views"), "edit_count", F.col("rechecks").cast("int").alias("rechecks")))


@query("str09b_pending_stream", """
SELECT p.wiki, p.title, p.window_start, CASE WHEN d.status IS NULL THEN 0 ELSE 1 END AS rechecks FROM s_pending p LEFT JOIN s_dec d USING (wiki, title, window_start)
WHERE (d.status IS NULL OR d.status = 'PENDING_VIEWS') AND NOT (window_start < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 36 HOUR AND EXISTS (SELECT 1 FROM f_arrival a WHERE a.wiki = p.wiki AND a.ts_hour >= p.window_start))""")
def str09b(t):
    """Pending windows, then decisions, then the ledger, each a micro-batch of the keyed state."""
    from .attention import NOW, decisions, pending

    path, day = scratch.path(t.spark, "pending"), NOW[:11]
    steps = [
        P.decision_rows(pending(t).withColumn("status", F.lit("PENDING_VIEWS")), day + "11:57:00"), P.decision_rows(decisions(t), day + "11:58:00"),
        P.ledger_rows(t.f_arrival, day + "11:59:00"), P.ledger_rows(t.f_arrival.orderBy("ts_hour").limit(1), NOW),
    ]
    for rows in steps:
        rows.write.mode("append").parquet(f"{path}/in")
        source = t.spark.readStream.schema(P.ROWS).parquet(f"{path}/in")
        P.start_pending_stream(source, f"{path}/out", f"{path}/state", None, buckets=8).awaitTermination()
    return P.pending_table(t.spark, f"{path}/out")


@query("snk07_foreach_batch", "SELECT status, count(*) AS n FROM s_dec WHERE edit_count >= 1 GROUP BY 1")
def snk07(t):
    return str08(t).groupBy("status").agg(F.count("*").alias("n"))


@query("str06_update_mode", "SELECT wiki, title, window_start, edit_count, byte_delta, max_rev_id FROM s_edit")
def str06(t):
    """Several micro-batches of one file each (STR07's limit), out of order within a wide watermark (STR01)."""
    path = scratch.path(t.spark, "files")
    t.events.repartition(3, "event_id").write.parquet(path)
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    own = shaped(raw)
    return streamed(t, J.edit_windows(J.dedup_events(J.with_event_time(own, "60 days")), "1 hour", "1 hour").select(*WINDOW, "edit_count", "byte_delta", "max_rev_id"), WINDOW)
