"""Queries of the attention jobs: windows, views, baselines, decisions, pending state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import attention as A
from ..operators.statistics import exact_quantile
from . import scratch
from .registry import STEPS, Tables, query

AS_OF, JUDGED, NOW = "2024-01-27", "2024-01-28", "2024-01-30 12:00:00"

STEPS["s_edit"] = """
SELECT wiki, trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title, date_trunc('hour', event_ts) AS window_start, count(*) AS edit_count,
  count(DISTINCT nullif(trim(usr), '')) AS editor_count, CAST(sum(byte_delta) AS BIGINT) AS byte_delta, max(event_ts) AS last_edit_ts, max(rev_id) AS max_rev_id
FROM f_edit_events WHERE NOT coalesce(is_bot, false) GROUP BY 1, 2, 3"""
STEPS["s_windows"] = """
SELECT wiki, title, window_start, coalesce(edit_count, 0) AS edit_count, coalesce(editor_count, 0) AS editor_count, coalesce(byte_delta, 0) AS byte_delta, max_rev_id, views
FROM s_edit FULL JOIN (SELECT wiki, title, ts_hour AS window_start, views FROM f_hourly_views) USING (wiki, title, window_start)"""
BASELINE = """
SELECT wiki, title, hour_of_day, max(em) AS edit_ewma, sqrt(sum(w * (edit_count - em) ** 2) / sum(w)) AS edit_stddev, max(vm) AS view_ewma,
  sqrt(sum(CASE WHEN views IS NOT NULL THEN w * (views - vm) ** 2 END) / sum(CASE WHEN views IS NOT NULL THEN w END)) AS view_stddev, count(DISTINCT CAST(window_start AS DATE)) AS sample_days
FROM (SELECT *, sum(w * edit_count) OVER p / sum(w) OVER p AS em, sum(CASE WHEN views IS NOT NULL THEN w * views END) OVER p / sum(CASE WHEN views IS NOT NULL THEN w END) OVER p AS vm
  FROM (SELECT *, extract(hour FROM window_start) AS hour_of_day, 0.5 ** (date_diff('day', CAST(window_start AS DATE), DATE '2024-01-27') / 14.0) AS w FROM {source}
    WHERE CAST(window_start AS DATE) <= DATE '2024-01-27' AND date_diff('day', CAST(window_start AS DATE), DATE '2024-01-27') < 28)
  WINDOW p AS (PARTITION BY wiki, title, hour_of_day)) GROUP BY 1, 2, 3"""
STEPS["s_base"] = BASELINE.format(source="s_windows")
STEPS["s_joined"] = """
SELECT w.*, b.edit_ewma, b.edit_stddev, b.view_ewma, b.view_stddev, b.sample_days, CASE WHEN sample_days IS NULL THEN 'absent' WHEN sample_days < 7 THEN 'thin' ELSE 'db' END AS baseline
FROM (SELECT *, extract(hour FROM window_start) AS hour_of_day FROM s_windows WHERE window_start >= TIMESTAMP '2024-01-28') w LEFT JOIN s_base b USING (wiki, title, hour_of_day)"""
STEPS["s_rule"] = """
SELECT *, CASE WHEN u THEN views / view_ewma END AS view_ratio, CASE WHEN u AND view_stddev > 0 THEN (views - view_ewma) / view_stddev END AS view_z
FROM (SELECT *, coalesce(sample_days >= 7 AND view_ewma > 0, false) AS u FROM s_joined)"""
STEPS["s_dec"] = """
SELECT *, CASE WHEN status = 'CONFIRMED' THEN round(ln(1 + greatest(0, views - CASE WHEN view_ewma > 0 THEN view_ewma ELSE 0 END)), 3) ELSE 0 END AS spike_score
FROM (SELECT *, CASE WHEN edit_count < 1 THEN 'REJECTED' WHEN views IS NULL THEN 'PENDING_VIEWS'
  WHEN views >= 100 AND (NOT u OR (view_ratio >= 2 AND (view_z IS NULL OR view_z >= 3))) THEN 'CONFIRMED' ELSE 'REJECTED' END AS status FROM s_rule)"""
STEPS["s_pending"] = "SELECT wiki, title, window_start FROM s_windows WHERE edit_count >= 1 AND views IS NULL AND window_start >= TIMESTAMP '2024-01-20'"
STEPS["s_daily"] = "SELECT wiki, title, CAST(ts_hour AS DATE) AS day, CAST(sum(views) AS BIGINT) AS views FROM f_hourly_views GROUP BY 1, 2, 3"


def windows(t: Tables):
    return A.join_windows(A.edit_windows_exact(t.f_edit_events), t.f_hourly_views.select("wiki", "title", "ts_hour", "views"))


def decisions(t: Tables):
    w = windows(t)
    return A.decide(w.where(F.col("window_start") >= JUDGED), A.ewma_baseline(w, AS_OF))


def pending(t: Tables):
    return windows(t).where((F.col("edit_count") >= 1) & F.col("views").isNull() & (F.col("window_start") >= "2024-01-20")).select("wiki", "title", "window_start", "views")


def daily_views(t: Tables):
    return t.f_hourly_views.groupBy("wiki", "title", F.to_date("ts_hour").alias("day")).agg(F.sum("views").alias("views"))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("flagship_confirmed_spikes", f"SELECT title, window_start, edit_count, views, spike_score, {q6('view_ratio', 'view_z')} FROM s_dec WHERE status = 'CONFIRMED'")
def flagship(t):
    return decisions(t).where("status = 'CONFIRMED'").select("title", "window_start", "edit_count", "views", "spike_score", *r6("view_ratio", "view_z"))


@query("prj05_humans_only", "SELECT meta_id, title, usr FROM f_edit_events WHERE NOT coalesce(is_bot, false)")
def prj05(t):
    return A.humans(t.f_edit_events).select("meta_id", "title", "usr")


@query("agg02_batch_edit_windows", "SELECT * FROM s_edit")
def agg02(t):
    return A.edit_windows_exact(t.f_edit_events)


@query("agg03_sum_views", "SELECT wiki, title, ts_hour, CAST(sum(views) AS BIGINT) AS views FROM f_hourly_views GROUP BY 1, 2, 3")
def agg03(t):
    v = t.f_hourly_views
    both = v.select("wiki", "title", "ts_hour", (F.col("views") - F.col("mobile_views")).alias("views"), F.lit("desktop").alias("agent"))
    return A.sum_views(both.unionByName(v.select("wiki", "title", "ts_hour", F.col("mobile_views").alias("views"), F.lit("mobile").alias("agent"))), ["desktop", "mobile"])


@query("agg04_daily_to_hourly_views", "SELECT 'enwiki' AS wiki, 'Page ' || (CAST(json_extract_string(props, '$.k') AS INT) % 20) AS title, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts_hour, CAST(sum(floor(value)) AS BIGINT) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2, 3")
def agg04(t):
    day = F.to_date(F.col("ts").cast("timestamp"))
    hours = F.concat(F.chr(F.hour(F.col("ts").cast("timestamp")).cast("long") + 65), F.floor("value").cast("string"))
    rows = t.events.where("event_type = 'view'").select(F.lit("enwiki").alias("wiki"), F.concat(F.lit("Page__"), (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")).alias("title"), day.alias("date"), hours.alias("hours"))
    packed = rows.groupBy("wiki", "title", "date").agg(F.array_join(F.collect_list("hours"), "").alias("hours"))
    return A.hourly_from_daily(packed, F.col("date"))


@query("agg05_hourly_views", "SELECT v.* FROM f_hourly_views v WHERE views >= 150 OR title IN ('Page 3', 'Page 7')")
def agg05(t):
    v = t.f_hourly_views
    rows = v.select("wiki", "title", "ts_hour", "mobile_views", F.explode(F.array(F.struct((F.col("views") - F.col("mobile_views")).alias("views"), F.lit(False).alias("is_mobile")), F.struct(F.col("mobile_views").alias("views"), F.lit(True).alias("is_mobile")))).alias("x"))
    names = t.spark.createDataFrame([("enwiki", "Page 3"), ("enwiki", "Page 7")], "wiki string, title string")
    return A.hourly_views(rows.select("wiki", "title", "ts_hour", "x.*"), 150, names)


@query("jon01_windows_full_outer", "SELECT * FROM s_windows")
def jon01(t):
    return windows(t)


MEANS = ("edit_ewma", "edit_stddev", "view_ewma", "view_stddev")


@query("agg06_ewma_baseline", f"SELECT wiki, title, CAST(hour_of_day AS INT) AS hour_of_day, sample_days, {q6(*MEANS)} FROM s_base")
def agg06(t):
    return A.ewma_baseline(windows(t), AS_OF).select("wiki", "title", "hour_of_day", "sample_days", *r6(*MEANS))


@query("agg07_views_only_baseline", "WITH b AS (" + BASELINE.format(source="(SELECT wiki, title, ts_hour AS window_start, 0 AS edit_count, views FROM f_hourly_views)") + f") SELECT wiki, title, CAST(hour_of_day AS INT) AS hour_of_day, sample_days, sample_days < 7 AS thin, {q6('view_ewma', 'view_stddev')} FROM b")
def agg07(t):
    b = A.baseline_from_views(t.f_hourly_views, AS_OF)
    return b.select("wiki", "title", "hour_of_day", "sample_days", (F.col("sample_days") < S.MIN_DAYS).alias("thin"), *r6("view_ewma", "view_stddev"))


@query("agg08_halflife_compare", """
SELECT half_life, count(*) AS slots, round(avg(e), 6) AS mean_ewma, round(avg(abs(e - p)), 6) AS mean_difference FROM (
  SELECT h AS half_life, wiki, title, extract(hour FROM window_start), sum(0.5 ** (a / h) * edit_count) / sum(0.5 ** (a / h)) AS e, avg(edit_count) AS p
  FROM (SELECT *, date_diff('day', CAST(window_start AS DATE), DATE '2024-01-27') AS a FROM s_windows) CROSS JOIN (VALUES (7.0::DOUBLE), (14.0), (28.0)) v(h) WHERE a >= 0 AND a < 28 GROUP BY 1, 2, 3, 4) GROUP BY 1""")
def agg08(t):
    return A.compare_halflives(windows(t), AS_OF, [7, 14, 28]).select("half_life", "slots", *r6("mean_ewma", "mean_difference"))


@query("prj09_prefilter", "SELECT wiki, title, window_start, edit_count, views FROM s_windows WHERE edit_count >= 1 AND (views IS NULL OR views >= 100)")
def prj09(t):
    return A.may_spike(windows(t)).select("wiki", "title", "window_start", "edit_count", "views")


@query("jon05_baseline_lookup", f"SELECT wiki, title, window_start, baseline, sample_days, {q6('view_ewma')} FROM s_joined")
def jon05(t):
    w = windows(t)
    out = A.with_baseline(w.where(F.col("window_start") >= JUDGED), A.ewma_baseline(w, AS_OF))
    return out.select("wiki", "title", "window_start", "baseline", "sample_days", *r6("view_ewma"))


@query("fun13_detect", f"SELECT wiki, title, window_start, status, baseline, sample_days IS NULL AS is_new_page, spike_score, {q6('view_ratio', 'view_z')} FROM s_dec")
def fun13(t):
    return decisions(t).select("wiki", "title", "window_start", "status", "baseline", "is_new_page", "spike_score", *r6("view_ratio", "view_z"))


@query("agg09_run_summary", """
SELECT count(*) AS evaluated, count_if(status = 'CONFIRMED') AS confirmed, count_if(status = 'PENDING_VIEWS') AS pending, count_if(status = 'REJECTED') AS rejected,
  count_if(baseline = 'db') AS baseline_db, count_if(baseline = 'thin') AS baseline_thin, count_if(baseline = 'absent') AS baseline_absent FROM s_dec""")
def agg09(t):
    return A.decision_summary(decisions(t))


@query("snk10_arrival_ledger", "SELECT a.wiki, a.ts_hour, count(v.title) AS rows FROM f_arrival a LEFT JOIN f_hourly_views v USING (wiki, ts_hour) GROUP BY 1, 2")
def snk10(t):
    return A.arrived(t.f_hourly_views, t.f_arrival)


@query("jon02_due_candidates", """
SELECT p.wiki, p.title, p.window_start, coalesce(v.views, 0) AS views FROM s_pending p JOIN f_arrival a ON a.wiki = p.wiki AND a.ts_hour = p.window_start
LEFT JOIN f_hourly_views v ON v.wiki = p.wiki AND v.title = p.title AND v.ts_hour = p.window_start ORDER BY p.window_start, p.wiki, p.title LIMIT 500""")
def jon02(t):
    return A.due_candidates(pending(t), t.f_arrival, t.f_hourly_views, 500).select("wiki", "title", "window_start", "views")


@query("jon03_missing_views", """
SELECT wiki, window_start, list_sort(list(DISTINCT title)) AS titles FROM s_pending p WHERE window_start <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 3 HOUR
AND NOT EXISTS (SELECT 1 FROM f_hourly_views v WHERE v.wiki = p.wiki AND v.title = p.title AND v.ts_hour = p.window_start) GROUP BY 1, 2 ORDER BY window_start, wiki LIMIT 100""")
def jon03(t):
    return A.missing_hours(pending(t), t.f_hourly_views, NOW, 100)


@query("jon04_expire", """
SELECT p.* FROM s_pending p WHERE window_start < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 36 HOUR AND EXISTS (SELECT 1 FROM f_arrival a WHERE a.wiki = p.wiki AND a.ts_hour >= p.window_start)""")
def jon04(t):
    return A.expired(pending(t), t.f_arrival, NOW).select("wiki", "title", "window_start")


@query("str09_pending_state", """
WITH d AS (SELECT wiki, title, window_start, status FROM s_dec) SELECT p.wiki, p.title, p.window_start, CASE WHEN d.status IS NULL THEN 0 ELSE 1 END AS rechecks FROM s_pending p LEFT JOIN d USING (wiki, title, window_start)
WHERE d.status IS NULL OR d.status = 'PENDING_VIEWS'""")
def str09(t):
    return A.pending_update(pending(t).drop("views").withColumn("rechecks", F.lit(0)), decisions(t))


@query("jon01b_missing_is_not_zero", "SELECT count(*) AS n, count(views) AS known, count_if(views = 0) AS zero, count_if(edit_count = 0) AS no_edits FROM s_windows")
def jon01b(t):
    return windows(t).agg(F.count("*").alias("n"), F.count("views").alias("known"), F.count_if(F.col("views") == 0).alias("zero"), F.count_if(F.col("edit_count") == 0).alias("no_edits"))


STEPS["s_roll"] = """
SELECT d.wiki, d.title, d.day, CAST(d.views AS DOUBLE) AS v, m.mean, m.seen, sqrt((SELECT sum(0.5 ** ((date_diff('day', p.day, d.day) - 1) / 14.0) * (p.views - m.mean) ** 2) / sum(0.5 ** ((date_diff('day', p.day, d.day) - 1) / 14.0))
  FROM s_daily p WHERE p.title = d.title AND p.wiki = d.wiki AND date_diff('day', p.day, d.day) BETWEEN 1 AND 28)) AS deviation
FROM s_daily d LEFT JOIN (SELECT d.wiki, d.title, d.day, count(*) AS seen, sum(0.5 ** ((date_diff('day', p.day, d.day) - 1) / 14.0) * p.views) / sum(0.5 ** ((date_diff('day', p.day, d.day) - 1) / 14.0)) AS mean
  FROM s_daily d JOIN s_daily p ON p.title = d.title AND p.wiki = d.wiki AND date_diff('day', p.day, d.day) BETWEEN 1 AND 28 GROUP BY 1, 2, 3) m USING (wiki, title, day)"""


@query("win05_prior_baseline", f"SELECT wiki, title, day, v, coalesce(seen, 0) AS seen, {q6('mean', 'deviation')} FROM s_roll")
def win05(t):
    return A.rolling_baseline(daily_views(t), "views").select("wiki", "title", "day", "v", "seen", *r6("mean", "deviation"))


SIGNAL = "seen >= 2 AND mean > 0 AND v / mean >= 1.5"


@query("win06_first_view_signal", "SELECT wiki, title, min(day) AS first_day FROM s_roll WHERE seen >= 2 AND mean > 0 AND v >= 50 AND v / mean >= 2 AND deviation > 0 AND (v - mean) / deviation >= 3 AND day >= DATE '2024-01-05' GROUP BY 1, 2")
def win06(t):
    return A.first_view_signal(daily_views(t), "2024-01-05", 50)


@query("agg29_signal_false_alarms", """
SELECT CAST(f AS DOUBLE) AS floor, count(s.day) AS days, count(DISTINCT s.title) AS pages FROM (VALUES (50), (100), (200)) v(f) LEFT JOIN
(SELECT * FROM s_roll WHERE seen >= 2 AND mean > 0 AND v / mean >= 2 AND deviation > 0 AND (v - mean) / deviation >= 3) s ON s.v >= f GROUP BY 1""")
def agg29(t):
    return A.by_floor(A.view_signals(daily_views(t), 50), [50.0, 100.0, 200.0]).withColumnRenamed("rows", "days")


@query("win07_first_detection", "SELECT wiki, title, min(CASE WHEN status = 'CONFIRMED' THEN window_start END) AS first_confirmed, min(CASE WHEN status <> 'REJECTED' THEN window_start END) AS first_candidate FROM s_dec GROUP BY 1, 2")
def win07(t):
    return A.first_detection(decisions(t))


@query("win07b_signal_lag", """
WITH c AS (SELECT wiki, title, min(CASE WHEN status = 'CONFIRMED' THEN window_start END) AS fc FROM s_dec GROUP BY 1, 2),
v AS (SELECT wiki, title, min(day) AS fd FROM s_roll WHERE seen >= 2 AND mean > 0 AND v >= 20 AND v / mean >= 2 AND deviation > 0 AND (v - mean) / deviation >= 3 GROUP BY 1, 2)
SELECT c.wiki, c.title, date_diff('day', fd, CAST(fc AS DATE)) AS lag_days FROM c LEFT JOIN v USING (wiki, title)""")
def win07b(t):
    first, signal = A.first_detection(decisions(t)), A.first_view_signal(daily_views(t), "2000-01-01", 20)
    return first.join(signal, ["wiki", "title"], "left").select("wiki", "title", F.datediff(F.to_date("first_confirmed"), "first_day").cast("long").alias("lag_days"))


@query("agg30_recall_and_alarms", """
WITH h AS (SELECT title, count(*) AS w FROM s_dec WHERE status = 'CONFIRMED' GROUP BY 1), p AS (SELECT DISTINCT title, CAST(substr(title, 6) AS INT) < 10 AS tgt FROM s_windows)
SELECT count_if(tgt) AS targets, count_if(tgt AND w IS NOT NULL) AS found, CAST(coalesce(sum(CASE WHEN NOT tgt THEN w END), 0) AS BIGINT) AS control_windows, count_if(NOT tgt AND w IS NOT NULL) AS control_pages FROM p LEFT JOIN h USING (title)""")
def agg30(t):
    pages = windows(t).select("wiki", "title").distinct()
    n = F.substr("title", F.lit(6)).cast("int")
    return A.recall(decisions(t), pages.where(n < 10), pages.where(n >= 10))


@query("agg15_daily_edits", "SELECT trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title, CAST(event_ts AS DATE) AS day, count(*) AS n FROM f_edit_events GROUP BY 1, 2")
def agg15(t):
    return t.f_edit_events.groupBy(S.canonical_title(F.col("title")).alias("title"), F.to_date("event_ts").alias("day")).agg(F.count("*").alias("n"))


@query("agg16_coverage_span", "WITH d AS (SELECT DISTINCT CAST(event_ts AS DATE) AS day FROM f_edit_events), g AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM d) SELECT min(day) AS first_day, max(day) AS last_day, count_if(date_diff('day', day, nxt) > 1) AS holes FROM g")
def agg16(t):
    days = t.f_edit_events.select(F.to_date("event_ts").alias("day")).distinct()
    # Every run of days but the last is followed by a hole.
    ends = days.join(days.select(F.date_sub("day", 1).alias("day"), F.lit(True).alias("goes_on")), "day", "left")
    n = F.count_if(F.col("goes_on").isNull())
    return ends.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.greatest(n - 1, F.lit(0)).alias("holes"))


@query("agg17_candidate_titles", "SELECT date_trunc('hour', event_ts) AS hour, trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title, count(*) AS edits FROM f_edit_events WHERE NOT is_bot AND CAST(event_ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1, 2")
def agg17(t):
    own = A.humans(t.f_edit_events).where(F.to_date("event_ts").between("2024-01-10", "2024-01-20"))
    return own.groupBy(S.hour_floor(F.col("event_ts")).alias("hour"), S.canonical_title(F.col("title")).alias("title")).agg(F.count("*").alias("edits"))


@query("prj08_date_range", "SELECT meta_id FROM f_edit_events WHERE CAST(event_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def prj08(t):
    return t.f_edit_events.where(F.to_date("event_ts").between("2024-01-05", "2024-01-06")).select("meta_id")


@query("set02_union_titles", "SELECT title FROM f_hourly_views WHERE views >= 300 UNION SELECT trim(regexp_replace(title, '[ _]+', ' ', 'g')) FROM f_edit_events WHERE NOT is_bot")
def set02(t):
    return t.f_hourly_views.where("views >= 300").select("title").unionByName(A.humans(t.f_edit_events).select(S.canonical_title(F.col("title")).alias("title"))).distinct()


@query("agg27_volume_bands", "SELECT CAST(f AS BIGINT) AS floor, count(v.title) AS rows, count(DISTINCT v.title) AS pages FROM (VALUES (1), (10), (50), (100), (500), (1000)) x(f) LEFT JOIN f_hourly_views v ON v.views >= f GROUP BY 1")
def agg27(t):
    own = A.by_floor(t.f_hourly_views, [1, 10, 50, 100, 500, 1000])
    return own.withColumn("floor", F.col("floor").cast("long"))


@query("agg27b_top_pages", "SELECT title, CAST(sum(views) AS BIGINT) AS views, round(sum(mobile_views) / sum(views), 6) AS mobile FROM f_hourly_views GROUP BY 1 ORDER BY views DESC, title LIMIT 25")
def agg27b(t):
    own = t.f_hourly_views.groupBy("title").agg(F.sum("views").alias("views"), F.sum("mobile_views").alias("m"))
    return own.select("title", "views", F.round(S.mobile_ratio(F.col("m"), F.col("views")), 6).alias("mobile")).orderBy(F.desc("views"), "title").limit(25)


@query("fun07_mobile_ratio", "SELECT title, ts_hour, round(CASE WHEN views > 0 THEN mobile_views / views END, 6) AS ratio FROM f_hourly_views")
def fun07(t):
    return t.f_hourly_views.select("title", "ts_hour", F.round(S.mobile_ratio(F.col("mobile_views"), F.col("views")), 6).alias("ratio"))


@query("agg25_gate_crosstab", "SELECT count_if(e AND m) AS both_gates, count_if(e AND NOT m) AS edits_only, count_if(NOT e AND m) AS mobile_only, count_if(NOT e AND NOT m) AS neither FROM (SELECT coalesce(w.edit_count, 0) >= 1 AS e, v.views > 0 AND v.mobile_views / v.views >= 0.25 AS m FROM f_hourly_views v LEFT JOIN s_edit w ON w.title = v.title AND w.wiki = v.wiki AND w.window_start = v.ts_hour)")
def agg25(t):
    w = A.edit_windows_exact(t.f_edit_events).select("wiki", "title", F.col("window_start").alias("ts_hour"), "edit_count")
    own = t.f_hourly_views.join(w, ["wiki", "title", "ts_hour"], "left")
    e, m = F.coalesce(F.col("edit_count"), F.lit(0)) >= 1, F.coalesce(S.mobile_ratio(F.col("mobile_views"), F.col("views")) >= 0.25, F.lit(False))
    return own.agg(F.count_if(e & m).alias("both_gates"), F.count_if(e & ~m).alias("edits_only"), F.count_if(~e & m).alias("mobile_only"), F.count_if(~e & ~m).alias("neither"))


@query("agg26_co_spike_days", """
WITH p AS (SELECT d.title, d.day, d.views, median(q.views) AS med, count(*) AS seen FROM s_daily d JOIN s_daily q ON q.title = d.title AND q.wiki = d.wiki AND q.views > 0 AND date_diff('day', q.day, d.day) BETWEEN 1 AND 28 GROUP BY 1, 2, 3)
SELECT day, count(*) AS titles FROM p WHERE seen >= 14 AND med >= 20 AND views / med >= 2 GROUP BY 1""")
def agg26(t):
    return A.co_spikes(daily_views(t), floor=20)


@query("agg23_slot_coverage", """
WITH e AS (SELECT trim(regexp_replace(title, '[ _]+', ' ', 'g')) AS title, event_ts FROM f_edit_events WHERE NOT is_bot),
s AS (SELECT w AS width, title, extract(hour FROM event_ts) // w AS slot, count(DISTINCT CAST(event_ts AS DATE)) AS days FROM e CROSS JOIN (VALUES (1), (3), (6), (24)) v(w) GROUP BY 1, 2, 3)
SELECT CAST(width AS INT) AS width, count(*) AS slots, count_if(days >= 7) AS covered, count(DISTINCT CASE WHEN days >= 7 THEN title END) AS pages FROM s GROUP BY 1""")
def agg23(t):
    e = A.humans(t.f_edit_events).withColumn("width", F.explode(F.array(*[F.lit(w) for w in (1, 3, 6, 24)])))
    own = e.groupBy("width", S.canonical_title(F.col("title")).alias("title"), F.floor(F.hour("event_ts") / F.col("width")).alias("slot")).agg(F.count_distinct(F.to_date("event_ts")).alias("days"))
    return own.groupBy("width").agg(F.count("*").alias("slots"), F.count_if(F.col("days") >= 7).alias("covered"), F.count_distinct(F.when(F.col("days") >= 7, F.col("title"))).alias("pages"))


@query("agg24_slot_width_cost", """
WITH own AS (SELECT *, extract(hour FROM window_start) AS h, CAST(window_start AS DATE) <= DATE '2024-01-27' AS past FROM s_windows),
b1 AS (SELECT title, h, avg(edit_count) AS m, stddev_pop(edit_count) AS s FROM own WHERE past GROUP BY 1, 2), b6 AS (SELECT title, h // 6 AS h, avg(edit_count) AS m, stddev_pop(edit_count) AS s FROM own WHERE past GROUP BY 1, 2),
j AS (SELECT (o.edit_count - b1.m) / nullif(b1.s, 0) AS z1, (o.edit_count - b6.m) / nullif(b6.s, 0) AS z6 FROM own o JOIN b1 ON b1.title = o.title AND b1.h = o.h JOIN b6 ON b6.title = o.title AND b6.h = o.h // 6 WHERE NOT past)
SELECT count(*) AS windows, count_if((z1 >= 1) = (z6 >= 1)) AS agree, round(median(z6 - z1), 6) AS median_difference, round(avg(z6 - z1), 6) AS mean_difference, round(min(z6 - z1), 6) AS least, round(max(z6 - z1), 6) AS most FROM j WHERE z1 IS NOT NULL AND z6 IS NOT NULL""")
def agg24(t):
    own = windows(t).withColumn("h", F.hour("window_start")).withColumn("h6", F.floor(F.col("h") / 6)).withColumn("past", F.to_date("window_start") <= AS_OF)
    base = lambda k, n: own.where("past").groupBy("title", k).agg(F.avg("edit_count").alias(f"m{n}"), F.stddev_pop("edit_count").alias(f"s{n}"))
    j = own.where("not past").join(base("h", 1), ["title", "h"]).join(base("h6", 6), ["title", "h6"])
    z1, z6 = S.z_score(F.col("edit_count"), F.col("m1"), F.col("s1")), S.z_score(F.col("edit_count"), F.col("m6"), F.col("s6"))
    path = scratch.path(t.spark, "differences")
    j.select(z1.alias("z1"), z6.alias("z6")).where("z1 is not null and z6 is not null").withColumn("x", F.col("z6") - F.col("z1")).write.parquet(path)
    j = t.spark.read.parquet(path)
    median = F.lit(exact_quantile(j, "x")).cast("double")
    return j.agg(F.count("*").alias("windows"), F.count_if((F.col("z1") >= 1) == (F.col("z6") >= 1)).alias("agree"), F.round(F.max(median), 6).alias("median_difference"), F.round(F.avg("x"), 6).alias("mean_difference"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"))


@query("dqc04_window_evidence", "SELECT title, window_start, last_edit_ts < window_start + INTERVAL 30 MINUTE AS early FROM s_edit WHERE NOT (last_edit_ts < window_start + INTERVAL 30 MINUTE)")
def dqc04(t):
    w = A.edit_windows_exact(t.f_edit_events)
    early = F.col("last_edit_ts") < F.col("window_start") + F.expr("interval 30 minutes")
    return w.select("title", "window_start", early.alias("early")).where("not early")


@query("jon21_seed_means_back", "SELECT title, window_start, round(edit_count - avg(edit_count) OVER (PARTITION BY wiki, title, extract(hour FROM window_start)), 6) AS above FROM s_windows")
def jon21(t):
    w = windows(t).withColumn("hour_of_day", S.hour_of_day(F.col("window_start")))
    mean = w.groupBy("wiki", "title", "hour_of_day").agg(F.avg("edit_count").alias("mean"))
    return w.join(mean, ["wiki", "title", "hour_of_day"]).select("title", "window_start", F.round(F.col("edit_count") - F.col("mean"), 6).alias("above"))
