"""Queries of the scalar functions over titles, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import quality as D
from ..operators import serving as V
from .registry import query

CANON = "trim(regexp_replace(title, '[ _]+', ' ', 'g'))"


@query("fun01_canonical_title", f"SELECT DISTINCT title, {CANON} AS canonical FROM f_edit_events")
def fun01(t):
    return t.f_edit_events.select("title", S.canonical_title(F.col("title")).alias("canonical")).distinct()


@query("fun02_link_key", "SELECT DISTINCT lower(title) AS title, upper(substr(lower(trim(regexp_replace(title, '[\\s_]+', ' ', 'g'))), 1, 1)) || substr(lower(trim(regexp_replace(title, '[\\s_]+', ' ', 'g'))), 2) AS key FROM f_edit_events")
def fun02(t):
    low = F.lower("title")
    return t.f_edit_events.select(low.alias("title"), S.link_key(low).alias("key")).distinct()


@query("fun03_wikitext_links", "SELECT l_orderkey * 10 + l_linenumber AS id, list_sort(['Page ' || l_partkey, 'Page ' || l_suppkey || 's']) AS links FROM lineitem")
def fun03(t):
    n, m = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    body = F.concat(F.lit("see [[page_"), n, F.lit("#top|x]] and [[File:a.png]] [[de:Seite]] [[#here]] [[:Category:x]] [["), F.lit("page  "), n, F.lit("]] [["), F.lit("Page "), m, F.lit("s]]"))
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), S.wikitext_links(body).alias("links"))


@query("fun04_hour_floor", "SELECT meta_id, date_trunc('hour', event_ts) AS hour, CAST(extract(hour FROM event_ts) AS INT) AS hour_of_day FROM f_edit_events")
def fun04(t):
    return t.f_edit_events.select("meta_id", S.hour_floor(F.col("event_ts")).alias("hour"), S.hour_of_day(F.col("event_ts")).alias("hour_of_day"))


@query("fun05_file_hour", "SELECT DISTINCT ts_hour AS starts FROM f_hourly_views")
def fun05(t):
    name = F.date_format(F.col("ts_hour") + F.expr("interval 1 hour"), "'pageviews-'yyyyMMdd-HHmmss'.gz'")
    return t.f_hourly_views.select(S.file_hour(name).alias("starts")).distinct()


@query("fun06_safe_row_floor", "SELECT title, ts_hour FROM f_hourly_views WHERE greatest(mobile_views, views - mobile_views) >= 50")
def fun06(t):
    return t.f_hourly_views.where(F.greatest("mobile_views", F.col("views") - F.col("mobile_views")) >= S.safe_row_floor(100, 2)).select("title", "ts_hour")


@query("fun08_domain_of_wiki", "SELECT DISTINCT n_name AS wiki, CASE WHEN regexp_full_match(lower(n_name) || 'wiki', '[a-z][a-z0-9_-]*wiki') THEN replace(lower(n_name), '_', '-') || '.wikipedia.org' END AS domain FROM nation")
def fun08(t):
    return t.nation.select(F.col("n_name").alias("wiki"), S.domain_of_wiki(F.concat(F.lower("n_name"), F.lit("wiki"))).alias("domain")).distinct()


@query("fun09b_synthesised_ids", f"SELECT meta_id, 'dump:enwiki:' || rev_id AS dump_id, 'live:enwiki:' || {CANON} AS issue_key FROM f_edit_events")
def fun09b(t):
    return t.f_edit_events.select("meta_id", S.meta_id(F.col("wiki"), F.col("rev_id")).alias("dump_id"), S.issue_key(F.lit("live"), F.col("wiki"), S.canonical_title(F.col("title"))).alias("issue_key"))


@query("fun10_decode_hourly", "SELECT event_id, [{'h': CAST(extract(hour FROM ts) AS INT), 'v': CAST(floor(value) AS BIGINT)}] AS hours FROM events WHERE value >= 0")
def fun10(t):
    packed = F.concat(F.chr(F.hour(F.col("ts").cast("timestamp")).cast("long") + 65), F.floor("value").cast("string"))
    return t.events.where("value >= 0").select("event_id", S.decode_hourly(packed).alias("hours"))


@query("fun11_decay_weight", "SELECT DISTINCT date_diff('day', CAST(event_ts AS DATE), DATE '2024-01-31') AS age, round(0.5 ** (date_diff('day', CAST(event_ts AS DATE), DATE '2024-01-31') / 14.0), 9) AS w FROM f_edit_events")
def fun11(t):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("event_ts"))
    return t.f_edit_events.select(age.cast("long").alias("age"), F.round(S.decay_weight(age, 14), 9).alias("w")).distinct()


@query("fun12_z_score", "WITH m AS (SELECT title, avg(views) AS m, stddev_pop(views) AS s FROM f_hourly_views GROUP BY 1) SELECT v.title, v.ts_hour, round(CASE WHEN s > 0 THEN (views - m) / s END, 6) AS z FROM f_hourly_views v JOIN m USING (title)")
def fun12(t):
    m = t.f_hourly_views.groupBy("title").agg(F.avg("views").alias("m"), F.stddev_pop("views").alias("s"))
    return t.f_hourly_views.join(m, "title").select("title", "ts_hour", F.round(S.z_score(F.col("views"), F.col("m"), F.col("s")), 6).alias("z"))


@query("fun14_spike_score", "SELECT title, ts_hour, round(ln(1 + greatest(0, views - mobile_views)), 3) AS score FROM f_hourly_views")
def fun14(t):
    return t.f_hourly_views.select("title", "ts_hour", S.spike_score(F.col("views"), F.col("mobile_views")).alias("score"))


@query("fun15_article_fields", "SELECT doc_id, org AS first_org, theme AS first_theme, location AS first_location FROM f_article_rows")
def fun15(t):
    a = t.f_article_rows
    row = F.array(*[F.lit("")] * 4, F.col("doc_id").cast("string"), F.lit(""), F.lit(""), F.concat("theme", F.lit(";")), F.lit(""), F.concat(F.lit("1#"), F.upper("location"), F.lit("#US##;")), *[F.lit("")] * 3, F.upper("org"), F.concat("org", F.lit(",17;")), *[F.lit("")] * 12)
    r = a.select(S.article_record(row).alias("r"))
    return r.select(F.col("r.doc_id").cast("long").alias("doc_id"), F.get("r.orgs", F.lit(0)).alias("first_org"), F.get("r.themes", F.lit(0)).alias("first_theme"), F.get("r.locations", F.lit(0)).alias("first_location"))


@query("fun16_org_name_key", "SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^\\w\\s]', ' ', 'g')) AS key FROM supplier")
def fun16(t):
    name = F.concat(F.lit("The "), F.col("s_name"), F.lit(" Holdings Co., Inc."))
    return t.supplier.select(F.col("s_suppkey").alias("id"), S.org_key(name).alias("key"))


@query("fun17_title_terms", "SELECT p_partkey AS id, list_filter(string_split_regex(lower(p_name), '[^0-9a-z]+'), lambda w: len(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+')) AS terms FROM part")
def fun17(t):
    return t.part.select(F.col("p_partkey").alias("id"), S.title_terms(F.concat(F.lit("History of "), F.col("p_name"), F.lit(" (2024 event)"))).alias("terms"))


@query("fun19_completeness", "SELECT title, window_start, CASE WHEN views IS NULL THEN 'pending' ELSE 'complete' END AS completeness FROM s_windows")
def fun19(t):
    from .attention import windows

    return windows(t).select("title", "window_start", S.completeness(F.col("views")).alias("completeness"))


@query("fun20_sentence_budget", "SELECT doc_id, rtrim(array_to_string(string_split(text, '. ')[1:CASE WHEN doc_id % 5 <= 1 THEN 6 WHEN doc_id % 5 <= 3 THEN 4 ELSE 2 END], '. '), '.') AS lead FROM documents")
def fun20(t):
    return t.documents.select("doc_id", S.first_sentences(F.col("text"), S.sentence_budget(F.col("doc_id") % 5)).alias("lead"))


@query("fun21_representative_text", "SELECT doc_id % 200 AS cluster, left(string_agg('d' || doc_id || ': ' || rtrim(array_to_string(string_split(text, '. ')[1:2], '. '), '.'), chr(10) ORDER BY n_chars DESC NULLS LAST, doc_id), 2000) AS body FROM documents GROUP BY 1")
def fun21(t):
    line = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(": "), S.first_sentences(F.col("text"), 2))
    rows = t.documents.select((F.col("doc_id") % 200).alias("cluster"), "n_chars", "doc_id", line.alias("line"))
    return V.representative_text(rows, ["cluster"], [F.desc_nulls_last("n_chars"), F.col("doc_id")], 2000)


@query("fun22_fit_lead", """
WITH p AS (SELECT doc_id, string_split(text, '. ') AS s FROM documents), n AS (SELECT *, len(s) AS n FROM p),
m AS (SELECT *, list_max(list_filter(range(n), lambda m: len(s[1]) + coalesce(list_sum(list_transform(s[n - m + 1:n], lambda x: len(x) + 2)), 0) <= 400 OR m = 0)) AS m FROM n)
SELECT doc_id, left(array_to_string(list_concat([s[1]], CASE WHEN m > 0 THEN s[n - m + 1:n] ELSE [] END), '. '), 400) AS lead FROM m""")
def fun22(t):
    return t.documents.select("doc_id", S.fit_lead(F.col("text"), 400).alias("lead"))


#: Tags go one kind after the other here, since the pattern language of the SQL has no back references.
GONE = "html"
for tag in ("table", "style", "figure", "sup"):
    GONE = f"regexp_replace({GONE}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
LEAD = f"array_to_string(list_transform(regexp_extract_all({GONE}, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda p: regexp_replace(p, '(?s)<[^>]+>', '', 'g')), ' ')"
for entity, sign in S.ENTITIES:
    LEAD = f"replace({LEAD}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"


@query("fun23_lead_from_html", f"SELECT page_id, trim(regexp_replace({LEAD}, '\\s+', ' ', 'g')) AS lead FROM pages")
def fun23(t):
    return t.pages.select("page_id", S.lead_from_html(F.col("html")).alias("lead"))


@query("fun26_slot_floor", "SELECT meta_id, time_bucket(INTERVAL 15 MINUTE, event_ts) AS slot FROM f_edit_events")
def fun26(t):
    return t.f_edit_events.select("meta_id", S.slot_floor(F.col("event_ts")).alias("slot"))


@query("fun29_cosine", """
SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda k: CAST(a.embedding[k] AS DOUBLE) * b.embedding[k]))
  / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10""")
def fun29(t):
    e = t.embeddings.withColumn("first", F.col("vec_id") - F.col("vec_id") % 10)
    first = t.embeddings.select(F.col("vec_id").alias("first"), F.col("embedding").alias("q"))
    return e.join(first, "first").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("fun30_second_precision", "SELECT meta_id, date_trunc('second', event_ts) AS at FROM f_edit_events")
def fun30(t):
    return t.f_edit_events.select("meta_id", S.to_second(F.col("event_ts")).alias("at"))


@query("fun31_sector_from_info", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS sector FROM customer")
def fun31(t):
    return t.customer.select(F.col("c_custkey").alias("id"), S.clean_sector(F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))).alias("sector"))


@query("prj06_content_namespace", "SELECT p_partkey AS id FROM part WHERE p_partkey % 5 IN (1, 3, 4) AND p_partkey % 50 <> 1")
def prj06(t):
    k = F.col("p_partkey") % 5
    raw = F.concat(F.when(k == 0, F.lit("Talk:")).when(k == 1, F.lit("")).when(k == 2, F.lit("User_talk:")).when(k == 3, F.lit("Bang:_")).otherwise(F.lit("talk_")), F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.where(S.is_content_title(F.when(F.col("p_partkey") % 50 == 1, F.lit("-")).otherwise(raw))).select(F.col("p_partkey").alias("id"))


@query("dqc06_verdict_schema", """
SELECT * FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'not_json' WHEN c_custkey % 11 = 0 THEN 'keys' WHEN c_acctbal > 0 AND c_custkey % 3 <> 0 THEN 'no_rationale' WHEN NOT c_acctbal > 0 AND c_custkey % 3 = 0 THEN 'rationale' END AS error FROM customer)
WHERE error IS NOT NULL""")
def dqc06(t):
    k = F.col("c_custkey")
    why = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.lit(" "))
    parts = [(F.col("c_acctbal") > 0).alias("verdict"), F.col("c_mktsegment").alias("relation"), F.lit("up").alias("direction"), F.lit("high").alias("confidence"), why.alias("rationale")]
    full = F.to_json(F.struct(*parts, F.lit(None).cast("string").alias("evidence")), {"ignoreNullFields": "false"})
    text = F.when(k % 7 == 0, F.col("c_name")).when(k % 11 == 0, F.to_json(F.struct(*parts))).otherwise(full)
    return D.verdict_violations(t.customer.select(k.alias("id"), text.alias("body"))).select("id", "error")


@query("dqc07_attempt_state", """
WITH l AS (SELECT user_id AS item, ts AS tt, event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'a' ELSE 'b' END AS model, event_type <> 'error' AS ok FROM events), m AS (SELECT item, arg_max(model, (tt, event_id)) AS model FROM l GROUP BY 1)
SELECT item, count_if(NOT ok) AS attempts, m.model, count_if(NOT ok) >= 3 AS failed FROM l JOIN m USING (item) WHERE l.model = m.model GROUP BY 1, 3""")
def dqc07(t):
    model = F.when(F.col("ts") < "2024-01-15", "a").otherwise("b")
    log = t.events.select(F.col("user_id").alias("item"), F.struct("ts", "event_id").alias("at"), model.alias("model"), (F.col("event_type") != "error").alias("ok"))
    return D.attempt_state(log)


@query("dqc10_sections_filter", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN [] ELSE [c_mktsegment] END AS ids,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 0 ELSE 1 + CAST(c_custkey % 4 = 1 AS INT) END AS evidence FROM customer""")
def dqc10(t):
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    title = F.when(k % 3 == 0, F.lit(" ")).otherwise(F.col("c_name"))
    known = F.struct(F.col("c_mktsegment").alias("id"), title.alias("title"), F.array(F.concat(F.lit("m"), (k % 4).cast("string")), nation).alias("evidenceIds"))
    other = F.struct(F.lit("").alias("id"), F.col("c_name").alias("title"), F.array(nation).alias("evidenceIds"))
    text = F.when(k % 5 == 0, F.col("c_name")).otherwise(F.to_json(F.array(known, other)))
    own = D.clean_sections(t.customer.select(k.alias("id"), text.alias("sections"), F.array(F.lit("m1"), nation).alias("members")))
    n = F.aggregate("sections", F.lit(0), lambda s, x: s + F.size(x["evidenceIds"]))
    return own.select("id", F.transform("sections", lambda x: x["id"]).alias("ids"), n.alias("evidence"))
