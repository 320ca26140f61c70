"""Views that give the driver's tables the shapes of attention data. {K} is the JSON field, {S} the string type."""

VIEWS = {
    "f_edit_events": """
SELECT 'enwiki' AS wiki, concat('Page__', CAST({K} % 20 AS {S})) AS title, concat('u', CAST(user_id % 40 AS {S})) AS usr, event_type = 'error' AS is_bot,
  CASE WHEN event_type = 'signup' THEN 'new' ELSE 'edit' END AS event_type, CAST(floor(value) AS INT) AS byte_delta, event_id AS rev_id,
  CAST(ts AS TIMESTAMP) AS event_ts, CAST(event_id AS {S}) AS meta_id FROM events WHERE event_type <> 'click'""",
    "f_hourly_views": """
SELECT 'enwiki' AS wiki, concat('Page ', CAST({K} % 20 AS {S})) AS title, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts_hour, CAST(sum(floor(value)) AS BIGINT) AS views,
  CAST(sum(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END) AS BIGINT) AS mobile_views FROM events WHERE event_type IN ('view','click','purchase') GROUP BY 1,2,3""",
    "f_arrival": """
SELECT DISTINCT 'enwiki' AS wiki, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts_hour FROM events WHERE extract(hour FROM ts) % 12 <> 5""",
    "f_clicks": """
SELECT concat('Page ', CAST(l_partkey % 40 AS {S})) AS prev, concat('Page ', CAST(l_suppkey % 40 AS {S})) AS curr,
  CASE l_returnflag WHEN 'N' THEN 'link' WHEN 'R' THEN 'external' ELSE 'other' END AS kind, CAST(l_quantity AS BIGINT) AS n FROM lineitem""",
    "f_root_rows": """
SELECT 'replay' AS source, date_trunc('month', CAST(l_shipdate AS TIMESTAMP)) AS snapshot_ts, l_partkey % 300 AS page_id, concat('page_', CAST(l_partkey % 300 AS {S})) AS title,
  CAST(sum(l_quantity) AS BIGINT) AS views, max(l_orderkey) AS max_rev_id FROM lineitem GROUP BY 1,2,3,4""",
    "f_links": """
SELECT DISTINCT date_trunc('month', CAST(l_shipdate AS TIMESTAMP)) AS snapshot_ts, l_partkey % 300 AS page_id, concat('Page ', CAST(l_orderkey % 300 AS {S})) AS target FROM lineitem""",
    "f_article_rows": """
SELECT l.l_orderkey AS doc_id, lower(p.p_brand) AS org, upper(p.p_type) AS theme, lower(n.n_name) AS location FROM lineitem l
  JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "f_clusters": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'replay' END AS source, CAST(o_orderdate AS TIMESTAMP) AS snapshot_ts,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'replay' END, ':enwiki:Page ', CAST(o_custkey % 100 AS {S})) AS issue_key,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Page ', CAST(o_custkey % 100 AS {S})) END AS label, o_totalprice / 50000 AS pulse_score,
  CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'DETECTED' ELSE 'DISCARDED' END AS status FROM orders""",
    "f_cluster_stock": """
SELECT l_orderkey AS cluster_id, concat('S', CAST(l_suppkey AS {S})) AS ticker, max(l_discount) AS similarity, max(l_tax) * 100 AS gdelt_lift,
  CASE max(l_returnflag) WHEN 'R' THEN 'BOTH' WHEN 'N' THEN 'GDELT_ONLY' ELSE 'EMBEDDING_ONLY' END AS tier, max(l_linestatus) = 'O' AS verified FROM lineitem GROUP BY 1,2""",
    "f_prices": """
SELECT concat('S', CAST(o_custkey % 100 AS {S})) AS ticker, CAST(o_orderdate AS DATE) AS trade_date, CAST(max(o_totalprice) AS DECIMAL(14,4)) AS close FROM orders GROUP BY 1,2""",
}
