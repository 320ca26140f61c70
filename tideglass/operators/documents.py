"""Documents that a reader gets whole: maps of snapshots, details of issues, inputs of reports; and the audit of maps.

Tables of the store:
clusters  id, source, snapshot_ts, issue_key, label, category, first_detected, hot, pulse_score, status
members   cluster_id, page_id, wiki, title, is_seed, weight, edit_count, views, edit_baseline, view_baseline, spike_score,
          size_score, completeness, window_start, window_end
edges     cluster_id, id, source_page_id, target_page_id, kind, directed, weight, evidence_label, evidence_month, evidence_observed
reports   cluster_id, summary, summary_model, sections (JSON), report_model, generated_at; one row a cluster
stocks    cluster_id, ticker, name, exchange, sector, tier, match_path, similarity, gdelt_lift, rationale, verified
registry  source, snapshot_ts, cluster_count, score_version, new_window_hours

A document holds what belongs to one cluster or one snapshot, which root selection bounds; nothing else is gathered. Ids are
strings in documents, since readers may not keep 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .serving import asof_reuse, tier_order

SNAPSHOT = ["source", "snapshot_ts"]
#: Domains of a map's fields, stocks of a detail, characters of an introduction.
SOURCES = ("live", "replay")
STATUSES = ("DETECTED", "VERIFYING", "CONFIRMED")
COMPLETENESS = ("complete", "pending", "unavailable")
PREVIEW, INTRO = 5, 1_500

NODE = ("wiki", "title", "is_seed", "edit_count", "views", "edit_baseline", "view_baseline", "spike_score", "size_score", "completeness", "window_start", "window_end")
SECTIONS = "array<struct<id:string,title:string,body:string,evidenceIds:array<string>>>"


def listed(rows: DataFrame, key: str, order: list[Column], item: Column, name: str) -> DataFrame:
    """(key, name): the items of each key as one array in order."""
    own = rows.select(key, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), item.alias("item")).alias("x"))
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias(name))


def first_false(c: str) -> Column:
    """A key that sorts true before all others."""
    return F.when(F.col(c), 0).otherwise(1)


def pulse_map(clusters: DataFrame, members: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """One map for each registered snapshot: meta, and its clusters by pulse with their nodes (seeds first, then by weight) and
    edges with their evidence. Discarded clusters are left out; a snapshot without clusters has an empty map."""
    node = F.struct(F.col("page_id").cast("string").alias("page_id"), *NODE)
    nodes = listed(members, "cluster_id", [first_false("is_seed"), -F.col("weight"), F.col("page_id")], node, "nodes")
    evidence = F.struct(F.col("evidence_label").alias("label"), F.col("evidence_month").alias("month"), F.col("evidence_observed").alias("observed"))
    edge = F.struct(*(F.col(c).cast("string").alias(c) for c in ("id", "source_page_id", "target_page_id")), "kind", "directed", "weight", evidence.alias("evidence"))
    ends = listed(edges, "cluster_id", [F.col("id")], edge, "edges")
    whole = clusters.where("status <> 'DISCARDED'").join(nodes.withColumnRenamed("cluster_id", "id"), "id", "left").join(ends.withColumnRenamed("cluster_id", "id"), "id", "left")
    none = lambda frame, c: F.coalesce(F.col(c), F.array().cast(frame.schema[c].dataType))
    fields = [c for c in ("issue_key", "label", "summary", "category", "first_detected", "hot", "pulse_score", "status") if c in whole.columns]
    whole = whole.withColumns({"nodes": none(nodes, "nodes"), "edges": none(ends, "edges")})
    item = F.struct(F.col("id").cast("string").alias("id"), *fields, F.size("nodes").alias("member_count"), "nodes", "edges")
    packed = whole.select(*SNAPSHOT, F.struct((-F.col("pulse_score")).alias("p"), F.col("id").alias("i"), item.alias("c")).alias("x"))
    maps = packed.groupBy(*SNAPSHOT).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("clusters"))
    out = registry.join(maps, SNAPSHOT, "left").withColumn("clusters", none(maps, "clusters"))
    total = lambda c: F.aggregate("clusters", F.lit(0), lambda s, x: s + F.size(x[c]))
    meta = F.struct("score_version", "new_window_hours", F.size("clusters").alias("cluster_count"), total("nodes").alias("node_count"), total("edges").alias("edge_count"), F.lit(False).alias("truncated"))
    return out.select(*SNAPSHOT, F.col("cluster_count").alias("registered"), meta.alias("meta"), "clusters")


def map_violations(maps: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """(source, snapshot_ts, rule, cluster_id, subject) of all that is wrong with maps; every rule is an element of one array
    over the nested document, which is read and exploded once. A missing value breaks a rule that needs one."""
    kind = "array<struct<rule:string,cluster_id:string,subject:string>>"
    bad = lambda rule, c=None, subject=None: F.struct(F.lit(rule).alias("rule"), (F.lit(None).cast("string") if c is None else c["id"]).alias("cluster_id"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"))
    when = lambda wrong, x: F.when(F.coalesce(wrong, F.lit(True)), F.array(x)).otherwise(F.array().cast(kind))
    each = lambda items, wrong, x: F.transform(F.filter(items, lambda i: F.coalesce(wrong(i), F.lit(True))), x)
    repeated = lambda items: F.array_distinct(F.filter(items, lambda i: F.size(F.filter(items, lambda j: j == i)) > 1))

    def of_cluster(c: Column) -> Column:
        nodes, edges = c["nodes"], c["edges"]
        ids = F.transform(nodes, lambda n: n["page_id"])
        outside = lambda e: ~(F.array_contains(ids, e["source_page_id"]) & F.array_contains(ids, e["target_page_id"]))
        domains = [when(~c["status"].isin(*STATUSES), bad("domain", c, F.lit("status")))]
        if categories:
            domains.append(when(~c["category"].isin(*categories), bad("domain", c, F.lit("category"))))
        return F.concat(
            when(c["member_count"] != F.size(nodes), bad("count", c, F.lit("members"))),
            F.transform(repeated(ids), lambda i: bad("unique", c, i)),
            each(edges, outside, lambda e: bad("edge_ends", c, e["id"])),
            each(nodes, lambda n: ~(n["window_end"] <= F.col("snapshot_ts")), lambda n: bad("window_after_snapshot", c, n["page_id"])),
            each(nodes, lambda n: ~(n["window_start"] < n["window_end"]), lambda n: bad("window_order", c, n["page_id"])),
            when(F.coalesce(c["first_detected"] > F.col("snapshot_ts"), F.lit(False)), bad("first_detected", c)),
            *domains,
            each(nodes, lambda n: ~n["completeness"].isin(*COMPLETENESS), lambda n: bad("domain", c, F.concat(F.lit("completeness of "), n["page_id"]))),
            each(nodes, lambda n: F.coalesce(~(n["size_score"] <= 1), F.lit(False)), lambda n: bad("size_over_one", c, n["page_id"])),
        )

    actual = lambda name: F.aggregate("clusters", F.lit(0), lambda s, c: s + F.size(c[name]))
    found = F.concat(
        when(F.col("registered") != F.size("clusters"), bad("count", subject=F.lit("registered"))),
        when(F.col("meta.cluster_count") != F.size("clusters"), bad("count", subject=F.lit("clusters"))),
        when(F.col("meta.node_count") != actual("nodes"), bad("count", subject=F.lit("nodes"))),
        when(F.col("meta.edge_count") != actual("edges"), bad("count", subject=F.lit("edges"))),
        when(~F.col("source").isin(*SOURCES), bad("domain", subject=F.lit("source"))),
        F.transform(repeated(F.transform("clusters", lambda c: c["id"])), lambda i: bad("unique", subject=i)),
        F.transform(repeated(F.filter(F.transform("clusters", lambda c: c["issue_key"]), lambda k: k.isNotNull())), lambda i: bad("unique", subject=i)),
        F.flatten(F.transform("clusters", of_cluster)),
    )
    return maps.select(*SNAPSHOT, F.explode(found).alias("v")).select(*SNAPSHOT, "v.*")


def best_stocks(stocks: DataFrame, n: int = PREVIEW) -> DataFrame:
    """(cluster_id, stocks): the n best verified stocks, by tier, lift, similarity, ticker. Each task sends n of a cluster on, and
    n are gathered."""
    order = [tier_order(F.col("tier")), -F.coalesce("gdelt_lift", F.lit(0.0)), -F.coalesce("similarity", F.lit(0.0)), F.col("ticker")]
    top = stocks.where("verified").withColumn("__n", F.row_number().over(W.partitionBy("cluster_id").orderBy(*order))).where(F.col("__n") <= n)
    item = F.struct(*(c for c in ("ticker", "name", "exchange", "sector", "tier", "match_path", "similarity", "gdelt_lift", "rationale") if c in stocks.columns))
    return listed(top, "cluster_id", [F.col("__n")], item, "stocks")


def sections_of(text: Column) -> Column:
    """Sections of a report that have an id and a title, missing evidence as none; null if that leaves none, or for no such
    JSON."""
    named = lambda s: (F.trim(F.coalesce(s["id"], F.lit(""))) != "") & (F.trim(F.coalesce(s["title"], F.lit(""))) != "")
    whole = F.transform(F.filter(F.from_json(text, SECTIONS), named), lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"), s["body"].alias("body"), F.coalesce(s["evidenceIds"], F.array().cast("array<string>")).alias("evidence_ids")))
    return F.when(F.size(whole) > 0, whole)


def issue_detail(clusters: DataFrame, members: DataFrame, reports: DataFrame, stocks: DataFrame) -> DataFrame:
    """One document for each cluster that is not discarded: its row, members (seeds first, then by weight), summary and its model,
    the best verified stocks, and the report (status, model, generated_at, sections) or null."""
    member = F.struct(F.col("page_id").cast("string").alias("page_id"), *(c for c in ("wiki", "title", "weight", "is_seed", "edit_count", "views", "completeness") if c in members.columns))
    people = listed(members, "cluster_id", [first_false("is_seed"), -F.col("weight"), F.col("page_id")], member, "members")
    s = sections_of(F.col("sections"))
    report = F.when(s.isNotNull(), F.struct(F.lit("ready").alias("status"), F.col("report_model").alias("model"), "generated_at", s.alias("sections")))
    told = reports.select("cluster_id", "summary", "summary_model", report.alias("report"))
    best = best_stocks(stocks)
    out = clusters.where("status <> 'DISCARDED'")
    for part in (people, told, best):
        out = out.join(part.withColumnRenamed("cluster_id", "id"), "id", "left")
    none = lambda frame, c: F.coalesce(F.col(c), F.array().cast(frame.schema[c].dataType))
    return out.withColumns({"members": none(people, "members"), "stocks": none(best, "stocks")})


def report_inputs(clusters: DataFrame, members: DataFrame, intros: DataFrame, reports: DataFrame, stocks: DataFrame) -> DataFrame:
    """What a report is written from: snapshot, label, short summary, members with usual views and the introduction (page_id,
    rev_ts, intro) of that time, at most INTRO characters of it, and all verified stocks."""
    at = members.drop("snapshot_ts").join(clusters.select(F.col("id").alias("cluster_id"), "snapshot_ts"), "cluster_id")
    facts = intros.select("page_id", F.col("rev_ts").alias("__at"), F.lit(-1).cast("long").alias("__owner"), "intro")
    told = asof_reuse(at, facts, ["page_id"], "snapshot_ts", "__at", "cluster_id", "__owner", ["intro"], ["intro"])
    intro = F.when(F.col("intro") != "", F.left("intro", F.lit(INTRO)))
    member = F.struct("page_id", "title", "is_seed", "views", F.round("view_baseline").cast("long").alias("usual_views"), intro.alias("intro"))
    people = listed(told, "cluster_id", [first_false("is_seed"), -F.col("weight"), F.col("page_id")], member, "members")
    stock = F.struct(*(c for c in ("ticker", "name", "match_path", "rationale") if c in stocks.columns))
    verified = listed(stocks.where("verified"), "cluster_id", [F.col("ticker")], stock, "stocks")
    out = clusters.select("id", "snapshot_ts", "label")
    for part in (people, reports.select("cluster_id", F.col("summary").alias("short_summary")), verified):
        out = out.join(part.withColumnRenamed("cluster_id", "id"), "id", "left")
    none = lambda frame, c: F.coalesce(F.col(c), F.array().cast(frame.schema[c].dataType))
    return out.withColumns({"members": none(people, "members"), "stocks": none(verified, "stocks")})


def link_edges(clusters: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Edges of core_links' clusters as rows of a store: kept pairs, from the side that links (the smaller page, if both do) with
    its title as evidence; directed if only one does. Clusters need a cluster_id."""
    by_key = roots.select(*SNAPSHOT, F.col("page_id").alias("to"), F.col("link_key").alias("target"))
    said = links.join(by_key, [*SNAPSHOT, "target"]).where("page_id <> to").select(*SNAPSHOT, "page_id", "to").distinct()
    sides = said.groupBy(*SNAPSHOT, F.least("page_id", "to").alias("a"), F.greatest("page_id", "to").alias("b")).agg(F.min("page_id").alias("source_page_id"), F.count("*").alias("sides"))
    kept = clusters.select(*SNAPSHOT, "cluster_id", F.col("page_id").alias("a"), F.explode("kept").alias("b")).where("a < b")
    titles = roots.select(*SNAPSHOT, F.col("page_id").alias("source_page_id"), F.col("title").alias("evidence_label"))
    own = kept.join(sides, [*SNAPSHOT, "a", "b"]).join(titles, [*SNAPSHOT, "source_page_id"])
    target = F.when(F.col("a") == F.col("source_page_id"), F.col("b")).otherwise(F.col("a"))
    month = F.date_format("snapshot_ts", "yyyy-MM")
    return own.select(*SNAPSHOT, "cluster_id", F.xxhash64("cluster_id", "a", "b").alias("id"), "source_page_id", target.alias("target_page_id"), F.lit("link").alias("kind"), (F.col("sides") == 1).alias("directed"), F.lit(1.0).alias("weight"), "evidence_label", month.alias("evidence_month"), F.col("snapshot_ts").alias("evidence_observed"))
