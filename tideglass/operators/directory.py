"""Lists that a reader pages through: histories by document, saved items, stocks, and clusters that wait for a judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .documents import first_false
from .serving import page, search

UNTITLED = "(untitled)"


def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))


def with_counts_of(clusters: DataFrame, members: DataFrame, stocks: DataFrame) -> DataFrame:
    """clusters with the numbers of their members and verified stocks."""
    out = clusters.join(counted(members, "cluster_id", "member_count"), "id", "left").join(counted(stocks.where("verified"), "cluster_id", "stock_count"), "id", "left")
    return out.fillna(0, ["member_count", "stock_count"])


def document_of(source: str = "source", key: str = "issue_key") -> Column:
    """A cluster's document across sources, which is its key without the source; a cluster without one stands alone."""
    rest = F.substr(F.col(key), F.char_length(source) + 2)
    whole = F.startswith(F.col(key), F.concat(source, F.lit(":"))) & F.rlike(rest, F.lit("(?s)^.+:.+$"))
    return F.when(whole, rest).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))


def history_groups(clusters: DataFrame, registry: DataFrame, members: DataFrame, stocks: DataFrame, reports: DataFrame, source: str | None = None) -> DataFrame:
    """One row for each document over the registered snapshots: its latest cluster with label (else its lead member's title), first time
    seen, occurrences, numbers of members and verified stocks, summary, and the report to show first: one with sections, then the
    newest. reports: cluster_id, summary, has_sections."""
    own = clusters.where("status <> 'DISCARDED'").join(registry.select("source", "snapshot_ts").distinct(), ["source", "snapshot_ts"], "left_semi")
    own = (own if source is None else own.where(F.col("source") == source)).withColumn("document", document_of())
    told = own.join(reports.select(F.col("cluster_id").alias("id"), "summary", "has_sections"), "id", "left")
    latest = F.max(F.struct("snapshot_ts", "id", "label", "source", "status", "pulse_score", "summary"))
    report = F.max(F.when(F.col("has_sections").isNotNull(), F.struct("has_sections", "snapshot_ts", "id")))
    g = told.groupBy("document").agg(latest.alias("x"), F.min("snapshot_ts").alias("first_seen"), F.count("*").alias("occurrences"), report.alias("r"))
    g = g.select("document", "x.*", "first_seen", "occurrences", F.col("r.id").alias("default_report_id"))
    lead = members.groupBy(F.col("cluster_id").alias("id")).agg(F.min_by("title", F.struct(first_false("is_seed").alias("s"), (-F.col("weight")).alias("w"), "page_id")).alias("lead"))
    named = g.join(lead, "id", "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "lead", F.lit(UNTITLED))).drop("lead")
    return with_counts_of(named, members, stocks)


def history_page(groups: DataFrame, q: str = "", status: str | None = None, offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of the groups whose label holds q, newest first."""
    own = search(groups, ["label"], q) if q else groups
    own = own if status is None else own.where(F.col("status") == status)
    return page(own, [F.desc("snapshot_ts"), F.col("id")], offset, limit)


def saved_pages(saved: DataFrame, items: DataFrame, on: str, texts: list[str], q: str = "", offset: int = 0, limit: int = 20) -> DataFrame:
    """Of every member the items (member, on, added_at) that hold q, newest first, from offset on and at most limit, each with the
    member's total. Ranks are cut in every task before rows are dealt to members."""
    own = search(saved.join(items, on), texts, q.strip()) if q.strip() else saved.join(items, on)
    total = own.groupBy("member").agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy("member").orderBy(F.desc("added_at"), on))
    most = max(0, offset) + min(100, max(1, limit))
    return own.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") > max(0, offset)).join(total, "member")


def stock_cards(stocks: DataFrame, cluster_stock: DataFrame, clusters: DataFrame, prices: DataFrame) -> DataFrame:
    """Stocks with the number of clusters, not discarded, of which they are verified, and their last close; a stock without either
    stays."""
    live = cluster_stock.where("verified").join(clusters.where("status <> 'DISCARDED'").select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    n = live.groupBy("ticker").agg(F.count_distinct("cluster_id").alias("issue_count"))
    close = prices.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("last_close"))
    return stocks.join(n, "ticker", "left").join(close, "ticker", "left").fillna(0, ["issue_count"])


def stock_directory(cards: DataFrame, q: str = "", sector: str | None = None, exchange: str | None = None, has_issues: bool = False, offset: int = 0, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, total) of the cards by ticker; q is looked for in name or ticker."""
    own = cards.where(F.contains(F.lower("name"), F.lower(F.lit(q))) | F.contains(F.lower("ticker"), F.lower(F.lit(q)))) if q else cards
    for column, value in (("sector", sector), ("exchange", exchange)):
        own = own if value is None else own.where(F.col(column) == value)
    return page(own.where("issue_count > 0") if has_issues else own, [F.col("ticker")], offset, limit)


def to_judge(clusters: DataFrame, stocks: DataFrame, n: int) -> DataFrame:
    """Clusters without stocks that are among the n of the highest pulse in their snapshot, or whose issue was judged (a stock that is
    done) at that time or before; n of zero is no limit. stocks: cluster_id, done."""
    ranked = clusters.withColumn("place", F.row_number().over(W.partitionBy("snapshot_ts").orderBy(F.desc("pulse_score"), "id")))
    done = stocks.where("done").select(F.col("cluster_id").alias("id")).distinct()
    first = clusters.join(done, "id", "left_semi").where("issue_key is not null").groupBy("issue_key").agg(F.min("snapshot_ts").alias("judged"))
    own = ranked.where("status <> 'DISCARDED'").join(stocks.select(F.col("cluster_id").alias("id")), "id", "left_anti").join(first, "issue_key", "left")
    known = F.coalesce(F.col("judged") <= F.col("snapshot_ts"), F.lit(False))
    return own.where((F.lit(n) <= 0) | (F.col("place") <= n) | known).withColumn("exempt", known).drop("judged")
