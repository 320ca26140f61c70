"""Copies of days between stores: a closure of dependent rows, with ids mapped through every table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: pages page_id, wiki, title; snapshots source, snapshot_ts, ...; clusters id, source, snapshot_ts, ...; members cluster_id,
#: page_id, ...; edges cluster_id, source_page_id, target_page_id, ...; spikes source, page_id, window_start, detected_at, ...
TABLES = ("pages", "snapshots", "clusters", "members", "edges", "spikes")


def of_days(c: str, days: list[str], before: int = 0) -> Column:
    """Times of the UTC days, and of so many days before each."""
    day = lambda d: F.lit(d).cast("date")
    return reduce(or_, ((F.col(c) >= F.date_sub(day(d), before).cast("timestamp")) & (F.col(c) < F.date_add(day(d), 1).cast("timestamp")) for d in days), F.lit(False))


def mapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows with column replaced by its id in the other store (ids: from_id, to_id)."""
    own = ids.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to"))
    return rows.join(own, F.col(column) == F.col("__from")).withColumn(column, F.col("__to")).drop("__from", "__to")


def copy_snapshots(source: dict[str, DataFrame], target: dict[str, DataFrame], days: list[str], name: str = "replay") -> dict[str, DataFrame]:
    """The target's tables with the source's snapshots of the days: their clusters, members, edges, all pages that these name, and the
    members' spikes of the days and of the day before each.

    Pages are found by (wiki, title), or get the hash of both as id; a cluster's id is the hash of its snapshot and old id. So a
    repeat maps to the same ids. What the target has under a key stays: a snapshot, with all that belongs to it; a page; a
    spike of a page and window. Only rows of the days are shuffled; nothing is looked up by the driver."""
    new = source["snapshots"].where((F.col("source") == name) & of_days("snapshot_ts", days)).join(target["snapshots"].select("source", "snapshot_ts"), ["source", "snapshot_ts"], "left_anti")
    clusters = source["clusters"].join(new.select("source", "snapshot_ts"), ["source", "snapshot_ts"], "left_semi")
    cluster_ids = clusters.select(F.col("id").alias("from_id"), F.xxhash64("source", "snapshot_ts", "id").alias("to_id"))
    keys = cluster_ids.select(F.col("from_id").alias("cluster_id"))
    members, edges = (source[t].join(keys, "cluster_id", "left_semi") for t in ("members", "edges"))
    of_members = members.select("page_id").distinct()
    spikes = source["spikes"].where((F.col("source") == name) & of_days("detected_at", days, 1)).join(of_members, "page_id", "left_semi")
    named = of_members.union(edges.select(F.explode(F.array("source_page_id", "target_page_id")))).distinct()
    pages = source["pages"].join(named, "page_id", "left_semi")
    known = target["pages"].select("wiki", "title", F.col("page_id").alias("known"))
    found = pages.join(known, ["wiki", "title"], "left").select(F.col("page_id").alias("from_id"), F.coalesce("known", F.xxhash64("wiki", "title")).alias("to_id"), "wiki", "title", "known")
    more = {
        "pages": found.where("known is null").select(F.col("to_id").alias("page_id"), "wiki", "title"),
        "snapshots": new, "clusters": mapped(clusters, cluster_ids, "id"), "members": mapped(mapped(members, cluster_ids, "cluster_id"), found, "page_id"),
        "edges": mapped(mapped(mapped(edges, cluster_ids, "cluster_id"), found, "source_page_id"), found, "target_page_id"),
        "spikes": mapped(spikes, found, "page_id").join(target["spikes"].select("source", "page_id", "window_start"), ["source", "page_id", "window_start"], "left_anti"),
    }
    return {t: target[t].unionByName(more[t].select(target[t].columns)) for t in TABLES}
