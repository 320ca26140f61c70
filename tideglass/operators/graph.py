"""Root selection, link graphs of snapshots, issue clusters and their expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Roots of a snapshot, hours before a page may be picked again, least link focus, least pieces to detach.
LIMIT, COOLDOWN, FOCUS, DETACH = 20, 24, 0.005, 2
#: Gates of neighbours.
MIN_CLICKS, CREATED_DAYS, EVENT_EDITS, BASE_EDITS, RESURGENCE = 10, 30, 20, 5, 5.0

SNAPSHOT = ["source", "snapshot_ts"]


def select_roots(spikes: DataFrame, limit: int | None = LIMIT, cooldown: int = COOLDOWN, prior: DataFrame | None = None, span: int = 4, rounds: list[int] | None = None) -> DataFrame:
    """Picks of each snapshot in time order: most viewed first, no page again within the cooldown, counted from its last
    pick here or in prior (source, snapshot_ts, page_id of earlier runs).

    Without a cooldown this is a rank, and without a limit pages do not meet and go one by one. Otherwise a pick depends on
    earlier ones, but on those within the cooldown only. So time is cut into blocks of `span` cooldowns; a block depends on what
    its predecessor leaves cooling, and on nothing before. All blocks are evaluated at once, each from an assumed set of cooling
    pages (at first none), and again only where the predecessor turns out to leave another set, until no set changes.
    After round n the first n blocks are final, so it ends; rounds gets the number of blocks that each round evaluated.

    At most `limit` pages of each snapshot within the cooldown (and prior's) can be cooling, so the rows that can ever be
    picked are cut by rank first, and a set has as many pages at most. Rounds are checkpoints in the shared folder.
    """
    rows = spikes.select(*SNAPSHOT, "page_id", F.coalesce("views", F.lit(0)).alias("views"))
    rank = F.row_number().over(W.partitionBy(*SNAPSHOT).orderBy(F.desc("views"), "page_id"))
    if not cooldown:
        return rows.withColumn("n", rank).where(F.lit(True) if limit is None else F.col("n") <= limit).select(*SNAPSHOT, "page_id")
    seconds = cooldown * 3600
    at = F.unix_timestamp("snapshot_ts").alias("at")
    old = (rows.limit(0) if prior is None else prior).select(*SNAPSHOT, "page_id")
    old = old.select(*SNAPSHOT, at, "page_id", F.lit(None).cast("long").alias("views"), F.lit(True).alias("prior"))
    rows = rows.select(*SNAPSHOT, at, "page_id", "views", F.lit(False).alias("prior"))
    if limit is None:
        return one_pass(rows.unionByName(old).withColumn("part", F.col("page_id")), None, seconds).select(*SNAPSHOT, "page_id")
    times = rows.select("source", "at").distinct().withColumn("most", F.lit(limit).cast("long")).unionByName(old.groupBy("source", "at").agg(F.count("*").alias("most")))
    times = times.groupBy("source", "at").agg(F.sum("most").alias("most"))
    times = times.withColumn("most", F.sum("most").over(W.partitionBy("source").orderBy("at").rangeBetween(-seconds + 1, 0)))
    block = F.floor(F.col("at") / (seconds * span)).alias("part")
    may = rows.withColumn("n", rank).join(times, ["source", "at"]).where("n <= most").drop("n", "most")
    base = may.unionByName(old).select("*", block).checkpoint()
    return settled(base, limit, seconds, seconds * span, rounds).select(*SNAPSHOT, "page_id")


def settled(base: DataFrame, limit: int, seconds: int, width: int, rounds: list[int] | None) -> DataFrame:
    """Picks of all blocks (source, part), evaluated until no block's set of cooling pages changes."""
    key, cooling = ["source", "part"], "array<struct<page_id:bigint,at:bigint>>"
    blocks = base.select(*key).distinct().withColumn("cooling", F.array().cast(cooling)).checkpoint()
    todo, picks, done = blocks, None, 0
    while True:
        done += 1
        held = todo.select(*key, F.explode("cooling").alias("c")).select(*key, F.timestamp_seconds("c.at").alias("snapshot_ts"), F.col("c.at").alias("at"), F.col("c.page_id").alias("page_id"), F.lit(None).cast("long").alias("views"), F.lit(True).alias("prior"))
        new = one_pass(base.join(todo.select(*key), key, "left_semi").unionByName(held), limit, seconds)
        picks = (new if picks is None else picks.join(todo.select(*key), key, "left_anti").unionByName(new)).checkpoint()
        if rounds is not None:
            rounds.append(todo.count())
        last = picks.select(*key, "at", "page_id").unionByName(base.where("prior").select(*key, "at", "page_id")).where(F.col("at") > (F.col("part") + 1) * width - seconds)
        left = last.groupBy("source", (F.col("part") + 1).alias("part"), "page_id").agg(F.max("at").alias("at")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_id", "at"))).alias("new"))
        after = blocks.join(left, key, "left").select(*key, F.coalesce("new", F.array().cast(cooling)).alias("cooling"), F.col("cooling").alias("was")).checkpoint()
        todo, blocks = after.where("cooling <> was").drop("was"), after.drop("was")
        if todo.isEmpty():
            return picks


def one_pass(rows: DataFrame, limit: int | None, seconds: int) -> DataFrame:
    """Picks of each (source, part) in one ordered pass, which holds the picks of one cooldown; prior rows only cool."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, last, taken = None, None, {}, 0
        for pdf in batches:
            keep = []
            for source, number, t, page, is_prior in zip(pdf["source"], pdf["part"], pdf["at"], pdf["page_id"], pdf["prior"], strict=True):
                if (source, number) != part:
                    part, now, last = (source, number), None, {}
                if t != now:
                    now, taken, last = t, 0, {p: u for p, u in last.items() if t - u < seconds}
                free = page not in last and (limit is None or taken < limit)
                keep.append(free and not is_prior)
                if free or is_prior:
                    last[page] = t
                    taken += not is_prior
            yield pdf.loc[keep, ["source", "part", "snapshot_ts", "at", "page_id"]]

    order = ["source", "part", "at", F.desc("prior"), F.desc("views"), "page_id"]
    return rows.repartition("source", "part").sortWithinPartitions(*order).mapInPandas(pick, "source string, part long, snapshot_ts timestamp, at long, page_id long")


def root_edges(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected edges (a < b) between roots of a snapshot of which one links to the other."""
    by_key = roots.select(*SNAPSHOT, F.col("page_id").alias("to"), F.col("link_key").alias("target"))
    own = links.join(roots.select(*SNAPSHOT, "page_id"), [*SNAPSHOT, "page_id"], "left_semi")
    pairs = own.join(by_key, [*SNAPSHOT, "target"]).where("page_id <> to")
    return pairs.select(*SNAPSHOT, F.least("page_id", "to").alias("a"), F.greatest("page_id", "to").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with the smallest page of its component, all snapshots at once.

    Labels fall to the smallest neighbour's; every other step follows labels of labels, until none falls. Each round is
    written to the shared checkpoint folder, so the plan stays short and a lost executor costs one round."""
    both = edges.select(*SNAPSHOT, "a", "b").union(edges.select(*SNAPSHOT, "b", "a")).checkpoint()
    label = nodes.select(*SNAPSHOT, "page_id", F.col("page_id").alias("comp")).checkpoint()
    while True:
        low = both.join(label.withColumnRenamed("page_id", "b"), [*SNAPSHOT, "b"]).groupBy(*SNAPSHOT, F.col("a").alias("page_id")).agg(F.min("comp").alias("low"))
        step = label.join(low, [*SNAPSHOT, "page_id"], "left").select(*SNAPSHOT, "page_id", F.least("comp", F.coalesce("low", "comp")).alias("c"), F.col("comp").alias("was"))
        up = step.select(*SNAPSHOT, F.col("page_id").alias("c"), F.col("c").alias("upper"))
        new = step.join(up, [*SNAPSHOT, "c"]).select(*SNAPSHOT, "page_id", F.least("c", "upper").alias("comp"), "was").checkpoint()
        label = new.drop("was")
        if new.where("comp <> was").isEmpty():
            return label


def focus_ratios(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Degree within the snapshot over all outlinks; unknown without outlinks."""
    ends = edges.select(*SNAPSHOT, F.explode(F.array("a", "b")).alias("page_id")).groupBy(*SNAPSHOT, "page_id").agg(F.count("*").alias("degree"))
    out = links.groupBy(*SNAPSHOT, "page_id").agg(F.count_distinct("target").alias("outlinks"))
    own = nodes.select(*SNAPSHOT, "page_id").join(ends, [*SNAPSHOT, "page_id"], "left").join(out, [*SNAPSHOT, "page_id"], "left")
    degree = F.coalesce("degree", F.lit(0))
    return own.select(*SNAPSHOT, "page_id", degree.alias("degree"), "outlinks", F.when(F.col("outlinks") > 0, degree / F.col("outlinks")).alias("ratio"))


def members_of(mask: int) -> list[int]:
    """Places of the bits of a mask: sets of a snapshot's roots are masks, in the roots' order."""
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def flooded(near: list[int], start: int, room: int) -> int:
    """What start reaches over near without leaving room."""
    seen = edge = start & room
    while edge:
        edge = reduce(or_, (near[i] for i in members_of(edge))) & room & ~seen
        seen |= edge
    return seen


def parts_without(near: list[int], v: int) -> list[int]:
    """The parts that v's neighbours would be in if v were away."""
    left, out = near[v], []
    while left:
        out.append(flooded(near, left & -left, ~(1 << v)))
        left &= ~out[-1]
    return out


def weak_bridge(near: list[int], ratios: list[float | None], views: list[int], least: float) -> tuple[int, int] | None:
    """(page, neighbours to leave): the page of lowest focus that joins parts keeps its strongest part only."""
    weak = [(ratios[v], -near[v].bit_count(), v) for v in range(len(near)) if ratios[v] is not None and ratios[v] < least]
    for *_, v in sorted(weak):
        parts = parts_without(near, v)
        if len(parts) > 1:
            return v, near[v] & ~strongest(near[v], parts, views)
    return None


def strongest(links: int, parts: list[int], views: list[int]) -> int:
    """The part of most links, then of the most viewed page, then of the first page in order."""
    return max(parts, key=lambda p: ((p & links).bit_count(), max(views[i] for i in members_of(p)), -(p & -p)))


def unvouched_bridge(near: list[int], out: list[int], views: list[int], least: int) -> tuple[int, int] | None:
    """(page, neighbours to leave): parts that the page does not link out to, if there are enough. Without any part that it
    links to, the strongest stays. Pages that join most parts come first, then those of most links, then in order."""
    split = {v: parts for v in range(len(near)) if len(parts := parts_without(near, v)) > 1}
    for v in sorted(split, key=lambda v: (-len(split[v]), -near[v].bit_count(), v)):
        vouched = [p for p in split[v] if p & near[v] & out[v]] or [strongest(near[v], split[v], views)]
        rest = [p for p in split[v] if p not in vouched]
        if len(rest) >= least:
            return v, near[v] & reduce(or_, rest)
    return None


def apply_cuts(near: list[int], find: Callable[[], tuple[int, int] | None]) -> list[tuple[int, int]]:
    """Take out what find names, one page at a time, until it names none; the links that went."""
    gone = []
    while (cut := find()) is not None:
        v, mask = cut
        near[v] &= ~mask
        for x in members_of(mask):
            near[x] &= ~(1 << v)
            gone.append((v, x))
    return gone


CORE = "source string, snapshot_ts timestamp, page_id long, comp long, degree long, kept_degree long, kept array<long>, weak array<long>, unvouched array<long>"


def linked_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots with the number of all their outlinks and the roots of their snapshot among them. One pass over either side."""
    keys = F.collect_list(F.struct("link_key", "page_id")).over(W.partitionBy(*SNAPSHOT))  # LIMIT roots at most
    own = roots.select(*SNAPSHOT, "page_id", F.coalesce("views", F.lit(0)).alias("views"), "score", keys.alias("keys"))
    to = F.transform(F.filter("keys", lambda k: (k["link_key"] == F.col("target")) & (k["page_id"] != F.col("page_id"))), lambda k: k["page_id"])
    both = own.join(links.select(*SNAPSHOT, "page_id", "target"), [*SNAPSHOT, "page_id"], "left").withColumn("to", to)
    return both.groupBy(*SNAPSHOT, "page_id").agg(F.first("views").alias("views"), F.first("score").alias("score"), F.count_distinct("target").alias("outlinks"), F.array_distinct(F.flatten(F.collect_set(F.when(F.size("to") > 0, F.col("to"))))).alias("out"))


def core_links(roots: DataFrame, links: DataFrame, focus: float = FOCUS, detach: int = DETACH) -> DataFrame:
    """Roots with their cluster after both suppressions, their degree before and after, the neighbours that they keep, and
    those that they lost for weak focus or because nobody vouched.

    Joins and outlinks are DataFrame work; only the order-dependent cuts run in a function over one snapshot's roots,
    which root selection holds to LIMIT. Roots need source, snapshot_ts, page_id, link_key, views, score."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "page_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        pages, n = [int(p) for p in pdf["page_id"]], len(pdf)
        place = {p: i for i, p in enumerate(pages)}
        out = [reduce(or_, (1 << place[x] for x in own if x in place), 0) for own in pdf["out"]]
        near = [out[i] | reduce(or_, (1 << j for j in range(n) if out[j] >> i & 1), 0) for i in range(n)]
        degree, views = [x.bit_count() for x in near], [int(v) for v in pdf["views"]]
        ratios = [d / o if o else None for d, o in zip(degree, pdf["outlinks"], strict=True)]
        lost = [apply_cuts(near, lambda: weak_bridge(near, ratios, views, focus)), apply_cuts(near, lambda: unvouched_bridge(near, out, views, detach))]
        named = lambda cut, i: sorted(pages[b if a == i else a] for a, b in cut if i in (a, b))
        pdf["comp"] = [min(pages[x] for x in members_of(flooded(near, 1 << i, -1))) for i in range(n)]
        pdf["degree"], pdf["kept_degree"] = degree, [x.bit_count() for x in near]
        pdf["kept"] = [sorted(pages[x] for x in members_of(m)) for m in near]
        pdf["weak"], pdf["unvouched"] = ([named(cut, i) for i in range(n)] for cut in lost)
        return pdf[["source", "snapshot_ts", "page_id", "comp", "degree", "kept_degree", "kept", "weak", "unvouched"]]

    return linked_roots(roots, links).groupBy(*SNAPSHOT).applyInPandas(one, CORE)


def core(roots: DataFrame, links: DataFrame, focus: float = FOCUS, detach: int = DETACH) -> DataFrame:
    """Roots with their cluster after both suppressions, and their degree before and after."""
    return core_links(roots, links, focus, detach).drop("kept", "weak", "unvouched")


def core_edges(clusters: DataFrame) -> DataFrame:
    """The links (a < b) of core_links: kept, or the rule that took them out."""
    def ends(fate: str) -> Column:
        return F.transform(fate, lambda b: F.struct(b.alias("b"), F.lit(fate).alias("fate")))

    kinds = [ends(c) for c in ("kept", "weak", "unvouched")]
    return clusters.select(*SNAPSHOT, F.col("page_id").alias("a"), F.explode(F.concat(*kinds)).alias("x")).select(*SNAPSHOT, "a", "x.*").where("a < b")


def size_buckets(members: DataFrame, key: str) -> DataFrame:
    n = members.groupBy(key).agg(F.count("*").alias("n"))
    c = F.col("n")
    bucket = F.when(c == 1, "1").when(c == 2, "2").when(c <= 4, "3-4").when(c <= 7, "5-7").when(c <= 12, "8-12").otherwise("13+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.max("n").alias("largest"))


def lead_of(members: DataFrame, keys: list[str]) -> DataFrame:
    """Lead page of each component: highest score, then largest title."""
    return members.groupBy(*keys).agg(F.max_by("page_id", F.struct("score", "title")).alias("lead_page"), F.max("score").alias("pulse"), F.count("*").alias("members"))


def build_snapshots(members: DataFrame, hot: float = 5.0) -> DataFrame:
    """Issues of each snapshot from rooted members (source, snapshot_ts, comp, page_id, title, wiki, score, views)."""
    lead = F.max(F.struct("score", "title", "wiki"))
    out = members.groupBy(*SNAPSHOT, "comp").agg(lead.alias("lead"), F.round(F.max("score"), 3).alias("pulse_score"), F.count_if(F.col("score") >= hot).alias("hot_members"), F.count("*").alias("member_count"))
    out = out.select(*SNAPSHOT, "comp", F.col("lead.title").alias("label"), S.issue_key(F.col("source"), F.col("lead.wiki"), F.col("lead.title")).alias("issue_key"), "pulse_score", (F.col("hot_members") > 0).alias("hot"), "member_count")
    first = out.groupBy("issue_key").agg(F.min("snapshot_ts").alias("first_detected"))
    return out.join(first, "issue_key")


def neighbours(clicks: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pages that readers reach from or come from a seed: clicks summed, directed if at least as many go out."""
    own = clicks.where("kind = 'link' and prev <> curr").select("prev", "curr", "n")
    keys = seeds.select(F.col("title").alias("seed")).distinct()
    out = own.join(keys, own.prev == keys.seed).select("seed", F.col("curr").alias("neighbour"), F.col("n").alias("out"), F.lit(0).cast("long").alias("into"))
    into = own.join(keys, own.curr == keys.seed).select("seed", F.col("prev").alias("neighbour"), F.lit(0).cast("long").alias("out"), F.col("n").alias("into"))
    both = out.unionByName(into).groupBy("seed", "neighbour").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return both.select("seed", "neighbour", (F.col("out") + F.col("into")).alias("n"), (F.col("out") >= F.col("into")).alias("directed"))


def resurgence(pairs: DataFrame, daily: DataFrame) -> DataFrame:
    """Pairs with edits of the neighbour in [event_start, event_end) and in the interval as long before it.

    The range is inside the aggregate, so the join is on the title alone."""
    d = daily.select(F.col("title").alias("neighbour"), "day", F.col("n").alias("edits"))
    length = F.datediff("event_end", "event_start")
    base = F.date_sub(F.col("event_start"), length)
    hit = lambda a, b: F.coalesce(F.sum(F.when((F.col("day") >= a) & (F.col("day") < b), F.col("edits"))), F.lit(0))
    keys = pairs.columns
    return pairs.join(d, "neighbour", "left").groupBy(*keys).agg(hit(F.col("event_start"), F.col("event_end")).alias("event_edits"), hit(base, F.col("event_start")).alias("base_edits"))


def passes_resurgence():
    e, b = F.col("event_edits"), F.col("base_edits")
    return (e >= EVENT_EDITS) & (b >= BASE_EDITS) & (e >= RESURGENCE * b)


def expand(pairs: DataFrame) -> DataFrame:
    """Neighbours that join a cluster, by the first qualifying seed in score order.

    pairs: snapshot_ts, comp, seed, seed_score, neighbour, n, month, created, event_edits, base_edits, is_member; month is
    the first day of the month that the clicks are of, which must be over before the snapshot's month."""
    days = F.abs(F.datediff("snapshot_ts", "created"))
    gate = F.when(F.col("seed") == F.col("neighbour"), "self").when(F.col("is_member"), "duplicate").when(F.col("n") < MIN_CLICKS, "few_clicks").when(F.col("created") > F.to_date("snapshot_ts"), "future")
    gate = gate.when(~F.coalesce(F.col("month") < F.trunc("snapshot_ts", "month"), F.lit(False)), "open_month")
    gate = gate.when(days <= CREATED_DAYS, "new_page").when(passes_resurgence(), "resurgence").otherwise("quiet")
    marked = pairs.withColumn("gate", gate)
    good = marked.where(F.col("gate").isin("new_page", "resurgence"))
    place = F.row_number().over(W.partitionBy("snapshot_ts", "comp", "neighbour").orderBy(F.desc("seed_score"), "seed"))
    return good.withColumn("place", place).where("place = 1").select("snapshot_ts", "comp", "neighbour", "seed", "n", "gate", (F.col("gate") == "new_page").alias("is_seed"))


def relation_edges(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Known relations with both ends in a cluster, seen by the snapshot, the target not added by a later seed."""
    a = members.select("snapshot_ts", "comp", F.col("title").alias("subject"), F.col("rank").alias("subject_rank"))
    b = members.select("snapshot_ts", "comp", F.col("title").alias("object"), F.col("rank").alias("object_rank"))
    both = relations.join(a, "subject").join(b, ["snapshot_ts", "comp", "object"])
    return both.where("observed <= snapshot_ts and object_rank <= subject_rank and subject <> object").select("snapshot_ts", "comp", "subject", "object", "relation")


def funnel(pairs: DataFrame) -> DataFrame:
    own = pairs
    return own.agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("candidates"), F.count_if(F.col("created").isNull()).alias("unknown_creation"), F.count_if(F.col("n") >= MIN_CLICKS).alias("enough_clicks"), F.count_if((F.col("n") >= MIN_CLICKS) & passes_resurgence()).alias("resurgent"))
