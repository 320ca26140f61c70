"""Reads over issues, candidates, prices and snapshots: as-of joins, rankings, histories, pages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S

TIERS = ("BOTH", "GDELT_ONLY", "EMBEDDING_ONLY")


def tier_order(c: Column) -> Column:
    return F.when(c == "BOTH", 0).when(c == "GDELT_ONLY", 1).otherwise(2)


def scope(df: DataFrame, statuses: list[str] | None = None, source: str | None = None, days: list[str] = (), times: list[str] = ()) -> DataFrame:
    """Rows of the statuses (default: all but DISCARDED), the source, and any of the UTC days or exact times."""
    out = df.where(F.col("status").isin(*statuses) if statuses else F.col("status") != "DISCARDED")
    out = out.where(F.col("source") == source) if source else out
    if days or times:
        none = F.lit(False)
        by_day = F.to_date("snapshot_ts").isin(*[F.lit(d).cast("date") for d in days]) if days else none
        by_time = F.col("snapshot_ts").isin(*[F.lit(x).cast("timestamp") for x in times]) if times else none
        out = out.where(by_day | by_time)
    return out


def search(df: DataFrame, columns: list[str], q: str) -> DataFrame:
    """Rows that hold q, without regard to case, in the joined columns; no sign of q is special."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(q))))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, total): the rows after offset, 1 to 100 of them, and how many there are in all."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit))), df.agg(F.count("*").alias("total"))


#: Rows that one task of an as-of join gets, about.
TASK_ROWS = 500_000
#: Hash buckets that keys are counted by before any key is counted itself.
KEY_BUCKETS = 65_536


def asof_reuse(
    targets: DataFrame, facts: DataFrame, keys: list[str], target_ts: str, fact_ts: str, own: str, fact_own: str, ties: list[str], take: list[str], hot: int = 1_000_000, blocks: int = 64,
) -> DataFrame:
    """Targets with the fields of the latest fact of the same keys at or before them that another owner made.

    Equal times are settled by the largest ties. Facts and targets are one table for `carried_forward`. Targets with a null in a
    key or no time find nothing, facts with either are not found."""
    names, at = shared_names(targets, keys, target_ts)
    kept = {c: f"__f_{c}" for c in (fact_own, *ties, *take)}
    k = names[: len(keys)]
    f = facts.dropna(subset=[*keys, fact_ts]).select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], F.col(fact_ts).alias("__ts"), F.lit(True).alias("__fact"), *[F.col(c).alias(n) for c, n in kept.items()])
    t = targets.select(*[F.col(c).alias(n) for c, n in at.items()], F.lit(True).alias("__target"))
    found = carried_forward(f.unionByName(t, allowMissingColumns=True), k, at[own], kept[fact_own], [kept[c] for c in ties], {kept[c]: c for c in take}, hot, blocks)
    # Keys and times of both sides have one type in the union; targets get theirs back.
    return found.select(*[F.col(n).cast(targets.schema[c].dataType).alias(c) for c, n in at.items()], "__found.*")


def asof_within(
    rows: DataFrame, keys: list[str], ts: str, own: str, ties: list[str], take: dict[str, str], fact: Column | None = None, hot: int = 1_000_000, blocks: int = 64,
) -> DataFrame:
    """As `asof_reuse` of rows with those of them that are facts (default: all), with fields of the fact by the names in take. A row is
    dealt and sorted once, as target and fact at a time."""
    names, at = shared_names(rows, keys, ts)
    is_fact = reduce(and_, (F.col(c).isNotNull() for c in (*keys, ts)), F.lit(True) if fact is None else F.coalesce(fact, F.lit(False)))
    both = rows.select(*[F.col(c).alias(n) for c, n in at.items()], F.lit(True).alias("__target"), is_fact.alias("__fact"))
    found = carried_forward(both, names[: len(keys)], at[own], at[own], [at[c] for c in ties], {at[c]: n for c, n in take.items()}, hot, blocks)
    return found.select(*[F.col(n).alias(c) for c, n in at.items()], "__found.*")


def shared_names(targets: DataFrame, keys: list[str], ts: str) -> tuple[list[str], dict[str, str]]:
    """Names of the keys and the time in the table that is dealt, and those of all columns of the targets."""
    names = [*[f"__k{i}" for i in range(len(keys))], "__ts"]
    known = dict(zip((*keys, ts), names, strict=True))
    return names, {c: known.get(c, f"__t_{c}") for c in targets.columns}


def carried_forward(both: DataFrame, k: list[str], own: str, owner: str, ties: list[str], take: dict[str, str], hot: int, blocks: int) -> DataFrame:
    """Rows with `__target`, each with the latest row with `__fact` of its keys k at or before its `__ts` whose owner is not its own, as
    `__found`, by the names in take.

    Rows are dealt once by key over as many tasks as they need, without what can be made of their columns there, and sorted once
    by time; running windows carry the latest fact forward, and the latest one of an owner before it. Keys are counted before,
    by their hash buckets, and themselves only in buckets with more than `hot` rows: a key with more than that is cut into time
    blocks at its quantiles, dealt by key and block, and each of them begins with what a scan over the blocks before it carries
    forward, their last fact and the last one of another owner. Nothing is joined but the cuts. Rows of one key and one time stay
    together; rows with a null in a key are dealt evenly."""
    whole = reduce(and_, (F.col(c).isNotNull() for c in k))
    bucket = F.when(whole, F.pmod(F.xxhash64(*k), F.lit(KEY_BUCKETS)))
    counts = both.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    n, full = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > hot, F.col("b")))).first()
    # There is at most one hot key for `hot` rows, so both small tables are bounded.
    many = both.where(bucket.isin(full)).groupBy(*k).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(*k) if full else None
    tasks = max(both.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
    block = F.when(~whole, F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    fact, order = F.coalesce("__fact", F.lit(False)), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.col(owner).alias("owner"))
    x = F.struct(F.col(owner).alias("owner"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(take)])
    both = both.withColumn("__seq", F.lit(0))
    if many is None or many.isEmpty():
        both = both.withColumn("__block", F.coalesce(block, F.lit(0)))
    else:
        cuts = both.join(F.broadcast(many), k, "left_semi").groupBy(*k).agg(F.percentile_approx("__ts", [i / blocks for i in range(1, blocks)], 10_000).alias("__cuts"))
        both = both.join(F.broadcast(cuts), k, "left")
        both = both.withColumn("__block", block.otherwise(F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__ts"))), F.lit(0))))
        carried = carried_facts(both.where(F.col("__cuts").isNotNull() & fact).select(*k, "__block", "__ts", order.alias("__order"), x.alias("__x")), k, blocks)
        fields = {owner: "owner"} | {c: f"x{i}" for i, c in enumerate(take)}
        carried = carried.select(*k, "__block", "__seq", F.lit(True).alias("__fact"), *[F.col(f"__x.{n}").alias(c) for c, n in fields.items() if c not in k])
        both = both.drop("__cuts").unionByName(carried, allowMissingColumns=True)
    both = both.repartition(tasks, *k, "__block").withColumns({"__x": F.when(fact, x), "__order": F.when(fact, order)})
    dealt = W.partitionBy(*k, "__block")
    row = dealt.orderBy("__seq", "__ts", "__order")
    # Where the owner changes, the fact before is the best of another owner until the next change.
    before = F.last("__x", True).over(row.rowsBetween(W.unboundedPreceding, -1))
    both = both.withColumn("__before", before)
    both = both.withColumn("__left", F.when(F.col("__x").isNotNull() & ~F.col("__before.owner").eqNullSafe(F.col("__x.owner")), F.col("__before")))
    both = both.withColumn("__other", F.last("__left", True).over(row.rowsBetween(W.unboundedPreceding, 0)))
    # A target sees all facts of its own time, also those sorted after it.
    seen = F.max_by(F.struct("__x", "__other"), F.when(F.col("__x").isNotNull(), F.struct("__seq", "__ts", "__order")))
    both = both.withColumn("__seen", seen.over(dealt.orderBy("__seq", "__ts").rangeBetween(W.unboundedPreceding, 0))).where("__target")
    chosen = F.when(~F.col("__seen.__x.owner").eqNullSafe(F.col(own)), F.col("__seen.__x")).otherwise(F.col("__seen.__other"))
    return both.withColumn("__one", chosen).withColumn("__found", F.struct(*[F.col(f"__one.x{i}").alias(n) for i, n in enumerate(take.values())]))


def carried_facts(facts: DataFrame, k: list[str], blocks: int) -> DataFrame:
    """Facts that each block of a hot key begins with: of the blocks before it the last one of another owner (__seq -2), then
    the last (-1). A key has two facts a block, so its scan is bounded by `blocks`."""
    kind = facts.schema["__x"].dataType
    last = facts.groupBy(*k, "__block", F.col("__x.owner").alias("__o")).agg(F.max(F.struct("__ts", "__order")).alias("__at"), F.max_by("__x", F.struct("__ts", "__order")).alias("__x"))
    two = last.withColumn("__p", F.row_number().over(W.partitionBy(*k, "__block").orderBy(F.desc("__at")))).where("__p <= 2")
    by_block = two.groupBy(*k, "__block").agg(F.max(F.when(F.col("__p") == 1, F.col("__x"))).alias("a"), F.max(F.when(F.col("__p") == 2, F.col("__x"))).alias("b"))
    by_key = by_block.groupBy(*k).agg(F.map_from_entries(F.collect_list(F.struct("__block", F.struct("a", "b")))).alias("m"))
    none = F.lit(None).cast(kind)
    start = F.struct(none.alias("a"), none.alias("b"), F.array().cast(T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("a", kind), T.StructField("b", kind)]))).alias("out"))

    def step(s: Column, i: Column) -> Column:
        own = F.try_element_at("m", i)
        other = F.when(own["b"].isNotNull(), own["b"]).when(~s["a"]["owner"].eqNullSafe(own["a"]["owner"]), s["a"]).otherwise(s["b"])
        out = F.concat(s["out"], F.array(F.struct(i.alias("block"), s["a"].alias("a"), s["b"].alias("b"))))
        return F.struct(F.when(own.isNull(), s["a"]).otherwise(own["a"]).alias("a"), F.when(own.isNull(), s["b"]).otherwise(other).alias("b"), out.alias("out"))

    states = by_key.select(*k, F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(blocks)), start, step, lambda s: s["out"])).alias("s"))
    rows = F.array(F.struct(F.lit(-2).alias("q"), F.col("s.b").alias("x")), F.struct(F.lit(-1).alias("q"), F.col("s.a").alias("x")))
    return states.select(*k, F.col("s.block").alias("__block"), F.explode(rows).alias("r")).where("r.x is not null").select(*k, "__block", F.col("r.q").alias("__seq"), F.col("r.x").alias("__x"))


def top_per_snapshot(clusters: DataFrame, n: int) -> DataFrame:
    """The n clusters of the highest pulse in each snapshot, ties to the smaller id."""
    place = F.row_number().over(W.partitionBy("source", "snapshot_ts").orderBy(F.desc("pulse_score"), "id"))
    return clusters.withColumn("place", place).where(F.col("place") <= n)


def latest_per_key(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def stable_key() -> Column:
    """Key of an issue; rows without one stand alone."""
    return F.coalesce(F.nullif("issue_key", F.lit("")), F.concat(F.lit("#"), F.col("id").cast("string")))


def rankings(clusters: DataFrame, start: str, as_of: str, n: int = 10) -> DataFrame:
    """The best row of each issue within the time range, n of the highest pulse."""
    own = clusters.where(F.col("snapshot_ts").between(F.lit(start).cast("timestamp"), F.lit(as_of).cast("timestamp")))
    best = latest_per_key(own, stable_key(), [F.desc("pulse_score"), F.desc("snapshot_ts"), F.desc("id")])
    return best.orderBy(F.desc("pulse_score"), F.desc("snapshot_ts"), F.desc("id")).limit(n)


def history_groups(clusters: DataFrame) -> DataFrame:
    """By document across sources: latest row, first time seen, occurrences, label."""
    own = clusters.withColumn("document", S.document_key(F.col("issue_key")))
    newest = F.struct("snapshot_ts", "id", "label", "pulse_score", "status")
    g = own.groupBy("document").agg(F.max(newest).alias("x"), F.min("snapshot_ts").alias("first_seen"), F.count("*").alias("occurrences"))
    return g.select("document", F.col("x.id").alias("id"), F.col("x.snapshot_ts").alias("last_seen"), "first_seen", "occurrences", F.coalesce("x.label", F.substr(F.col("document"), F.instr(F.col("document"), ":") + 1)).alias("label"), F.col("x.pulse_score").alias("pulse_score"))


def first_detected(clusters: DataFrame) -> DataFrame:
    """Each cluster with the time its issue was first seen."""
    first = clusters.groupBy("issue_key").agg(F.min("snapshot_ts").alias("first_detected"))
    return clusters.join(first, "issue_key")


def combine(embedding: DataFrame, lift: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of both kinds with their tier, in tier and score order."""
    both = embedding.join(lift, [*keys, "ticker"], "full")
    tier = F.when(F.col("similarity").isNotNull() & F.col("gdelt_lift").isNotNull(), "BOTH").when(F.col("gdelt_lift").isNotNull(), "GDELT_ONLY").otherwise("EMBEDDING_ONLY")
    both = both.withColumn("tier", tier)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(tier_order(F.col("tier")), F.desc_nulls_last("gdelt_lift"), F.desc_nulls_last("similarity"), "ticker"))
    return both.withColumn("place", place)


def angles_to(pivots: np.ndarray, column: pa.ListArray) -> np.ndarray:
    """Angles of each vector of a column to each pivot (rows of length 1); NaN for a vector without a direction or of another
    length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), len(pivots)), np.nan)
    own = lengths == pivots.shape[1]
    if own.any():
        x = column.filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, pivots.shape[1])
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[own] = np.arccos(np.clip(x / size @ pivots.T, -1, 1))
    return out


#: Queries, and items, of one matrix product at most, about.
SIDE = 2_048
#: Stands for the similarity of vectors without an angle, below all others.
NO_ANGLE = -2.0


def matrices(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows of a column of vectors, and the vectors; without those that are null or hold a null."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten()
        some = np.asarray(flat.is_valid()).reshape(-1, n).all(axis=1)
        out[n] = at[some], flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)[some]
    return out


def nearest(q: pa.ListArray, v: pa.ListArray, asking: np.ndarray, ids: np.ndarray, kth: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, value): for each row x of q the rows y of v that can be among its k nearest, with their cosine (NO_ANGLE: none).

    Matrix products find them; they differ from the cosine by far less than the margin, and so does what order by a rounded cosine
    may change. The cosine itself is summed term by term, as the expression `cosine` does. Of equal ones the k smallest ids stay.
    Rows further than the margin below their kth are left out."""
    alike = np.full((len(q), len(v)), NO_ANGLE)
    left, right = matrices(q), matrices(v)
    with np.errstate(all="ignore"):
        for n in left.keys() & right.keys():
            (i, a), (j, b) = left[n], right[n]
            size = np.outer((a * a).sum(axis=1), (b * b).sum(axis=1))
            found = np.where(size == 0, NO_ANGLE, a @ b.T / np.sqrt(size))
            alike[np.ix_(i, j)] = np.where(np.isnan(found), 2.0, found)
        alike[asking[:, None] == ids[None, :]] = -np.inf
        least = np.partition(alike, -k, axis=1)[:, -k] if 0 < k < len(v) else np.full(len(q), -np.inf)
        x, y = np.nonzero((alike >= np.maximum(least, kth)[:, None] - margin) & (alike > -np.inf))
        value = alike[x, y]
        for n in left.keys() & right.keys():
            (i, a), (j, b) = left[n], right[n]
            row_a, row_b = np.full(len(q), -1), np.full(len(v), -1)
            row_a[i], row_b[j] = np.arange(len(i)), np.arange(len(j))
            at = np.flatnonzero((row_a[x] >= 0) & (row_b[y] >= 0) & (value != NO_ANGLE))
            dots = [np.zeros(len(at)) for _ in range(3)]
            for c in range(n):
                p, r = a[row_a[x[at]], c], b[row_b[y[at]], c]
                for s, term in zip(dots, (p * r, p * p, r * r), strict=True):
                    s += term
            value[at] = dots[0] / np.sqrt(dots[1] * dots[2])
    order = np.lexsort((ids[y], -np.where(np.isnan(value), np.inf, value), x))
    x, y, value = x[order], y[order], value[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (x[1:] != x[:-1]) | ~((value[1:] == value[:-1]) | np.isnan(value[1:]) & np.isnan(value[:-1]))
    run = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    return x[run < k], y[run < k], value[run < k]


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, digits: int = 9, pivots: int | None = None, trace: dict | None = None) -> DataFrame:
    """The k items nearest each query by cosine, rounded to digits so that order does not hang on the sum's order.

    Items belong to the block of their nearest pivot, some hundred items at most. A block's items lie within an angle of it, its
    radius, so an item's angle to a query is at least the pivot's less the radius. Each query first meets the blocks that can
    be nearest, until they hold k items, and then only blocks that can still reach its k-th similarity; the others are not read
    for it. Queries and items of a block meet in slices, one matrix product each. Items without a direction (zero, or of another length) are a block of their own, which all read; so are all blocks for
    such a query. trace gets how many pairs there are and how many were read. Pivots and radii are all that the driver holds."""
    n = items.count()
    wanted = pivots or max(1, min(256, math.isqrt(n)))
    picked = items.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("embedding").collect()
    dims = len(picked[0].embedding) if picked else 0
    own = [r.embedding for r in picked if len(r.embedding) == dims]
    centre = np.array(own, dtype=np.float64).reshape(len(own), dims)
    centre = centre / np.sqrt((centre * centre).sum(axis=1, keepdims=True))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = angles_to(centre, batch.column(1)) if len(centre) else np.full((batch.num_rows, 1), np.nan)
            some = ~np.isnan(angle).any(axis=1)
            block = np.where(some, np.where(np.isnan(angle), np.inf, angle).argmin(axis=1), -1).astype(np.int32)
            near = np.where(some, np.where(np.isnan(angle), np.inf, angle).min(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(near)], names=[*batch.schema.names, "block", "angle"])

    fields = [T.StructField("item_id", items.schema["vec_id"].dataType), T.StructField("v", items.schema["embedding"].dataType)]
    placed = items.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")).mapInArrow(assign, T.StructType([*fields, T.StructField("block", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    known = {r.block: (r.n, r.radius) for r in placed.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    blocks = np.array(sorted(known), dtype=np.int32)
    sizes, radii = (np.array([known[b][i] for b in blocks.tolist()], dtype=np.float64) for i in range(2))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = angles_to(centre, batch.column(1)) if len(centre) else np.full((batch.num_rows, 1), np.nan)
            out: tuple[list, list, list] = ([], [], [])
            for own in angle:
                most = np.cos(np.maximum(0, np.where(blocks >= 0, own[blocks], 0) - radii - 1e-6)) + 1e-6
                most = np.where((blocks < 0) | np.isnan(most), 2.0, most)
                order = np.argsort(-most, kind="stable")
                held = np.cumsum(np.where(blocks[order] < 0, 0, sizes[order]))
                out[0].append(blocks[order]), out[1].append(most[order]), out[2].append(np.concatenate(([True], held[:-1] <= k)) if len(order) else [])
            lists = [pa.array([list(x) for x in c], type=pa.list_(t)) for c, t in zip(out, (pa.int32(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "blocks", "most", "first"])

    given = T.StructType([queries.schema["query_id"], T.StructField("q", queries.schema["embedding"].dataType), *(T.StructField(c, T.ArrayType(t)) for c, t in (("blocks", T.IntegerType()), ("most", T.DoubleType()), ("first", T.BooleanType())))])
    asked = queries.select("query_id", F.col("embedding").alias("q")).mapInArrow(ask, given).select("query_id", "q", F.explode(F.arrays_zip("blocks", "most", "first")).alias("x")).select("query_id", "q", F.col("x.blocks").alias("block"), F.col("x.most").alias("most"), F.col("x.first").alias("first"))

    parts = max(1, math.ceil(queries.count() / SIDE))
    slices = F.element_at(F.create_map(*(F.lit(x) for b in known for x in (b, math.ceil(known[b][0] / SIDE)))), F.col("block")) if known else F.lit(1)
    cut = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    dealt = placed.where("item_id is not null").withColumn("slice", cut("item_id", slices)).select("block", "slice", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "item_id", "v")
    margin = 2 * 10.0**-digits

    def best(asks: pa.Table, own: pa.Table) -> pa.Table:
        """Of the items those that can be among the k nearest of each query, with their similarity."""
        least = asks["kth"].to_numpy()
        x, y, value = nearest(asks["q"].combine_chunks(), own["v"].combine_chunks(), asks["query_id"].to_numpy(), own["item_id"].to_numpy(), np.where(np.isnan(least), -np.inf, least), k, margin)
        return pa.table({"query_id": asks["query_id"].take(pa.array(x)), "item_id": own["item_id"].take(pa.array(y)), "value": pa.array(value, mask=value == NO_ANGLE)})

    def scored(pairs: DataFrame) -> DataFrame:
        asks = pairs.where("query_id is not null").withColumn("kth", F.coalesce("kth", F.lit(float("nan")))).withColumn("part", cut("query_id", F.lit(parts)))
        asks = asks.select("block", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "part", "query_id", "q", "kth")
        met = [side.groupBy("block", "slice", "part") for side in (asks, dealt)]
        out = T.StructType([given["query_id"], fields[0], T.StructField("value", T.DoubleType())])
        return met[0].cogroup(met[1]).applyInArrow(best, out).select("query_id", "item_id", F.round("value", digits).alias("similarity"))

    def ranked(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
        return rows.withColumn("place", place).where(F.col("place") <= k)

    near = ranked(scored(asked.where("first").withColumn("kth", F.lit(None).cast("double"))))
    kth = near.where(F.col("place") == k).select("query_id", F.col("similarity").alias("kth"))
    rest = asked.where("not first").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - 10.0**-digits))
    if trace is not None:
        count = F.element_at(F.create_map(*(F.lit(x) for b in known for x in (b, known[b][0]))), F.col("block"))
        read = asked.where("first").select("block").unionByName(rest.select("block")).agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
        trace |= {"pairs": n * queries.count(), "read": read}
    return ranked(near.drop("place").unionByName(scored(rest)))


def representative_text(lines: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The lines (column line) of each key in order, joined by line ends and cut after most characters.

    A line without text is left out; every other takes two characters at least with its end, so no more than most / 2 + 1
    lines of a key are gathered, and each partition sends no more than that on."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    own = lines.where("line is not null and line <> ''").withColumn("__n", place).where(F.col("__n") <= most // 2 + 1)
    rows = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__n", "line"))).alias("x"))
    return rows.select(*keys, F.left(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit(most)).alias("body"))


def with_counts(clusters: DataFrame, stock: DataFrame) -> DataFrame:
    n = stock.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("candidates"), F.count_if("verified").alias("verified"))
    return clusters.join(n, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("candidates", "verified")})


def timeline(snapshots: DataFrame) -> DataFrame:
    """One snapshot an instant, live before replay."""
    return latest_per_key(snapshots, F.col("snapshot_ts"), [F.when(F.col("source") == "live", 0).otherwise(1), F.col("source")])


def closest(snapshots: DataFrame, at: str) -> DataFrame:
    """The snapshot nearest an instant, ties to the earlier."""
    far = F.abs(F.unix_timestamp("snapshot_ts") - F.unix_timestamp(F.lit(at).cast("timestamp")))
    return snapshots.orderBy(far, "snapshot_ts", "source").limit(1)


def issues_by_day(clusters: DataFrame, month: str, zone: str = "Asia/Seoul") -> DataFrame:
    """Issues of each local day of the month, days without any too."""
    spark = clusters.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(month).cast("date"), F.last_day(F.lit(month).cast("date")))).alias("day"))
    n = clusters.groupBy(F.to_date(F.from_utc_timestamp("snapshot_ts", zone)).alias("day")).agg(F.count_distinct("issue_key").alias("issues"))
    return F.broadcast(days).join(n, "day", "left").select("day", F.coalesce("issues", F.lit(0)).alias("issues"))


def verification_state(stock: DataFrame) -> DataFrame:
    return stock.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(F.col("verified").isNull()).alias("pending"), F.count_if(F.coalesce("verified", F.lit(False)) & F.col("tier").isin("BOTH", "GDELT_ONLY")).alias("passes")).withColumn("complete", (F.col("n") > 0) & (F.col("pending") == 0))


def next_status(clusters: DataFrame, stock: DataFrame) -> DataFrame:
    """DETECTED to VERIFYING once there are candidates, to CONFIRMED once none is pending; others stay."""
    own = clusters.join(verification_state(stock).withColumnRenamed("cluster_id", "id"), "id", "left")
    new = F.when(F.col("status") != "DETECTED", F.col("status")).when(F.col("n").isNull(), "DETECTED").when(F.col("complete"), "CONFIRMED").otherwise("VERIFYING")
    return own.select("id", "status", new.alias("next_status"))
