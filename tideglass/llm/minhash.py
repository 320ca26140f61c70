"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles. Two permutations, the second shifted circularly by i, give signature
coordinate i; bands of ROWS coordinates are buckets. Documents of one bucket become linked only after their full sets
are compared: 100 * intersection >= percent * union.

Documents with equal sets form a class and go through once. In each bucket every class is compared with one leader,
the class that shares most buckets with others, so work is linear in a bucket's size. Buckets whose classes then still
lie in more than one component are finished exactly: members are dealt to a leader of their own family (`families`) and
meet by how they differ from it (`by_leaders`).
Before the leader's comparison a pair is left to that last step if set sizes forbid a link, or if a sketch of the
signature's lowest bits falls SLACK standard deviations below the threshold.

Defined cases: null, empty or wordless text has an empty set, is linked with nothing and kept; fewer words than the
width are one shingle; repeated rows are copies of each other; a null doc_id is never chosen while another is there.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, append_columns, circulant_minima, connected_components, mix64, row_key, shingle_hashes, small_or_shuffled, stage

#: A pair at similarity 0.8 shares none of 32 bands of 4 coordinates with probability 5e-8.
BANDS, ROWS = 32, 4
#: Bands of the first round, which joins most copies before the others are looked at.
FIRST = 8
#: Times that members far from all leaders so far are dealt to new ones; more families meet as members of one.
ROUNDS = 3
#: Words of 64 bits that bound how many elements two members' differences share (a power of two).
WORDS = 4
#: Standard deviations by which a sketch may fall short before a member and its leader wait for the last step.
SLACK = 5


def sketch(df: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """df with n_shingles, set_key (128-bit digest of the sorted set, null if empty), bands and sketch words s1, s2."""
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), True)),
        T.StructField("s1", T.LongType()),
        T.StructField("s2", T.LongType()),
    ]

    def fn(cols: list[list]) -> list[pa.Array]:
        n, key, bands, s = [], [], [], []
        number = np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)
        for t in cols[0]:
            h = np.unique(shingle_hashes(t, width))
            n.append(len(h))
            if not len(h):
                key.append(None), bands.append(None), s.append((None, None))
                continue
            key.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            minima = circulant_minima(h, BANDS * ROWS)
            rows = minima.reshape(BANDS, ROWS).astype(U64)
            b = number
            for i in range(ROWS):
                b = mix64(b ^ rows[:, i])
            bands.append(b.view(np.int64))
            s.append(np.packbits((minima & 1).astype(np.uint8)).view(np.int64).tolist())
        return [
            pa.array(n, type=pa.int64()),
            pa.array(key, type=pa.binary()),
            pa.array(bands, type=pa.list_(pa.int64())),
            pa.array([x[0] for x in s], type=pa.int64()),
            pa.array([x[1] for x in s], type=pa.int64()),
        ]

    return append_columns(df, [text], fields, fn)


def set_arrays(df: DataFrame, text: str, width: int) -> DataFrame:
    """df with shingles: the sorted set of shingle hashes, and key: its digest."""
    fields = [T.StructField("shingles", T.ArrayType(T.LongType(), True)), T.StructField("key", T.BinaryType())]

    def fn(cols: list[list]) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(t, width)) for t in cols[0]]
        return [
            pa.array([h.view(np.int64) for h in sets], type=pa.list_(pa.int64())),
            pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], type=pa.binary()),
        ]

    return append_columns(df, [text], fields, fn)


def may_link(percent: int, x: str = "x", y: str = "y", words: list[str] = ("s1", "s2")) -> Column:
    """Necessary for a link: sizes within the ratio, and enough equal bits in the sketches."""
    bits, agree = 64 * len(words), (1 + percent / 100) / 2
    least = bits * agree - SLACK * (bits * agree * (1 - agree)) ** 0.5
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in words])
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (differ <= int(bits - least))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def class_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cid, shingles) of the classes in ids (cid), made anew from the text of one document each."""
    wanted = stage(ids.distinct().join(classes, "cid").select("cid", "set_key", "row"), "wanted")
    sets = set_arrays(docs.select("row", "text").join(small_or_shuffled(wanted), "row"), "text", width).where("key = set_key")
    return stage(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left, right = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return stage(both.where(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"), "links")


def centred(rest: DataFrame) -> DataFrame:
    """(frame, top, id, central, comp, party): the members of each bucket with its leader. Pairs are sought between parties."""
    top = stage(rest.groupBy("band").agg(F.max(F.struct("central", "id")).alias("top")).select("band", F.col("top.id").alias("top")), "top")
    own = rest.join(top, "band").select("top", "id", "central", "comp").distinct()
    return own.select(F.lit(0).alias("frame"), "*", F.col("comp").alias("party"))


def with_sets(own: DataFrame, sets: DataFrame, leader: str) -> DataFrame:
    """own with n and nl, the sizes of the sets of id and its leader, and what only the one (added) or the other (lost) has."""
    x, y = sets.select(F.col("cid").alias("id"), F.col("shingles").alias("sx")), sets.select(F.col("cid").alias(leader), F.col("shingles").alias("sl"))
    parts = [F.size("sx").alias("n"), F.size("sl").alias("nl"), F.array_except("sx", "sl").alias("added"), F.array_except("sl", "sx").alias("lost")]
    return own.where(F.col("id") != F.col(leader)).join(x, "id").join(y, leader).select(*own.columns, *parts)


def families(own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """own with the members that are far from their leader dealt to leaders of their own, where these are at most half as far.

    Members of one family add the same elements to the leader's set; the least hash among those that many of them add names
    the family, and its most central member leads it. What a family has in common is then in nobody's difference. Members
    of different families meet in a frame of their own (1), by their differences from the leader that they had."""
    lo, hi = 100 - percent, 100 + percent
    d = with_sets(own.select("top", "id", "central"), sets, "top").withColumn("d", F.size("added") + F.size("lost"))
    far = stage(d.where(F.col("d") * hi > (F.col("n") + F.col("nl")) * lo).select("top", "id", "central", "d", "added"), "far")
    dealt: list[DataFrame] = []
    for _ in range(ROUNDS):
        e = far.select("top", "id", F.explode("added").alias("e"))
        counts = stage(e.groupBy("top", "e").agg(F.count("*").alias("of")).where("of > 1"), "counts")
        best = F.max("of").over(W.partitionBy("top", "id"))
        named = e.join(counts, ["top", "e"]).withColumn("best", best).where("2 * of >= best").groupBy("top", "id").agg(F.min(F.xxhash64("e")).alias("name"))
        named = stage(far.join(named, ["top", "id"]).select("top", "id", "central", "d", "name"), "named")
        heads = named.groupBy("top", "name").agg(F.max(F.struct("central", "id")).alias("head"), F.count("*").alias("of")).where("of > 1")
        heads = stage(heads.select("top", "name", F.col("head.id").alias("sub")), "heads")
        nearer = with_sets(named.join(heads, ["top", "name"]).select("top", "id", "sub", "d"), sets, "sub")
        moved = stage(nearer.where(2 * (F.size("added") + F.size("lost")) <= F.col("d")).select("top", "id", "sub"), "moved")
        if moved.isEmpty():
            break
        dealt.append(stage(moved.union(moved.select("top", F.col("sub").alias("id"), "sub")).distinct(), "dealt"))
        far = stage(far.join(dealt[-1].select("top", "id"), ["top", "id"], "left_anti"), "far")
    if not dealt:
        return own
    subs = reduce(DataFrame.union, dealt)
    placed = stage(own.join(subs, ["top", "id"], "left").withColumn("sub", F.coalesce("sub", "top")), "placed")
    within = placed.select("frame", F.col("sub").alias("top"), "id", "comp", "party").distinct()
    across = placed.join(subs.select("top").distinct(), "top").select(F.lit(1).alias("frame"), "top", "id", "comp", F.col("sub").alias("party"))
    return within.union(across)


def by_difference(rest: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """by_leaders with one leader a bucket."""
    return by_leaders(centred(rest), sets, percent)


def by_leaders(own: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): the members of unresolved buckets that are linked to their leader, and all pairs of others that
    may still be linked.

    With x ^ L the symmetric difference of a member and its leader, |x ^ y| = |x ^ L| + |y ^ L| - 2 s, where s elements
    lie in both differences. A link means |x ^ y| * (100 + percent) <= (|x| + |y|) * (100 - percent), and of two members
    in different components at most one is linked to L. That gives a least s > 0 for each member, so a linked pair
    shares one of the first |x ^ L| - s + 1 elements of both differences, in one order of all elements: rarest first.
    Changes that are a member's own come first there and meet nobody, so a family of unlinked near copies makes no
    pairs. Linked members (near) look half as far as unlinked ones that look for them (far); of two unlinked ones that
    with the smaller difference looks less far still (short), since s >= |x ^ L| - (|x| + |y|) (100 - percent) / 2 (100 + percent).
    An element met by one party alone is left out, and members of its largest party meet only those of others. Two members
    that meet become a pair only if s can be large enough by the elements that follow and by their bits, which drops no link."""
    lo, hi, keys = 100 - percent, 100 + percent, ["frame", "top"]
    d = with_sets(own.select(*keys, "id", "comp", "party").distinct(), sets, "top").withColumn("parts", F.concat("added", "lost")).drop("added", "lost")
    d = d.withColumn("d", F.size("parts"))
    d = stage(d.withColumn("linked", F.col("d") * hi <= (F.col("n") + F.col("nl")) * lo), "differences")
    links = d.where("linked").select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b")).distinct()

    e = d.select(*keys, "id", F.explode("parts").alias("e"))
    counts = stage(e.groupBy(*keys, "e").agg(F.count("*").alias("of")).where("of > 1"), "counts")
    mine = W.partitionBy(*keys, "id")
    # One bit for each of a member's elements that others have too: a bit that only one of two members has is an element that they do not share.
    bits = [F.bit_or(F.when(F.expr(f"shiftright(e, 6) & {WORDS - 1} = {i}"), F.expr("shiftleft(1L, CAST(e & 63 AS INT))")).otherwise(F.lit(0))).over(mine).alias(f"w{i}") for i in range(WORDS)]
    ranked = e.join(counts, [*keys, "e"]).select(*keys, "id", "e", F.row_number().over(mine.orderBy("of", "e")).alias("rank"), F.count("*").over(mine).alias("common"), *bits)
    near = F.floor((F.col("d") * hi + (F.col("nl") - F.col("n")) * lo) / F.lit(2 * hi)) + 1
    far = F.ceil((F.col("d") * percent - F.col("n") * lo) / F.lit(percent))
    short = F.col("d") - F.floor(F.col("n") * lo / F.lit(2 * percent))
    first = lambda least: F.col("d") - F.greatest(least, F.lit(1)) + 1 - (F.col("d") - F.col("common"))
    looks = {"near": F.col("rank") <= first(near), "far": F.col("rank") <= first(far), "short": F.col("rank") <= first(F.greatest(near, short))}
    meets = ranked.join(d.drop("parts"), [*keys, "id"]).withColumns(looks)
    words = [f"w{i}" for i in range(WORDS)]
    meets = meets.where("near or far and not linked").withColumn("rest", F.col("common") - F.col("rank") + 1)
    meets = stage(meets.select(*keys, "e", "id", "n", "d", "comp", "party", "linked", "common", "rest", *words, *looks), "meets")
    sizes = meets.groupBy(*keys, "e", "party").agg(F.count("*").alias("of")).groupBy(*keys, "e").agg(F.max(F.struct("of", "party")).alias("largest"), F.count("*").alias("parties"))
    sizes = stage(sizes.where("parties > 1").select(*keys, "e", F.col("largest.party").alias("largest")), "parties")
    meets = stage(meets.join(sizes, [*keys, "e"]).withColumn("other", F.col("party") != F.col("largest")).drop("largest"), "meets")
    side = lambda s: meets.select(*keys, "e", *looks, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "d", "comp", "party", "linked", "other", "common", "rest", *words)])

    def shareable(s: str, t: str) -> Column:
        return F.col(f"common_{s}") - reduce(Column.__add__, [F.bit_count(F.col(f"{w}_{s}").bitwiseAND(F.bitwise_not(f"{w}_{t}"))) for w in words])

    # At the first element that two members share no more than the rest of either follows, and no more than the bits allow.
    most = F.least("rest_x", "rest_y", shareable("x", "y"), shareable("y", "x"))
    enough = 2 * hi * most >= hi * (F.col("d_x").cast("long") + F.col("d_y")) - lo * (F.col("n_x").cast("long") + F.col("n_y"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.drop(*looks), y.drop(*looks)
        both = x.where("other_x").join(y, [*keys, "e"]).unionByName(x.where("not other_x").join(y.where("other_y"), [*keys, "e"]))
        return both.where("party_x <> party_y and comp_x <> comp_y").where(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")).where(enough)

    alone = met(side("x").where("not linked_x and short"), side("y").where("not linked_y and near")).where("struct(d_x, id_x) < struct(d_y, id_y)")
    mixed = met(side("x").where("not linked_x and far"), side("y").where("linked_y and near"))
    return links, alone.union(mixed).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    return groups_of(docs, id_col, text, width, percent).drop("row", "comp")


def groups_of(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """near_duplicates with row, the key of doc_id and text, and comp, the component's number (null without words)."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("row", row_key("doc_id", "text"))
    rows = stage(sketch(only, "text", width).drop("text"), "sketches")
    # A class has a 64-bit number from its digest; two classes of one number are told apart by set_key in every join back.
    classes = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "s1", "s2")])
    classes = stage(classes.withColumn("cid", F.xxhash64("set_key")), "classes")
    members = classes.select(F.col("cid").alias("id"), F.col("n_shingles").alias("n"), "s1", "s2", F.posexplode("bands").alias("no", "band"))
    # What is counted by bucket is written first: a join with it can then be split where a bucket is hot.
    shared = stage(members.groupBy("band").agg(F.count("*").alias("of")).where("of > 1"), "shared")
    members = stage(members.join(shared, "band").select("band", "no", "id", "n", "s1", "s2", "of"), "members")
    central = members.groupBy("id").agg(F.sum("of").alias("central"))
    members = stage(members.drop("of").join(central, "id"), "central")

    links: list[DataFrame] = []
    tried: list[DataFrame] = []
    comp = None

    def check(pairs: DataFrame, sets: DataFrame | None = None) -> None:
        nonlocal comp
        pairs = ordered(pairs)
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        if pairs.isEmpty():
            return
        tried.append(pairs)
        if sets is None:
            sets = class_sets(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), classes, only, width)
        new = verified(pairs, sets, percent)
        if not new.isEmpty():
            links.append(new)
            comp = connected_components(reduce(DataFrame.union, links))

    def labelled(own: DataFrame) -> DataFrame:
        """The members of buckets that hold more than one component, with their component and their bucket's leader."""
        if comp is None:
            out = own.withColumn("comp", F.col("id"))
        else:
            out = own.join(comp.withColumnRenamed("id", "of_id"), F.col("id") == F.col("of_id"), "left")
            out = out.select(*own.columns, F.coalesce("comp", "id").alias("comp"))
        leader = F.max(F.struct("central", "id", "n", "s1", "s2", "comp")).alias("leader")
        mixed = out.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), leader).where("lo <> hi")
        return out.join(stage(mixed.select("band", "leader"), "mixed"), "band")

    def with_leaders(own: DataFrame) -> DataFrame:
        pairs = own.select(F.struct("id", "n", "s1", "s2", "comp").alias("x"), F.col("leader").alias("y"))
        pairs = pairs.where((F.col("x.comp") != F.col("y.comp")) & may_link(percent))
        return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    check(with_leaders(labelled(members.where(F.col("no") < FIRST))))
    check(with_leaders(labelled(members)))
    rest = stage(labelled(members).drop("leader"), "rest")
    if not rest.isEmpty():
        sets = class_sets(rest.select(F.col("id").alias("cid")), classes, only, width)
        direct, pairs = by_leaders(families(stage(centred(rest), "own"), sets, percent), sets, percent)
        if not direct.isEmpty():
            links.append(direct)
            comp = connected_components(reduce(DataFrame.union, links))
        check(pairs, sets)

    heads = classes.select("set_key", "cid", F.col("doc"))
    if comp is not None:
        heads = heads.join(comp.select(F.col("id").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        first = heads.groupBy("comp").agg(F.min("doc").alias("component_id"))
        heads = heads.join(first, "comp")
    else:
        heads = heads.withColumns({"comp": F.col("cid"), "component_id": F.col("doc")})
    heads = heads.select(F.col("set_key").alias("of_set"), "component_id", "comp")
    out = rows.select("doc_id", "n_shingles", "set_key", "row").join(heads, F.col("set_key") == F.col("of_set"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row", "comp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one of the smallest doc_id. Of rows of a group that share it one stays;
    rows without words or without doc_id all stay."""
    groups = stage(groups_of(docs, id_col, text, width, percent).where("n_shingles > 0 and doc_id is not null"), "groups")
    shared = groups.where("kept").groupBy("doc_id", "comp").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
    shared = stage(shared, "shared")
    keyed = docs.withColumn("__row", row_key(id_col, text))
    gone = groups.where("not kept").select(F.col("row").alias("__row"))
    if not shared.isEmpty():
        others = groups.where("kept").join(shared, ["doc_id", "comp"]).where("row <> first")
        gone = gone.union(others.select("row"))
    out = keyed.join(small_or_shuffled(stage(gone.distinct(), "gone")), "__row", "left_anti")
    if not shared.isEmpty():  # whole rows that are repeated: one of each stays
        again = small_or_shuffled(shared.select(F.col("first").alias("__row")))
        out = out.join(again, "__row", "left_anti").unionByName(out.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    return out.select(docs.columns)
