"""Repair of the turn structure of conversations, by an automaton of what is left of them.

A conversation's rows, in order, become a signature: a letter for each row's role initial and fault. What a rest of a
signature costs, and the first of its cheapest edits in ASCII order, depend on nothing but that rest and on the state of
the grammar `(s?(ua)+)?` in which it is met. So the signatures of all conversations are put into one acyclic automaton
that shares every common rest: its nodes are the distinct suffixes, minimised from the end. Distinct signatures are
dealt and sorted by their reversed text; in that order the nodes of a signature are those that it has in common with its
predecessor, which still lie on a stack, and new ones. Each node gets, for each of the four states, its cost to go and its
best edits as (edits up to the next row, state there, rank of the best audits among the four states), so a node takes
constant time and space, however long the rest is; a task holds one path.

Rows are ordered once, over range partitions that cut a long conversation; a piece of a conversation in one partition
gives a piece of its signature. Edits are dealt back to rows by equal row keys. Only the signature and the audit of a
conversation, some bytes a row, are ever one value.

Edits: keep (0), rerole to user or assistant (3), delete (4), insert an empty user or assistant row (3); a truncated row
that stays costs 3 more; blank and duplicate rows are deleted.

Defined cases: a null role or text is one space; turns are integers, nulls first; rows of one turn are in the order of
role, then of text (its first 64 characters, then its MD5), so equal rows stand together; all rows with a null conv_id are
one conversation; a role counts by its first character; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, stage

#: State after one more row of an initial; the states are nothing, system, user and assistant last.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The state after the one row that may be put in, and who speaks it.
ADDED, SPEAKER = (2, 2, 3, 2), "uuau"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A plan writes what is put in as u or a, a new role as U or A; the audit has I and R for them.
AUDIT = str.maketrans("uaUA", "IIRR")

BLANK = r"[\x20\x09-\x0D]*"
SOLVED = T.StructType([T.StructField("sig", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("plan", T.StringType()), T.StructField("nodes", T.LongType())])

#: Of a state at a node: cost to go, edits up to and with the next row, state after it, rank among the states' audits.
Best = tuple[int, str, int, int]


def ranked(best: list[tuple[int, str, int, int]]) -> list[Best]:
    """best with the rank below replaced by the rank of each whole audit among them."""
    keys = [(plan.translate(AUDIT), below) for _, plan, _, below in best]
    place = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [(cost, plan, state, place[k]) for (cost, plan, state, _), k in zip(best, keys, strict=True)]


def end_node() -> list[Best]:
    """After the last row: what must still be put in."""
    out = []
    for state in range(4):
        plan = ""
        while state not in (0, 3):
            plan, state = plan + SPEAKER[state], ADDED[state]
        out.append((INSERT * len(plan), plan, state, 0))
    return ranked(out)


def node(letter: str, below: list[Best]) -> list[Best]:
    """The node of a row before the rest below. letter: s, u, a or x, upper case if truncated; d if it must go."""
    taken = []
    for state in range(4):
        ways = [(DELETE, "D", state)]
        if letter != "d":
            more = TRUNCATED if letter.isupper() else 0
            ways.append((REROLE + more, SPEAKER[state].upper(), ADDED[state]))
            if state in AFTER.get(letter.lower(), {}):
                ways.append((KEEP + more, "K", AFTER[letter.lower()][state]))
        taken.append(min(((cost + below[to][0], plan, to, below[to][3]) for cost, plan, to in ways), key=order))
    best = []
    for state in range(4):
        ways, at, put = [], state, ""
        for _ in range(4):
            cost, plan, to, rank = taken[at]
            ways.append((cost + INSERT * len(put), put + plan, to, rank))
            put, at = put + SPEAKER[at], ADDED[at]
        best += nsmallest(1, ways, key=order)
    return ranked(best)


def order(way: tuple[int, str, int, int]) -> tuple[int, str, int]:
    return way[0], way[1].translate(AUDIT), way[3]


def solve(signatures: DataFrame) -> DataFrame:
    """(sig, cost, plan, nodes) of distinct signatures; nodes: how many it added to its task's automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last = [end_node()], ""
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for sig in batch.column(0).to_pylist():
                shared = common_suffix(sig, last)
                del path[shared + 1 :]
                for letter in reversed(sig[: len(sig) - shared]):
                    path.append(node(letter, path[-1]))
                state, plan = 0, []
                for own in reversed(path):
                    plan.append(own[state][1])
                    state = own[state][2]
                for column, value in zip(out, (sig, path[-1][0][0], "".join(plan), len(sig) - shared), strict=True):
                    column.append(value)
                last = sig
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=SOLVED.names)

    back = F.reverse("sig")
    dealt = signatures.select("sig").repartitionByRange(F.left(back, F.lit(256))).sortWithinPartitions(back)
    return dealt.mapInArrow(run, SOLVED)


def common_suffix(a: str, b: str) -> int:
    n, step = 0, min(len(a), len(b))
    while step:  # halving steps compare slices, not characters
        if n + step <= min(len(a), len(b)) and a[len(a) - n - step : len(a) - n] == b[len(b) - n - step : len(b) - n]:
            n += step
        else:
            step //= 2
    return n


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in, by crc32(conv_id:turn) % 20 (nulls: one space): 0 drops, 1 empties the text, 2 takes its
    [.!?], 3 repeats the row, 4 makes the role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.encode(key, "UTF-8")) % 20).alias("__by"))
    by = F.col("__by")
    text = F.when(by == 1, "").when(by == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(by != 0).select("conv_id", "turn", F.when(by == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): at is unique and follows the order of conversations and their rows."""
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    own = own.withColumn("__d", F.md5("text")).withColumn("__n", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.left("text", F.lit(64)).asc(), F.asc("__d"), F.asc("__n")]
    return stage(own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "ordered")


def faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault): fault is blank, duplicate, truncated or none, the first that holds."""
    light = ordered.select(
        "conv_id", "turn", "at", row_key("conv_id", "role", "text").alias("key"),
        F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x").alias("initial"),
        F.rlike("text", F.lit(rf"\A{BLANK}\z")).alias("blank"), F.rlike("text", F.lit(rf"[.!?]{BLANK}\z")).alias("ended"),
    )
    seen = light.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    again = F.col("first").isNotNull() & (F.col("at") > F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(~F.col("ended"), "truncated").otherwise("none")
    return light.join(seen, "key", "left").select("conv_id", "turn", "at", "initial", fault.alias("fault"))


def pieces_of(rows: DataFrame) -> DataFrame:
    """One row for each conversation and range partition: its signature there, and what its report adds up."""
    fault = F.col("fault")
    letter = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    own = F.array_sort(F.collect_list(F.struct("at", letter.alias("letter"), "initial")))
    counts = [F.count_if(fault == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    grouped = rows.groupBy("conv_id", F.shiftright("at", 33).alias("piece")).agg(F.min("at").alias("first"), F.count("*").alias("n"), *counts, F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"), own.alias("own"))
    text = lambda c: F.array_join(F.transform("own", lambda r: r[c]), "")
    return grouped.select("conv_id", "piece", "first", "n", "blank", "duplicate", "truncated", "low", "high", "turns", text("letter").alias("sig"), text("initial").alias("roles"))


def reports(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, sig, parts) of each conversation."""
    whole = pieces.groupBy("conv_id").agg(
        *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "turns")), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_list(F.struct("first", "n", "low", "high", "sig", "roles"))).alias("parts"),
    )
    meet = F.size(F.filter("parts", lambda p, i: F.get("parts", i - 1)["high"] == p["low"]))  # a turn on both sides of a cut
    roles = F.array_join(F.transform("parts", lambda p: p["roles"]), "")
    legal = F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    span = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns") + meet
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.least(span.cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long"))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.char_length(roles) - 1 - legal).cast("long").alias("illegal"), F.array_join(F.transform("parts", lambda p: p["sig"]), "").alias("sig"), F.transform("parts", lambda p: F.struct(p["first"].alias("first"), p["n"].alias("n"))).alias("parts"))


def edited(ordered: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, turn, at, part, edit, role, text) of the repaired rows, in the order of at and part; solved: reports with
    plans. A row that was put in has the turn of the row at which it was."""
    tokens = F.regexp_extract_all("plan", F.lit("[ua]*[KDUA](?:[ua]+$)?"), 0)
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda n, p: n + p["n"])
    parted = solved.select(tokens.alias("tokens"), F.transform("parts", lambda p, i: F.struct(p["first"].alias("first"), p["n"].alias("n"), before(i).alias("skip"))).alias("parts"))
    parted = parted.select("tokens", F.explode("parts").alias("p")).select("p.first", F.slice("tokens", (F.col("p.skip") + 1).cast("int"), F.col("p.n").cast("int")).alias("tokens"))
    by_row = parted.select("first", F.posexplode("tokens").alias("i", "token")).select((F.col("first") + F.col("i")).alias("at"), "token")
    op = F.regexp_extract("token", "[KDUA]", 0)
    put = lambda s: F.transform(F.regexp_extract_all(s, F.lit("[ua]"), 0), lambda c: F.struct(F.lit("insert").alias("edit"), who(c).alias("role"), F.lit("").alias("text")))
    role = F.when(op == "K", F.col("role")).otherwise(who(F.lower(op)))
    own = F.when(op == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(F.struct(F.when(op == "K", "keep").otherwise("rerole").alias("edit"), role.alias("role"), F.col("text").alias("text"))))
    whole = F.concat(put(F.regexp_extract("token", "^[ua]*", 0)), own, put(F.regexp_extract("token", "[ua]*$", 0)))
    return ordered.join(by_row, "at").select("conv_id", "turn", "at", F.posexplode(whole).alias("part", "row")).select("conv_id", "turn", "at", "part", "row.edit", "row.role", "row.text")


def who(c: Column) -> Column:
    return F.when(c == "u", "user").otherwise("assistant")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, plan) and its
    repaired rows (see edited)."""
    ordered = in_order(rows)
    whole = stage(reports(pieces_of(faults(ordered))), "reports")
    solved = stage(solve(whole.select("sig").distinct()).select("sig", "cost", "plan"), "solved")
    report = whole.join(solved, "sig")
    audit = F.translate("plan", "uaUA", "IIRR")
    return report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"), "plan"), edited(ordered, report)


def line_digests(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, sha256): lowercase hex of each key's lines in order, joined by newlines. Lines stream through their key's task
    in order and are never held together; a digest of one text is sequential, so one key is one task's."""
    fields = T.StructType([rows.schema[key], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            ended: tuple[list, list] = ([], [])
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or own != now:
                    if digest is not None:
                        ended[0].append(now), ended[1].append(digest.hexdigest())
                    now, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(text.encode("utf-8", "surrogatepass"))
            kind = batch.schema.types[0]
            yield pa.RecordBatch.from_arrays([pa.array(ended[0], type=kind), pa.array(ended[1], type=pa.string())], names=fields.names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], type=kind), pa.array([digest.hexdigest()], type=pa.string())], names=fields.names)

    return rows.select(key, *order, line.alias("__line")).repartition(key).sortWithinPartitions(key, *order).select(key, "__line").mapInArrow(run, fields)
