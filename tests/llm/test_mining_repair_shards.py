"""Hard negatives, repair of conversations and shards, each against a plain version."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import hardneg, repair, shards
from tideglass.llm import queries as Q

SF = "/root/testdata/sf0.001"


def held(s):
    return min(max(s, -(2**63)), 2**63 - 1)


def mined(rows, every, k_pos, k_neg):
    """rows: (id, label, vector). All anchors' rows, by all pairs."""
    ok = [(i, g, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, g, v in rows if None not in (i, g, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, g, q) in enumerate(ok):
        if i % every:
            continue
        scored = sorted((-held(sum(a * b for a, b in zip(q, v, strict=True))), j, h) for m, (j, h, v) in enumerate(ok) if m != n and len(v) == len(q))
        for s, j, _ in [r for r in scored if r[2] == g][:k_pos]:
            fit = [r for r in scored if r[2] != g and 30 * -s <= 100 * -r[0] <= 90 * -s][:k_neg]
            out.update((i, j, r + 1, b, -s, -t) for r, (t, b, _) in enumerate(fit))
    return out


@pytest.mark.parametrize("tile_values", [1 << 20, 300])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, tile_values):
    monkeypatch.setattr(hardneg, "TILE_VALUES", tile_values)  # how many range partitions there are
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(4)), (rng.normal(0, 0.3, 6) + (i % 3)).tolist()) for i in range(400)]
    rows += [(1000 + i, 7 + i % 2, rng.normal(0, 1, 3).tolist()) for i in range(60)]
    same = rows[3][2]
    rows += [(2000 + i, i % 2, same) for i in range(300)]  # one vector, very often
    rows += [(20, 1, same), (20, 1, same), (40, None, same), (60, 1, None), (80, 1, [None] * 6), (100, 1, [float("nan")] * 6), (120, 2, [float("inf")] * 6), (None, 1, same), (140, 3, []), (141, 3, []), (142, 4, []), (160, 9, [0.0] * 6), (161, 9, [0.0] * 6)]
    rows += [(5000 + i, i % 2, [a * 1e15, b * 1e15]) for i, (a, b) in enumerate(rng.normal(0, 1, (30, 2)).tolist())] + [(5100, 0, [1e200, -1e200]), (5101, 1, [1e-200, 3.0]), (5102, 0, [1e18, 1.0]), (5120, 0, [2.0, 1.0]), (5121, 1, [1.0, 1.0])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("x", F.lit(1)).repartition(5)
    got = Counter(map(tuple, hardneg.mine(df, every=20, positives=3, negatives=4).collect()))
    want = mined(rows, 20, 3, 4)
    assert got == want and len(want) > 100
    assert hardneg.mine(df.where("false")).count() == 0
    assert hardneg.mine(df.where("label is null")).count() == 0


def test_best_first_prunes_and_loses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 8))
    x = np.floor(np.repeat(centres, 128, axis=0) + rng.normal(0, 5, (5120, 8)))
    labels = np.repeat(np.arange(40) % 5, 128)
    at = hardneg.packed_order(x, labels)
    assert sorted(at) == list(range(len(x)))
    tile = hardneg.Tile(at.copy(), at.copy(), labels[at], x[at])
    scored = 0
    for i in range(0, 5120, 500):
        q, low, high = x[i], np.array([-(2**63)]), np.array([2**63 - 1])
        lower, upper = (v[:, 0] for v in tile.bounds(q[None]))
        best = hardneg.Best(1, 5)
        scored += hardneg.best_first(tile, lower, upper, q, int(labels[i]), True, i, low, high, best)
        want = sorted((-int(x[j] @ q), j) for j in range(5120) if labels[j] == labels[i] and j != i)[:5]
        assert [(-s, j) for s, j, _ in zip(*best.held[0], strict=True)] == want
    assert scored < 0.3 * 11 * 40


def test_query_of_hard_negatives_has_its_anchors(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, Q.op11_hardneg(spark, SF).collect())) == mined(rows, 100, 5, 10)


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated), by shortest paths over whole strings."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, i, state, said = heapq.heappop(queue)
        if i == len(rows) and state in (0, 3):
            return cost, audit, said
        if (i, state, audit) in done:
            continue
        done.add((i, state, audit))
        for role in ("user", "assistant"):
            if (state, role[0]) in after and cost < 4 * len(rows) + 4:
                heapq.heappush(queue, (cost + 3, audit + "I", i, after[state, role[0]], (*said, f"{role}:")))
        if i < len(rows):
            role, text, go, cut = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, state, said))
            if not go:
                for kind, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (state, name[:1]) in after:
                        heapq.heappush(queue, (cost + price + 3 * cut, audit + kind, i + 1, after[state, name[:1]], (*said, f"{name}:{text}")))


def repaired(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
    seen, own, counts = set(), [], Counter()
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        blank, again, cut = not kept, (role, text) in seen, not kept.endswith((".", "!", "?"))
        counts["blank" if blank else "duplicate" if again else "truncated" if cut else "none"] += 1
        seen.add((role, text))
        own.append((role, text, blank or again, cut and not blank and not again))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, said = cheapest(own)
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(said)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_repair_against_shortest_paths(spark, coalesce):
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t\r\n", None, "Yes.", "long " * 30 + "a.", "long " * 30 + "b.", "ß\n."]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((c if c else None, rng.choice([t, t, t, 2 * t, None]), role, rng.choice(texts)))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(400)]  # one conversation over several partitions
    rows += [(501, 2**63 - 1, "user", "a."), (501, -(2**63), "assistant", "b.")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("AT", F.lit(1)).withColumn("sig", F.lit("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        report, fixed = repair.repair(df)
        got = {r.conv_id: tuple(r[1:-1]) for r in report.collect()}
        lines = {}
        for r in fixed.orderBy("at", "part").collect():
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        digests = {r.conv_id: r.sha256 for r in repair.line_digests(fixed, "conv_id", ["at", "part"], F.concat_ws(":", "role", "text")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_conv = {}
    for c, *rest in rows:
        by_conv.setdefault(c, []).append(rest)
    assert set(got) == set(by_conv)
    for c, own in by_conv.items():
        if c == 500:
            assert got[c] == (0, 0, 0, 0, 0, 0, "K" * 400)
            continue
        *numbers, said = repaired(own)
        numbers[0] = min(numbers[0], 2**63 - 1)
        assert got[c] == tuple(numbers), own
        assert "\n".join(lines.get(c, [])) == said
        assert digests.get(c, hashlib.sha256().hexdigest()) == hashlib.sha256(said.encode()).hexdigest()
    assert repair.repair(df.where("false"))[0].count() == 0


def test_automaton_shares_every_rest(spark):
    rng = random.Random(7)
    signatures = sorted({"".join(rng.choice("uaUAsxd") for _ in range(rng.randrange(3))) + rng.choice(["ua" * 20, "uaua", "uAd", ""]) for _ in range(300)})
    solved = repair.solve(spark.createDataFrame([(s,) for s in signatures], "sig string").coalesce(1)).collect()
    assert {r.sig for r in solved} == set(signatures)
    rests = {s[i:] for s in signatures for i in range(len(s))}
    assert sum(r.nodes for r in solved) == len(rests)  # a node is made once
    assert all(repair.common_suffix(a, b) == len(next(a[i:] for i in range(len(a) + 1) if b.endswith(a[i:]))) for a in signatures[:40] for b in signatures[:40])


def test_query_of_repair_damages_as_its_contract(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    extra = [(-7, None, None, None), (None, 3, "user", "Hello."), (-8, 1, "user", "Hi.")]
    damaged = {}
    for c, t, role, text in [tuple(r) for r in rows] + extra:
        role, text = (" " if v is None else v for v in (role, text))
        by = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = damaged.setdefault(c, [])
        if by:
            own += [(t, "user" if by == 4 else role, "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text)] * (2 if by == 3 else 1)
    from_spark = repair.damage(spark.createDataFrame([tuple(r) for r in rows] + extra, "conv_id long, turn long, role string, text string")).collect()
    assert Counter(map(tuple, from_spark)) == Counter((c, *r) for c, own in damaged.items() for r in own)
    got = {r.conv_id: tuple(r)[1:] for r in Q.op12_repair(spark, SF).collect()}
    for c, own in damaged.items():
        if c in got:
            *numbers, said = repaired(own) if own else (0, 0, 0, 0, 0, 0, "", "")
            assert got[c] == (*numbers, hashlib.sha256(said.encode()).hexdigest())
    assert set(got) == {r.conv_id for r in rows}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4096, 4097, 100_003])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    out = shards.permute(x, n, seed=n)
    assert sorted(out) == list(range(n))
    assert (shards.permute(out, n, seed=n, back=True) == x).all()
    shard, slot = shards.place(x, n, 16, seed=n)
    assert (shards.row_number_at(shard, slot, n, 16, seed=n) == x).all()
    if n >= 1000:
        assert len(set(shard[:200])) == 16 and abs(np.corrcoef(x, out)[0, 1]) < 0.1
        assert (shards.permute(x, n, seed=n + 1) != out).mean() > 0.9


def test_shards_depend_on_rows_alone(spark, tmp_path):
    rows = [(i % 300 if i % 5 else None, "x" * (i % 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SLOT int")
    one = shards.assign(df.repartition(7), 9, ["doc_id"], seed=3)
    two = shards.assign(df.orderBy(F.rand(1)).coalesce(2), 9, ["doc_id"], seed=3)
    assert one.columns == ["doc_id", "text", "row_number", "shard", "slot"]
    got = sorted(map(tuple, one.collect()), key=repr)
    assert got == sorted(map(tuple, two.collect()), key=repr)
    assert sorted(r[2] for r in got) == list(range(3000))
    assert [r[0] for r in sorted(got, key=lambda r: r[2])] == sorted((r[0] for r in rows), key=lambda v: (v is not None, v or 0))
    counts = Counter(r[3] for r in got)
    assert set(counts) == set(range(9)) and max(counts.values()) - min(counts.values()) <= 1
    for s, c in counts.items():
        assert sorted(r[4] for r in got if r[3] == s) == list(range(c))
    shards.write(one, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(one.columns).collect()), key=repr) == got
    for folder in (tmp_path / "out").glob("shard=*"):
        slots = [r.slot for f in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)
    assert shards.assign(df.where("false")).count() == 0


def test_query_of_shards(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op13_shards(spark, SF).collect():
        data = docs.pop(r.doc_id).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert not docs
