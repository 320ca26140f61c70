"""Each operator against a plain version, on the small tables and on rows made to be awkward."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.llm import bpe, chat, decontam, langid, minhash, quality, secrets, suffix, topk, warc
from tideglass.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def small(spark, limit=None):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return rows[:limit]


@pytest.fixture(scope="module")
def awkward(spark):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word7 ", "other ").replace("word250 ", "")
    texts = [None, "", "   \t\n", "one", "One", "two words", base, base, near, "ß " * 90_000, "x" * 50_000, "a b c d", "A B C D", "日本語 テスト 🙂 é", "<|im_end|>&lt;|", base + " tail " + base]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"host{i % 2}/p", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("IDS", F.lit("x")).withColumn("bins", F.lit(2.5)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def test_bpe_equals_library_and_decodes(spark, awkward):
    enc, path, pattern = tiktoken_encoding()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    out = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert bpe.encode_and_decode(docs, path, pattern).select(*out[0].asDict()).collect() == out
    assert bpe.encode_and_decode(empty(spark), path, pattern).count() == 0
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(awkward, path, pattern).columns == [c for c in awkward.columns if c != "IDS"] + ["ids"]
    assert bpe.encode(empty(spark), path, pattern).count() == 0


def test_perfect_hash_is_minimal():
    _, path, pattern = tiktoken_encoding()
    v = bpe.vocabulary(path, pattern)
    assert sorted(v.slot_id) == list(range(len(v.tokens)))
    assert [v.lookup(t) for t in v.tokens] == list(range(len(v.tokens)))
    assert v.lookup(b"no such token at all") == v.lookup(b"\xff\xfe\xfd") == -1


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, awkward, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = docs.unionByName(awkward.select("doc_id", "text"))
    rows = docs.collect()
    sets = [shingles(r.text, width) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp, first = components(len(rows), links), {}
    for r, c in zip(rows, comp, strict=True):
        if r.doc_id is not None:
            first[c] = min(first.get(c, r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, len(s), first.get(c) if s else r.doc_id) for r, s, c in zip(rows, sets, comp, strict=True))
    got = minhash.near_duplicates(docs, width=width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_group_with_distant_members(spark):
    """A chain whose ends are far apart, and a template family that is not linked, fall into the same buckets."""
    base = [f"w{i}" for i in range(200)]
    chain = [base[i * 4 :] + [f"v{j}" for j in range(i * 4)] for i in range(20)]
    family = [base[:120] + [f"f{k}x{i}" for i in range(80)] for k in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(chain + family)]
    sets = [shingles(t, 4) for _, t in rows]
    comp = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == comp
    assert len(set(comp)) == 41


def test_near_links_inside_a_family(spark):
    """Copies of one template with few, many, shared and lost words: linked to the leader, to each other or to nobody."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    texts = [base]
    for k in range(260):
        t = list(rng.choice(texts[-30:]) if k % 4 == 0 else base)
        for _ in range(rng.choice((1, 3, 5, 6, 8, 11))):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(([], [f"n{rng.randrange(10**6)}"], [f"n{rng.randrange(4)}"], [t[i], f"n{rng.randrange(10**6)}"]))
        texts.append(t[: rng.choice((999, 999, 150))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles(t, 4) for _, t in rows]
    for percent in (80, 70):
        links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        comp = components(len(rows), links)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, percent=percent).collect()}
        assert [got[i] for i in range(len(rows))] == comp
        assert 20 < len(set(comp)) < 250
    # The last step alone: every class in one bucket, nothing linked before.
    ids = spark.createDataFrame([(i, [hash(s) for s in sorted(own)]) for i, own in enumerate(sets)], "cid long, shingles array<long>")
    rest = ids.select(F.lit(0).alias("band"), F.col("cid").alias("id"), F.when(F.col("cid") == 0, 1).otherwise(0).alias("central"), F.col("cid").alias("comp"))
    links = {(j, i) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    direct, pairs = minhash.by_difference(rest, ids, 80)
    direct, pairs = ({tuple(r) for r in minhash.ordered(x).collect()} for x in (direct, pairs))
    near = {a for a, b in links if b == 0} | {b for a, b in links if a == 0}
    assert direct == {p for p in links if 0 in p}
    assert {p for p in links if 0 not in p and not near.issuperset(p)} <= pairs
    assert len(pairs) < len(rows) ** 2 / 12


def test_copies_that_lose_much_of_a_template_make_few_pairs(spark):
    """Copies that lack different parts of one template share lost elements by chance; only those that share enough become pairs."""
    import random

    rng = random.Random(5)
    word = lambda: rng.getrandbits(64) - 2**63
    template = [word() for _ in range(147)]
    for n in (60, 240):
        sets = [set(template)] + [set(rng.sample(template, 111)) | {word(), word()} for _ in range(n)]
        sets += [own - {rng.choice(sorted(own))} for own in sets[1 : n // 10]]
        ids = spark.createDataFrame([(i, sorted(own)) for i, own in enumerate(sets)], "cid long, shingles array<long>")
        rest = ids.select(F.lit(0).alias("band"), F.col("cid").alias("id"), F.when(F.col("cid") == 0, 1).otherwise(0).alias("central"), F.col("cid").alias("comp"))
        direct, pairs = minhash.by_difference(rest, ids, 80)
        links = {(j, i) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        got = [tuple(r) for r in pairs.select(F.least("a", "b"), F.greatest("a", "b")).collect()]
        assert direct.isEmpty() and len(links) == n // 10 - 1 and links <= set(got)
        assert len(got) <= 2 * n


def test_near_families_in_one_bucket(spark):
    """Copies of several templates in one bucket: pairs grow with the copies, and no link is lost."""
    import random

    def in_one_bucket(sets):
        ids = spark.createDataFrame([(i, sorted(own)) for i, own in enumerate(sets)], "cid long, shingles array<long>")
        rest = ids.select(F.lit(0).alias("band"), F.col("cid").alias("id"), F.when(F.col("cid") == 0, 1).otherwise(0).alias("central"), F.col("cid").alias("comp"))
        direct, pairs = minhash.by_leaders(minhash.families(minhash.centred(rest), ids, 80), ids, 80)
        return [[tuple(r) for r in minhash.ordered(x).collect()] for x in (direct, pairs)]

    common = set(range(100))
    template = lambda k: common | set(range(1000 * k, 1000 * k + 60))
    for own in (18, 24):
        for n in (300, 1200):
            sets = [template(1 + i % 3) | set(range(10**6 + 100 * i, 10**6 + 100 * i + own)) for i in range(n)]
            direct, pairs = in_one_bucket(sets)
            assert len(direct) + len(pairs) <= 2 * n
            assert len(set(components(n, direct + pairs))) == (3 if own == 18 else n)

    rng = random.Random(3)
    sets = []
    for i in range(240):
        t = set(rng.choice(sets[-20:])) if i % 5 == 4 else template(1 + i % 3)
        t -= set(rng.sample(sorted(t), rng.choice((0, 2, 6, 9))))
        sets.append(t | {10**6 + rng.randrange(40 if i % 2 else 10**6) for _ in range(rng.choice((2, 9, 12, 18, 24)))})
    links = [(j, i) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    direct, pairs = in_one_bucket(sets)
    assert set(direct) <= set(links)
    assert components(len(sets), direct + [p for p in pairs if p in set(links)]) == components(len(sets), links)


def test_drop_near_duplicates(spark, awkward):
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({None: 2, 0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 9: 1, 10: 1, 11: 1, 13: 1, 14: 1})
    assert minhash.drop_near_duplicates(empty(spark)).count() == 0


def test_language_of_held_out_rows(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    got = {r.doc_id: r for r in langid.identify(awkward).where("doc_id is not null").collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0.0
    assert got[6].lang_pred == "en" and 0 <= got[6].score <= 1
    assert langid.identify(empty(spark)).count() == 0
    import zlib as z

    assert all(r.held_out == (z.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_language_distances_against_a_plain_version(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(awkward.select("doc_id", "text", "lang")).unionByName(spark.createDataFrame([(9001, "ΑΒΓ αβγ ｆ１", "el"), (9002, "İß ﬁ", "tr"), (9003, "a", None), (9004, "12 !?", "en")], "doc_id long, text string, lang string"))
    rows = docs.collect()

    def counted(text):
        x = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        x = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in x))
        own = [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1) if x[i : i + n] != " "]
        return Counter(sum((0 if c == " " else ord(c)) << 21 * i for i, c in enumerate(reversed(g))) for g in own) if x.strip() else Counter()

    top = lambda c: sorted(c, key=lambda g: (-c[g], g))[:400]
    sums = defaultdict(Counter)
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    for r in rows:
        if r.lang is not None and r.text is not None and not out_of(r.doc_id):
            sums[r.lang] += counted(r.text)
    ranks = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in sums.items() if c}
    want = Counter()
    for r in rows:
        mine = top(counted(r.text or ""))
        far = sorted((sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(mine)), lang) for lang, p in ranks.items()) if mine else []
        want[r.doc_id, out_of(r.doc_id), far[0][1] if far else "und", round(1 - far[0][0] / (400 * len(mine)), 9) if far else 0.0] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()) == want


def test_rare_languages_are_sampled_whole(spark):
    rows = [(i, "the text", "en") for i in range(5000)] + [(10_000 + i, "der text", "de") for i in range(40)]
    got = Counter(r.lang for r in langid.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "lang", 500).collect())
    assert got["de"] == 40 and 400 < got["en"] < 600


def test_quality_against_a_plain_version(spark, awkward):
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(awkward.select("doc_id", "text", "source"))
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(6, 1), (6, 0), (7, None), (99_999, 1)]
    rows = docs.collect()
    said = defaultdict(list)
    for i, q in labels:
        if q is not None:
            said[i].append(q)
    label = [sum(said[r.doc_id]) / len(said[r.doc_id]) if r.doc_id in said else None for r in rows]
    bins = [quality.measured(r.text) for r in rows]
    good, bad = sum(x for x in label if x is not None), sum(1 - x for x in label if x is not None)
    table = [[math.log((sum(x for x, b in zip(label, bins, strict=True) if x is not None and b[f] == v) + 0.5) / (good + 0.5 * n)) - math.log((sum(1 - x for x, b in zip(label, bins, strict=True) if x is not None and b[f] == v) + 0.5) / (bad + 0.5 * n)) for v in range(n)] for f, n in enumerate(len(e) + 1 for e in quality.EDGES.values())]
    center = (good + 1) / (good + bad + 2)
    used = {(f, b[f]) for x, b in zip(label, bins, strict=True) if x is not None for f in range(len(table))}
    evidence = [round(sum(table[f][v] if (f, v) in used else 0.0 for f, v in enumerate(b)), 9) for b in bins]
    seen = [x if x is not None else 1 / (1 + math.exp(-(e + math.log(center / (1 - center))))) for x, e in zip(label, evidence, strict=True)]
    path = [r.source or "" for r in rows]
    host = [p.split("/")[0] for p in path]

    def sums(keys):
        out = defaultdict(lambda: [0.0, 0])
        for k, s in zip(keys, seen, strict=True):
            out[k][0] += s
            out[k][1] += 1
        return out

    hosts, paths, mean = sums(host), sums(path), sum(seen) / len(seen)

    def moments(own):
        own = [(g, n, c) for g, n, c in own if n > 1]
        n, n2, within = sum(n for _, n, _ in own), sum(n * n for _, n, _ in own), sum(n * c * (1 - c) for _, n, c in own)
        if len(own) < 2 or not within:
            return 10.0
        p = within / n
        between = (sum(n * (g / n - c) ** 2 for g, n, c in own) - p * len(own)) / max(n - n2 / n, 1e-9)
        return min(max(p / between - 1, 1.0), 1e4) if between > 1e-9 else 1e4

    m = moments([(g, n, mean) for g, n in hosts.values()])
    rate = {h: (g + m * mean) / (n + m) for h, (g, n) in hosts.items()}
    k = moments([(g, n, rate[p.split("/")[0]]) for p, (g, n) in paths.items()])
    want = []
    for r, e, s, h, p in zip(rows, evidence, seen, host, path, strict=True):
        others = (hosts[h][0] - s + m * mean) / (hosts[h][1] - 1 + m)
        prior = min(max((paths[p][0] - s + k * others) / (paths[p][1] - 1 + k), 1e-6), 1 - 1e-6)
        want.append((str(r.doc_id), h, round(e, 6), rate[h], 1 / (1 + math.exp(-(e + math.log(prior / (1 - prior)))))))
    got = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    got = sorted((str(r.doc_id), r.host, round(r.evidence, 6), r.host_rate, r.probability) for r in got)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-6)


def test_quality_learns_labels(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.classify(docs, train).join(test, "doc_id").collect()
    assert sum(r.accepted == (r.quality == 1) for r in out) / len(out) > 0.95
    odd = quality.classify(awkward, spark.createDataFrame([(6, 1), (6, None), (None, 1), (99, 0), (3, 0), (3, 1)], "doc_id long, quality int"))
    assert odd.count() == awkward.count()
    none = quality.classify(awkward, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.probability == 0.5 and r.accepted for r in none)
    assert quality.classify(empty(spark), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "some plain words here", "en", "big" if i < 400 else "tiny", 1) for i in range(402)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(400)] + [(400, 0), (401, 0)], "doc_id long, quality int")
    got = {r.host: r for r in quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert abs(got["big"].host_rate - 0.9) < 0.01 and 0 < got["tiny"].host_rate < got["big"].host_rate


def test_chat_round_trip_and_states(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", "&lt;| & <| &amp;lt;|"), (2, 0, "assistant", "x"), (3, 0, "user", None), (3, 1, "assistant", "a🙂"), (3, 1, "assistant", "a🙂"),
            (None, None, None, None), (4, 5, "user", ""), (4, 3, "to\nol", "t\n\nu"), (5, 0, "user", "q"), (5, 1, "assistant", ""), (5, 2, "user", "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    done = chat.format_conversations(df)
    out = {r.conv_id: r for r in done.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: False, 3: False, None: False, 4: False, 5: False}
    for k, r in out.items():
        own = sorted(((t, a or "", b or "") for c, t, a, b in rows if c == k), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert [(b.role, b.text) for b in r.back] == [(a, b) for _, a, b in own]
        assert r.loss == "".join(b for _, a, b in own if a == "assistant")
        assert r.formatted.count("<|im_start|>") == len(own)
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_conversations(df.where("false")).count() == 0


def base_secrets(text):
    found = []
    for rank, (kind, pattern, least, group) in enumerate((("assign", secrets.ASSIGN.replace("(?i)", ""), 6, 2), ("access", secrets.ACCESS, 20, 0), ("hex", secrets.HEX, 24, 0))):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
            if len(m[group]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_secrets_base_spans(spark, awkward):
    odd = ["password = token: abc", "🙂 API-KEY='abcdef1' Secret:\"zzzzzz\" token:short", "AKIA" + "A" * 15, "xAKIA" + "B7" * 10 + " AKIAAKIA", "f" * 23 + " " + "0a" * 12 + "g", "passwd  :   hunter2hunter2=token:aaaaaaaa", "é" * 5 + "secret=" + "q" * 8 + "🙂token=" + "r" * 9]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    out = secrets.find_secrets(docs, model=secrets.train(docs)).collect()
    for r in out:
        spans = [(s.start, s.rank, s.stop, s.kind) for s in r.secrets]
        assert spans == sorted(spans)
        assert [s for s in spans if s[3] != "markov"] == base_secrets(r.text)
    assert sum(s.kind == "markov" for r in out for s in r.secrets) < len(out) // 20


def test_secrets_by_models(spark):
    import random

    rng = random.Random(5)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    names = ["the", "reader", "value", "count", "index", "station", "nation", "handle", "request", "configuration", "version", "update2", "item10"]
    rows = [(i, " ".join(rng.choice(names) for _ in range(60)) + f" token={key(40)} " + "_".join(rng.choice(names) for _ in range(4))) for i in range(300)]
    fresh = [key(40) for _ in range(50)]
    plain = ["_".join(rng.choice(names) for _ in range(6)) + "1" for _ in range(50)]
    table = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    test = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(fresh + plain)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.secrets] for r in secrets.find_secrets(test, model=table).collect()}
    assert sum(bool(got[i]) for i in range(50)) >= 45 and not any(got[i] for i in range(50, 100))
    clean = {r.doc_id: r.text for r in secrets.redact(test, model=table).collect()}
    assert clean[0] == "see [SECRET] here" and clean[60] == f"see {plain[10]} here"


def test_secrets_learn_from_all_rows_that_hold_one(spark):
    import random

    rng = random.Random(6)
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    names = ["reader", "station", "configuration", "version", "request", "handle"]
    line = lambda: " ".join(rng.choice(names) for _ in range(12)) + " " + "_".join(rng.choice(names) for _ in range(5))
    rows = [(i, line()) for i in range(3000)] + [(3000 + i, f"{line()} token={key()}") for i in range(30)]
    table = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"), sample=20)
    test = spark.createDataFrame([(i, f"see {key()} here") for i in range(50)], "doc_id long, text string")
    assert table is not None and sum(r.secrets[0].kind == "markov" for r in secrets.find_secrets(test, model=table).collect() if r.secrets) >= 40


def test_planted_random_tokens_are_found(spark):
    """Random tokens of several kinds among real documents; the threshold is set on tokens that were held out."""
    import random
    import string

    rng = random.Random(12)
    kinds = [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF"]
    key = lambda k, n: "".join(rng.choice(kinds[k]) for _ in range(n))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    rows, planted = [], {}
    for i, t in enumerate(texts):
        if i % 10 == 0:
            rows.append((i, f"{t} token={key(i // 10 % 4, 36)}"))
        elif i % 10 == 1:
            planted[i] = len(t) + 5, len(t) + 5 + 32
            rows.append((i, f"{t} key {key(i // 10 % 4, 32)} end"))
        else:
            rows.append((i, t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train(docs)
    assert model.recall >= 0.9
    out = {r.doc_id: [(s.start, s.stop) for s in r.secrets if s.kind == "markov"] for r in secrets.find_secrets(docs, model=model).collect()}
    assert sum(span in out[i] for i, span in planted.items()) >= 0.9 * len(planted)
    assert sum(bool(own) for i, own in out.items() if i not in planted) < len(rows) / 200


def test_markov_ratios_against_a_plain_version(spark):
    import math

    docs = spark.createDataFrame([(1, "token=Zx9Qk2Lm8Vb token=P0oT7yR5wX1 secret: QzX83jKd0LmN"), (2, "reader_station configuration value_of_index another_handle"), (3, "version request handler nation")], "doc_id long, text string")
    tokens = secrets.labelled_tokens(docs).collect()
    assert {r.token for r in tokens if r.secret} == {"Zx9Qk2Lm8Vb", "P0oT7yR5wX1", "QzX83jKd0LmN"}
    used = [c for c in map(chr, range(128)) if c.isalnum() or c in "+/_=-."]
    n = {True: Counter(), False: Counter()}
    for r in tokens:
        w = 1 if r.secret or r.n > 1 else secrets.ONCE
        for t, v in [(r.token, w)] + [(r.token.upper(), w * secrets.ONCE)] * (not r.secret):
            for i in range(len(t) - 1):
                n[r.secret][t[i : i + 2]] += v * (not r.held)

    def chance(label, a, b):
        total = sum(n[label].values())
        single = (sum(v for k, v in n[label].items() if k[1] == b) + 0.5) / (total + 0.5 * len(used))
        back = 64 if label else 4
        return math.log((n[label][a + b] + back * single) / (sum(v for k, v in n[label].items() if k[0] == a) + back))

    model = secrets.train(docs)
    for a, b in (("Z", "x"), ("r", "e"), ("_", "s"), ("9", "Q"), ("q", "q")):
        assert abs(model.ratios[ord(a) * 128 + ord(b)] - (chance(True, a, b) - chance(False, a, b))) < 1e-9


def test_secrets_sample_is_of_distinct_texts(spark):
    copies = spark.range(4000).select(F.lit("one text in many copies").alias("text"))
    docs = copies.union(spark.range(400).select(F.concat(F.lit("text number "), F.col("id").cast("string"))))
    got = secrets.ordinary_texts(docs, 100).collect()
    assert 60 <= len(got) <= 150 and len({r.text for r in got}) == len(got)
    assert secrets.ordinary_texts(docs, 5000).count() == 401


def test_redact_keeps_the_rest(spark, awkward):
    docs = awkward.unionByName(spark.createDataFrame([(70, "a password: hunter22 b AKIA" + "C" * 16 + ".", None, None, None)], DOCS), allowMissingColumns=True)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 70").first().text == "a [SECRET] b [SECRET]."
    assert out.where("doc_id = 0").first().text is None
    assert secrets.redact(empty(spark)).count() == 0 and secrets.train(empty(spark)) is None


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (5, "u", "other"), (None, "n", "<p>x</p>"), (-7, "m", "q"), (9, "z", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    root, manifest = warc.write(pages, str(tmp_path / "w"), roll_bytes=400, shards=3)
    out = warc.read(spark, root, manifest).collect()
    b32 = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter((p, len((h or "").encode()), b32(h or "")) for p, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in out)
    assert kinds == Counter([(1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "revisit", 5), (5, "response", None), (-7, "response", None), (9, "revisit", -7)])
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    assert all(r.payload.decode() == "é" * 70_000 for r in out if r.payload_bytes == 140_000 and r.record_type == "response")
    again = warc.write(pages.repartition(5), str(tmp_path / "v"), roll_bytes=400, shards=3)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))
    for r in manifest.collect():
        with open(f"{root.removeprefix('file://')}/{r.file}", "rb") as f:
            data = f.read()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
        assert zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1\r\n")
    none = warc.write(pages.where("false"), str(tmp_path / "e"))
    assert warc.read(spark, *none).count() == 0


def test_warc_shards_of_far_ids(spark, tmp_path):
    """Ids in clumps, one far away: every shard has its part, and the files do not hang on the session's cores."""
    ids = [*range(500), 2**50, *range(10**9, 10**9 + 300), -(2**62), *[5 + 10**12 * i for i in range(100)]]
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 200) for i in ids], "page_id long, url string, html string")
    root, manifest = warc.write(pages, str(tmp_path / "a"), shards=8)
    records = {}
    for r in manifest.collect():
        records[r.file[:12]] = records.get(r.file[:12], 0) + r.records
    assert sum(records.values()) == len(ids) and len(records) == 8 and max(records.values()) < 2.5 * len(ids) / 8
    again = warc.write(pages.coalesce(1), str(tmp_path / "b"))[1], warc.write(pages.repartition(7), str(tmp_path / "c"))[1]
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, again[1].collect()))
    assert [r.page_id for r in warc.read(spark, root, manifest).where("page_id = -4611686018427387904").collect()] == [-(2**62)]
    (tmp_path / "a" / manifest.first().file).unlink()
    with pytest.raises(FileNotFoundError, match="manifest"):
        warc.read(spark, root, manifest)


def test_warc_deals_null_ids_and_shards_evenly(spark, tmp_path):
    pages = spark.createDataFrame([(i if i % 2 else None, f"u{i}", f"page {i} " * 20) for i in range(800)] + [(None, f"c{i}", "same " * 20) for i in range(20)], "page_id long, url string, html string")
    root, manifest = warc.write(pages, str(tmp_path / "n"), shards=8)
    sizes = [r.records for r in manifest.groupBy(F.regexp_extract("file", r"(\d+)", 1).alias("shard")).agg(F.sum("records").alias("records")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    out = warc.read(spark, root, manifest).collect()
    assert sum(r.page_id is None for r in out) == 420 and sum(r.record_type == "revisit" for r in out) == 19
    again = warc.write(pages.repartition(5), str(tmp_path / "m"), shards=8)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_warc_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    out = {r.page_id: r.record_type for r in warc.read(spark, *warc.write(pages, str(tmp_path / "s"), dedup_bytes=5)).collect()}
    assert out == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_against_all_windows(spark, awkward):
    import random

    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b, c = line(200), line(333), line(700)
    made = [a, "x" + a + "y", a[1:], a[:-1] + "zz", b + line(50) + b, c, c[100:450] + line(400), line(300) + c[:230] + line(20) + c[230:460], c[:350] + "!" + c[351:], "ab" * 600, "q" * 1000, "q" * 999 + "r", line(5000), b[:199], c[60:259], c[61:262]]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    # Longer than a piece, with repeats across its pieces' edges and of other texts.
    made += ["".join(line(3000) + rng.choice((b, c, a, c[100:450])) for _ in range(360)) + "z" * 3000, a + a]
    assert len(made[-2].encode()) > suffix.PIECE
    docs = docs.unionByName(spark.createDataFrame([(3000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    rows = docs.collect()
    expected = Counter((r.doc_id, *x) for r, x in zip(rows, repeats([(r.text or "").encode() for r in rows], 200), strict=True))
    got = suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == expected
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_topk_against_all_scores(spark):
    import random

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(600)] + [(1000 + i, rng.normal(0, 0.2, 5).tolist()) for i in range(60)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (50, rows[3][1]), (50, rows[3][1]), (50, rows[50][1]), (750, None), (751, [None] * 16), (800, [float("nan")] * 16), (850, [float("inf")] * 16), (900, []), (None, rows[3][1]), (2000, [0.0, 900.0, -3.5]), (2001, [1.0, -70.0, 2.0]), (2002, [1.0, 1e4, 2.0])]
    rows += [(2050, [1e13, -1e13]), (2051, [1e13, 1e13]), (2052, [1e13, -9e12]), (2100, [1e14, 0.0]), (2053, [0.0, 0.0]), (2054, [1.0, 2.0]), (2150, [-3e16, 3e16]), (2055, [1e300, -1e300]), (2200, [-1e17, 2.0])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    valid = [(i, [held(int(np.floor(x * 256))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for n, (i, q) in enumerate(valid):
        if i % 50 == 0:
            best = sorted((-held(sum(a * b for a, b in zip(q, v, strict=True))), j) for m, (j, v) in enumerate(valid) if m != n and len(v) == len(q))[:5]
            expected[i, tuple((r + 1, j, -s) for r, (s, j) in enumerate(best))] += 1
    got = defaultdict(list)
    for r in topk.search(df, every=50, k=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in {i for i, _ in expected}:
        assert sorted(got[i]) == sorted(x for (j, own), n in expected.items() if j == i for x in own * n), i
    assert topk.search(df.where("false")).count() == 0


def test_topk_over_several_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.integers(-300, 300, (5000, 8)) / 256).round(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    whole = np.floor(x * 256).astype(np.int64)
    scores = whole[::5] @ whole.T  # more queries than a block holds
    want = {(5 * q, r + 1, int(j), int(scores[q, j])) for q in range(1000) for r, j in enumerate([j for j in np.lexsort((np.arange(5000), -scores[q])) if j != 5 * q][:3])}
    assert {tuple(r) for r in topk.search(df, every=5, k=3).collect()} == want


def test_containment_against_all_pairs(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    extra = [(900, "one"), (901, "two words"), (902, ""), (903, None), (904, " ".join(f"word{i}" for i in range(40, 90))), (905, " ".join(f"word{i}" for i in range(20)) + " " + " ".join(f"word{i}" for i in range(200, 240))), (904, "a b c d"), (None, "a b c d")]
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items] + extra, "item_id long, text string")
    expected = Counter()
    for d in docs.collect():
        own = shingles(d.text, 5)
        for i, t in [(r.item_id, r.text) for r in items] + extra:
            s = shingles(t, 5)
            if i is not None and s and 100 * len(s & own) >= 80 * len(s):
                expected[d.doc_id, i, len(s), len(s & own)] += 1
    for limit in (50_000, 20):
        decontam.ITEMS, keep = limit, decontam.ITEMS
        got = decontam.contained_items(docs, bench).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()
        decontam.ITEMS = keep
        assert Counter(map(tuple, got)) == expected
    clean = decontam.drop_contaminated(awkward, bench)
    assert clean.columns == awkward.columns
    assert decontam.drop_contaminated(awkward, bench.where("false")).count() == awkward.count()


def test_small_items_in_long_documents(spark):
    import random

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    items = [(i, " ".join(word() for _ in range(5 + i % 4))) for i in range(3000)]
    texts = [" ".join([*(f"{t} " + " ".join(word() for _ in range(30)) for _, t in items[k : k + 300])]) for k in range(0, 3000, 300)]
    index = decontam.Index(items, 5)
    assert [[m["item_id"] for m in own] for own in index.matches(texts, 80)] == [list(range(k, k + 300)) for k in range(0, 3000, 300)]
    starts = [t + " " + " ".join(word() for _ in range(40)) for _, t in items]
    assert [[m["item_id"] for m in own] for own in index.matches(starts, 80)] == [[i] for i in range(3000)]
    assert decontam.contained_items(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select(F.size("matches")).first()[0] == 300


def test_contract_queries_have_every_row(spark):
    for name, table, key in (("op1_bpe", "documents", "doc_id"), ("op3_langid", "documents", "doc_id"), ("op4_quality", "documents", "doc_id"), ("op6_secrets", "documents", "doc_id"), ("op7_warc", "pages", "page_id"), ("op8_suffix", "documents", "doc_id")):
        whole = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
        got = Q.QUERIES[name](spark, SF).select(key)
        assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty(), name


def test_native_operators_run_no_python(spark):
    for name in ("op5_chat", "op6_secrets"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
