"""The pipeline's stages, each judged on its own input."""

import base64
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tideglass.llm import quality, secrets

from .test_operators import base_secrets, components, shingles

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        seen[name] = (docs.collect(), spark.read.parquet(str(tmp_path / str(k))).collect())
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    before, after = seen["quality"]
    judged = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in judged.where("accepted").collect()} and 0 < len(after) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in after}) <= 0.02 * len(good)

    before, after = seen["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    sets = [shingles(r.text, 5) for r in before]
    links = [(i, j) for i in range(len(before)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r.doc_id for r in after} == {before[c].doc_id for c in components(len(before), links)}

    before, after = seen["decontamination"]
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not any(s and 100 * len(s & shingles(r.text, 5)) >= 80 * len(s) for s in items)}
    assert {r.doc_id for r in after} == clean

    before, after = seen["secrets"]
    assert len(before) == len(after)
    for r in after:
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text or "")

    before, after = seen["tokens"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == enc.encode_ordinary(r.text or "") for r in after) and len(before) == len(after)
    assert corpus_pipeline.run(spark, SF).select(F.count("*")).first()[0] == len(after)


def test_decisions_are_on_rows(spark):
    """Rows without doc_id, or with one that others have too, stand for themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = lambda rows: spark.createDataFrame([(i, t, "en", "a/b", len(t)) for i, t in rows], schema)
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_distinct(spark, own(rows), SF).collect()), key=repr)
    line = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    x, y, z = line(0, 60), line(100, 160), line(200, 260)
    assert kept([(1, x), (5, x), (5, y)]) == [(1, x), (5, y)]
    assert kept([(5, x), (5, y), (7, z), (7, z)]) == sorted([(5, x), (5, y), (7, z)], key=repr)
    assert len(kept([(5, x), (5, x + " more")])) == 1
    chain = [(1, line(0, 60)), (None, line(6, 66)), (2, line(12, 72))]
    assert kept(chain) == sorted(chain[:2], key=repr)

    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    bad = quality.classify(docs, labels).where("not accepted").join(labels, "doc_id", "left_anti").orderBy("probability").first().doc_id
    fine = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    odd = docs.where(F.col("doc_id") == bad)
    both = docs.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(fine.withColumn("doc_id", F.lit(bad)))
    out = corpus_pipeline.keep_quality(spark, both, SF)
    assert out.where("doc_id is null").isEmpty()
    assert [r.text for r in out.where(F.col("doc_id") == bad).collect()] == [fine.first().text]


def awkward_rows():
    line = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, line(0, 300)), (5, line(0, 299)), (5, line(0, 299)), (6, "ß " * 40_000), (7, "x" * 60_000), (8, "日本語 🙂 テスト token=abcdefgh12345678"), (None, line(500, 600)), (None, None), (9, "token: " + "Zq9" * 9)]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"h{k % 2}/p", None if k % 5 == 0 else 7) for k, (i, t) in enumerate(rows)]


def test_every_stage_takes_awkward_and_empty_tables(spark):
    """Nulls everywhere, long texts, repeated rows, no rows, and columns whose names the stages use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(awkward_rows(), schema).withColumns({"row": F.lit("r"), "key": F.lit(1), "BINS": F.lit(2), "bands": F.array(F.lit("b")), "matches": F.lit(None).cast("string"), "decoded": F.lit(3), "label": F.lit("l"), "secrets": F.lit(4), "host": F.lit("h"), "shingles": F.lit(5)})
    extra = docs.columns[5:]
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF)
        rows = out.collect()
        kept[name] = Counter((r.doc_id, (r.text or "")[:40]) for r in rows)
        if name == "tokens":
            assert "ids" in out.columns and [c for c in docs.columns if c != "decoded"] == [c for c in out.columns if c != "ids"][: len(docs.columns) - 1]
        else:
            assert out.columns == docs.columns and all(r[c] == v for r in rows for c, v in zip(extra, docs.first()[5:], strict=True))
        none = function(spark, docs.where("false"), SF)
        assert none.count() == 0 and none.columns == out.columns
    whole = Counter((r.doc_id, (r.text or "")[:40]) for r in docs.collect())
    assert kept["decontamination"] == kept["tokens"] == whole
    assert kept["near_duplicates"] == whole - Counter({(5, awkward_rows()[5][1][:40]): 2})
    assert sum(kept["secrets"].values()) == sum(whole.values()) and "[SECRET]" in " ".join(t for _, t in kept["secrets"])
    assert kept["quality"] <= whole and sum(kept["quality"].values()) >= len(whole) - 6


def test_secrets_stage_against_a_plain_version(spark):
    """Masked where the operator's spans lie, base patterns found by plain matching among them, and nothing else touched."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = secrets.train(docs)
    spans = {r.doc_id: [(s.start, s.stop) for s in r.secrets] for r in secrets.find_secrets(docs, model=model).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, SF).collect()}
    for r in docs.collect():
        assert {(a, b) for a, _, b, _ in base_secrets(r.text)} <= set(spans[r.doc_id])
        at, text = 0, ""
        for a, b in sorted(spans[r.doc_id]):
            if a >= at:
                text += r.text[at:a] + "[SECRET]"
            at = max(at, b)
        want = None if r.text is None else text + r.text[at:]
        assert out[r.doc_id].text == want and (out[r.doc_id].n_chars == r.n_chars or want != r.text)
