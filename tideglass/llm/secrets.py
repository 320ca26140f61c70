"""Secret scans by fixed patterns and character Markov models, DataFrame functions only.

Base kinds are patterns (assign, access, hex); matches that are too short are dropped after matching. The method adds
spans of kind markov: long tokens whose characters follow a model of random strings rather than one of ordinary
identifiers, by the log-likelihood ratio of their character pairs. Both models are counted from labelled tokens: the values that
base patterns find in any document are random strings; all other tokens of a sample of documents are ordinary
identifiers, but one that a single text holds counts little (a secret that nobody labelled is such a one), and each
counts a little in capitals too. A run of digits is a number and is not judged. Only ordinary ones are sampled: distinct texts whose hash falls below a fraction chosen so that about SAMPLE stay.
One labelled token in HELD is not counted but judged by the models: the ratio a character that a token must reach is the one
that no more than WRONG of the ordinary tokens held out pass (of those that two texts hold; shorter ones too, whose ratios
spread more). A token must also carry TOTAL in all, the odds that outweigh how seldom a token is a secret.

Positions are code points, end exclusive. Defined cases: null text is empty; repeated rows give repeated results;
without labelled tokens of both kinds nothing is added.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Cheap necessary conditions: texts without them have no span of the kind that is long enough.
MAY = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Tokens that the models judge: shorter ones cannot carry TOTAL against usual text.
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Distinct texts that ordinary identifiers are learned from, about.
SAMPLE = 20_000
#: The ratio in all (a token is random with odds of 3 million to one), and that a character where nothing was held out.
TOTAL, EACH = 15.0, 0.25
#: One labelled token in so many is held out; the share of ordinary ones, of SHORT characters at least, that may pass.
HELD, WRONG, SHORT = 5, 0.001, 8
#: What an ordinary token of a single text counts as, and any one in capitals.
ONCE = 0.02
#: Pairs that the frequency of the second character counts as: characters of random strings hardly hang together.
BACK, BACK_RANDOM = 4.0, 64.0

SPANS = "array<struct<start: bigint, stop: bigint>>"


def spans(text: Column, pattern: str, least: int, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has at least so many characters, as array<(start, stop)>."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda r: F.struct(F.char_length(r["g"]).cast("long").alias("gap"), F.char_length(r["m"]).cast("long").alias("len"), (F.char_length(r["v"]) >= least).alias("ok")),
    )
    return walked(rows)


def walked(rows: Column) -> Column:
    """Gaps and lengths in order to places."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(x: Column, r: Column) -> Column:
        a = x["at"] + r["gap"]
        b = a + r["len"]
        return F.struct(b.alias("at"), F.when(r["ok"], F.concat(x["out"], F.array(F.struct(a.alias("start"), b.alias("stop"))))).otherwise(x["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda x: x["out"])


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(SPANS)
    return {
        "assign": F.when(text.rlike(MAY["assign"]), spans(text, ASSIGN, 6, 2)).otherwise(none),
        "access": F.when(text.rlike(MAY["access"]), spans(text, ACCESS, 20)).otherwise(none),
        "hex": F.when(text.rlike(MAY["hex"]), spans(text, HEX, 24)).otherwise(none),
    }


def codes_of(token: Column) -> Column:
    """ASCII codes of a token's characters."""
    return F.filter(F.transform(F.split(token, ""), lambda c: F.ascii(c)), lambda c: c > 0)


def pairs_of(token: Column) -> Column:
    """Character pairs of an ASCII token as 128 * first + second."""
    codes = codes_of(token)
    n = F.char_length(token) - 1
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * 128 + b)


def total_of(token: Column, ratios: Column) -> Column:
    """Sum of the ratios of a token's pairs, in one pass."""
    first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(x: Column, c: Column) -> Column:
        gain = F.when(x["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(ratios, x["last"] * 128 + c), F.lit(0.0)))
        return F.struct(c.alias("last"), (x["sum"] + gain).alias("sum"))

    return F.aggregate(codes_of(token), first, step, lambda x: x["sum"])


def ordinary_texts(docs: DataFrame, sample: int) -> DataFrame:
    """Distinct texts, about sample of them; all, if there are fewer."""
    if docs.limit(sample + 1).count() > sample:
        n = docs.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
        docs = docs.where(F.pmod(F.xxhash64("text", F.lit("markov")), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    return docs.distinct()


class Model(NamedTuple):
    """ratios: log-likelihood ratio (random to ordinary) of each pair of characters, 128 * 128 of them; each: least a character;
    recall: share of the random tokens held out that reach it (null without such tokens)."""

    ratios: list[float]
    each: float
    recall: float | None


def labelled_tokens(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(secret, token, n, held), each token once with the number of texts that hold it: what base patterns find in all documents, and all else in a sample of them."""
    docs = docs.select(F.col(text).alias("text")).where("text is not null")
    t = F.col("text")
    values = F.array_distinct(F.concat(
        F.when(t.rlike(MAY["assign"]), F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")),
        F.when(t.rlike(MAY["access"]), F.regexp_extract_all(t, F.lit(r"AKIA([A-Z0-9]{16,})"), F.lit(1))).otherwise(F.array().cast("array<string>")),
        F.when(t.rlike(MAY["hex"]), F.regexp_extract_all(t, F.lit(r"[0-9a-f]{24,}"), F.lit(0))).otherwise(F.array().cast("array<string>")),
    ))
    may = t.rlike(MAY["assign"]) | t.rlike(MAY["access"]) | t.rlike(MAY["hex"])
    random = docs.where(may).select(F.explode(F.filter(values, lambda x: F.char_length(x) >= 8)).alias("token"))
    labelled = ordinary_texts(docs, sample).select(values.alias("random"), F.array_distinct(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))).alias("tokens"))
    ordinary = labelled.select(F.explode(F.filter("tokens", lambda x: ~F.exists("random", lambda r: x.contains(r) | r.contains(x)))).alias("token"))
    tokens = random.select(F.lit(True).alias("secret"), "token").union(ordinary.select(F.lit(False), "token")).groupBy("secret", "token").agg(F.count("*").alias("n"))
    return tokens.withColumn("held", F.pmod(F.xxhash64("token"), F.lit(HELD)) == 0)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """The models and their threshold; none without labelled tokens of both kinds."""
    tokens = stage(labelled_tokens(docs, text, sample), "tokens")
    own = F.when(F.col("secret") | (F.col("n") > 1), F.lit(1.0)).otherwise(ONCE)
    said = F.struct("token", own.alias("w"))
    kinds = F.when(F.col("secret"), F.array(said)).otherwise(F.array(said, F.struct(F.upper("token").alias("token"), (own * ONCE).alias("w"))))
    pairs = tokens.where("not held").select("secret", F.explode(kinds).alias("x")).select("secret", "x.w", F.explode(pairs_of(F.col("x.token"))).alias("pair"))
    counted = pairs.groupBy("secret", "pair").agg(F.sum("w").alias("n")).collect()  # at most 2 * 128 * 128 rows
    tables = {label: {r.pair: r.n for r in counted if r.secret == label} for label in (True, False)}
    if not tables[True] or not tables[False]:
        return None
    used = [c for c in range(128) if chr(c).isalnum() or chr(c) in "+/_=-."]
    models = [conditional(tables[True], used, BACK_RANDOM), conditional(tables[False], used, BACK)]
    ratios = [models[0][p] - models[1][p] if p in models[0] else 0.0 for p in range(128 * 128)]
    judged = tokens.where(F.col("held") & (F.char_length("token") >= F.when(F.col("secret"), LEAST).otherwise(SHORT)) & ~F.col("token").rlike("^[0-9]+$"))
    judged = judged.where("secret or n > 1").select("secret", (total_of(F.col("token"), constant(ratios)) / F.char_length("token")).alias("each"))
    each = judged.where("not secret").agg(F.percentile("each", F.lit(1 - WRONG))).first()[0]
    each = EACH if each is None else max(0.0, float(each))
    return Model(ratios, each, judged.where("secret").agg(F.avg((F.col("each") >= each).cast("double"))).first()[0])


def constant(ratios: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(f"{x:.4f}" for x in ratios) + "]"), "array<double>")


def conditional(counts: dict[int, float], used: list[int], back: float) -> dict[int, float]:
    """Log-probability of each second character given the first; rare pairs fall back to how often the second occurs."""
    single = {b: sum(counts.get(a * 128 + b, 0) for a in used) for b in used}
    total = sum(single.values())
    single = {b: (n + 0.5) / (total + 0.5 * len(used)) for b, n in single.items()}
    out = {}
    for a in used:
        row = sum(counts.get(a * 128 + b, 0) for b in used)
        out |= {a * 128 + b: math.log((counts.get(a * 128 + b, 0) + back * single[b]) / (row + back)) for b in used}
    return out


def markov_spans(text: Column, model: Model | None) -> Column:
    """Tokens that look random."""
    if model is None:
        return F.array().cast(SPANS)
    ratios = constant(model.ratios)
    matches = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    judged = lambda m: ~m.rlike("^[0-9]+$") & (total_of(m, ratios) >= F.greatest(F.lit(TOTAL), model.each * F.char_length(m)))
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g")),
        lambda r: F.struct(F.char_length(r["g"]).cast("long").alias("gap"), F.char_length(r["m"]).cast("long").alias("len"), judged(r["m"]).alias("ok")),
    )
    return F.when(text.rlike(TOKEN), walked(rows)).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, text: str = "text", model: Model | None = None, out: str = "secrets") -> DataFrame:
    """docs with out: array of (start, rank, stop, kind), ordered; markov spans only where they meet no base span."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = {k: f"__{k}" for k in KINDS}
    df = docs.withColumns({names[k]: c for k, c in base_spans(t).items()} | {names["markov"]: markov_spans(t, model)})
    base = F.concat(*[F.col(names[k]) for k in KINDS[:3]])
    df = df.withColumn(names["markov"], F.filter(names["markov"], lambda m: ~F.exists(base, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))))

    def kind(k: str) -> Column:
        return F.transform(names[k], lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["stop"].alias("stop"), F.lit(k).alias("kind")))

    return df.withColumn(out, F.sort_array(F.concat(*[kind(k) for k in KINDS]))).drop(*names.values())


def joined_spans(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    own = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", model: Model | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span in text replaced by mask; overlapping spans become one. A null text stays null."""
    found = find_secrets(docs, text, model, "__secrets")
    source = F.col(text)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(x: Column, s: Column) -> Column:
        begin = F.greatest(x["at"], s["start"])
        piece = F.substr(source, (x["at"] + 1).cast("int"), (begin - x["at"]).cast("int"))
        more = F.when(s["start"] >= x["at"], F.concat(x["out"], piece, F.lit(mask))).otherwise(x["out"])
        return F.struct(F.greatest(x["at"], s["stop"]).alias("at"), more.alias("out"))

    clean = F.aggregate("__secrets", first, step, lambda x: F.concat(x["out"], F.substr(source, (x["at"] + 1).cast("int"))))
    return found.withColumn(text, F.when(F.size("__secrets") > 0, clean).otherwise(source)).select(docs.columns)
