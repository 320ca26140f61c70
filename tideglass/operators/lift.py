"""Organisations in the news of an issue: lift, vocabulary, predicates, and their match to tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S


def match_issue(themes: list[str], places: list[str]) -> Column:
    """Any theme code that holds one of themes, and any place with one of places as whole words; an empty list asks nothing."""
    if not themes and not places:
        raise ValueError("an issue needs a theme or a place")
    theme = F.exists("themes", lambda x: F.array_contains(F.array(*[F.contains(x, F.lit(t.upper())) for t in themes]), True)) if themes else F.lit(True)
    place = F.exists("locations", lambda x: x.rlike("(?U)(" + "|".join(rf"\b\Q{p.lower()}\E\b" for p in places) + ")")) if places else F.lit(True)
    return theme & place


def org_lift(articles: DataFrame, predicate: Column, least: int = 3, top: int | None = None) -> DataFrame:
    """lift = share of an organisation among the issue's articles over its share among all; an article counts once."""
    a = articles.select(predicate.alias("hit"), F.array_distinct("orgs").alias("orgs"))
    totals = a.agg(F.count("*").alias("nc"), F.count_if("hit").alias("ni"))
    n = a.select("hit", F.explode("orgs").alias("org")).groupBy("org").agg(F.count("*").alias("cc"), F.count_if("hit").alias("ic"))
    out = n.where(F.col("ic") >= least).join(F.broadcast(totals)).withColumn("lift", (F.col("ic") / F.col("ni")) / (F.col("cc") / F.col("nc")))
    out = out.select("org", F.col("ic").alias("issue_count"), F.col("cc").alias("corpus_count"), "lift")
    return out if top is None else out.orderBy(F.desc("lift"), F.desc("issue_count"), "org").limit(top)


def vocabulary(articles: DataFrame) -> DataFrame:
    """Articles in which each theme and each place occurs."""
    terms = articles.select(F.explode(F.concat(
        F.transform(F.array_distinct("themes"), lambda x: F.struct(F.lit("theme").alias("axis"), x.alias("term"))),
        F.transform(F.array_distinct("locations"), lambda x: F.struct(F.lit("location").alias("axis"), x.alias("term"))),
    )).alias("t"))
    return terms.groupBy("t.axis", "t.term").agg(F.count("*").alias("support"))


#: Letters that a theme and a word of a title must share before they are compared; words have as many at least.
SHARED = 4


def judged_terms(members: DataFrame, words: DataFrame, n_docs: int, least: int = 3, share: float = 0.001, most: float = 0.5) -> DataFrame:
    """Terms of all clusters' titles with their support in the news and the reason to reject them: unseen, rare or general.

    A word supports a theme code that holds it and a place that has it as whole words. Words meet themes by their first
    SHARED letters and places by their first token, so that equal keys are joined and only those compared."""
    terms = members.select("cluster_id", "is_seed", F.explode(S.title_terms(F.col("title"))).alias("word"))
    whole = members.select("cluster_id", "is_seed", F.lower(F.trim(F.regexp_replace("title", r"\([^)]*\)", " "))).alias("word"))
    own = terms.withColumn("axis", F.lit("theme")).unionByName(whole.withColumn("axis", F.lit("location"))).unionByName(terms.withColumn("axis", F.lit("location")))
    own = own.groupBy("cluster_id", "axis", "word").agg(F.max("is_seed").alias("is_seed"))
    wanted = own.select("axis", "word").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("term")), lambda i: F.substr(F.col("term"), i, F.lit(SHARED))))
    themes = words.where("axis = 'theme'").select("term", "support", F.explode(grams).alias("key"))
    theme = wanted.where("axis = 'theme'").withColumn("key", F.upper(F.substr(F.col("word"), F.lit(1), F.lit(SHARED)))).join(themes, "key").where(F.contains("term", F.upper("word")))
    # A place without a token, or a word without one, meets by the empty key.
    places = words.where("axis = 'location'").select("term", "support", F.explode(F.array_distinct(F.concat(F.split("term", r"\W+"), F.array(F.lit(""))))).alias("key"))
    first = F.regexp_extract("word", r"\w+", 0)
    place = wanted.where("axis = 'location'").withColumn("key", first).join(places, "key").where(F.expr(r"regexp_like(term, concat('\\b\\Q', word, '\\E\\b'))"))
    known = theme.unionByName(place).groupBy("axis", "word").agg(F.sum("support").alias("support"))
    n = F.coalesce("support", F.lit(0))
    reason = F.when(F.col("support").isNull(), "unseen").when(n < max(least, int(share * n_docs)), "rare").when(n > most * n_docs, "general")
    return own.join(known, ["axis", "word"], "left").select("cluster_id", "axis", "word", "is_seed", reason.alias("reason"), n.alias("support"))


def derive_predicates(members: DataFrame, words: DataFrame, n_docs: int, least: int = 3, share: float = 0.001, most: float = 0.5, themes: int = 2, places: int = 3) -> DataFrame:
    """For every cluster at once: terms of its titles that the news use, neither rare nor general, best first."""
    own = judged_terms(members, words, n_docs, least, share, most).where("reason is null")
    rank = F.row_number().over(W.partitionBy("cluster_id", "axis").orderBy(F.desc("is_seed"), F.desc("support"), "word"))
    return own.withColumn("place", rank).where(F.col("place") <= F.when(F.col("axis") == "theme", themes).otherwise(places)).select("cluster_id", "axis", "word", "support", "place")


def match_orgs(orgs: DataFrame, stocks: DataFrame, aliases: DataFrame, blocked: list[str]) -> DataFrame:
    """Organisations with the ticker of the same name: the first ticker wins, aliases fill gaps, blocked aliases never."""
    own = stocks.select(S.org_key(F.col("name")).alias("key"), "ticker", F.lit(0).alias("kind"))
    more = aliases.select(S.org_key(F.col("name")).alias("key"), "ticker", F.lit(1).alias("kind")).where(~F.col("key").isin(*blocked))
    index = own.unionByName(more).where("key <> ''").groupBy("key").agg(F.min(F.struct("kind", "ticker")).alias("x")).select("key", F.col("x.ticker").alias("ticker"))
    return orgs.withColumn("key", S.org_key(F.col("org"))).join(index, "key", "left").drop("key")


def lift_curve(slots: DataFrame, block: int = 1024) -> DataFrame:
    """Running lift over slots from (slot from 0 on, articles, issue_articles, org_articles, both).

    Sums run inside blocks of slots; what lies before a block is the sum of at most one span of blocks for each power of
    two, so no window holds all slots."""
    counts = ["articles", "issue_articles", "org_articles", "both"]
    own = slots.withColumn("block", F.floor(F.col("slot") / block))
    sums = own.groupBy("block").agg(*[F.sum(c).alias(c) for c in counts])
    levels = F.sequence(F.lit(0), F.lit(62 - block.bit_length()))
    spans = sums.select("block", F.explode(levels).alias("level"), *counts)
    spans = spans.groupBy("level", F.expr("shiftright(block, level)").alias("span")).agg(*[F.sum(c).alias(c) for c in counts])
    parts = sums.select("block", F.explode(F.filter(levels, lambda k: F.expr("block") .bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)).alias("level"))
    parts = parts.withColumn("span", F.expr("shiftright(block, level) - 1"))
    before = parts.join(spans, ["level", "span"]).groupBy("block").agg(*[F.sum(c).alias(f"{c}_before") for c in counts])
    w = W.partitionBy("block").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    run = {c: F.sum(c).over(w) + F.coalesce(f"{c}_before", F.lit(0)) for c in counts}
    lift = F.try_divide(F.try_divide(run["both"], run["issue_articles"]), F.try_divide(run["org_articles"], run["articles"]))
    return own.join(before, "block", "left").select("slot", lift.alias("lift"))
