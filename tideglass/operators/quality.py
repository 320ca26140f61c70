"""Checks of rows, answers and hours, each as a DataFrame of what is wrong or how much agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_rows(df: DataFrame, problem: Column, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good, bad): problem names what is wrong with a row or is null. In strict mode a bad row fails the job."""
    if mode == "strict":
        return df.withColumn("__ok", F.when(problem.isNull(), True).otherwise(F.raise_error(problem))).where("__ok").drop("__ok"), df.limit(0).withColumn("error", F.lit(None).cast("string"))
    marked = df.withColumn("error", problem)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def hour_alignment(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """By title: how often hourly views are nearer the profile's same hour than its next, and the other way round."""
    same = daily.select("title", "ts_hour", F.col("views").alias("same"))
    after = daily.select("title", (F.col("ts_hour") - F.expr("interval 1 hour")).alias("ts_hour"), F.col("views").alias("after"))
    own = hourly.join(same, ["title", "ts_hour"]).join(after, ["title", "ts_hour"])
    a, b = F.abs(F.col("views") - F.col("same")), F.abs(F.col("views") - F.col("after"))
    return own.groupBy("title").agg(F.count("*").alias("n"), F.count_if(a < b).alias("same_hour"), F.count_if(b < a).alias("next_hour"))


VERDICT = {"verdict", "relation", "direction", "confidence", "rationale", "evidence"}


def verdict_violations(responses: DataFrame, body: str = "body") -> DataFrame:
    """Answers that are no JSON object of exactly the six keys, or have a rationale where none belongs or lack one."""
    keys = F.json_object_keys(body)
    row = F.from_json(body, "verdict boolean, relation string, direction string, confidence string, rationale string, evidence string")
    blank = F.coalesce(F.trim(row["rationale"]), F.lit("")) == ""
    wrong = F.when(keys.isNull(), "not_json").when(F.array_sort(keys) != F.array(*[F.lit(k) for k in sorted(VERDICT)]), "keys").when(row["verdict"].isNull(), "verdict")
    wrong = wrong.when(row["verdict"] & blank, "no_rationale").when(~row["verdict"] & ~blank, "rationale")
    return responses.withColumn("error", wrong).where("error is not null")


def attempt_state(log: DataFrame, cap: int = 3) -> DataFrame:
    """Failures of each item since its model last changed, and whether it failed for good."""
    w = W.partitionBy("item").orderBy("at")
    changed = F.coalesce((F.lag("model").over(w) != F.col("model")).cast("int"), F.lit(0))
    own = log.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    last = own.groupBy("item").agg(F.max("run").alias("run"))
    n = own.join(last, ["item", "run"]).groupBy("item").agg(F.count_if(~F.col("ok")).alias("attempts"), F.max_by("model", "at").alias("model"))
    return n.withColumn("failed", F.col("attempts") >= cap)


def clean_sections(df: DataFrame, column: str = "sections", members: str = "members") -> DataFrame:
    """Report sections with id and title, their evidence held to the members; what is no such JSON has none."""
    kind = "array<struct<id: string, title: string, body: string, evidenceIds: array<string>>>"
    full = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    own = F.filter(F.coalesce(F.from_json(column, kind), F.array().cast(kind)), lambda s: full(s["id"]) & full(s["title"]))
    fixed = F.transform(own, lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"), s["body"].alias("body"), F.array_intersect(F.coalesce(s["evidenceIds"], F.array().cast("array<string>")), F.col(members)).alias("evidenceIds")))
    return df.withColumn(column, fixed)


def window_violations(windows: DataFrame) -> DataFrame:
    """windows with each rule that they break: end after start, last edit before end, detected after start. What is null breaks none
    but the first, which needs both ends."""
    rules = {
        "end": ~F.coalesce(F.col("window_end") > F.col("window_start"), F.lit(False)), "last_edit": F.col("last_edit_ts") >= F.col("window_end"), "detected": F.col("detected_at") <= F.col("window_start"),
    }
    found = F.array_compact(F.array(*(F.when(wrong, name) for name, wrong in rules.items())))
    return windows.withColumn("rule", F.explode(found))


#: Keys and domains of an answer about a stock, and keys of a summary.
ANSWER = ("issue_class", "verified", "match_path", "confidence", "rationale_en", "rationale_ko")
ISSUE_CLASSES = ("SINGLE_COMPANY_EVENT", "SECTOR_OR_REGION_EVENT")
MATCH_PATHS = ("DIRECT_MENTION", "PRODUCT_INDUSTRY", "SUPPLY_CHAIN", "REGION")
CONFIDENCES = ("strong", "weak")
SUMMARY = ("sufficient_context", "summary_ko")


def of_schema(body: str, keys: tuple[str, ...], flag: str) -> tuple[Column, Column]:
    """(fields as JSON texts by name, what is wrong): an object of exactly the keys, with true or false under flag."""
    fields = F.from_json(body, "map<string,string>")
    raw = F.get_json_object(body, f"$.{flag}")
    quoted = F.rlike(body, F.lit(rf'"{flag}"\s*:\s*"'))
    names = F.json_object_keys(body)
    wrong = F.when(names.isNull(), "not_object").when(F.array_sort(names) != F.array(*(F.lit(k) for k in sorted(keys))), "keys").when(~F.coalesce(raw.isin("true", "false"), F.lit(False)) | quoted, flag)
    return fields, wrong


def answer_violations(responses: DataFrame, body: str = "body") -> DataFrame:
    """Answers about stocks that break their schema, with the first rule that they break: six keys, the issue's class, a flag, and
    if it is true a path, a confidence and two texts, else nulls."""
    x, wrong = of_schema(body, ANSWER, "verified")
    blank = lambda k: F.trim(F.coalesce(x[k], F.lit(""))) == ""
    yes = x["verified"] == "true"
    wrong = wrong.when(~F.coalesce(x["issue_class"].isin(*ISSUE_CLASSES), F.lit(False)), "issue_class")
    wrong = wrong.when(yes & ~F.coalesce(x["match_path"].isin(*MATCH_PATHS), F.lit(False)), "match_path").when(yes & ~F.coalesce(x["confidence"].isin(*CONFIDENCES), F.lit(False)), "confidence")
    wrong = wrong.when(yes & blank("rationale_en"), "rationale_en").when(yes & blank("rationale_ko"), "rationale_ko")
    rest = F.coalesce(x["match_path"], x["confidence"], x["rationale_en"], x["rationale_ko"])
    return responses.withColumn("error", wrong.when(~yes & rest.isNotNull(), "not_null")).where("error is not null")


def summary_violations(responses: DataFrame, body: str = "body") -> DataFrame:
    """Summaries that break their schema: two keys, a flag, and a text if and only if it is true."""
    x, wrong = of_schema(body, SUMMARY, "sufficient_context")
    blank, yes = F.trim(F.coalesce(x["summary_ko"], F.lit(""))) == "", x["sufficient_context"] == "true"
    return responses.withColumn("error", wrong.when(yes & blank, "summary").when(~yes & x["summary_ko"].isNotNull(), "not_null")).where("error is not null")
