"""Queries by name, the tables they read, and their SQL for DuckDB."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Rows of a table that one task gets, about, where a view is dealt by key.
TASK_ROWS = 500_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Named steps that several SQL texts use, in the order of their dependence.
STEPS: dict[str, str] = {}


class Tables:
    """The driver's tables and the adapter views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name].replace("{K}", "CAST(get_json_object(props,'$.k') AS INT)").replace("{S}", "STRING")
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})

    def dealt(self, table: str, *keys: str) -> Tables:
        """These tables with one dealt by keys over as many tasks as its rows need, so that a task's memory does not grow with
        the table. What groups by the keys or more needs no other shuffle."""
        out = Tables(self.spark, self.sf_dir)
        setattr(out, table, getattr(self, table).repartition(self.tasks(table), *keys))
        return out

    def tasks(self, table: str) -> int:
        """As many tasks as the rows of a table need."""
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(getattr(self, table).count() / TASK_ROWS))


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(t: Tables) under name; sql may use adapter views and STEPS as if they were tables."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = completed(sql)
        return f

    return put


def completed(sql: str) -> str:
    """sql with a WITH clause for the views and steps that it uses."""
    duck = {k: v.replace("{K}", "CAST(json_extract_string(props,'$.k') AS INT)").replace("{S}", "VARCHAR") for k, v in VIEWS.items()} | STEPS
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in duck.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(body)
    # Steps are used more than once, so each is computed once; one that names itself is recursive.
    kind = lambda name: "" if re.search(rf"\b{name}\b", duck[name]) else "MATERIALIZED "
    clauses = ",\n".join(f"{name} AS {kind(name)}({duck[name]})" for name in duck if name in need)
    if not clauses:
        return sql
    body = sql.strip()
    for head in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(head):
            return f"WITH RECURSIVE {clauses},\n{body[len(head):]}"
    return f"WITH RECURSIVE {clauses}\n{body}"
