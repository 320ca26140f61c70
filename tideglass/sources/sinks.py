"""Writers: sharded files with a manifest, keyed upserts, partition replacement, ids, copies between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, max_records: int = 500_000) -> DataFrame:
    """JSON shards of at most max_records rows; the manifest is written last, and a finished path is left alone.

    Spark's committer puts the files in place together, so a failed job leaves none."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(f"{path}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records).option("compression", "gzip").json(f"{path}/data")
    rows = spark.read.schema(df.schema).json(f"{path}/data")
    rows.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("records")).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target with updates put in by key; of several updates of a key the last by order stays.

    On a catalog with row-level operations use target.mergeInto; this is the same for plain files: the caller writes
    the result to a new version or overwrites only the partitions that updates touch."""
    if order:
        w = W.partitionBy(*keys).orderBy(F.desc(order))
        updates = updates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    else:
        updates = updates.dropDuplicates(keys)
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(target.columns))


def resolve_pages(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """The page dimension with the missing (wiki, title) added; ids are hashes, so a repeat gives the same."""
    new = keys.select("wiki", "title").distinct().join(pages, ["wiki", "title"], "left_anti")
    return pages.unionByName(new.select(F.xxhash64("wiki", "title").alias("page_id"), "wiki", "title").select(pages.columns))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def dependants(snapshot: DataFrame, tables: dict[str, DataFrame], key: str = "cluster_id") -> DataFrame:
    """Rows of each table that hang on the snapshot's clusters."""
    out = None
    for name, table in tables.items():
        n = table.join(snapshot.select(key), key, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def replace_where(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """target with all rows of new's keys replaced by new."""
    return target.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(target.columns))


def write_titles_by_hour(df: DataFrame, path: str) -> None:
    """One text file an hour of sorted distinct titles."""
    rows = df.select("title", F.date_format("hour", "yyyy-MM-dd").alias("day"), F.date_format("hour", "HH").alias("hour")).distinct()
    rows.repartition("day", "hour").sortWithinPartitions("day", "hour", "title").write.mode("overwrite").partitionBy("day", "hour").text(path)


def copy_days(source: DataFrame, target: DataFrame, ids: DataFrame, days: list[str], ts: str = "snapshot_ts", key: str = "page_id") -> DataFrame:
    """Rows of source of the days with ids mapped (ids: from_id, to_id), added to target where their key is not there."""
    own = source.where(F.to_date(ts).isin(*[F.lit(d).cast("date") for d in days])).join(ids, F.col(key) == F.col("from_id"))
    own = own.withColumn(key, F.col("to_id")).select(target.columns)
    return target.unionByName(own.join(target.select(key, ts), [key, ts], "left_anti"))
