"""Readers of edit streams, dumps, view counts, clickstreams, news archives, listings and prices.

Layouts are declared, never inferred; a row of the wrong width fails the job in strict mode and is set apart otherwise.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from ..operators.quality import check_rows

EDIT = T.StructType([
    T.StructField("wiki", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("title", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("rev_id", T.LongType()), T.StructField("rev_parent_id", T.LongType()), T.StructField("byte_delta", T.IntegerType()), T.StructField("new_length", T.IntegerType()),
    T.StructField("user", T.StringType()), T.StructField("is_bot", T.BooleanType()), T.StructField("is_minor", T.BooleanType()), T.StructField("event_ts", T.StringType()),
    T.StructField("event_ts_ms", T.LongType()), T.StructField("source", T.StringType()), T.StructField("meta_id", T.StringType()),
])

#: Columns of a history dump, and those that are read, by place.
HISTORY_WIDTH = 78


def parse_edits(df: DataFrame, value: str = "value") -> DataFrame:
    """Edits from JSON text; rows without an id are dropped."""
    e = df.select(F.from_json(F.col(value).cast("string"), EDIT).alias("e")).select("e.*")
    return e.withColumn("event_ts", F.to_timestamp("event_ts")).where(F.col("meta_id").rlike(r"\S"))


def read_edit_stream(spark: SparkSession, bootstrap: str, topic: str, starting: str = "latest", max_offsets: int = 50_000) -> DataFrame:
    """Edits from Kafka; max_offsets limits each micro-batch."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic)
    return parse_edits(raw.option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_offsets).load())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = EDIT) -> DataFrame:
    """All shards below path, gzip or not."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").json(path)


def fields_of(spark: SparkSession, path: str, sep: str, named_by: str = "file") -> DataFrame:
    """Fields of each line and the name of its file, or of the folder that the file is in."""
    lines = spark.read.text(path).where("value <> ''")
    name = F.col("_metadata.file_name") if named_by == "file" else F.element_at(F.split("_metadata.file_path", "/"), -2)
    return lines.select(F.split("value", sep, -1).alias("f"), name.alias("file"))


def width_error(width: int) -> Column:
    return F.when(F.size("f") != width, F.format_string("%d columns instead of %d", F.size("f"), F.lit(width)))


def read_history(spark: SparkSession, path: str, places: dict[str, int], mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows) of headerless tab-separated dumps; places names the columns wanted; '' is missing."""
    good, bad = check_rows(fields_of(spark, path, "\t"), width_error(HISTORY_WIDTH), mode)
    return good.select(*[F.nullif(F.get("f", F.lit(i)), F.lit("")).alias(name) for name, i in places.items()]), bad


def read_recent_changes(spark: SparkSession, path: str) -> DataFrame:
    kind = "type string, ns int, title string, rcid long, revid long, old_revid long, user string, bot boolean, minor boolean, oldlen int, newlen int, timestamp string, logtype string, logaction string, logparams struct<target_title: string>"
    return spark.read.schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", "*json*").json(path)


def read_hourly_views(spark: SparkSession, path: str, projects: dict[str, bool], mode: str = "strict", named_by: str = "file") -> tuple[DataFrame, DataFrame]:
    """Hourly counts of the projects (name -> mobile); the name of the file (or its folder) gives the end of its hour.

    Namespaces are dropped by the raw title, before it is made canonical; titles that then are empty go."""
    f = fields_of(spark, path, " ", named_by)
    error = F.coalesce(width_error(4), F.when(F.get("f", F.lit(2)).try_cast("long").isNull(), F.lit("count is no number")))
    good, bad = check_rows(f, error, mode)
    own = good.where(F.get("f", F.lit(0)).isin(*projects) & S.is_content_title(F.get("f", F.lit(1))))
    mobile = F.get("f", F.lit(0)).isin(*[p for p, m in projects.items() if m])
    own = own.select(S.canonical_title(F.get("f", F.lit(1))).alias("title"), F.get("f", F.lit(2)).cast("long").alias("views"), mobile.alias("is_mobile"), S.file_hour(F.col("file")).alias("ts_hour"))
    return own.where("title <> ''"), bad


def read_daily_views(spark: SparkSession, path: str, project: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Daily counts with a sparse hour string, whose sum must be the day's total."""
    f = fields_of(spark, path, " ")
    hours = S.decode_hourly(F.get("f", F.lit(5)))
    total = F.aggregate(hours, F.lit(0).cast("long"), lambda s, x: s + x["v"])
    error = F.coalesce(width_error(6), F.when(hours.isNull(), F.lit("hours cannot be read")), F.when(total != F.get("f", F.lit(4)).try_cast("long"), F.lit("hours do not sum to the total")), F.when(F.get("f", F.lit(4)).try_cast("long").isNull(), F.lit("total is no number")))
    good, bad = check_rows(f, error, mode)
    own = good.where((F.get("f", F.lit(0)) == project) & S.is_content_title(F.get("f", F.lit(1))))
    return own.select(F.get("f", F.lit(1)).alias("title"), F.get("f", F.lit(3)).alias("access"), F.get("f", F.lit(4)).cast("long").alias("total"), F.get("f", F.lit(5)).alias("hours"), "file"), bad


def read_clickstream(spark: SparkSession, path: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Links with integer counts."""
    good, bad = check_rows(fields_of(spark, path, "\t"), width_error(4), mode)
    own = good.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("prev", "curr", "kind"))], F.get("f", F.lit(3)).try_cast("long").alias("n"))
    return own.where("kind = 'link' and n is not null"), bad


def read_gkg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(article records, broken archives by path) from zip archives, one a slot. A broken archive gives no records."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(batch.column(1)[i].as_py())) as z:
                        text = b"\n".join(z.read(n) for n in z.namelist()).decode("utf-8", "replace").split("\n")
                except (zipfile.BadZipFile, EOFError, OSError):
                    text = [None]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(text)), pa.array(text, type=pa.string())], names=["path", "line"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(lines, "path string, line string")
    record = S.article_record(F.split("line", "\t", -1))
    return raw.select(record.alias("r")).where("r is not null").select("r.*"), raw.where("line is null").select("path")


#: What names common stock, and the exchanges by their letter.
COMMON = ("common stock", "common shares", "ordinary shares", "class a common", "class b common", "class c common")
EXCHANGES = {"N": "NYSE", "A": "NYSE American"}


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated exchange list with a header and a trailer line."""
    rows = spark.read.option("sep", "|").option("header", "true").csv(path)
    return rows.where(~F.col(f"`{rows.columns[0]}`").startswith("File Creation Time"))


def common_stock(df: DataFrame, ticker: str = "Symbol", name: str = "Security Name", exchange: str | None = None) -> DataFrame:
    """Common stock that is neither a test issue nor a fund, of a listed exchange, with a plain ticker."""
    c = lambda n: F.col(f"`{n}`")
    venue = F.lit("NASDAQ") if exchange is None else F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])[c(exchange)]
    own = df.where((c("Test Issue") == "N") & (c("ETF") == "N") & F.lower(c(name)).rlike("|".join(COMMON)))
    own = own.select(F.trim(c(ticker)).alias("ticker"), F.trim(c(name)).alias("name"), venue.alias("exchange"))
    return own.where(F.col("exchange").isNotNull() & F.col("ticker").rlike("^[A-Z][A-Z.]{0,6}$"))


def read_ticker_index(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) from a JSON object of objects."""
    text = spark.read.option("wholetext", "true").text(path)
    own = text.select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: long, ticker: string, title: string>>"))).alias("x"))
    return own.select(F.upper(F.trim("x.ticker")).alias("ticker"), F.lpad(F.col("x.cik_str").cast("string"), 10, "0").alias("cik"), F.col("x.title").alias("title"))


def universe(listings: list[DataFrame], index: DataFrame) -> DataFrame:
    """Stocks of all listings, the first of a ticker, named by the index where it knows them."""
    from ..operators.sets import union_first

    first = union_first([x.select("ticker", "name", "exchange") for x in listings], ["ticker"])
    return first.join(index, "ticker", "left").select("ticker", F.coalesce("title", "name").alias("name"), "exchange", "cik")


def clean_prices(df: DataFrame) -> DataFrame:
    """Daily bars: without a usable close the row goes, other unusable fields become null; class shares use a dash."""
    ok = lambda n: F.when(~F.isnan(n) & (F.abs(F.col(n)) < 1e10), F.col(n)).cast("decimal(14,4)")
    out = df.withColumns({n: ok(n) for n in ("open", "high", "low", "close")}).where("close is not null")
    volume = F.when(~F.isnan("volume") & (F.abs(F.col("volume")) < 1e18), F.col("volume")).cast("long")
    return out.withColumn("volume", volume).withColumn("symbol", F.replace("ticker", F.lit("."), F.lit("-")))


def pick_complete_month(manifests: DataFrame, files: DataFrame, month: str) -> DataFrame:
    """The newest month up to the one given whose manifest matches the files: all shards there, with their sizes.

    manifests: month, file, bytes; files: month, file, bytes. No row if none is complete."""
    both = manifests.where(F.col("month") <= month).join(files.withColumnRenamed("bytes", "there"), ["month", "file"], "left")
    whole = both.groupBy("month").agg(F.bool_and(F.coalesce(F.col("there") == F.col("bytes"), F.lit(False))).alias("complete"), F.count("*").alias("shards"))
    return whole.where("complete").orderBy(F.desc("month")).limit(1).select("month", "shards")


# Events of all sources in one shape.


def normalize_changes(df: DataFrame, wikis: list[str]) -> DataFrame:
    """Raw change events: articles, edits and new pages of the wikis; an event without an id fails the job."""
    own = df.where((F.col("namespace") == 0) & F.col("type").isin("edit", "new") & F.col("wiki").isin(*wikis))
    event_id = F.when(F.col("meta.id").rlike(r"\S"), F.col("meta.id")).otherwise(F.raise_error(F.lit("event without id")))
    new = F.col("length.new")
    return own.select("wiki", F.col("meta.domain").alias("domain"), S.canonical_title(F.col("title")).alias("title"), F.col("type").alias("event_type"), F.col("revision.new").alias("rev_id"), F.col("revision.old").alias("rev_parent_id"),
        (new - F.coalesce("length.old", F.lit(0))).alias("byte_delta"), new.alias("new_length"), "user", F.col("bot").alias("is_bot"), F.col("minor").alias("is_minor"), F.to_timestamp("meta.dt").alias("event_ts"), event_id.alias("meta_id"))


def normalize_history(df: DataFrame) -> DataFrame:
    """Dump rows: created revisions of pages that were articles then, under the title they had."""
    own = df.where((F.col("entity") == "revision") & (F.col("event") == "create") & (F.col("namespace_then") == "0"))
    ts = F.to_timestamp("event_timestamp")
    first = F.to_timestamp("first_edit_timestamp")
    rev = F.col("rev_id").cast("long")
    return own.select("wiki", S.domain_of_wiki(F.col("wiki")).alias("domain"), S.canonical_title(F.col("title_then")).alias("title"), F.when(first == ts, "new").otherwise("edit").alias("event_type"), rev.alias("rev_id"),
        F.nullif(F.col("parent_id").cast("long"), F.lit(0)).alias("rev_parent_id"), F.col("bytes_diff").cast("int").alias("byte_delta"), "user", ts.alias("event_ts"), S.meta_id(F.col("wiki"), rev).alias("meta_id")).where("title <> ''")


def normalize_rc(df: DataFrame, wiki: str = "enwiki") -> DataFrame:
    own = df.where("ns = 0 and type in ('edit', 'new')")
    return own.select(F.lit(wiki).alias("wiki"), S.canonical_title(F.col("title")).alias("title"), F.col("type").alias("event_type"), F.col("revid").alias("rev_id"), (F.col("newlen") - F.coalesce("oldlen", F.lit(0))).alias("byte_delta"), F.col("user").alias("usr"), F.col("bot").alias("is_bot"), F.to_timestamp("timestamp").alias("event_ts"), F.concat(F.lit("rc:"), F.col("rcid").cast("string")).alias("meta_id"))


def fan_out_logs(df: DataFrame, wiki: str = "enwiki") -> DataFrame:
    """Moves and protections: one row for the page and one for the page it moved to, without a revision."""
    own = df.where("type = 'log' and logtype in ('move', 'protect')")
    titles = F.array_distinct(F.array_compact(F.array("title", "logparams.target_title")))
    return own.select(F.lit(wiki).alias("wiki"), F.explode(titles).alias("t"), F.lit("log").alias("event_type"), F.lit(None).cast("long").alias("rev_id"), F.lit(None).cast("int").alias("byte_delta"), F.col("user").alias("usr"), F.col("bot").alias("is_bot"), F.to_timestamp("timestamp").alias("event_ts"), F.concat_ws(":", F.lit("rc"), F.col("rcid").cast("string")).alias("meta_id")).withColumn("title", S.canonical_title(F.col("t"))).drop("t")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
