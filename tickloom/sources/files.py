"""Typed scans and sinks: tick CSV, daily Parquet, bars, ledgers of JSON lines. Every scan states its schema; nothing is inferred."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prices import decimal_units, event_micros
from ..functions.text import digest
from .verify import digest as table_digest

TICK_CSV = "time_utc string, symbol string, price string"
TICKS = "event_time_micros timestamp, price_units bigint"
BARS = "symbol string, symbol_id int, timestamp_utc timestamp, unix_utc_s bigint, server_time_s bigint, open double, high double, low double, close double, volume double, period_s int"


def read_tick_csv(spark: SparkSession, path: str, symbol: str, scale: int) -> DataFrame:
    """Rows of `time_utc,symbol,price` files as t (micros), units and reason: null, or bad_time, other_symbol, bad_price."""
    rows = spark.read.schema(TICK_CSV).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    t, u = event_micros(F.col("time_utc")), decimal_units(F.col("price"), scale)
    return rows.select("time_utc", "symbol", "price", t.alias("t"), u.alias("units"), F.when(t.isNull(), "bad_time").when(F.coalesce(F.col("symbol") != symbol, F.lit(True)), "other_symbol").when(u.isNull(), "bad_price").alias("reason"))


def write_daily(df: DataFrame, path: str, time: str, *partitions: str) -> None:
    """One folder per UTC day (and partition column); days that `df` has are replaced, others stay."""
    df.withColumn("date", F.to_date(time)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions, "date").parquet(path)


def read_daily(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Days [first, last] of a daily table; only their folders are listed into the scan."""
    return spark.read.schema(schema + ", date date").parquet(path).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def checked_schema(df: DataFrame, schema: str) -> DataFrame:
    """`df` if its columns and types are exactly those of `schema` (nullability aside), else a ValueError."""
    want = [tuple(x.strip().split(" ", 1)) for x in schema.split(",")]
    if df.dtypes != want:
        raise ValueError(f"schema {df.dtypes} instead of {want}")
    return df


def strays(df: DataFrame, time: str) -> DataFrame:
    """Rows whose day isn't that of the folder they lie in."""
    return df.where(F.to_date(time) != F.col("date"))


def bar_problems(bars: DataFrame, period: int) -> DataFrame:
    """Bars with `problem`: null, or missing_value, not_finite, negative_volume, high_too_low, low_too_high or off_grid (first that holds)."""
    c = F.col
    prices = [c(x) for x in ("open", "high", "low", "close")]
    none = prices[0].isNull()
    for x in (*prices[1:], c("start_micros")):
        none = none | x.isNull()
    wild = F.lit(False)
    for x in prices:
        wild = wild | F.isnan(x) | (F.abs(x) == float("inf"))
    return bars.withColumn("problem", F.when(none, "missing_value").when(wild, "not_finite").when(c("volume") < 0, "negative_volume").when(c("high") < F.greatest("open", "close"), "high_too_low").when(c("low") > F.least("open", "close"), "low_too_high").when(F.pmod(c("start_micros"), F.lit(period * 1_000_000)) != 0, "off_grid"))


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON, one a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


CANDLES = "generation string, open_micros bigint, close_micros bigint, known_at_micros bigint, open_units bigint, high_units bigint, low_units bigint, close_units bigint, observations bigint, fill string"
PAGES = "acquisition_id string, ordinal bigint, payload binary, payload_sha256 string, receipt_time_utc timestamp"


def write_bars(bars: DataFrame, path: str) -> None:
    """Provider bars by UTC day, in the columns of BARS."""
    write_daily(checked_schema(bars, BARS), path, "timestamp_utc", "symbol")


def read_bars(spark: SparkSession, path: str, first: str, last: str, period: int, server_offset: int) -> DataFrame:
    """Bars of the days [first, last] with `problem`: null, or that of bar_problems, clock (its three times don't agree, or the server's clock isn't `server_offset` seconds ahead) or period. No row is left out, and null provider columns stay null."""
    plain = BARS.replace("symbol string, ", "", 1)
    rows = read_daily(spark, path, "symbol string, " + plain, first, last)
    rows = bar_problems(rows.withColumn("start_micros", F.unix_micros("timestamp_utc")), period)
    clock = (F.col("unix_utc_s") * 1_000_000 != F.col("start_micros")) | (F.col("server_time_s") - F.col("unix_utc_s") != server_offset)
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.coalesce(clock, F.lit(False)), "clock").when(F.col("period_s") != period, "period"))).drop("start_micros")


def out_of_order(rows: DataFrame, key: str, time: str, place: str) -> DataFrame:
    """Rows that don't come strictly after the row before them (by `place`) of their key."""
    before = F.lag(time).over(Window.partitionBy(key).orderBy(place))
    return rows.withColumn("_before", before).where(F.col("_before") >= F.col(time)).drop("_before")


def write_candles(candles: DataFrame, path: str) -> None:
    write_daily(checked_schema(candles.select(*[c.split()[0] for c in CANDLES.split(", ")]), CANDLES).withColumn("_at", F.timestamp_micros("open_micros")), path, "_at", "generation")


def read_candles(spark: SparkSession, path: str, first: str, last: str, duration: int, offset: int = 0) -> DataFrame:
    """Candles of the days [first, last] with `problem`: null, or length (not `duration`), off_grid, early (known before its close) or range (high or low inside open and close)."""
    c = F.col
    rows = read_daily(spark, path, CANDLES, first, last)
    problem = (
        F.when(c("close_micros") - c("open_micros") != duration * 1_000_000, "length").when(F.pmod(c("open_micros") - offset * 1_000_000, F.lit(duration * 1_000_000)) != 0, "off_grid")
        .when(c("known_at_micros") < c("close_micros"), "early").when((c("high_units") < F.greatest("open_units", "close_units")) | (c("low_units") > F.least("open_units", "close_units")), "range")
    )
    return rows.withColumn("problem", problem)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages by the UTC day of their receipt, payloads as they came."""
    write_daily(pages.select(*[c.split()[0] for c in PAGES.split(", ")]), path, "receipt_time_utc")


def read_pages(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Raw pages received on the days [first, last], with `intact`: has the payload the digest it was written with?"""
    return read_daily(spark, path, PAGES, first, last).withColumn("intact", F.sha2("payload", 256) == digest(F.col("payload_sha256")))


def read_generation(spark: SparkSession, path: str, inventory: DataFrame, schema: str, time: str) -> DataFrame:
    """All rows of a daily table on the days that an inventory (date) lists, each as often as it is written, with `listed_rows` (n_rows of its day) and the day's place in the list. Ordered work partitions by day_no and sorts within."""
    days = inventory.select(F.col("date").alias("_date"), F.col("n_rows").alias("listed_rows"), F.row_number().over(Window.orderBy("date")).alias("day_no"))  # a row a day
    rows = spark.read.schema(schema + ", date date").parquet(path)
    return rows.join(days, rows["date"] == days["_date"]).drop("_date").repartition("day_no").sortWithinPartitions("day_no", time)


def daily_archive(spark: SparkSession, root: str) -> DataFrame:
    """The plan of a folder of daily tick files: path, name, date, length, n_rows (from the `.meta.json` beside it, null without one) and `problem`: null, undeclared (another name), no_meta, or repeated (two files of one name and day).

    Only the list of files is read, and the small files of counts.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(root).select("path", "length")
    base = F.element_at(F.split("path", "/"), -1)
    files = listed.where(~base.endswith(".meta.json"))
    pattern = r"^(.+)_(\d{4}-\d{2}-\d{2})_ticks\.parquet$"
    files = files.select("path", "length", F.nullif(F.regexp_extract(base, pattern, 1), F.lit("")).alias("name"), F.regexp_extract(base, pattern, 2).try_cast("date").alias("date"))
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").load(root)
    meta = meta.select(F.regexp_replace("path", r"\.meta\.json$", ".parquet").alias("path"), F.from_json(F.decode("content", "UTF-8"), "rows bigint")["rows"].alias("n_rows"))
    x = files.join(meta, "path", "left").withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("name", "date")))
    problem = F.when(F.col("name").isNull() | F.col("date").isNull(), "undeclared").when(F.col("_k") > 1, "repeated").when(F.col("n_rows").isNull(), "no_meta")
    return x.withColumn("problem", problem).drop("_k")


def publish(df: DataFrame, path: str, *partitions: str) -> dict[str, object]:
    """Writes a table and then its manifest (rows, columns, digest of the rows) as `_manifest.json` beside the data: a table without one isn't whole. Never overwrites."""
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)
    spark = df.sparkSession
    done = table_digest(spark.read.schema(df.schema).parquet(path)).first()
    manifest = {"rows": done["n_rows"], "digest": str(done["digest"]), "schema": df.schema.simpleString()}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def verified(spark: SparkSession, path: str, schema: str) -> dict[str, object]:
    """The manifest of a published table, after its rows have been counted and digested again; a ValueError if they differ."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    now = table_digest(spark.read.schema(schema).parquet(path)).first()
    if (now["n_rows"], str(now["digest"])) != (manifest["rows"], manifest["digest"]):
        raise ValueError(f"{path} holds {now['n_rows']} rows that aren't those of its manifest")
    return manifest
