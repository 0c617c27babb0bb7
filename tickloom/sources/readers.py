"""Readers that bear what is found in files: broken lines, other versions, growing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clean


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of JSON lines with the schema, and a row with the numbers of lines: lines, blank, broken. Blank and broken lines
    are skipped and counted."""
    text = spark.read.text(path)
    parsed = text.select("value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    blank = F.coalesce(F.btrim("value") == "", F.lit(True))
    broken = ~blank & (F.col("r").isNull() | F.col("r._broken").isNotNull())
    rows = parsed.filter(~blank & ~broken).select("r.*").drop("_broken")
    counts = parsed.agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(broken).alias("broken"))
    return rows, counts


def document(spark: SparkSession, path: str, schema: str, version: str, field: str = "version") -> DataFrame:
    """A whole JSON document of the wanted version; another version is an error when it is read."""
    d = spark.read.schema(schema).json(path, multiLine=True)
    same = F.col(field).cast("string") == version
    return d.filter(F.when(F.coalesce(same, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unexpected version: "), F.coalesce(F.col(field).cast("string"), F.lit("none")))).cast("boolean")))


def last_line(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each file that is not blank: file, value. Lines are numbered within their file by position."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    return t.filter(F.btrim("value") != "").groupBy("file").agg(F.max_by("value", "at").alias("value"))


def wire_bars(spark: SparkSession, path: str, ticker: str, first_ms: int, last_ms: int) -> DataFrame:
    """Bars landed as JSON (t in epoch milliseconds, o, h, l, c, v), of an exact range of times, both ends included; the volume
    is cut to a whole number and the ticker put in upper case."""
    raw = spark.read.schema("t bigint, o double, h double, l double, c double, v double").json(path)
    at = F.timestamp_millis("t")
    return raw.filter(F.col("t").between(first_ms, last_ms)).select(clean.ticker(F.lit(ticker)).alias("ticker"), at.alias("ts"), "o", "h", "l", "c", F.col("v").cast("bigint").alias("v"))


def newer_than(rows: DataFrame, stored: DataFrame, key: str, ts: str) -> DataFrame:
    """The rows after the last stored time of their key (all of a key that has none): an incremental read."""
    mark = stored.groupBy(key).agg(F.max(ts).alias("_mark"))
    return rows.join(mark, key, "left").filter(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def page(rows: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """One page of an ordered table, from 0."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def latest_files(files: DataFrame, keep: int) -> DataFrame:
    """Which files (path, modified) a retention of the newest `keep` leaves; equal times by path."""
    w = Window.orderBy(F.desc("modified"), F.desc("path"))
    return files.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")
