"""Writers: append, keyed upsert, CSV, JSON lines by day, and gzip text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.merge import upsert, without
from tickloom.ordered import written


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


class KeyedTable:
    """A table that rows are merged into by key. Rows lie in `buckets` parts by a hash of the key; a merge writes only the parts
    that its rows touch, below data/<version>, and then a manifest manifests/<version> that names the newest folder of each
    part. A version is in force once its manifest bears its name, so a lost writer leaves the last one. Folders are deleted
    when none of the last `keep` manifests names them, so readers have that many merges' time. One writer at a time; the
    number of parts stays what it was when the table was begun."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64, keep: int = 10):
        self.spark, self.path, self.keys, self.order, self.keep = spark, path.rstrip("/"), keys, order, keep
        last = self._manifest()
        self.buckets = last["buckets"] if last else buckets

    def _names(self, folder: str) -> list[str]:
        fs, at = _fs(self.spark, self.path)
        folder = f"{self.path}/{folder}"
        return [s.getPath().getName() for s in fs.listStatus(at(folder))] if fs.exists(at(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _manifest(self, version: int | None = None) -> dict | None:
        v = self.versions()
        if not v:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{v[-1] if version is None else version}").first()[0])

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The rows in force, of all parts or of some; None of a table without a version."""
        m = self._manifest()
        if m is None:
            return None
        at = [f"{self.path}/data/{v}/_part={p}" for p, v in m["parts"].items() if parts is None or int(p) in parts]
        schema = StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _change(self, rows: DataFrame, make: Callable[[DataFrame | None], DataFrame]) -> int:
        """A new version in which the parts that rows touch are what `make` gives of them; the number of the version in force."""
        m, v = self._manifest(), self.versions()
        touched = [r[0] for r in rows.dropna(subset=self.keys).select(self._part()).distinct().collect()]  # at most `buckets`
        if not touched:
            return v[-1] if v else 0
        number = (v[-1] if v else 0) + 1
        out = make(self.read(touched))
        out.withColumn("_part", self._part()).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/data/{number}")
        made = {n.removeprefix("_part="): number for n in self._names(f"data/{number}") if n.startswith("_part=")}
        parts = {p: x for p, x in (m["parts"] if m else {}).items() if int(p) not in touched} | made
        text = json.dumps({"buckets": self.buckets, "parts": parts, "schema": out.schema.jsonValue()})
        temp = f"{self.path}/_w-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(temp)
        fs, at = _fs(self.spark, self.path)
        fs.mkdirs(at(f"{self.path}/manifests"))
        if not fs.rename(at(temp), at(f"{self.path}/manifests/{number}")):
            raise OSError(f"version {number} exists already")
        self._clear()
        return number

    def _clear(self) -> None:
        fs, at = _fs(self.spark, self.path)
        v = self.versions()
        for n in v[: -self.keep]:
            fs.delete(at(f"{self.path}/manifests/{n}"), True)
        named = {x for n in v[-self.keep :] for x in self._manifest(n)["parts"].values()}
        for n in self._names("data"):
            if n.isdigit() and int(n) not in named and int(n) <= v[-1]:
                fs.delete(at(f"{self.path}/data/{n}"), True)

    def merge(self, rows: DataFrame) -> int:
        """Merges rows in; of equal keys the last by the order columns stays, rows with a null key are left out."""
        return self._change(rows, lambda old: upsert(rows if old is None else old.unionByName(rows), self.keys, self.order).select(*rows.columns))

    def remove(self, rows: DataFrame) -> int:
        """Deletes the rows with the keys of these."""
        if self.read() is None:
            return 0
        return self._change(rows, lambda old: without(old, rows, self.keys))

    def claim(self, rows: DataFrame) -> DataFrame:
        """Inserts the rows whose keys are not there yet, and gives those: a claim that succeeds once for each key."""
        rows, old = upsert(rows, self.keys, self.order).select(*rows.columns), self.read()
        # what is new is settled before the table changes
        new = written(rows if old is None else without(rows, old, self.keys), "claimed")
        self.merge(new)
        return new

    def stream(self, df: DataFrame, checkpoint: str):
        """A streaming query that merges each batch; a repeated batch changes nothing."""
        return df.writeStream.foreachBatch(lambda batch, _: self.merge(batch) and None).option("checkpointLocation", checkpoint).outputMode("append")


def csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; quotes only where needed, or around everything. Quotes within are doubled."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', emptyValue="")


def json_by_day(df: DataFrame, path: str, ts: str) -> None:
    """Appends JSON lines, a folder for each UTC day; rows without a time come under __HIVE_DEFAULT_PARTITION__."""
    df.withColumn("day", F.date_format(F.col(ts), "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def gzip_text(df: DataFrame, path: str) -> None:
    """A string column as gzip-compressed lines."""
    df.write.mode("overwrite").text(path, compression="gzip")


def summary_json(df: DataFrame, path: str) -> None:
    """Each row as one JSON document a line."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
