"""Tables in one global order, split anywhere, and scans over them.

`ranged` range-partitions a table by its whole sort key and writes it to the shared folder, one file of one row group for
each partition, so a hot entity is spread over as many partitions as its rows need and the split points stay fixed for every
later pass, also when executors are lost. `scan` then hands each partition, in order, to a function on Arrow data. What a
partition must know of its neighbours is exchanged between the passes as one small record for each partition: `prefix`
combines the records of all partitions before (or after) each one by a parallel prefix scan in two levels, `neighbours` brings
each partition the rows next to it. `scan` gives every partition its own record.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a partition of a ranged table, by the default width of its columns. A partition is held in memory while it is
#: scanned, so this bounds a task's memory.
BYTES = 16 << 20
#: Partitions of a group of the prefix scan: each group is scanned by one task, and the groups' totals by one more.
GROUP = 1_000
#: Records that are sent to every task; with more partitions each partition meets its own record in a shuffle.
CARRIES = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. A local session without one gets its own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/") + "/tickloom"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the folder is the cluster's to clear
        pass


def drop_at_exit(spark: SparkSession, path: str) -> str:
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives the loss of executors. Dropped when the driver ends."""
    spark = df.sparkSession
    path = drop_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, per: int) -> int:
    """Partitions for so many rows: of at most about `per` rows, and enough for all cores once there are enough rows."""
    return max(rows // per + 1, min(spark.sparkContext.defaultParallelism, rows // 20_000 + 1))


@dataclass
class Ranged:
    """A written table in the order of keys: its columns, the number of the partition in `_pid`, and whether a row is the
    first of its partition in `_first`."""

    df: DataFrame
    keys: list[str]
    parts: int


def ranged(df: DataFrame, keys: list[str], rows: int, name: str, per: int | None = None) -> Ranged:
    """df in the order of keys. rows: about how many it has; per: rows of a partition, from BYTES unless given."""
    spark = df.sparkSession
    n = parts_for(spark, rows, per or max(1, BYTES // df._jdf.schema().defaultSize()))
    at = F.monotonically_increasing_id()  # in its low 33 bits the number of the row in its partition
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_pid": F.spark_partition_id(), "_first": at.bitwiseAND(F.lit((1 << 33) - 1)) == 0})
    path = drop_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    out.write.option("compression", "zstd").option("parquet.block.size", (1 << 31) - 1).parquet(path)
    return Ranged(spark.read.schema(out.schema).parquet(path), keys, n)


def scan(table: Ranged, fn: Callable[[int, pa.Table, pa.Table | None], pa.Table | None], schema: str, carry: DataFrame | None = None) -> DataFrame:
    """fn of each partition: its number, its rows in order, and its record as a table of one row (None without one).

    carry: one row for each partition, with its `_pid`. Up to CARRIES of them are sent to all tasks once for each executor;
    if the table has more partitions, rows and records are brought together by partition instead. A file is read by one
    task, in order; a file that came in parts would be an error and is refused."""
    if carry is None:
        return table.df.mapInArrow(_runner(lambda pid, t: fn(pid, t, None)), schema)
    if table.parts <= CARRIES:
        rows = carry.toArrow()
        sent = table.df.sparkSession.sparkContext.broadcast((rows, {p: i for i, p in enumerate(rows.column("_pid").to_pylist())}))

        def with_own(pid: int, t: pa.Table) -> pa.Table | None:
            all_, at = sent.value
            return fn(pid, t, all_.slice(at[pid], 1) if pid in at else None)

        return table.df.mapInArrow(_runner(with_own), schema)
    kind = carry.schema.simpleString()
    mine = table.df.withColumn("_carry", F.lit(None).cast(kind))
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.df.schema if f.name not in ("_pid", "_first")]
    own = carry.select(*null, "_pid", F.lit(True).alias("_first"), F.struct(*carry.columns).alias("_carry"))
    both = mine.unionByName(own).repartitionById(table.parts, "_pid").sortWithinPartitions("_pid", F.col("_carry").isNull(), *table.keys)

    def split(pid: int, t: pa.Table) -> pa.Table | None:
        has = t.column("_carry")[0].is_valid
        own = pa.Table.from_struct_array(t.column("_carry").slice(0, 1).combine_chunks()) if has else None
        t = t.drop_columns(["_carry"]).slice(int(has))
        return fn(pid, t, own) if t.num_rows else None

    return both.mapInArrow(_runner(split), schema)


def _runner(fn: Callable[[int, pa.Table], pa.Table | None]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            ids = b.column("_pid").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and ids[lo] != at:
                    yield from _batches(fn(int(at), pa.Table.from_batches(held)))
                    held = []
                if not held and not b.column("_first")[lo].as_py():
                    raise RuntimeError(f"partition {ids[lo]} was read in parts")
                at = ids[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _batches(fn(int(at), pa.Table.from_batches(held)))

    return run


def _batches(out: pa.Table | None) -> Iterator[pa.RecordBatch]:
    if out is not None and out.num_rows:
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)


def _group() -> Column:
    return F.floor(F.col("_pid") / F.lit(GROUP))


def prefix(edges: DataFrame, parts: int, before: list[str], after: list[str] = ()) -> DataFrame:
    """For each partition the greatest value of each column of `before` over all partitions before it, and the least of each
    column of `after` over all after it; null where there is none. edges: _pid and the columns, one row for each partition.

    A parallel prefix scan: groups of GROUP partitions are scanned side by side, then the groups' totals (one row for each
    GROUP partitions), and the two are put together."""
    w = Window.partitionBy(_group()).orderBy("_pid")
    past, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    own = edges.select("_pid", _group().alias("_g"), *(F.max(c).over(past).alias(c) for c in before), *(F.min(c).over(rest).alias(c) for c in after))
    if parts <= GROUP:
        return own.drop("_g")
    totals = edges.groupBy(_group().alias("_g")).agg(*(F.max(c).alias(c) for c in before), *(F.min(c).alias(c) for c in after))
    w = Window.orderBy("_g")
    past, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select("_g", *(F.max(c).over(past).alias(f"_{c}") for c in before), *(F.min(c).over(rest).alias(f"_{c}") for c in after))
    both = own.join(totals, "_g")
    return both.select("_pid", *(F.greatest(c, f"_{c}").alias(c) for c in before), *(F.least(c, f"_{c}").alias(c) for c in after))


def neighbours(edges: DataFrame, parts: int, most: int) -> DataFrame:
    """For each partition the `most` rows before it and after it, in order: _pid, before, after. edges: _pid, head and tail, the
    first and last `most` rows of each partition as arrays, at least one row each. The partitions are numbered without gaps
    (in two levels, as in prefix), and each hands its rows to the `most` next ones on either side."""
    w = Window.partitionBy(_group()).orderBy("_pid")
    own = edges.withColumns({"_g": _group(), "_i": F.row_number().over(w).cast("bigint")})
    if parts > GROUP:
        sizes = edges.groupBy(_group().alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
        sizes = sizes.select("_g", F.coalesce(F.sum("_size").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        own = own.join(sizes, "_g").withColumn("_i", F.col("_i") + F.col("_start"))
    hops = own.withColumn("_hop", F.explode(F.sequence(F.lit(1), F.lit(most))))
    none = F.lit(None).cast(edges.schema["head"].dataType)
    given = hops.select((F.col("_i") + F.col("_hop")).alias("_to"), F.col("_i").alias("_from"), F.col("tail").alias("before"), none.alias("after")).unionAll(
        hops.select((F.col("_i") - F.col("_hop")).alias("_to"), F.col("_i").alias("_from"), none, "head")
    )
    line = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("_from", c)))), lambda x: x[c]))
    got = given.groupBy("_to").agg(line("before").alias("before"), line("after").alias("after"))
    got = got.select(F.col("_to").alias("_i"), F.slice("before", F.greatest(F.lit(1), F.size("before") - most + 1), F.lit(most)).alias("before"), F.slice("after", 1, most).alias("after"))
    return own.select("_pid", "_i").join(got, "_i", "left").drop("_i")


def change(t: pa.Table, *names: str) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns (without nulls); the first row does."""
    n = t.num_rows
    out = np.zeros(n, bool)
    for name in names:
        c = t.column(name)
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            c = c.combine_chunks()
            c = c.dictionary_encode()
            c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).indices
        v = c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
        out[1:] |= v[1:] != v[:-1]
    if n:
        out[0] = True
    return out
