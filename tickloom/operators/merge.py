"""Upserts, patches and change-driven views over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last one by the order columns; rows with a null key are left out. Partly reduced before the
    shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.dropna(subset=keys).groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def patch(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], drop_nulls: bool = True) -> DataFrame:
    """Rows with equal keys as patches of one row, in order: each column's last value, with drop_nulls its last known one."""
    at = F.struct(*order)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at) if drop_nulls else at).alias(c)
    return rows.dropna(subset=keys).groupBy(*keys).agg(*map(last, columns))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in gone (rows with a null key stay)."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def changes(rows: DataFrame, by: str, order: list[str], watched: list[Column]) -> DataFrame:
    """Whether each row differs from the one before it of the same `by` in any watched column; the first one does."""
    w = Window.partitionBy(by).orderBy(*order)
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~c.eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("changed", differs | (F.row_number().over(w) == 1))


def runs(rows: DataFrame, by: str, order: list[str], flag: Column, n: int = 3) -> DataFrame:
    """Whether each row ends a run of n rows of its `by` that all have the flag (null counts as not)."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)
    return rows.withColumn("run", (F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == n))


def first_per_reason(rows: DataFrame, reason: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each reason, numbered; a report of bounded size."""
    w = Window.partitionBy(reason).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def cadence(keys: DataFrame, key: str, minutes: DataFrame, interval: int) -> DataFrame:
    """Which keys are due in which minute of the day: key number s (from 0, in order) is due when (minute - s) mod interval is
    0. Keys are numbered by their rank; minutes: minute int."""
    slots = keys.select(key).distinct().withColumn("slot", (F.dense_rank().over(Window.orderBy(key)) - 1) % interval)
    return slots.join(F.broadcast(minutes.withColumn("slot", F.pmod("minute", F.lit(interval)))), "slot").select(key, "minute")
