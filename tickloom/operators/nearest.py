"""Records paired with the nearest record in time of the same entity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.ordered import change, prefix, ranged, scan


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    rows: int,
    tolerance_us: int,
    per: int | None = None,
) -> DataFrame:
    """Each distinct left record with the right record of its entity that is nearest in time, before or after it, at most
    tolerance_us microseconds away (inclusive). Of right records equally near, the smallest id.

    left, right: entity string, time bigint (microseconds), id bigint; other columns are not read. rows: about how many both
    have. Returns left_id, right_id, gap_us; a left record without a partner does not appear.

    Both sides are range-partitioned together by (entity, time, side, id), so an entity of any size is spread over as many
    partitions as it needs; each partition is scanned once. The last right record before a partition and the first after it
    come from a prefix scan over one record for each partition.

    Nulls: rows without entity, time or id are left out, on either side. Repeated ids on the left count once; repeated right
    rows change nothing. Empty tables give no rows. Ties in time and equal records are settled by id.
    """

    def side(df: DataFrame, kind: int) -> DataFrame:
        df = df.select("entity", F.col("time").cast("bigint"), F.lit(kind).cast("tinyint").alias("kind"), F.col("id").cast("bigint"))
        return df.dropna()

    both = side(right, 0).unionAll(side(left, 1))
    table = ranged(both, ["entity", "time", "kind", "id"], rows, "nearest", per)
    right_rows = F.col("kind") == 0
    edges = table.df.groupBy("_pid").agg(
        F.max(F.when(right_rows, F.struct("entity", "time", (-F.col("id")).alias("n")))).alias("last"),
        F.min(F.when(right_rows, F.struct("entity", "time", F.col("id").alias("n")))).alias("first"),
    )
    carry = prefix(edges, table.parts, ["last"], ["first"])

    def pair(pid: int, t: pa.Table, own: pa.Table | None) -> pa.Table:
        before, after = (own.column(c)[0].as_py() if own is not None else None for c in ("last", "first"))
        n = t.num_rows
        time, kind, ids = (t.column(c).to_numpy() for c in ("time", "kind", "id"))
        other = change(t, "entity")
        ent = np.cumsum(other)
        # the first of the right records of one instant has the smallest id
        is_right, at = kind == 0, np.arange(n)
        start = is_right & change(t, "entity", "time", "kind")
        prev = np.maximum.accumulate(np.where(start, at, -1))
        nxt = np.minimum.accumulate(np.where(is_right, at, n)[::-1])[::-1]
        twice = np.zeros(n, bool)
        twice[1:] = ~(other[1:] | (np.diff(time) != 0) | (np.diff(kind) != 0) | (np.diff(ids) != 0))
        q = np.flatnonzero(~is_right & ~twice)
        none = np.iinfo(np.int64).max
        gap, best = np.full(len(q), none), np.full(len(q), none)

        def offer(ok: np.ndarray, times: np.ndarray, other_ids: np.ndarray) -> None:
            g = np.where(ok, np.abs(time[q] - times), none)
            better = (g < gap) | (g == gap) & ok & (other_ids < best)
            gap[better], best[better] = g[better], np.broadcast_to(other_ids, g.shape)[better]

        p, x = prev[q], np.minimum(nxt[q], n - 1)
        offer((p >= 0) & (ent[p] == ent[q]), time[p], ids[p])
        offer((nxt[q] < n) & (ent[x] == ent[q]), time[x], ids[x])
        names = t.column("entity")
        if before and before["entity"] == names[0].as_py():
            offer(ent[q] == 1, np.int64(before["time"]), np.int64(-before["n"]))
        if after and after["entity"] == names[n - 1].as_py():
            offer(ent[q] == ent[-1], np.int64(after["time"]), np.int64(after["n"]))
        keep = gap <= tolerance_us
        return pa.table({"left_id": ids[q][keep], "right_id": best[keep], "gap_us": gap[keep]})

    return scan(table, pair, "left_id bigint, right_id bigint, gap_us bigint", carry)


def tick_quotes(ticks: DataFrame, quotes: DataFrame, tolerance_us: int = 2_000_000) -> DataFrame:
    """Each distinct tick with the nearest quote of its ticker that has a positive bid: tick_id, quote_id, gap_us."""
    rows = ticks.count() + quotes.count()
    left = ticks.select(clean.ticker("ticker").alias("entity"), clean.micros("time_utc").alias("time"), F.col("tick_id").alias("id"))
    right = quotes.filter("bid_price > 0").select(
        clean.ticker("ticker").alias("entity"), clean.micros("time_utc").alias("time"), F.col("quote_id").alias("id")
    )
    return nearest_in_time(left, right, rows, tolerance_us).select(
        F.col("left_id").alias("tick_id"), F.col("right_id").alias("quote_id"), "gap_us"
    )
