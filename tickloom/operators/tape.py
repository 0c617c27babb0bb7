"""Ticks and quotes: rolling prices, flow, sweeps, snapshots, and as-of reference prices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.ordered import change, prefix, ranged, scan


def clean_ticks(ticks: DataFrame) -> DataFrame:
    """One row for each tick_id with ticker, time and a price: ticker, session_date, ts, tick_id, price double, size."""
    t = ticks.select(
        clean.ticker("ticker").alias("ticker"), clean.ny_date("time_utc").alias("session_date"), F.col("time_utc").cast("timestamp").alias("ts"), "tick_id",
        F.col("price").cast("double").alias("price"), F.col("size").cast("bigint").alias("size"),
    )
    return t.filter("ticker is not null and ts is not null and price is not null and tick_id is not null").dropDuplicates(["tick_id"])


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """One row for each quote_id with ticker and time: ticker, session_date, ts, quote_id, bid, ask (null unless above 0), sizes."""
    price = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    q = quotes.select(
        clean.ticker("ticker").alias("ticker"), clean.ny_date("time_utc").alias("session_date"), F.col("time_utc").cast("timestamp").alias("ts"), "quote_id",
        price("bid_price").alias("bid"), price("ask_price").alias("ask"), F.col("bid_size").cast("bigint").alias("bid_size"), F.col("ask_size").cast("bigint").alias("ask_size"),
    )
    return q.filter("ticker is not null and ts is not null and quote_id is not null").dropDuplicates(["quote_id"])


def rolling_vwap(ticks: DataFrame, n: int = 500) -> DataFrame:
    """Each clean tick with the volume-weighted price of the last n ticks of its ticker and session; null without size. The
    sums of the last n ticks are differences of running sums, which are of whole millionths and so exact: a tick costs the
    same whatever n is."""
    w = Window.partitionBy("ticker", "session_date").orderBy("ts", "tick_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    money = F.sum((F.round(F.col("price") * 1_000_000).cast("decimal(18,0)") * F.col("size")).cast("decimal(28,0)")).over(so_far)
    x = ticks.select("ticker", "session_date", "ts", "tick_id", money.alias("_m"), F.sum("size").over(so_far).alias("_s"), F.count("size").over(so_far).alias("_c"))
    within = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0))
    v = F.when(within("_c") > 0, F.try_divide(within("_m").cast("double"), (within("_s") * 1_000_000).cast("double")))
    return x.select("ticker", "session_date", "ts", "tick_id", v.alias("vwap"))


def tape_flow(ticks: DataFrame, n: int = 100) -> DataFrame:
    """The flow of the last n clean ticks of each ticker and session: ticks, mean size, volume, big prints (at least 2.5 mean
    sizes), volume on upticks and on downticks, and the move from first to last. Only the last n ticks are sorted out of a
    session, before its shuffle."""
    keys = ["ticker", "session_date"]
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("tick_id"))
    last = ticks.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    mean = last.withColumns({"_b": F.lead("price").over(Window.partitionBy(*keys).orderBy("_k")), "_mean": F.avg("size").over(Window.partitionBy(*keys))})
    size = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
    return mean.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("ticks"), F.round(F.avg("size"), 6).alias("mean_size"), F.sum("size").alias("volume"),
        F.count_if(F.col("size") >= F.col("_mean") * 2.5).alias("big_prints"), size(F.col("price") > F.col("_b")).alias("up_volume"),
        size(F.col("price") < F.col("_b")).alias("down_volume"), F.round(F.min_by("price", "_k") - F.max_by("price", "_k"), 6).alias("move"),
    )


def quote_pressure(quotes: DataFrame, n: int = 80, tail: int = 5) -> DataFrame:
    """Of the last n clean quotes of each ticker and session: mean sizes, the last sizes, and how many bids and asks differ
    among the last `tail` and how they moved."""
    w = Window.partitionBy("ticker", "session_date").orderBy(F.desc("ts"), F.desc("quote_id"))
    last = quotes.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    t = lambda c: F.when(F.col("_k") <= tail, F.col(c))
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    return last.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("quotes"), F.round(F.avg("bid_size"), 6).alias("mean_bid_size"), F.round(F.avg("ask_size"), 6).alias("mean_ask_size"),
        at("bid_size", 1).alias("last_bid_size"), at("ask_size", 1).alias("last_ask_size"), F.count_distinct(t("bid")).alias("bids"), F.count_distinct(t("ask")).alias("asks"),
        F.round(at("bid", 1) - at("bid", tail), 6).alias("bid_move"), F.round(at("ask", 1) - at("ask", tail), 6).alias("ask_move"),
    )


def sweeps(bars: DataFrame, n: int = 10) -> DataFrame:
    """Bars that trade beyond the range of the n bars before them in their session and close back within it: ticker,
    session_date, ts, side (high or low; a bar may have both)."""
    w = Window.partitionBy("ticker", "session_date").orderBy("ts").rowsBetween(-n, -1)
    hi, lo = F.col("_hi"), F.col("_lo")
    sides = F.array_compact(F.array(F.when((F.col("h") > hi) & (F.col("c") < hi), "high"), F.when((F.col("l") < lo) & (F.col("c") > lo), "low")))
    return bars.withColumns({"_hi": F.max("h").over(w), "_lo": F.min("l").over(w)}).select("ticker", "session_date", "ts", F.explode(sides).alias("side"))


def snapshots(ticks: DataFrame, quotes: DataFrame) -> DataFrame:
    """For each ticker the last price with its time, and the last positive bid and ask with their time: a trade updates the
    price, a quote keeps the earlier side where its own is not positive."""
    t = ticks.groupBy("ticker").agg(F.max(F.struct("ts", "tick_id", "price")).alias("t"))
    q = quotes.groupBy("ticker").agg(
        F.max(F.when(F.col("bid").isNotNull(), F.struct("ts", "quote_id", "bid"))).alias("b"), F.max(F.when(F.col("ask").isNotNull(), F.struct("ts", "quote_id", "ask"))).alias("a"),
        F.max("ts").alias("quote_ts"),
    )
    return t.join(q, "ticker", "full").select(
        "ticker", F.col("t.price").alias("price"), F.col("t.ts").alias("price_ts"), F.col("b.bid").alias("bid"), F.col("a.ask").alias("ask"), "quote_ts"
    )


def throttle(quotes: DataFrame, gap_ms: int = 100) -> DataFrame:
    """For each ticker and session, how many clean quotes come less than gap_ms after the one before them, and how many do
    not, by event time."""
    w = Window.partitionBy("ticker", "session_date").orderBy("ts", "quote_id")
    close = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) < gap_ms * 1000, F.lit(False))
    return quotes.withColumn("close", close).groupBy("ticker", "session_date").agg(F.count_if("close").alias("within"), F.count_if(~F.col("close")).alias("apart"))


def latest_known(asks: DataFrame, records: DataFrame, kinds: int, rows: int, per: int | None = None) -> DataFrame:
    """For each ask the latest record of each kind of its entity at or before its time: id, and for each kind k the time t<k>
    (microseconds) and the value v<k>, null without one. Of records at one instant the largest value.

    asks: entity string, time bigint, id bigint; records: entity, time, kind int (0 to kinds - 1), value double. All lie in one
    order by (entity, time), split into partitions anywhere; the latest records before a partition come from a prefix scan
    over one record of each kind for each partition. Rows with a null entity or time, and records with a null kind or value,
    are left out. rows: about how many both have.
    """
    none = F.lit(None)
    r = records.filter("kind is not null and value is not null").select("entity", "time", F.col("kind").cast("int").alias("kind"), "value", none.cast("bigint").alias("id"))
    a = asks.select("entity", "time", F.lit(kinds).alias("kind"), none.cast("double").alias("value"), "id")
    both = r.unionAll(a).filter("entity is not null and time is not null")
    table = ranged(both, ["entity", "time", "kind", "value", "id"], rows, "latest", per)
    last = [F.max(F.when(F.col("kind") == k, F.struct("entity", "time", "value"))).alias(f"k{k}") for k in range(kinds)]
    carry = prefix(table.df.groupBy("_pid").agg(*last), table.parts, [f"k{k}" for k in range(kinds)])

    def look(pid: int, t: pa.Table, own: pa.Table | None) -> pa.Table:
        n, kind, time = t.num_rows, t.column("kind").to_numpy(), t.column("time").to_numpy()
        value, ent, at = t.column("value").fill_null(0.0).to_numpy(), np.cumsum(change(t, "entity")), np.arange(n)
        q = np.flatnonzero(kind == kinds)
        out = {"id": t.column("id").take(pa.array(q))}
        first = t.column("entity")[0].as_py()
        for k in range(kinds):
            near = np.maximum.accumulate(np.where(kind == k, at, -1))[q]
            ok = (near >= 0) & (ent[near] == ent[q])
            ts, v = time[near].copy(), value[near].copy()
            c = own.column(f"k{k}")[0].as_py() if own is not None else None
            if c and c["entity"] == first:
                old = ~ok & (ent[q] == 1)
                ts[old], v[old], ok = c["time"], c["value"], ok | old
            out |= {f"t{k}": pa.array(ts, mask=~ok), f"v{k}": pa.array(v, mask=~ok)}
        return pa.table(out)

    return scan(table, look, "id bigint, " + ", ".join(f"t{k} bigint, v{k} double" for k in range(kinds)), carry)


def reference_prices(asks: DataFrame, ticks: DataFrame, quotes: DataFrame, bars: DataFrame, rows: int, quote_s: int = 30, tick_s: int = 60, per: int | None = None) -> DataFrame:
    """For each ask (id, ticker, ts) the price to refer to: the middle of the last quote with both sides if at most quote_s
    seconds old, else the last tick's price if at most tick_s old, else the last bar's close: id, price, kind. An ask at the
    time of a record sees it. Without any of them the price and the kind are null. See latest_known."""
    us = F.unix_micros("ts")
    line = lambda df, k, price: df.select(F.col("ticker").alias("entity"), us.alias("time"), F.lit(k).alias("kind"), price.alias("value"))
    records = line(quotes, 0, (F.col("bid") + F.col("ask")) / 2).unionAll(line(ticks, 1, F.col("price"))).unionAll(line(bars, 2, F.col("c")))
    seen = latest_known(asks.select(F.col("ticker").alias("entity"), us.alias("time"), "id"), records, 3, rows, per)
    seen = seen.join(asks.select("id", F.unix_seconds("ts").alias("now")), "id")
    fresh = lambda k, s: F.col("now") - F.floor(F.col(f"t{k}") / 1_000_000) <= s
    return seen.select(
        "id", F.when(fresh(0, quote_s), F.col("v0")).when(fresh(1, tick_s), F.col("v1")).otherwise(F.col("v2")).alias("price"),
        F.when(fresh(0, quote_s), "quote").when(fresh(1, tick_s), "tick").when(F.col("v2").isNotNull(), "bar").alias("kind"),
    )
