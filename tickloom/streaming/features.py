"""Streams of market events: demultiplexing, incremental session features, throttling, windows and keyed sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions import clean

#: Event kinds on the wire, and their fields.
BAR, TRADE, QUOTE = "AM", "T", "Q"
WIRE = "ev string, sym string, o double, h double, l double, c double, v double, s bigint, p double, sz bigint, bp double, bs bigint, ap double, `as` bigint, t bigint"


def demultiplex(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, trades and quotes of a stream (or table) of JSON events, by their kind; other kinds and lines that cannot be read
    are left out. Times are epoch milliseconds; volumes are cut to whole numbers."""
    e = lines.select(F.from_json(column, WIRE).alias("e")).select("e.*").withColumn("ticker", clean.ticker("sym")).filter("ticker is not null")
    at = lambda c: F.timestamp_millis(c)
    bars = e.filter(F.col("ev") == BAR).select("ticker", at("s").alias("ts"), "o", "h", "l", "c", F.col("v").cast("bigint").alias("v"))
    trades = e.filter(F.col("ev") == TRADE).select("ticker", at("t").alias("ts"), F.col("p").alias("price"), F.col("sz").alias("size"))
    quotes = e.filter(F.col("ev") == QUOTE).select("ticker", at("t").alias("ts"), F.col("bp").alias("bid"), F.col("bs").alias("bid_size"), F.col("ap").alias("ask"), F.col("as").alias("ask_size"))
    return bars, trades, quotes


FEATURES = (
    "ticker string, session_date date, ts timestamp, vwap double, dist_to_vwap double, delta_close double, delta_vwap double, body double, bar_range double, upper_wick double, lower_wick double, body_ratio double,"
    " avg_volume_5 double, rel_volume double, above_vwap boolean, below_vwap boolean, vwap_cross_up boolean, vwap_cross_down boolean, late boolean"
)
STATE = "pv double, v double, n bigint, last array<double>, c double, vwap double, ts timestamp"


def _one(key: tuple, b, s: tuple) -> tuple[tuple, tuple]:
    """The features of a bar after state s, and the state after it; a late bar gets features and leaves the state as it is."""
    pv, v, n, last, c0, w0, ts = s
    late = ts is not None and b.ts <= ts
    pv1, v1, n1, last1 = pv + (b.h + b.l + b.c) / 3 * b.v, v + b.v, n + 1, [*last, float(b.v)][-5:]
    vwap = pv1 / v1 if v1 else 0.0
    mean5 = sum(last1) / len(last1)
    base = v / n if n else mean5
    base = max(base, mean5) if n1 <= 10 else base
    span = b.h - b.l
    row = (
        *key, b.ts, vwap, b.c - vwap, None if c0 is None else b.c - c0, None if w0 is None else vwap - w0, abs(b.c - b.o), span, b.h - max(b.o, b.c), min(b.o, b.c) - b.l,
        abs(b.c - b.o) / span if span else 0.0, mean5, b.v / base if base > 0 else 0.0, b.c > vwap, b.c < vwap, c0 is not None and c0 < w0 and b.c > vwap, c0 is not None and c0 > w0 and b.c < vwap, late,
    )
    return row, s if late else (pv1, v1, n1, last1, float(b.c), float(vwap), b.ts)


def seeds(bars: DataFrame) -> DataFrame:
    """The state of each ticker and session after stored bars (ticker, ts, o, h, l, c, v), as the stream would have it: ticker,
    session_date, seed struct. Bars without a price or volume are left out, repeated minutes count once."""
    b = bars.dropna(subset=["ticker", "ts", "o", "h", "l", "c", "v"]).select(clean.ticker("ticker").alias("ticker"), "ts", "h", "l", "c", "v").dropDuplicates(["ticker", "ts"])
    pv, v = F.sum((F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v")), F.sum(F.col("v").cast("double"))
    last = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ts", F.col("v").cast("double").alias("v"))), lambda x, y: F.when(x["ts"] < y["ts"], -1).otherwise(1)), -5, 5), lambda x: x["v"])
    # a session has at most as many bars as minutes
    s = b.groupBy("ticker", clean.ny_date("ts").alias("session_date")).agg(pv.alias("pv"), v.alias("v"), F.count(F.lit(1)).alias("n"), last.alias("last"), F.max_by("c", "ts").alias("c"), F.max("ts").alias("ts"))
    seed = F.struct("pv", "v", "n", "last", F.col("c").cast("double").alias("c"), F.coalesce(F.try_divide("pv", "v"), F.lit(0.0)).alias("vwap"), F.col("ts").alias("seen"))
    return s.select("ticker", "session_date", seed.alias("seed"))


def session_features(bars: DataFrame, stored: DataFrame | None = None, idle_hours: int = 168) -> DataFrame:
    """Features of a stream of bars (ticker, ts, o, h, l, c, v), as the batch operator gives them for bars in order: the state
    of a ticker and session is a few numbers, and each bar costs the same. A late or repeated bar (not after the last one of
    its session) is projected on the current state, marked late, and does not advance it. A new session starts afresh. Bars
    without ticker, time, price or volume are left out.

    stored: bars kept so far. A session without state begins from its stored bars, so a stream that starts in mid-session, or
    has lost its state, goes on as if it had seen them; bars that are stored already count as repeated. State of
    sessions whose last bar lies idle_hours behind the newest bar of the stream is dropped, so it is bounded by the sessions of
    that time; so are bars that come later than that, and none besides."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        if state.exists:
            s = state.get
        else:
            s = (0.0, 0.0, 0, [], None, None, None)
            if seeded and rows["n"].iloc[0] > 0:
                x = rows.iloc[0]
                s = (float(x["pv"]), float(x["sv"]), int(x["n"]), [float(v) for v in x["last"]], float(x["sc"]), float(x["vwap"]), x["seen"])
        s = (*s[:3], list(s[3]), *s[4:])
        out = []
        for b in rows[["ts", "o", "h", "l", "c", "v"]].itertuples(index=False):
            row, s = _one(key, b, s)
            out.append(row)
        state.update(s)
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000) + idle_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in FEATURES.split(", ")])

    seeded = stored is not None
    ready = bars.dropna(subset=["ticker", "ts", "o", "h", "l", "c", "v"]).withColumn("session_date", clean.ny_date("ts")).withWatermark("ts", f"{idle_hours} hours")
    if seeded:
        # the stored bars are read with each batch
        s = seeds(stored).select("ticker", "session_date", "seed.pv", F.col("seed.v").alias("sv"), "seed.n", "seed.last", F.col("seed.c").alias("sc"), "seed.vwap", "seed.seen")
        ready = ready.join(s, ["ticker", "session_date"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ready.groupBy("ticker", "session_date").applyInPandasWithState(run, FEATURES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def throttled(quotes: DataFrame, gap_ms: int = 100) -> DataFrame:
    """The quotes of each ticker that come at least gap_ms after the last one that was let through, by event time, so a replay
    gives the same. quotes: ticker, ts, bid, ask."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for r in rows.itertuples(index=False):
            if last is None or (r.ts - last).total_seconds() * 1000 >= gap_ms:
                kept.append((key[0], r.ts, r.bid, r.ask))
                last = r.ts
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["ticker", "ts", "bid", "ask"])

    ready = quotes.select("ticker", "ts", "bid", "ask").dropna(subset=["ticker", "ts"])
    return ready.groupBy("ticker").applyInPandasWithState(run, "ticker string, ts timestamp, bid double, ask double", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def windowed_bars(trades: DataFrame, minutes: int, late: str = "1 day") -> DataFrame:
    """Bars of so many minutes from a stream of trades (ticker, ts, price, size); the watermark only bounds the state."""
    at = F.window("ts", f"{minutes} minutes")
    return trades.withWatermark("ts", late).groupBy("ticker", at.alias("w")).agg(
        F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.sum("size").alias("v")
    ).select("ticker", F.col("w.start").alias("bucket"), "o", "h", "l", "c", "v")
