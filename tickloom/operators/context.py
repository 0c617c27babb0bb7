"""What was known at an instant: news in time, bars on hand, the last event, the best so far; and links between records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clean


def news_as_of(asks: DataFrame, news: DataFrame, days: int = 2, n: int = 10) -> DataFrame:
    """For each ask the n latest news published in the `days` days up to its instant (both ends included), never later, that
    name no ticker or its own: ask, news, n (1 for the latest; equal times by news id).

    asks: ask bigint, ticker string, at timestamp. news: news bigint, tickers array<string>, published timestamp. Tickers compare
    trimmed and in upper case. News are brought to the asks by ticker and day, so an ask meets those of its own days only; a
    hot ticker is spread by day. News without tickers are met by day. Rows with a null id or time are left out; an ask without
    a ticker meets only news without."""
    day = lambda c: F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("bigint")
    a = asks.filter("ask is not null and at is not null").select("ask", clean.ticker("ticker").alias("ticker"), F.col("at").cast("timestamp").alias("at"))
    every = F.array("ticker", F.lit("*"))
    a = a.withColumn("day", F.explode(F.sequence(day("at") - days, day("at")))).withColumn("who", F.explode(F.array_compact(every))).drop("ticker")
    own = F.array_distinct(F.array_compact(F.transform(F.coalesce("tickers", F.array().cast("array<string>")), clean.ticker)))
    v = news.filter("news is not null and published is not null").select("news", F.col("published").cast("timestamp").alias("published"), own.alias("own"))
    v = v.select("news", "published", day("published").alias("day"), F.explode(F.when(F.size("own") == 0, F.array(F.lit("*"))).otherwise(F.col("own"))).alias("who"))
    met = a.join(v, ["who", "day"]).filter((F.col("published") <= F.col("at")) & (F.col("published") >= F.col("at") - F.make_dt_interval(F.lit(days))))
    w = Window.partitionBy("ask").orderBy(F.desc("published"), "news")
    return met.select("ask", "news", "published").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("ask", "news", "n")


def matching(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows whose key is among the wanted ones, and those without a key."""
    return rows.filter(F.col(key).isNull()).unionByName(rows.join(wanted.select(key).dropna().distinct(), key, "left_semi").select(*rows.columns))


def with_last(rows: DataFrame, labels: DataFrame, keys: list[str], order: list[str], value: str, otherwise: str) -> DataFrame:
    """rows with the last label of their keys (by the order columns), or `otherwise`."""
    best = labels.dropna(subset=keys).groupBy(*keys).agg(F.max_by(value, F.struct(*order, value)).alias(value))
    return rows.join(best, keys, "left").withColumn(value, F.coalesce(value, F.lit(otherwise)))


def enough(bars: DataFrame, least: int = 8) -> DataFrame:
    """The bars of the sessions with at least `least` of them."""
    full = bars.groupBy("ticker", "session_date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return bars.join(full, ["ticker", "session_date"], "left_semi")


def cooled(rows: DataFrame, by: str, order: list[str], minutes: int = 10) -> DataFrame:
    """Each row with the whole minutes since the row before it of the same `by` (order: its time, then what settles ties), null
    for the first, and whether that is long enough ago for another."""
    w = Window.partitionBy(by).orderBy(*order)
    since = F.floor((clean.micros(order[0]) - F.lag(clean.micros(order[0])).over(w)) / 60_000_000)
    return rows.withColumn("since", since).withColumn("cooled", F.coalesce(F.col("since") >= minutes, F.lit(True)))


def peaks(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the greatest value up to it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("peak", F.max(value).over(w))


def session_part(ts: str, parts: int = 6) -> Column:
    """The part of the New York day an instant lies in: six parts (premarket, open30, morning, midday, afternoon, close30), or
    four (open, morning, midday, close)."""
    m = clean.ny_minutes(ts)
    if parts == 6:
        return F.when(m < 570, "premarket").when(m < 600, "open30").when(m < 690, "morning").when(m < 840, "midday").when(m < 930, "afternoon").otherwise("close30")
    return F.when(m < 600, "open").when(m < 690, "morning").when(m < 840, "midday").otherwise("close")


def running_vwap(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """The volume-weighted price of each session after each of its ticks: bars of the session that closed at or before the tick
    (their typical price (h + l + c) / 3) seed it, ticks later than the last of these bars' minutes add to it.

    Sums are of whole millionths, so their order does not matter.

    bars: ticker, session_date, ts (start of the minute), h, l, c, v; ticks: ticker, session_date, ts, tick_id, price, size. A
    tick within the minute of a bar counts until that bar closes, and then the bar takes the place of its ticks. Bars and
    ticks without price or size are left out."""
    end = F.col("ts") + F.expr("interval 1 minute")
    b = bars.dropna(subset=["h", "l", "c", "v"]).select(
        "ticker", "session_date", end.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("tick_id"), F.date_trunc("minute", "ts").alias("minute"),
        (F.round((F.col("h") + F.col("l") + F.col("c")) * 1_000_000).cast("decimal(20,0)") * F.col("v")).cast("decimal(28,0)").alias("pv"), F.col("v").cast("bigint").alias("v"),
    )
    t = ticks.dropna(subset=["price", "size"]).select(
        "ticker", "session_date", F.col("ts").alias("at"), F.lit(1).alias("kind"), "tick_id", F.date_trunc("minute", "ts").alias("minute"),
        (F.round(F.col("price") * 1_000_000).cast("decimal(20,0)") * F.col("size") * 3).cast("decimal(28,0)").alias("pv"), F.col("size").cast("bigint").alias("v"),
    )
    # when its minute has a bar, what a tick added goes again as the bar comes
    has = b.select("ticker", "session_date", "minute").distinct()
    gone = t.join(has, ["ticker", "session_date", "minute"], "left_semi").groupBy("ticker", "session_date", "minute").agg((-F.sum("pv")).cast("decimal(28,0)").alias("pv"), (-F.sum("v")).alias("v"))
    gone = gone.select("ticker", "session_date", (F.col("minute") + F.expr("interval 1 minute")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("tick_id"), "minute", "pv", "v")
    w = Window.partitionBy("ticker", "session_date").orderBy("at", "kind", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(gone).unionByName(t)
    out = both.withColumns({"_pv": F.sum("pv").over(w), "_v": F.sum("v").over(w)})
    return out.filter("kind = 1").select("ticker", "session_date", "tick_id", F.col("at").alias("ts"), F.try_divide(F.col("_pv").cast("double"), F.col("_v") * 3_000_000).alias("vwap"))
