"""Minute bars: one clean bar a minute, session features, coarser bars, summaries and the state of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clean

MINUTE = 60_000_000


def clean_bars(minute_bar: DataFrame) -> DataFrame:
    """One bar for each ticker and minute: ticker, session_date (New York), ts, o, h, l, c (double), v, source.

    Of the bars of one minute a final one goes before an unfinished one, then the latest provider time, then the largest
    volume, close and the other values. Nulls: bars without ticker or start are left out, null values stay.
    """
    minute = F.floor((clean.micros("bar_start_utc") + MINUTE // 2) / F.lit(MINUTE)).cast("bigint")
    rank = F.struct(F.coalesce("is_final", F.lit(False)).alias("f"), "provider_ts_utc", "v", "c", "o", "h", "l", clean.source("source").alias("source"))
    one = (
        minute_bar.select(clean.ticker("ticker").alias("ticker"), minute.alias("m"), rank.alias("b"))
        .filter("ticker is not null and m is not null").groupBy("ticker", "m").agg(F.max("b").alias("b"))
    )
    ts = F.timestamp_seconds(F.col("m") * 60)
    value = [F.col(f"b.{x}").cast("double").alias(x) for x in "ohlc"]
    return one.select("ticker", clean.ny_date(ts).alias("session_date"), ts.alias("ts"), *value, F.col("b.v").alias("v"), F.col("b.source").alias("source"))


def _session() -> Window:
    return Window.partitionBy("ticker", "session_date").orderBy("ts")


def _ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, and `otherwise` where b is null or not above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def session_features(bars: DataFrame) -> DataFrame:
    """clean_bars with the features of each bar within its session, all over one partitioning by ticker and session.

    vwap is the running volume-weighted typical price, 0 without volume. rel_volume compares with the mean of the session's
    earlier bars, for the first ten bars with the larger of it and the mean of the last five; the first bar compares with
    itself. Deltas of the first bar are null and its crosses false. Bars with a null price or volume give null features and
    add nothing to the sums.
    """
    w = _session()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3
    volume = F.when(typical.isNotNull(), F.col("v"))
    df = bars.withColumns({
        "_pv": F.sum(typical * F.col("v")).over(run), "_v": F.sum(volume).over(run), "_n": F.row_number().over(w),
        "avg_volume_5": F.avg("v").over(w.rowsBetween(-4, 0)), "_prior": F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    df = df.withColumn("vwap", F.when(F.col("_v") == 0, 0.0).otherwise(F.try_divide("_pv", "_v")))
    before_c, before_vwap = F.lag("c").over(w), F.lag("vwap").over(w)
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    base = F.coalesce("_prior", "avg_volume_5")
    base = F.when(F.col("_n") <= 10, F.greatest(base, F.col("avg_volume_5"))).otherwise(base)
    no = F.lit(False)
    df = df.withColumns({
        "dist_to_vwap": F.col("c") - F.col("vwap"), "delta_close": F.col("c") - before_c, "delta_vwap": F.col("vwap") - before_vwap,
        "body": F.abs(F.col("c") - F.col("o")), "bar_range": F.col("h") - F.col("l"), "upper_wick": F.col("h") - top, "lower_wick": bottom - F.col("l"),
        "body_ratio": _ratio(F.abs(F.col("c") - F.col("o")), F.col("h") - F.col("l")), "rel_volume": _ratio(F.col("v").cast("double"), base),
        "above_vwap": F.coalesce(F.col("c") > F.col("vwap"), no), "below_vwap": F.coalesce(F.col("c") < F.col("vwap"), no),
        "vwap_cross_up": F.coalesce((before_c < before_vwap) & (F.col("c") > F.col("vwap")), no),
        "vwap_cross_down": F.coalesce((before_c > before_vwap) & (F.col("c") < F.col("vwap")), no),
    })
    return df.drop("_pv", "_v", "_n", "_prior")


def _first(c: str) -> Column:
    """The first known value of a column by time."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))


def _last(c: str) -> Column:
    """The last known value of a column by time."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))


def resample(features: DataFrame, minutes: int) -> DataFrame:
    """Bars of so many minutes (a divisor of 60) from session_features: OHLC, volume, last vwap, largest relative volume (null
    for 0) and counts of crosses."""
    return (
        features.groupBy("ticker", "session_date", F.window("ts", f"{minutes} minutes").start.alias("bucket"))
        .agg(
            _first("o").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), _last("c").alias("c"), F.sum("v").alias("v"),
            _last("vwap").alias("last_vwap"), F.nullif(F.max("rel_volume"), F.lit(0.0)).alias("max_rel_volume"),
            F.count_if("vwap_cross_up").alias("vwap_cross_up_count"), F.count_if("vwap_cross_down").alias("vwap_cross_down_count"),
        )
    )


def session_summary(features: DataFrame) -> DataFrame:
    """Open, high, low, close, volume, last vwap, bars, and first and last time of each session."""
    return features.groupBy("ticker", "session_date").agg(
        _first("o").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), _last("c").alias("c"), F.sum("v").alias("v"),
        _last("vwap").alias("last_vwap"), F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def percent(value: Column, base: Column) -> Column:
    """The change from base in percent with 3 digits, half to even; null where base is null or 0."""
    return clean.half_even(F.try_divide(value - base, base) * 100, 3)


def part_summary(bars: DataFrame, from_minute: int, to_minute: int) -> DataFrame:
    """Summary of the bars of a part of the day, from and to a minute of the New York day (inclusive): with the first time of
    the high and of the low, and the change in percent."""
    at = clean.ny_minutes("ts")
    part = bars.filter((at >= from_minute) & (at <= to_minute))
    late = F.lit(0) - F.unix_seconds("ts")
    return part.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("bars"), _first("o").alias("o"), F.max("h").alias("h"),
        F.max_by("ts", F.when(F.col("h").isNotNull(), F.struct("h", late))).alias("high_ts"), F.min("l").alias("l"), F.min_by("ts", F.when(F.col("l").isNotNull(), F.struct("l", "ts"))).alias("low_ts"),
        _last("c").alias("c"), F.sum("v").alias("v"),
    ).withColumn("change_pct", percent(F.col("c"), F.col("o")))


def session_state(features: DataFrame) -> DataFrame:
    """The state of each session at its last bar: levels, changes in percent, returns over the last 5 and 15 bars (from the
    5th and 15th bar from the end, else the first), volumes of the last and the previous five bars and their ratio, crosses,
    extremes of the last 15 bars, and the regime. One aggregation over bars numbered from the end."""
    back = F.row_number().over(Window.partitionBy("ticker", "session_date").orderBy(F.desc("ts")))
    df = features.withColumn("_k", back)
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    within = lambda c, a, b: F.when(F.col("_k").between(a, b), F.col(c))
    s = df.groupBy("ticker", "session_date").agg(
        at("c", 1).alias("last_close"), _first("o").alias("session_open"), F.max("h").alias("session_high"), F.min("l").alias("session_low"),
        at("vwap", 1).alias("last_vwap"), F.coalesce(at("c", 5), _first("c")).alias("_c5"), F.coalesce(at("c", 15), _first("c")).alias("_c15"),
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(within("v", 1, 5)), F.lit(0)).alias("last_5_bar_volume"), F.nullif(F.sum(within("v", 6, 10)), F.lit(0)).alias("previous_5_bar_volume"),
        F.count_if("vwap_cross_up").alias("vwap_cross_up_count"), F.count_if("vwap_cross_down").alias("vwap_cross_down_count"),
        F.nullif(F.max(within("rel_volume", 1, 15)), F.lit(0.0)).alias("max_rel_volume_last_15"), F.max(within("h", 1, 15)).alias("recent_15_high"),
        F.min(within("l", 1, 15)).alias("recent_15_low"), at("rel_volume", 1).alias("last_bar_rel_volume"), at("body_ratio", 1).alias("last_bar_body_ratio"),
    )
    c, o, vwap = F.col("last_close"), F.col("session_open"), F.col("last_vwap")
    regime = F.when((c > o) & (c > vwap), "above_open_above_vwap").when((c < o) & (c < vwap), "below_open_below_vwap").when(
        c.isNotNull() & o.isNotNull() & vwap.isNotNull(), "mixed_open_vwap"
    ).otherwise("unknown")
    two = F.col("_n") >= 2
    return s.withColumns({
        "session_change_pct": percent(c, o), "distance_to_vwap_pct": percent(c, vwap), "return_last_5_bars_pct": F.when(two, percent(c, F.col("_c5"))),
        "return_last_15_bars_pct": F.when(two, percent(c, F.col("_c15"))), "regime": regime,
        "volume_acceleration_ratio": clean.half_even(F.try_divide(F.col("last_5_bar_volume").cast("double"), F.col("previous_5_bar_volume")), 3),
    }).drop("_c5", "_c15", "_n")


def structure(bars: DataFrame, compressed: float = 0.12) -> DataFrame:
    """Of each bar with at least four before it in its session, the shape of the last five: lower_highs, higher_lows,
    compression (their whole range is below `compressed`) or neutral, in this order."""
    w = _session()
    h, low = F.col("h"), F.col("l")
    h1, h2, l1, l2 = F.lag("h", 1).over(w), F.lag("h", 2).over(w), F.lag("l", 1).over(w), F.lag("l", 2).over(w)
    five = w.rowsBetween(-4, 0)
    span = F.max("h").over(five) - F.min("l").over(five)
    shape = F.when((h < h1) & (h1 <= h2), "lower_highs").when((low > l1) & (l1 >= l2), "higher_lows").when(span < compressed, "compression").otherwise("neutral")
    return bars.select("ticker", "session_date", "ts", shape.alias("shape"), F.row_number().over(w).alias("_n")).filter("_n >= 5").drop("_n")


def bar_events(features: DataFrame, spike: float = 3.0, near: float = 0.003, warm: int = 5) -> DataFrame:
    """Events of each bar, a row for each: volume_spike (rel_volume of at least `spike`), vwap_cross_up, vwap_cross_down,
    new_high and new_low (against the session before it, from bar `warm` on), and approach of the session's opening price
    from further than the share `near` of it to within it."""
    w = _session()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.first("o").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda c: F.try_divide(F.abs(c - open_), open_)
    df = features.withColumns({
        "_n": F.row_number().over(w), "_hi": F.max("h").over(past), "_lo": F.min("l").over(past), "_gap": gap(F.col("c")), "_was": gap(F.lag("c").over(w)),
    })
    name = lambda cond, text: F.when(cond, text)
    events = F.array_compact(F.array(
        name(F.col("rel_volume") >= spike, "volume_spike"), name(F.col("vwap_cross_up"), "vwap_cross_up"), name(F.col("vwap_cross_down"), "vwap_cross_down"),
        name((F.col("_n") > warm) & (F.col("h") > F.col("_hi")), "new_high"), name((F.col("_n") > warm) & (F.col("l") < F.col("_lo")), "new_low"),
        name((F.col("_was") > near) & (F.col("_gap") <= near), "open_approach"),
    ))
    return df.select("ticker", "session_date", "ts", F.explode(events).alias("event"))


def held_levels(bars: DataFrame) -> DataFrame:
    """Bars that hold a reclaimed level: some close of the 4th to 12th bar back lay below the session's opening price, and
    the last two closes lie at or above it. ticker, session_date, ts, level."""
    w = _session()
    level = F.first("o").over(w.rowsBetween(Window.unboundedPreceding, 0))
    seen = F.min("c").over(w.rowsBetween(-11, -2))
    held = (seen < level) & (F.col("c") >= level) & (F.lag("c").over(w) >= level)
    return bars.select("ticker", "session_date", "ts", level.alias("level"), held.alias("_held")).filter("_held").drop("_held")


def day_volumes(summary: DataFrame, daily: DataFrame, days: int = 5) -> DataFrame:
    """Each session's volume against the mean of the `days` daily bars before it: adv (truncated) and rvol, the volume over
    what an average day would have had after as many of 390 bars, with 2 digits half to even; null without earlier bars."""
    d = daily.select(clean.ticker("ticker").alias("ticker"), F.col("bar_date"), F.col("v"), F.col("bar_id")).filter("ticker is not null and bar_date is not null")
    d = d.groupBy("ticker", "bar_date").agg(F.max("v").alias("v"))
    both = d.select("ticker", F.col("bar_date").alias("day"), F.col("v").cast("double").alias("dv"), F.lit(None).cast("bigint").alias("v"), F.lit(None).cast("bigint").alias("bars")).unionAll(
        summary.select("ticker", F.col("session_date").alias("day"), F.lit(None).cast("double").alias("dv"), "v", "bars")
    )
    # one row for each ticker and day, then the daily bars strictly before it
    one = both.groupBy("ticker", "day").agg(F.max("dv").alias("dv"), F.max("v").alias("v"), F.max("bars").alias("bars"))
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    past = F.slice(F.reverse(F.collect_list("dv").over(w)), 1, days)  # as many as the ticker has days
    adv = F.try_divide(F.aggregate(past, F.lit(0.0), lambda s, x: s + x), F.size(past).cast("double")).cast("bigint")
    share = F.least(F.lit(1.0), F.col("bars") / 390)
    return one.withColumn("adv", adv).filter("v is not null").select(
        "ticker", F.col("day").alias("session_date"), "v", "bars", "adv", clean.half_even(F.try_divide(F.col("v").cast("double"), F.col("adv") * share), 2).alias("rvol")
    )


def coverage(bars: DataFrame, features: DataFrame) -> DataFrame:
    """For each ticker the first and last bar, the last stored feature row, and how many bars have one and have none."""
    f = features.select(clean.ticker("ticker").alias("ticker"), F.col("ts_utc").cast("timestamp").alias("ts")).dropna().distinct().withColumn("has", F.lit(1))
    return bars.join(f, ["ticker", "ts"], "left").groupBy("ticker").agg(
        F.min("ts").alias("first_bar"), F.max("ts").alias("last_bar"), F.max(F.when(F.col("has") == 1, F.col("ts"))).alias("last_feature"),
        F.count("has").alias("joined"), (F.count(F.lit(1)) - F.count("has")).alias("missed"),
    )


def preferred_bars(minute_bar: DataFrame, order: list[str]) -> DataFrame:
    """One bar for each ticker and minute by preference of source (earlier in the list first, others last), then the latest
    provider time, then the largest volume and close: ticker, ts, c, v, source."""
    minute = F.floor((clean.micros("bar_start_utc") + MINUTE // 2) / F.lit(MINUTE)).cast("bigint")
    src = clean.source("source")
    place = F.lit(len(order))
    for i, s in enumerate(order):
        place = F.when(src == s, i).otherwise(place)
    rank = F.struct((-place).alias("p"), "provider_ts_utc", "v", "c", src.alias("source"))
    b = minute_bar.select(clean.ticker("ticker").alias("ticker"), minute.alias("m"), rank.alias("b")).filter("ticker is not null and m is not null")
    b = b.groupBy("ticker", "m").agg(F.max("b").alias("b"))
    return b.select("ticker", F.timestamp_seconds(F.col("m") * 60).alias("ts"), F.col("b.c").cast("double").alias("c"), "b.v", "b.source")


def feature_agreement(features: DataFrame, stored: DataFrame, within: float = 1e-4) -> DataFrame:
    """Computed features against the stored rows in force (the last ingested of a ticker and time): for each ticker the joined
    rows and how many agree in vwap and in body within a margin; a pair with a null agrees if both are null."""
    s = stored.select(clean.ticker("ticker").alias("ticker"), F.col("ts_utc").cast("timestamp").alias("ts"), "ingested_utc", F.col("vwap").cast("double").alias("s_vwap"), F.col("body").cast("double").alias("s_body"))
    s = s.dropna(subset=["ticker", "ts"]).groupBy("ticker", "ts").agg(F.max(F.struct("ingested_utc", "s_vwap", "s_body")).alias("s")).select("ticker", "ts", "s.s_vwap", "s.s_body")
    same = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= within, F.col(a).isNull() & F.col(b).isNull())
    return features.join(s, ["ticker", "ts"]).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(same("vwap", "s_vwap")).alias("same_vwap"), F.count_if(same("body", "s_body")).alias("same_body")
    )


def reference_moves(bars: DataFrame, ticker: str, back: int = 4, share: float = 0.002) -> DataFrame:
    """The move of a reference ticker over `back` bars of its session: ts, move (up, down, flat)."""
    w = _session()
    was = F.lag("c", back).over(w)
    change = F.try_divide(F.col("c") - was, was)
    r = bars.filter(F.col("ticker") == ticker).withColumn("change", change).filter("change is not null")
    return r.select("ts", F.when(F.col("change") > share, "up").when(F.col("change") < -share, "down").otherwise("flat").alias("move"))


def replay_instants(summary: DataFrame, minutes: int) -> DataFrame:
    """The instants at which each session is replayed: every so many minutes from its first bar on, up to one minute after its
    last bar, each with the last minute that is closed by then. ticker, session_date, at, last_closed."""
    step = F.expr(f"interval {minutes} minutes")
    every = F.sequence("first_ts", F.col("last_ts") + F.expr("interval 1 minute"), step)
    x = summary.select("ticker", "session_date", F.explode(every).alias("at"))
    return x.withColumn("last_closed", F.date_trunc("minute", "at") - F.expr("interval 1 minute"))


def documents(features: DataFrame, recent: int = 60, coarse: int = 5) -> DataFrame:
    """One nested document for each session: its state, its last `recent` bars, and the earlier ones as bars of `coarse`
    minutes. ticker, session_date, state struct, bars array, earlier array. A session has at most as many bars as minutes."""
    keys = ["ticker", "session_date"]
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    f = features.withColumn("_k", back)
    listed = lambda df, cols, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    near = listed(f.filter(F.col("_k") <= recent), ["ts", "o", "h", "l", "c", "v", "vwap", "rel_volume"], "bars")
    far = listed(resample(f.filter(F.col("_k") > recent), coarse), ["bucket", "o", "h", "l", "c", "v"], "earlier")
    state = session_state(features)
    state = state.select(*keys, F.struct(*(c for c in state.columns if c not in keys)).alias("state"))
    return state.join(near, keys).join(far, keys, "left").withColumn("earlier", F.coalesce("earlier", F.array()))
