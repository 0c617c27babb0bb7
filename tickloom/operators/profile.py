"""Volume profiles: how much volume traded at which price, with its peak, value area and thick and thin bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bin sizes by mean mid price (below each bound), in cents; the last one above all bounds.
SIZES = [(2, 2), (5, 5), (10, 5), (20, 5), (50, 10), (100, 25), (200, 50), (None, 100)]


def bin_cents(mid: Column) -> Column:
    """The bin size in cents for a mean mid price."""
    out = None
    for bound, cents in SIZES[:-1]:
        out = F.when(mid < bound, cents) if out is None else out.when(mid < bound, cents)
    return out.otherwise(SIZES[-1][1])


def profile_bins(bars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cents (the bin size), bin (number of the bin: its price over the bin size) and volume.

    Of each bar's volume 60 % (truncated) goes to the bin of its close, and 40 % evenly to the bins from its low to its high
    (truncated, 1 at least). Bars without volume or with a null price give nothing. bars: keys, h, l, c double, v bigint. The
    bins of a bar are as many as its range has; sums are partly made before the shuffle.
    """
    b = bars.filter("v > 0 and h is not null and l is not null and c is not null")
    sizes = b.groupBy(*keys).agg(bin_cents(F.avg((F.col("h") + F.col("l")) / 2)).alias("cents"))
    b = b.join(sizes, keys)
    number = lambda c: F.floor(F.round(F.col(c) * 10000) / (F.col("cents") * 100)).cast("bigint")
    b = b.select(*keys, "cents", "v", number("c").alias("at"), number("l").alias("lo"), number("h").alias("hi")).filter("hi >= lo")
    each = F.greatest(F.lit(1).cast("bigint"), (F.col("v") * F.lit(0.4) / (F.col("hi") - F.col("lo") + 1)).cast("bigint"))
    spread = b.select(*keys, "cents", F.explode(F.sequence("lo", "hi")).alias("bin"), each.alias("volume"))
    close = b.select(*keys, "cents", F.col("at").alias("bin"), (F.col("v") * F.lit(0.6)).cast("bigint").alias("volume"))
    return spread.unionAll(close).groupBy(*keys, "cents", "bin").agg(F.sum("volume").alias("volume"))


def profiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin_size, total, poc, val, vah, hvn, lvn (prices) of each profile.

    poc is the bin with most volume, the lowest of equals. The value area grows from it to 70 % of the volume, each time by
    the neighbour bin in the profile with more volume, the lower one of equals. hvn: the up to five largest bins above 1.5
    times the mean, lvn: bins in the value area below half of it, both by price. A profile has as many rows as bins, which its
    price range bounds, so it is brought together as an array.
    """
    p = bins.groupBy(*keys, "cents").agg(F.array_sort(F.collect_list(F.struct("bin", "volume"))).alias("b"), F.sum("volume").alias("total"))
    vol = lambda i: F.element_at("b", i)["volume"]
    n = F.size("b")
    p = p.withColumn("top", F.array_max(F.transform("b", lambda x: x["volume"])))
    p = p.withColumn("at", F.array_position(F.transform("b", lambda x: x["volume"]), F.col("top")).cast("int"))
    # state of the walk: lo, hi, volume so far
    start = F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), F.col("top").cast("double").alias("acc"))

    def step(s: Column, _: Column) -> Column:
        lo_v = F.when(s["lo"] > 1, vol(F.greatest(s["lo"] - 1, F.lit(1)))).otherwise(0)
        hi_v = F.when(s["hi"] < n, vol(F.least(s["hi"] + 1, n))).otherwise(0)
        down = (s["lo"] > 1) & (lo_v >= hi_v)
        up = ~down & (s["hi"] < n)
        more = s["acc"] < F.col("total") * F.lit(0.7)
        return F.struct(
            F.when(more & down, s["lo"] - 1).otherwise(s["lo"]).alias("lo"), F.when(more & up, s["hi"] + 1).otherwise(s["hi"]).alias("hi"),
            (s["acc"] + F.when(more & down, lo_v).when(more & up, hi_v).otherwise(0)).cast("double").alias("acc"),
        )

    p = p.withColumn("area", F.aggregate(F.sequence(F.lit(1), n), start, step))
    price = lambda x: F.round(x * F.col("cents") / 100.0, 2)
    mean = F.col("total") / n
    high = F.filter("b", lambda x: x["volume"] > mean * 1.5)
    ranked = F.slice(F.array_sort(F.transform(high, lambda x: F.struct((-x["volume"]).alias("v"), x["bin"].alias("bin")))), 1, 5)
    lo_bin, hi_bin = F.element_at("b", F.col("area.lo"))["bin"], F.element_at("b", F.col("area.hi"))["bin"]
    thin = F.filter("b", lambda x: (x["bin"] >= lo_bin) & (x["bin"] <= hi_bin) & (x["volume"] < mean * 0.5))
    return p.select(
        *keys, (F.col("cents") / 100.0).alias("bin_size"), "total", price(F.element_at("b", F.col("at"))["bin"]).alias("poc"), price(lo_bin).alias("val"), price(hi_bin).alias("vah"),
        F.array_sort(F.transform(ranked, lambda x: price(x["bin"]))).alias("hvn"), F.transform(thin, lambda x: price(x["bin"])).alias("lvn"),
    )


def profile_context(session: DataFrame, composite: DataFrame, prices: DataFrame) -> DataFrame:
    """Where a price lies in its session's profile and in the composite one. session: ticker, session_date, poc, val, vah, hvn,
    lvn; composite: the same by ticker; prices: ticker, session_date, price. Gives value_location (above, inside, below),
    poc_side, migration of the session's peak against the composite's value area, and the nearest thick and thin bins."""
    c = composite.select("ticker", F.col("poc").alias("c_poc"), F.col("val").alias("c_val"), F.col("vah").alias("c_vah"))
    x = prices.join(session, ["ticker", "session_date"]).join(c, "ticker", "left")
    p = F.col("price")
    side = lambda v, lo, hi: F.when(v > hi, "above").when(v < lo, "below").when(v.isNotNull() & lo.isNotNull(), "inside")
    over = lambda a: F.array_min(F.filter(a, lambda y: y > p))
    under = lambda a: F.array_max(F.filter(a, lambda y: y < p))
    return x.select(
        "ticker", "session_date", "price", side(p, F.col("val"), F.col("vah")).alias("value_location"),
        F.when(p > F.col("poc"), "above").when(p < F.col("poc"), "below").when(p == F.col("poc"), "at").alias("poc_side"),
        side(F.col("poc"), F.col("c_val"), F.col("c_vah")).alias("migration"), over("hvn").alias("hvn_above"), under("hvn").alias("hvn_below"),
        over("lvn").alias("lvn_above"), under("lvn").alias("lvn_below"),
    )
