"""What happens to price levels after a decision: first touches, excursions and the further course."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_touches(paths: DataFrame, bars: DataFrame) -> DataFrame:
    """Which level the bars after a start touch first, and how far they go.

    paths: id, ticker, session_date, start, side (long or short), entry, stop, t1, t2 double. bars: ticker, session_date, ts,
    h, l. Of the bars of the path's session after its start: outcome AMBIGUOUS (stop and t1 first touched in one bar), STOP,
    T2 (after t1, not after a later stop), T1, OPEN (neither), NO_BARS, INVALID (no risk: entry not beyond stop); stop_ts,
    t1_ts, and mfe and mae, the largest gain and loss in units of the risk up to the bar that ends the path, with 3 digits.

    No row loop: three conditional minima and one bound. Paths and bars meet on (ticker, session_date), and a session has as
    many bars as minutes. Nulls: a path with a null entry, stop or t1 is INVALID; a null t2 is never touched.
    """
    long = F.col("side") == "long"
    sign = F.when(long, 1.0).otherwise(-1.0)
    p = paths.withColumn("risk", sign * (F.col("entry") - F.col("stop")))
    after = bars.select("ticker", "session_date", F.col("ts").alias("bts"), "h", "l").filter("h is not null and l is not null")
    x = p.join(after, ["ticker", "session_date"]).filter(F.col("bts") > F.col("start"))
    good, bad = F.when(long, F.col("h")).otherwise(-F.col("l")), F.when(long, F.col("l")).otherwise(-F.col("h"))
    x = x.select("id", "bts", "risk", (sign * F.col("entry")).alias("e"), good.alias("good"), bad.alias("bad"), (bad <= sign * F.col("stop")).alias("s"), (good >= sign * F.col("t1")).alias("a"), (good >= sign * F.col("t2")).alias("b"))
    first = x.groupBy("id").agg(F.min(F.when(F.col("s"), F.col("bts"))).alias("fs"), F.min(F.when(F.col("a"), F.col("bts"))).alias("f1"), F.max("bts").alias("last"))
    x = x.join(first, "id")
    later = F.col("bts") > F.col("f1")
    second = x.groupBy("id").agg(
        F.first("fs").alias("fs"), F.first("f1").alias("f1"), F.first("last").alias("last"), F.min(F.when(F.col("s") & later, F.col("bts"))).alias("s2"),
        F.min(F.when(F.col("b") & (F.col("bts") > F.col("f1")), F.col("bts"))).alias("t2"),
    )
    fs, f1, s2, t2 = (F.col(c) for c in ("fs", "f1", "s2", "t2"))
    t2_ok = t2.isNotNull() & (s2.isNull() | (t2 <= s2))
    kind = F.when(fs == f1, "AMBIGUOUS").when(fs.isNotNull() & (f1.isNull() | (fs < f1)), "STOP").when(f1.isNotNull() & t2_ok, "T2").when(f1.isNotNull(), "T1").otherwise("OPEN")
    end = F.when(kind.isin("AMBIGUOUS", "STOP"), fs).otherwise(F.coalesce(s2, F.col("last")))
    second = second.select("id", kind.alias("kind"), fs.alias("fs"), f1.alias("f1"), s2.alias("s2"), end.alias("end"))
    run = x.select("id", "bts", "good", "bad", "e", "risk").join(second.select("id", "end"), "id").filter(F.col("bts") <= F.col("end")).groupBy("id").agg(
        F.greatest(F.lit(0.0), F.max((F.col("good") - F.col("e")) / F.nullif(F.col("risk"), F.lit(0.0)))).alias("mfe"),
        F.least(F.lit(0.0), F.min((F.col("bad") - F.col("e")) / F.nullif(F.col("risk"), F.lit(0.0)))).alias("mae"),
    )
    valid = F.coalesce(F.col("risk") > 0, F.lit(False)) & F.col("t1").isNotNull()
    out = p.select("id", valid.alias("valid")).join(second, "id", "left").join(run, "id", "left")
    kind = F.when(~F.col("valid"), "INVALID").when(F.col("kind").isNull(), "NO_BARS").otherwise(F.col("kind"))
    ok = lambda c: F.when(F.col("valid"), c)
    return out.select(
        "id", kind.alias("outcome"), ok(F.when(F.col("kind").isin("AMBIGUOUS", "STOP"), F.col("fs")).when(F.col("kind") == "T1", F.col("s2"))).alias("stop_ts"),
        ok(F.when(F.col("kind") != "STOP", F.col("f1"))).alias("t1_ts"), ok(F.round("mfe", 3)).alias("mfe"), ok(F.round("mae", 3)).alias("mae"),
    )


def further_course(starts: DataFrame, bars: DataFrame) -> DataFrame:
    """The bars of the session after each start (id, ticker, session_date, start, base): how many, and the largest rise, the
    largest fall and the last close against base in percent, 4 digits; null without bars."""
    after = bars.select("ticker", "session_date", F.col("ts").alias("bts"), "h", "l", "c")
    x = starts.join(after, ["ticker", "session_date"], "left").withColumn("on", F.col("bts") > F.col("start"))
    pct = lambda v: F.round(F.try_divide(v - F.first("base"), F.first("base")) * 100, 4)
    on = lambda c: F.when(F.col("on"), F.col(c))
    last = F.max_by("c", F.when(F.col("on") & F.col("c").isNotNull(), F.col("bts")))
    return x.groupBy("id").agg(F.count_if("on").alias("bars"), pct(F.max(on("h"))).alias("max_up"), pct(F.min(on("l"))).alias("max_down"), pct(last).alias("close_change"))
