"""Queries of the general data problems (p2 to p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import asknown, grid, nearest, rolling, spikes
from tickloom.registry import Registry, table

R = Registry()

TICKER = "nullif(upper(trim(ticker, ' ' || chr(9) || chr(10) || chr(13))), '')"
NY_DATE = "cast(timezone('America/New_York', {0} at time zone 'UTC') as date)"


@R.query(
    "p2_found",
    f"""
with t as (select distinct tick_id, {TICKER} as k, {NY_DATE.format("time_utc")} as d, time_utc, price from scanner_tick
  where {TICKER} is not null and time_utc is not null and price is not null and tick_id is not null),
 n as (select *, lag(price) over w as b1, lag(price, 2) over w as b2, lag(price, 3) over w as b3, lead(price) over w as a1, lead(price, 2) over w as a2, lead(price, 3) over w as a3,
   row_number() over w as i from t window w as (partition by k, d order by time_utc, tick_id)),
 u as (select k, d, median(cast(abs(price - b1) as double)) as u from n where price <> b1 group by 1, 2),
 runs as (select *, i - row_number() over (partition by k, d, price order by i) as g from n),
 r as (select *, count(*) over (partition by k, d, price, g) as run from runs),
 x as (select r.*, u.u, greatest(
   if(b1 is null or a1 is null, 0, greatest(price - greatest(b1, a1), least(b1, a1) - price)),
   if(b1 is null or a2 is null, 0, greatest(least(price, a1) - greatest(b1, a2), least(b1, a2) - greatest(price, a1))),
   if(b2 is null or a1 is null, 0, greatest(least(price, b1) - greatest(b2, a1), least(b2, a1) - greatest(price, b1))),
   if(b1 is null or a3 is null, 0, greatest(least(price, a1, a2) - greatest(b1, a3), least(b1, a3) - greatest(price, a1, a2))),
   if(b2 is null or a2 is null, 0, greatest(least(b1, price, a1) - greatest(b2, a2), least(b2, a2) - greatest(b1, price, a1))),
   if(b3 is null or a1 is null, 0, greatest(least(b2, b1, price) - greatest(b3, a1), least(b3, a1) - greatest(b2, b1, price)))) as dev
  from r left join u using (k, d)),
 b as (select distinct bar_id, {TICKER} as k, bar_date, cast(o as double) o, cast(h as double) h, cast(l as double) l, cast(c as double) c from daily_bar
  where {TICKER} is not null and bar_date is not null),
 reach as (select *, (h - greatest(o, c)) / greatest(o, c) as up, (least(o, c) - l) / least(o, c) as down from b),
 ub as (select k, median(x) as u from (select k, up as x from reach union all select k, down from reach) where x is not null group by 1),
 seq as (select *, if(h = lag(h) over w and l = lag(l) over w, 0, 1) as fresh from reach window w as (partition by k order by bar_date, bar_id)),
 rb as (select *, sum(fresh) over (partition by k order by bar_date, bar_id) as g from seq),
 cb as (select *, count(*) over (partition by k, g) as run from rb)
select 'scanner_tick' as record_table, tick_id as record_id from x where price <= 0 or run >= 12 or (dev > 0 and cast(dev as double) >= 10 * u)
union all
select 'daily_bar', bar_id from cb left join ub using (k)
where l <= 0 or h < l or h < greatest(o, c) or l > least(o, c) or (greatest(up, down) > 0 and greatest(up, down) >= 8 * u) or (run >= 4 and h is not null and l is not null)
""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible(table(spark, folder, "scanner_tick"), table(spark, folder, "daily_bar")).select("record_table", "record_id")


@R.query(
    "p3_found",
    f"""
with m as (select distinct {TICKER} as ticker, cast(floor((epoch_us(bar_start_utc) + 30000000) / 60000000.0) as bigint) as m from minute_bar
  where {TICKER} is not null and bar_start_utc is not null),
 d as (select *, {NY_DATE.format("make_timestamp(m * 60000000)")} as d from m),
 s as (select ticker, d, unnest(generate_series(min(m), max(m))) as m from d group by 1, 2)
select ticker, m * 60 as minute_epoch from s anti join m using (ticker, m)
""",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return grid.minute_grid(table(spark, folder, "minute_bar")).filter("filled").select("ticker", "minute_epoch")


@R.query("p3_grid")
def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    return grid.minute_grid(table(spark, folder, "minute_bar"))


def _rolling_sql(what: str) -> str:
    return f"""
with one as (select {TICKER} as ticker, ts_utc, arg_max(struct_pack(a := avg_volume_5, r := rel_volume), (ingested_utc, avg_volume_5, rel_volume)) as v from minute_bar_features
  where {TICKER} is not null and ts_utc is not null group by 1, 2),
 days as (select ticker, {NY_DATE.format("ts_utc")} as d, sum(v.a) as a, count(v.a) as na, sum(v.r) as r, count(v.r) as nr from one group by 1, 2),
 each as (select ticker, d, 'avg_volume_5' as measure, a as x from days where na > 0 union all select ticker, d, 'rel_volume', r from days where nr > 0),
 cal as (select ticker, measure, unnest(generate_series(min(d), max(d) + interval 29 day, interval 1 day))::date as d from each group by 1, 2),
 dense as (select ticker, measure, d, x from cal left join each using (ticker, measure, d)),
 roll as (select ticker, measure, d, coalesce(sum(x) over (w rows 6 preceding), 0) as t7, coalesce(sum(x) over (w rows 29 preceding), 0) as t30, count(x) over (w rows 29 preceding) as n
   from dense window w as (partition by ticker, measure order by d))
{what}"""


@R.query(
    "p4_found",
    _rolling_sql("""select ticker, cast(strftime(d, '%Y%m%d') as bigint) as day_key, measure from roll where n >= 12 and t30 > 0 and t7 * 30 >= t30 * 14"""),
)
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    state = rolling.bar_feature_state(table(spark, folder, "minute_bar_features"))
    day = F.date_format("day", "yyyyMMdd").cast("bigint").alias("day_key")
    return rolling.bursts(state).select(F.col("entity").alias("ticker"), day, "measure")


@R.query(
    "p4_totals",
    _rolling_sql("""select ticker, d as day, measure, cast(t7 as double) as total_7, cast(t30 as double) as total_30,
  cast(t7 as double) / 7 as average_7, cast(t30 as double) / 30 as average_30, cast(n as bigint) as active_30 from roll where n > 0"""),
)
def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    state = rolling.bar_feature_state(table(spark, folder, "minute_bar_features")).filter("active_30 > 0")
    short, long = (F.col(f"total_{n}").cast("double") for n in (rolling.SHORT, rolling.LONG))
    return state.select(
        F.col("entity").alias("ticker"), "day", "measure", short.alias("total_7"), long.alias("total_30"),
        (short / rolling.SHORT).alias("average_7"), (long / rolling.LONG).alias("average_30"),
        F.col("active_30").cast("bigint").alias("active_30"),
    )


@R.query(
    "p5_found",
    """
with ev as (
  select evidence_id, any_value(as_of_utc) as as_of, any_value(evidence_expectancy_per_triggered) as stated, any_value(analogue_scenario_ids) as ids
  from temporal_evidence where evidence_id is not null and evidence_expectancy_per_triggered is not null group by evidence_id),
 asked as (select evidence_id, as_of, unnest(list_distinct(ids)) as scenario_id from ev),
 vs as (select distinct scenario_id, version_no, known_utc, resolved_r, triggered from scenario_summary),
 forced as (
  select a.evidence_id, a.scenario_id, arg_max(struct_pack(r := v.resolved_r, t := v.triggered), (v.known_utc, v.version_no)) as f
  from asked a join vs v on a.scenario_id = v.scenario_id and v.known_utc <= a.as_of group by 1, 2),
 got as (select evidence_id, sum(coalesce(f.r, 0)) as r, count(*) filter (f.t) as n from forced group by 1)
select ev.evidence_id from ev left join got using (evidence_id)
where coalesce(n, 0) = 0 or abs(cast(stated as double) - cast(r as double) / n) > 0.001
""",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return asknown.unfounded_evidence(table(spark, folder, "temporal_evidence"), table(spark, folder, "scenario_summary")).select("evidence_id")


@R.query(
    "p6_found",
    f"""
with t as (select distinct tick_id, {TICKER} as k, time_utc from scanner_tick where {TICKER} is not null and time_utc is not null and tick_id is not null),
 q as (select distinct quote_id, {TICKER} as k, time_utc from scanner_quote where {TICKER} is not null and bid_price > 0 and time_utc is not null),
 pairs as (
  select tick_id, quote_id, row_number() over (partition by tick_id order by abs(epoch_us(t.time_utc) - epoch_us(q.time_utc)), quote_id) as n
  from t join q on t.k = q.k and q.time_utc between t.time_utc - interval 2 second and t.time_utc + interval 2 second)
select tick_id, quote_id from pairs where n = 1
""",
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.tick_quotes(table(spark, folder, "scanner_tick"), table(spark, folder, "scanner_quote")).select("tick_id", "quote_id")
