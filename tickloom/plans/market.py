"""Queries over bars, ticks and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.operators import bars, profile, tape
from tickloom.plans.data import NY_DATE, TICKER
from tickloom.registry import Registry, table

R = Registry()

BARS = f"""
raw as (select {TICKER} as ticker, cast(floor((epoch_us(bar_start_utc) + 30000000) / 60000000.0) as bigint) as m, coalesce(is_final, false) as f, provider_ts_utc, o, h, l, c, v,
   nullif(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '') as source from minute_bar where {TICKER} is not null and bar_start_utc is not null),
 bars as (select ticker, {NY_DATE.format("make_timestamp(m * 60000000)")} as session_date, make_timestamp(m * 60000000) as ts, cast(o as double) as o, cast(h as double) as h, cast(l as double) as l,
   cast(c as double) as c, v, source from raw
   qualify row_number() over (partition by ticker, m order by f desc, provider_ts_utc desc nulls last, v desc nulls last, c desc nulls last, o desc nulls last, h desc nulls last, l desc nulls last, source desc nulls last) = 1)"""
FEATURES = f"""{BARS},
 f0 as (select *, sum((h + l + c) / 3 * v) over w as pv, sum(if((h + l + c) is not null, v, null)) over w as cv, row_number() over s as n,
   avg(v) over (s rows 4 preceding) as avg_volume_5, avg(v) over (s rows between unbounded preceding and 1 preceding) as prior
   from bars window s as (partition by ticker, session_date order by ts), w as (partition by ticker, session_date order by ts rows unbounded preceding)),
 f1 as (select *, case when cv = 0 then 0.0 when cv is not null then pv / cv end as vwap, if(n <= 10, greatest(coalesce(prior, avg_volume_5), avg_volume_5), coalesce(prior, avg_volume_5)) as base from f0),
 feats as (select ticker, session_date, ts, o, h, l, c, v, source, avg_volume_5, vwap, c - vwap as dist_to_vwap, c - lag(c) over s as delta_close, vwap - lag(vwap) over s as delta_vwap, abs(c - o) as body,
   h - l as bar_range, h - greatest(o, c) as upper_wick, least(o, c) - l as lower_wick, if(h - l > 0, abs(c - o) / (h - l), 0) as body_ratio, if(base > 0, v / base, 0) as rel_volume,
   coalesce(c > vwap, false) as above_vwap, coalesce(c < vwap, false) as below_vwap, coalesce(lag(c) over s < lag(vwap) over s and c > vwap, false) as vwap_cross_up,
   coalesce(lag(c) over s > lag(vwap) over s and c < vwap, false) as vwap_cross_down
   from f1 window s as (partition by ticker, session_date order by ts))"""
ROUNDED = ["vwap", "dist_to_vwap", "delta_close", "delta_vwap", "body", "bar_range", "upper_wick", "lower_wick", "body_ratio", "avg_volume_5", "rel_volume"]
FLAGS = ["above_vwap", "below_vwap", "vwap_cross_up", "vwap_cross_down"]


def _bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars.clean_bars(table(spark, folder, "minute_bar"))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return bars.session_features(_bars(spark, folder))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@R.query("clean_bars", f"with {BARS} select * from bars")
def clean_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _bars(spark, folder)


@R.query(
    "session_features",
    f"with {FEATURES} select ticker, session_date, ts, o, h, l, c, v, {', '.join(f'round({c}, 6) as {c}' for c in ROUNDED)}, {', '.join(FLAGS)} from feats",
)
def session_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_features(spark, folder).drop("source"), **dict.fromkeys(ROUNDED, 6))


def _resample_sql(n: int) -> str:
    return f"""with {FEATURES} select ticker, session_date, time_bucket(interval {n} minute, ts) as bucket, arg_min(o, ts) as o, max(h) as h, min(l) as l, arg_max(c, ts) as c, cast(sum(v) as bigint) as v,
 round(arg_max(vwap, ts), 6) as last_vwap, round(nullif(max(rel_volume), 0), 6) as max_rel_volume, count(*) filter (vwap_cross_up) as vwap_cross_up_count, count(*) filter (vwap_cross_down) as vwap_cross_down_count
 from feats group by 1, 2, 3"""


def _resampled(n: int):
    def q(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(bars.resample(_features(spark, folder), n), last_vwap=6, max_rel_volume=6)

    return q


for _n in (5, 15):
    R.query(f"resample_{_n}m", _resample_sql(_n))(_resampled(_n))


@R.query(
    "session_summary",
    f"""with {FEATURES} select ticker, session_date, arg_min(o, ts) as o, max(h) as h, min(l) as l, arg_max(c, ts) as c, cast(sum(v) as bigint) as v, round(arg_max(vwap, ts), 6) as last_vwap,
 count(*) as bars, min(ts) as first_ts, max(ts) as last_ts from feats group by 1, 2""",
)
def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(bars.session_summary(_features(spark, folder)), last_vwap=6)


@R.query(
    "early_summary",
    f"""with {BARS}, p as (select * from bars where extract(hour from timezone('America/New_York', ts at time zone 'UTC')) * 60 + extract(minute from timezone('America/New_York', ts at time zone 'UTC')) between 570 and 659)
select ticker, session_date, count(*) as bars, arg_min(o, ts) as o, max(h) as h, arg_max(ts, (h, -epoch(ts))) as high_ts, min(l) as l, arg_min(ts, (l, epoch(ts))) as low_ts, arg_max(c, ts) as c,
 cast(sum(v) as bigint) as v, round_even((arg_max(c, ts) - arg_min(o, ts)) / nullif(arg_min(o, ts), 0) * 100, 3) as change_pct from p group by 1, 2""",
)
def early_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The first ninety minutes of the regular session; the pre-market uses the same operator with other bounds."""
    return bars.part_summary(_bars(spark, folder), 570, 659)


@R.query(
    "session_state",
    f"""with {FEATURES}, k as (select *, row_number() over (partition by ticker, session_date order by ts desc) as k from feats),
 s as (select ticker, session_date, max(c) filter (k = 1) as last_close, arg_min(o, ts) as session_open, max(h) as session_high, min(l) as session_low, max(vwap) filter (k = 1) as last_vwap,
  coalesce(max(c) filter (k = 5), arg_min(c, ts)) as c5, coalesce(max(c) filter (k = 15), arg_min(c, ts)) as c15, count(*) as n,
  cast(coalesce(sum(v) filter (k between 1 and 5), 0) as bigint) as last_5_bar_volume, cast(nullif(sum(v) filter (k between 6 and 10), 0) as bigint) as previous_5_bar_volume,
  count(*) filter (vwap_cross_up) as vwap_cross_up_count, count(*) filter (vwap_cross_down) as vwap_cross_down_count, round(nullif(max(rel_volume) filter (k <= 15), 0), 6) as max_rel_volume_last_15,
  max(h) filter (k <= 15) as recent_15_high, min(l) filter (k <= 15) as recent_15_low, round(max(rel_volume) filter (k = 1), 6) as last_bar_rel_volume, round(max(body_ratio) filter (k = 1), 6) as last_bar_body_ratio
  from k group by 1, 2)
select * exclude (c5, c15, n, last_vwap), round(last_vwap, 6) as last_vwap, round_even((last_close - session_open) / nullif(session_open, 0) * 100, 3) as session_change_pct,
 round_even((last_close - last_vwap) / nullif(last_vwap, 0) * 100, 3) as distance_to_vwap_pct, if(n >= 2, round_even((last_close - c5) / nullif(c5, 0) * 100, 3), null) as return_last_5_bars_pct,
 if(n >= 2, round_even((last_close - c15) / nullif(c15, 0) * 100, 3), null) as return_last_15_bars_pct, round_even(last_5_bar_volume / nullif(cast(previous_5_bar_volume as double), 0), 3) as volume_acceleration_ratio,
 case when last_close > session_open and last_close > last_vwap then 'above_open_above_vwap' when last_close < session_open and last_close < last_vwap then 'below_open_below_vwap'
  when last_close is not null and session_open is not null and last_vwap is not null then 'mixed_open_vwap' else 'unknown' end as regime from s""",
)
def session_state(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(bars.session_state(_features(spark, folder)), last_vwap=6, max_rel_volume_last_15=6, last_bar_rel_volume=6, last_bar_body_ratio=6)


@R.query(
    "bar_structure",
    f"""with {BARS}, x as (select ticker, session_date, ts, row_number() over w as n, h, l, lag(h) over w as h1, lag(h, 2) over w as h2, lag(l) over w as l1, lag(l, 2) over w as l2,
  max(h) over (w rows 4 preceding) - min(l) over (w rows 4 preceding) as span from bars window w as (partition by ticker, session_date order by ts))
select ticker, session_date, ts, case when h < h1 and h1 <= h2 then 'lower_highs' when l > l1 and l1 >= l2 then 'higher_lows' when span < 0.12 then 'compression' else 'neutral' end as shape from x where n >= 5""",
)
def bar_structure(spark: SparkSession, folder: str) -> DataFrame:
    return bars.structure(_bars(spark, folder))


@R.query(
    "bar_events",
    f"""with {FEATURES}, x as (select *, row_number() over w as n, max(h) over p as hi, min(l) over p as lo, first_value(o) over w as op, lag(c) over w as c1 from feats
   window w as (partition by ticker, session_date order by ts), p as (partition by ticker, session_date order by ts rows between unbounded preceding and 1 preceding)),
 e as (select ticker, session_date, ts, unnest([if(rel_volume >= 3, 'volume_spike', null), if(vwap_cross_up, 'vwap_cross_up', null), if(vwap_cross_down, 'vwap_cross_down', null),
   if(n > 5 and h > hi, 'new_high', null), if(n > 5 and l < lo, 'new_low', null), if(abs(c1 - op) / nullif(op, 0) > 0.003 and abs(c - op) / nullif(op, 0) <= 0.003, 'open_approach', null)]) as event from x)
select * from e where event is not null""",
)
def bar_events(spark: SparkSession, folder: str) -> DataFrame:
    return bars.bar_events(_features(spark, folder))


@R.query(
    "held_levels",
    f"""with {BARS}, x as (select ticker, session_date, ts, c, lag(c) over w as c1, first_value(o) over w as level, min(c) over (w rows between 11 preceding and 2 preceding) as low from bars
   window w as (partition by ticker, session_date order by ts))
select ticker, session_date, ts, level from x where low < level and c >= level and c1 >= level""",
)
def held_levels(spark: SparkSession, folder: str) -> DataFrame:
    return bars.held_levels(_bars(spark, folder))


@R.query(
    "day_volumes",
    f"""with {BARS}, s as (select ticker, session_date, cast(sum(v) as bigint) as v, count(*) as bars from bars group by 1, 2),
 d as (select {TICKER} as ticker, bar_date, max(v) as v from daily_bar where {TICKER} is not null and bar_date is not null group by 1, 2),
 p as (select s.ticker, s.session_date, any_value(s.v) as v, any_value(s.bars) as bars, avg(cast(d.v as double)) as adv from s left join lateral
   (select x.v from d x where x.ticker = s.ticker and x.bar_date < s.session_date and x.v is not null order by x.bar_date desc limit 5) d on true group by 1, 2)
select ticker, session_date, v, bars, cast(trunc(adv) as bigint) as adv, round_even(v / nullif(trunc(adv) * least(1.0, bars / 390.0), 0), 2) as rvol from p""",
)
def day_volumes(spark: SparkSession, folder: str) -> DataFrame:
    return bars.day_volumes(bars.session_summary(_features(spark, folder)), table(spark, folder, "daily_bar"))


@R.query(
    "bar_coverage",
    f"""with {BARS}, f as (select distinct {TICKER} as ticker, ts_utc as ts from minute_bar_features where {TICKER} is not null and ts_utc is not null)
select b.ticker, min(b.ts) as first_bar, max(b.ts) as last_bar, max(f.ts) as last_feature, count(f.ts) as joined, count(*) - count(f.ts) as missed from bars b left join f using (ticker, ts) group by 1""",
)
def bar_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return bars.coverage(_bars(spark, folder), table(spark, folder, "minute_bar_features"))


BINS = """ sz as (select ticker, session_date, case when avg((h + l) / 2) < 2 then 2 when avg((h + l) / 2) < 20 then 5 when avg((h + l) / 2) < 50 then 10 when avg((h + l) / 2) < 100 then 25
   when avg((h + l) / 2) < 200 then 50 else 100 end as cents from pb group by 1, 2),
 pb1 as (select pb.*, cents, cast(floor(round(c * 10000) / (cents * 100)) as bigint) as at_, cast(floor(round(l * 10000) / (cents * 100)) as bigint) as lo, cast(floor(round(h * 10000) / (cents * 100)) as bigint) as hi
   from pb join sz using (ticker, session_date)),
 sp as (select ticker, session_date, cents, unnest(generate_series(lo, hi)) as bin, greatest(1, cast(trunc(v * cast(0.4 as double) / (hi - lo + 1)) as bigint)) as volume from pb1 where hi >= lo
  union all select ticker, session_date, cents, at_, cast(trunc(v * cast(0.6 as double)) as bigint) from pb1 where hi >= lo),
 bins as (select ticker, session_date, cents, bin, cast(sum(volume) as bigint) as volume from sp group by 1, 2, 3, 4)"""
USABLE = "v > 0 and h is not null and l is not null and c is not null"


@R.query("volume_profile_bins", f"with {BARS}, pb as (select * from bars where {USABLE}), {BINS} select * from bins")
def volume_profile_bins(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_bins(_bars(spark, folder), ["ticker", "session_date"])


PROFILES = """ n as (select *, row_number() over (partition by ticker, session_date order by bin) as i, count(*) over (partition by ticker, session_date) as k, sum(volume) over (partition by ticker, session_date) as total from bins),
 top as (select ticker, session_date, any_value(cents) as cents, any_value(k) as k, cast(any_value(total) as bigint) as total, arg_max(i, (volume, -i)) as p, max(volume) as acc, list(volume order by i) as vs, list(bin order by i) as bs from n group by 1, 2),
 walk as (select ticker, session_date, p as lo, p as hi, cast(acc as double) as acc from top
  union all select w.ticker, w.session_date, if(d, lo - 1, lo), if(d, hi, hi + 1), w.acc + if(d, vs[lo - 1], vs[hi + 1])
   from (select w.*, t.k, t.total, t.vs, lo > 1 and (hi = k or vs[lo - 1] >= vs[hi + 1]) as d from walk w join top t using (ticker, session_date)) w where w.acc < total * cast(0.7 as double) and (lo > 1 or hi < k)),
 va as (select ticker, session_date, min(lo) as lo, max(hi) as hi from walk group by 1, 2)"""


@R.query(
    "volume_profile",
    f"""with recursive {BARS}, pb as (select * from bars where {USABLE}), {BINS}, {PROFILES}
select ticker, session_date, cents / 100.0::double as bin_size, total, round(bs[p] * cents / 100.0::double, 2) as poc, round(bs[lo] * cents / 100.0::double, 2) as val, round(bs[hi] * cents / 100.0::double, 2) as vah,
 (select coalesce(list(x order by x), []) from (select round(bin * cents / 100.0::double, 2) as x from n where n.ticker = t.ticker and n.session_date = t.session_date and n.volume > n.total / n.k::double * 1.5::double order by volume desc, bin limit 5)) as hvn,
 (select coalesce(list(round(bin * cents / 100.0::double, 2) order by bin), []) from n where n.ticker = t.ticker and n.session_date = t.session_date and n.i between lo and hi and n.volume < n.total / n.k::double * 0.5::double) as lvn
from top t join va using (ticker, session_date)""",
)
def volume_profile(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["ticker", "session_date"]
    return profile.profiles(profile.profile_bins(_bars(spark, folder), keys), keys)


@R.query("profile_context")
def profile_context(spark: SparkSession, folder: str) -> DataFrame:
    """The last close of each session within the session's profile and the ticker's composite one over its daily bars."""
    b, keys = _bars(spark, folder), ["ticker", "session_date"]
    d = table(spark, folder, "daily_bar").select(clean.ticker("ticker").alias("ticker"), "bar_id", *(F.col(c).cast("double").alias(c) for c in "hlc"), "v")
    d = d.filter("ticker is not null and l > 0 and h >= l").dropDuplicates(["bar_id"])
    composite = profile.profiles(profile.profile_bins(d, ["ticker"]), ["ticker"])
    session = profile.profiles(profile.profile_bins(b, keys), keys)
    return profile.profile_context(session, composite, b.groupBy(*keys).agg(F.max_by("c", "ts").alias("price")))


TICKS = f"""
ticks as (select {TICKER} as ticker, {NY_DATE.format("time_utc")} as session_date, time_utc as ts, tick_id, cast(price as double) as price, cast(size as bigint) as size from scanner_tick
   where {TICKER} is not null and time_utc is not null and price is not null and tick_id is not null qualify row_number() over (partition by tick_id order by received_utc) = 1)"""
QUOTES = f"""
quotes as (select {TICKER} as ticker, {NY_DATE.format("time_utc")} as session_date, time_utc as ts, quote_id, if(bid_price > 0, cast(bid_price as double), null) as bid, if(ask_price > 0, cast(ask_price as double), null) as ask,
   cast(bid_size as bigint) as bid_size, cast(ask_size as bigint) as ask_size from scanner_quote where {TICKER} is not null and time_utc is not null and quote_id is not null
   qualify row_number() over (partition by quote_id order by received_utc) = 1)"""


def _ticks(spark: SparkSession, folder: str) -> DataFrame:
    return tape.clean_ticks(table(spark, folder, "scanner_tick"))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    return tape.clean_quotes(table(spark, folder, "scanner_quote"))


@R.query(
    "rolling_vwap_500",
    f"""with {TICKS} select ticker, session_date, ts, tick_id, cast(sum(cast(round(price * 1000000) as bigint) * size) over w as double) / nullif(cast(sum(size) over w * 1000000 as double), 0) as vwap from ticks
   window w as (partition by ticker, session_date order by ts, tick_id rows 499 preceding)""",
)
def rolling_vwap_500(spark: SparkSession, folder: str) -> DataFrame:
    return tape.rolling_vwap(_ticks(spark, folder))


@R.query(
    "tape_flow",
    f"""with {TICKS}, k as (select *, row_number() over w as k, lead(price) over w as b0 from ticks window w as (partition by ticker, session_date order by ts desc, tick_id desc)),
 l as (select *, avg(size) over p as mean, count(*) over p as n from k where k <= 100 window p as (partition by ticker, session_date)),
 x as (select *, if(k < n, b0, null) as b from l)
select ticker, session_date, count(*) as ticks, round(avg(size), 6) as mean_size, cast(sum(size) as bigint) as volume, count(*) filter (size >= mean * 2.5) as big_prints,
 cast(coalesce(sum(size) filter (price > b), 0) as bigint) as up_volume, cast(coalesce(sum(size) filter (price < b), 0) as bigint) as down_volume, round(arg_min(price, k) - arg_max(price, k), 6) as move from x group by 1, 2""",
)
def tape_flow(spark: SparkSession, folder: str) -> DataFrame:
    return tape.tape_flow(_ticks(spark, folder))


@R.query(
    "quote_pressure",
    f"""with {QUOTES}, k as (select *, row_number() over (partition by ticker, session_date order by ts desc, quote_id desc) as k from quotes)
select ticker, session_date, count(*) as quotes, round(avg(bid_size), 6) as mean_bid_size, round(avg(ask_size), 6) as mean_ask_size, max(bid_size) filter (k = 1) as last_bid_size,
 max(ask_size) filter (k = 1) as last_ask_size, count(distinct bid) filter (k <= 5) as bids, count(distinct ask) filter (k <= 5) as asks, round(max(bid) filter (k = 1) - max(bid) filter (k = 5), 6) as bid_move,
 round(max(ask) filter (k = 1) - max(ask) filter (k = 5), 6) as ask_move from k where k <= 80 group by 1, 2""",
)
def quote_pressure(spark: SparkSession, folder: str) -> DataFrame:
    return tape.quote_pressure(_quotes(spark, folder))


@R.query(
    "liquidity_sweeps",
    f"""with {BARS}, x as (select *, max(h) over w as hi, min(l) over w as lo from bars window w as (partition by ticker, session_date order by ts rows between 10 preceding and 1 preceding))
select ticker, session_date, ts, 'high' as side from x where h > hi and c < hi union all select ticker, session_date, ts, 'low' from x where l < lo and c > lo""",
)
def liquidity_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    return tape.sweeps(_bars(spark, folder))


@R.query(
    "realtime_snapshot",
    f"""with {TICKS}, {QUOTES}, t as (select ticker, arg_max(price, (ts, tick_id)) as price, max(ts) as price_ts from ticks group by 1),
 q as (select ticker, arg_max(bid, (ts, quote_id)) filter (bid is not null) as bid, arg_max(ask, (ts, quote_id)) filter (ask is not null) as ask, max(ts) as quote_ts from quotes group by 1)
select * from t full join q using (ticker)""",
)
def realtime_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return tape.snapshots(_ticks(spark, folder), _quotes(spark, folder))


@R.query(
    "quote_throttle",
    f"""with {QUOTES}, x as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by ticker, session_date order by ts, quote_id)) < 100000, false) as close from quotes)
select ticker, session_date, count(*) filter (close) as within, count(*) filter (not close) as apart from x group by 1, 2""",
)
def quote_throttle(spark: SparkSession, folder: str) -> DataFrame:
    return tape.throttle(_quotes(spark, folder))


@R.query(
    "reference_prices",
    f"""with {TICKS}, {QUOTES}, {BARS}, a as (select record_id as id, any_value({TICKER}) as ticker, any_value(as_of_utc) as ts from analogue_record where record_id is not null and as_of_utc is not null and {TICKER} is not null group by 1),
 q as (select ticker, ts, max((bid + ask) / 2) as p from quotes where bid is not null and ask is not null group by 1, 2), t as (select ticker, ts, max(price) as p from ticks group by 1, 2), b as (select ticker, ts, c as p from bars where c is not null),
 x as (select a.id, a.ts, q.p as qp, epoch(a.ts)::bigint - floor(epoch(q.ts))::bigint as qa, t.p as tp, epoch(a.ts)::bigint - floor(epoch(t.ts))::bigint as ta, b.p as bp
   from a asof left join q on a.ticker = q.ticker and a.ts >= q.ts asof left join t on a.ticker = t.ticker and a.ts >= t.ts asof left join b on a.ticker = b.ticker and a.ts >= b.ts)
select id, case when qa <= 30 then qp when ta <= 60 then tp else bp end as price, case when qa <= 30 then 'quote' when ta <= 60 then 'tick' when bp is not null then 'bar' end as kind from x""",
)
def reference_prices(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "analogue_record").select(F.col("record_id").alias("id"), clean.ticker("ticker").alias("ticker"), F.col("as_of_utc").cast("timestamp").alias("ts"))
    asks = r.dropna().groupBy("id").agg(F.first("ticker").alias("ticker"), F.first("ts").alias("ts"))
    rows = sum(table(spark, folder, t).count() for t in ("scanner_tick", "scanner_quote", "minute_bar"))
    return tape.reference_prices(asks, _ticks(spark, folder), _quotes(spark, folder), _bars(spark, folder), rows)
