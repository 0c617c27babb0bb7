"""Further queries: choices between orders, agreement of sources, replay and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.operators import analogues, bars, evidence, merge, sampling
from tickloom.plans.data import TICKER
from tickloom.plans.evidence import DISTANCE, EV, LATEST, RECORDS
from tickloom.plans.market import BARS, FEATURES, _bars, _features
from tickloom.registry import Registry, table

R = Registry()

CHOICES = """
ch as (select evidence_window, query_record_id, arg_min(struct_pack(e := evidence_id, r := actual_r), (scenario_rank, evidence_id)) as raw, arg_min(struct_pack(e := evidence_id, r := actual_r), (t, scenario_rank, evidence_id)) as tier,
  arg_min(struct_pack(e := evidence_id, r := actual_r, band := coalesce(evidence_band, 'INSUFFICIENT')), (t, b, scenario_rank, evidence_id)) as aware
  from (select *, case upper(selection_tier) when 'PREFERRED' then 0 when 'SECONDARY' then 1 else 2 end as t, case evidence_band when 'STRONG' then 0 when 'NEUTRAL' then 1 when 'NEGATIVE' then 2 else 3 end as b from ev) group by 1, 2)"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.distinct_evidence(table(spark, folder, "temporal_evidence"))


@R.query(
    "ranking_windows",
    f"""with {EV}, {CHOICES}, x as (select *, raw.r is not null and tier.r is not null as br, tier.r is not null and aware.r is not null as bo, tier.e <> aware.e as changed from ch)
select evidence_window, count(*) as cards, count(*) filter (raw.e <> tier.e) as tier_changed, count(*) filter (changed) as evidence_changed, round_even(count(*) filter (changed) / cast(count(*) as double), 4) as evidence_changed_rate,
 count(*) filter (br) as raw_pairs, round_even(avg(raw.r) filter (br), 4) as raw_mean_r, round_even(avg(tier.r) filter (br), 4) as tier_mean_r_vs_raw, count(*) filter (bo) as pairs, round_even(avg(tier.r) filter (bo), 4) as tier_mean_r,
 round_even(avg(aware.r) filter (bo), 4) as aware_mean_r, round(sum(aware.r - tier.r) filter (bo), 6) as delta_total_r, count(*) filter (changed and bo and aware.r > tier.r) as better, count(*) filter (changed and bo and aware.r < tier.r) as worse,
 count(*) filter (changed and bo and aware.r = tier.r) as equal, count(*) filter (aware.band = 'STRONG') as strong, count(*) filter (aware.band = 'NEUTRAL') as neutral, count(*) filter (aware.band = 'NEGATIVE') as negative,
 count(*) filter (aware.band not in ('STRONG', 'NEUTRAL', 'NEGATIVE')) as insufficient from x group by 1""",
)
def ranking_windows(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.ranking_windows(_rows(spark, folder))


@R.query(
    "arm_summary",
    f"""with {EV}, {CHOICES}, a as (select 'raw' as arm, raw.r as r from ch union all select 'tier', tier.r from ch union all select 'aware', aware.r from ch)
select arm, count(*) as states, count(r) as resolved, count(*) filter (r > 0) as wins, count(*) filter (r < 0) as losses, round_even(avg(r), 4) as mean_r, round_even(median(r), 4) as median_r, round_even(sum(r), 4) as total_r from a group by 1""",
)
def arm_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.arm_summary(_rows(spark, folder))


@R.query(
    "tier_orders",
    f"""with {RECORDS}, x as (select record_id, unnest(scenarios) as s, generate_subscripts(scenarios, 1) as i from rec), y as (select record_id, i, s.*, case upper(s.selection_tier) when 'PREFERRED' then 0 when 'SECONDARY' then 1 else 2 end as t from x)
select record_id, list(scenario_rank order by i) as own_order, list(scenario_rank order by t, scenario_rank, i) as tier_order, arg_min(scenario_id, (if(t = 0, 0, 1), scenario_rank, scenario_id)) as chosen,
 list(scenario_rank order by i) <> list(scenario_rank order by t, scenario_rank, i) as changed from y group by 1""",
)
def tier_orders(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.tier_orders(analogues.scenario_rows(table(spark, folder, "analogue_record")))


@R.query(
    "setup_aggregates",
    f"""with {RECORDS}, {DISTANCE}, a as (select *, row_number() over (partition by q, ticker, day order by distance, r) as n1 from dist),
 b as (select *, row_number() over (partition by q, ticker order by distance, r) as n2 from a where n1 <= 2), c as (select *, row_number() over (partition by q order by distance, r) as rank from b where n2 <= 4),
 s as (select record_id, lower(s.direction) as direction, lower(s.entry_type) as entry_type, s.* exclude (direction, entry_type) from (select record_id, unnest(scenarios) as s from rec) where s.structurally_valid)
select q as query, direction, entry_type, count(*) as scenarios, count(*) filter (upper(selection_tier) = 'PREFERRED') as preferred, count(*) filter (upper(selection_tier) = 'SECONDARY') as secondary, count(*) filter (triggered) as triggered,
 count(*) filter (t1_before_stop) as t1_first, count(*) filter (upper(primary_outcome) = 'STOP_BEFORE_T1') as stop_first, count(resolved_r) as resolved, round_even(round(cast(sum(resolved_r) as double) / nullif(count(resolved_r), 0) * 1000, 4), 0) / 1000 as mean_r
from c join s on s.record_id = c.r where rank <= 24 group by 1, 2, 3""",
)
def setup_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    r = analogues.distinct_records(table(spark, folder, "analogue_record")).select("record_id", "ticker", "as_of_utc", "session_date_et", "regime", "features", "scenarios", "received_utc")
    return analogues.setup_aggregates(r, None, table(spark, folder, "feature_stat"))


@R.query(
    "enriched_outcomes",
    f"""with {RECORDS}, {LATEST}, s as (select record_id, s.scenario_rank, arg_max(s.grade, i) as grade from (select record_id, unnest(scenarios) as s, generate_subscripts(scenarios, 1) as i from rec) group by 1, 2)
select lat.scenario_id, coalesce(lat.grade, s.grade) as grade, lat.grade is null and s.grade is not null as filled from lat left join s on s.record_id = lat.record_id and s.scenario_rank = lat.scenario_rank""",
)
def enriched_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes with a missing grade filled from the record's scenario of the same rank; of repeated ranks the last counts."""
    s = analogues.scenario_rows(table(spark, folder, "analogue_record")).groupBy("record_id", "scenario_rank").agg(F.max_by("grade", F.when(F.col("grade").isNotNull(), F.col("ordinal"))).alias("g"))
    lat = evidence.latest_outcomes(table(spark, folder, "scenario_summary"))
    x = lat.join(s, ["record_id", "scenario_rank"], "left")
    return x.select("scenario_id", F.coalesce("grade", "g").alias("grade"), (F.col("grade").isNull() & F.col("g").isNotNull()).alias("filled"))


SOURCES = ["rest", "backfill", "stream"]


@R.query(
    "preferred_bars",
    f"""with r as (select {TICKER} as ticker, cast(floor((epoch_us(bar_start_utc) + 30000000) / 60000000.0) as bigint) as m, nullif(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '') as source, provider_ts_utc, v, c from minute_bar
   where {TICKER} is not null and bar_start_utc is not null)
select ticker, make_timestamp(m * 60000000) as ts, cast(c as double) as c, v, source from r qualify row_number() over (partition by ticker, m order by case source when 'rest' then 0 when 'backfill' then 1 when 'stream' then 2 else 3 end,
  provider_ts_utc desc nulls last, v desc nulls last, c desc nulls last, source desc nulls last) = 1""",
)
def preferred_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars.preferred_bars(table(spark, folder, "minute_bar"), SOURCES)


@R.query(
    "feature_agreement",
    f"""with {FEATURES}, s as (select {TICKER} as ticker, ts_utc as ts, cast(vwap as double) as sv, cast(body as double) as sb from minute_bar_features where {TICKER} is not null and ts_utc is not null
   qualify row_number() over (partition by {TICKER}, ts_utc order by ingested_utc desc, vwap desc nulls last, body desc nulls last) = 1)
select ticker, count(*) as rows, count(*) filter (coalesce(abs(vwap - sv) <= 1e-4::double, vwap is null and sv is null)) as same_vwap, count(*) filter (coalesce(abs(body - sb) <= 1e-4::double, body is null and sb is null)) as same_body
from feats join s using (ticker, ts) group by 1""",
)
def feature_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return bars.feature_agreement(_features(spark, folder), table(spark, folder, "minute_bar_features"))


@R.query(
    "reference_moves",
    f"""with {BARS}, top as (select ticker from bars group by 1 order by count(*) desc, ticker limit 1), x as (select ts, (c - lag(c, 4) over w) / nullif(lag(c, 4) over w, 0) as ch from bars where ticker = (select ticker from top) window w as (partition by session_date order by ts))
select ts, case when ch > 0.002::double then 'up' when ch < -0.002::double then 'down' else 'flat' end as move from x where ch is not null""",
)
def reference_moves(spark: SparkSession, folder: str) -> DataFrame:
    """Moves of the ticker with the most bars."""
    b = _bars(spark, folder)
    top = b.groupBy("ticker").count().orderBy(F.desc("count"), "ticker").limit(1).collect()
    return bars.reference_moves(b, top[0]["ticker"] if top else "")


@R.query(
    "replay_instants",
    f"""with {BARS}, s as (select ticker, session_date, min(ts) as a, max(ts) as b from bars group by 1, 2), x as (select ticker, session_date, unnest(generate_series(a, b + interval 1 minute, interval 15 minute)) as "at" from s)
select ticker, session_date, "at", date_trunc('minute', "at") - interval 1 minute as last_closed from x""",
)
def replay_instants(spark: SparkSession, folder: str) -> DataFrame:
    return bars.replay_instants(bars.session_summary(_features(spark, folder)), 15)


@R.query("session_documents")
def session_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON document for each session."""
    d = bars.documents(_features(spark, folder))
    return d.select("ticker", "session_date", F.size("bars").alias("bars"), F.to_json(F.struct("ticker", "session_date", "state", "bars", "earlier")).alias("document"))


@R.query("stable_hashes")
def stable_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded 63-bit hash of ticker and as-of time of each record."""
    r = analogues.distinct_records(table(spark, folder, "analogue_record"))
    key = F.concat_ws("|", "ticker", F.date_format("as_of_utc", "yyyy-MM-dd'T'HH:mm:ss"))
    return r.select("record_id", sampling.stable_hash(key, 42).alias("hash"))


@R.query(
    "first_outcomes",
    f"""with {LATEST} select primary_outcome, scenario_id, cast(row_number() over (partition by primary_outcome order by known_utc, scenario_id) as int) as n from lat qualify n <= 20""",
)
def first_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A report of the first twenty scenarios of each outcome."""
    lat = evidence.latest_outcomes(table(spark, folder, "scenario_summary"))
    return merge.first_per_reason(lat, "primary_outcome", ["known_utc", "scenario_id"], 20).select("primary_outcome", "scenario_id", "n")


@R.query(
    "active_symbols",
    f"""with t as (select {TICKER} as ticker, max(time_utc) as last_tick, count(distinct tick_id) as ticks from scanner_tick where {TICKER} is not null group by 1),
 e as (select {TICKER} as ticker, count(distinct evidence_id) as evidence from temporal_evidence where {TICKER} is not null group by 1)
select ticker, last_tick, coalesce(ticks, 0) as ticks, coalesce(evidence, 0) as evidence from t full join e using (ticker)""",
)
def active_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers that trade or have evidence."""
    t = table(spark, folder, "scanner_tick").withColumn("ticker", clean.ticker("ticker")).filter("ticker is not null").groupBy("ticker").agg(F.max("time_utc").alias("last_tick"), F.count_distinct("tick_id").alias("ticks"))
    e = table(spark, folder, "temporal_evidence").withColumn("ticker", clean.ticker("ticker")).filter("ticker is not null").groupBy("ticker").agg(F.count_distinct("evidence_id").alias("evidence"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(e, "ticker", "full").select("ticker", "last_tick", zero("ticks"), zero("evidence"))
