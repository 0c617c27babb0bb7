"""Queries over analogue records, scenario outcomes and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import analogues, evidence
from tickloom.plans.data import TICKER
from tickloom.registry import Registry, table

R = Registry()

RECORDS = f"""
rec as (select record_id, {TICKER} as ticker, as_of_utc, session_date_et, regime, features, raw_verdict, structural_verdict, scenarios from analogue_record
  where record_id is not null and {TICKER} is not null and session_date_et is not null qualify row_number() over (partition by record_id order by received_utc) = 1)"""
WEIGHTS = " ".join(f"when '{k}' then {v}::double" for k, v in analogues.WEIGHTS.items())
DISTANCE = f"""
z as (select r.record_id, s.feature_key, cast(r.features[s.feature_key] as double) / if(s.std_dev > 0.0001, cast(s.std_dev as double), 1) as z, case s.feature_key {WEIGHTS} else 1::double end as w
  from rec r cross join feature_stat s where r.features[s.feature_key] is not null),
 pairs as (select a.record_id as q, b.record_id as r, sqrt(sum(a.w * (a.z - b.z) ** 2) / sum(a.w)) as d, count(*) as shared from z a join z b on a.feature_key = b.feature_key and a.record_id <> b.record_id
   join rec ra on ra.record_id = a.record_id join rec rb on rb.record_id = b.record_id and rb.session_date_et < ra.session_date_et group by 1, 2 having count(*) >= 5),
 dist as (select q, r, rb.ticker, rb.session_date_et as day, shared, round(greatest(0, d + if(lower(ra.regime) = lower(rb.regime), 0, 0.35::double) + if(ra.ticker = rb.ticker, -0.05::double, 0)), 9) as distance
   from pairs join rec ra on ra.record_id = q join rec rb on rb.record_id = r)"""


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "analogue_record")


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.distinct_records(_records(spark, folder)).select("record_id", "ticker", "session_date_et", "regime", "features")


@R.query(
    "scenario_rows",
    f"""with {RECORDS}, x as (select record_id, ticker, as_of_utc, session_date_et, unnest(scenarios) as s, generate_subscripts(scenarios, 1) as ordinal from rec)
select record_id, ticker, as_of_utc, session_date_et, cast(ordinal as int) as ordinal, s.* from x""",
)
def scenario_rows(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.scenario_rows(_records(spark, folder))


@R.query(
    "feature_stats",
    f"""with {RECORDS}, x as (select unnest(map_keys(features)) as feature_key, cast(unnest(map_values(features)) as double) as v from rec)
select feature_key, round_even(avg(v), 6) as mean, round_even(stddev_samp(v), 6) as std_dev, count(v) as sample_count from x where v is not null group by 1 having count(v) >= 2""",
)
def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.feature_stats(_records(spark, folder))


@R.query(
    "knn_analogues",
    f"""with {RECORDS}, {DISTANCE}, a as (select *, row_number() over (partition by q, ticker, day order by distance, r) as n1 from dist),
 b as (select *, row_number() over (partition by q, ticker order by distance, r) as n2 from a where n1 <= 2), c as (select *, row_number() over (partition by q order by distance, r) as rank from b where n2 <= 4)
select q as query, r as record_id, cast(rank as int) as rank, round(distance, 6) as distance, shared from c where rank <= 24""",
)
def knn_analogues(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.analogues(_base(spark, folder), None, table(spark, folder, "feature_stat")).withColumn("distance", F.round("distance", 6))


SETUPS = """
su as (select r.record_id, concat_ws('|', lower(s.direction), lower(s.entry_type)) as setup, s.* from (select record_id, unnest(scenarios) as s from rec) r where s.structurally_valid
  qualify row_number() over (partition by r.record_id, concat_ws('|', lower(s.direction), lower(s.entry_type)) order by case upper(s.selection_tier) when 'PREFERRED' then 0 when 'SECONDARY' then 1 else 2 end, s.scenario_rank, s.scenario_id) = 1)"""


@R.query(
    "candidate_evidence",
    f"""with {RECORDS}, {DISTANCE}, {SETUPS},
 e as (select evidence_id, any_value(query_record_id) as q, concat_ws('|', lower(any_value(direction)), lower(any_value(entry_type))) as setup from temporal_evidence where evidence_id is not null and query_record_id is not null group by 1),
 m as (select e.evidence_id, e.q as qq, d.*, su.* exclude (record_id, setup) from e join dist d on d.q = e.q join su on su.record_id = d.r and su.setup = e.setup),
 a as (select *, row_number() over (partition by evidence_id, ticker, day order by distance, r) as n1 from m), b as (select *, row_number() over (partition by evidence_id, ticker order by distance, r) as n2 from a where n1 <= 2),
 c as (select b.*, rq.ticker as qt, row_number() over (partition by evidence_id order by distance, r) as rank from b join rec rq on rq.record_id = b.qq where n2 <= 4),
 x as (select *, cast(resolved_r as double) as v, coalesce(t1_before_stop, false) or coalesce(upper(primary_outcome) = 'T1_BEFORE_STOP', false) as won, upper(primary_outcome) = 'STOP_BEFORE_T1' as lost from c where rank <= 24)
select evidence_id, count(*) as returned, round_even(round((avg(distance)) * 10000, 4), 0) / 10000 as average_distance, count(*) filter (ticker = qt) as same_ticker, count(triggered) as known_trigger, count(*) filter (triggered) as triggered,
 round_even(round((count(*) filter (triggered) / nullif(cast(count(triggered) as double), 0)) * 10000, 4), 0) / 10000 as trigger_rate, count(*) filter (won) as t1, count(*) filter (lost) as stops, count(v) as resolved, count(*) filter (v > 0) as positive,
 count(*) filter (v < 0) as negative, round_even(round((cast(sum(resolved_r) as double) / nullif(count(v), 0)) * 10000, 4), 0) / 10000 as mean_r, round_even(round((median(v)) * 10000, 4), 0) / 10000 as median_r, round_even(round((count(*) filter (won) / nullif(cast(count(*) filter (won) + count(*) filter (lost) as double), 0)) * 10000, 4), 0) / 10000 as t1_rate_if_resolved,
 round_even(round((coalesce(cast(sum(resolved_r) as double), 0) / nullif(cast(count(*) filter (triggered) as double), 0)) * 10000, 4), 0) / 10000 as expectancy, count(*) filter (upper(selection_tier) = 'PREFERRED') as preferred, count(*) filter (upper(selection_tier) = 'SECONDARY') as secondary
from x group by 1""",
)
def candidate_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.candidate_evidence(table(spark, folder, "temporal_evidence"), _records(spark, folder), table(spark, folder, "feature_stat"))


METRICS = """count(*) as scenarios, count(*) filter (structurally_valid) as accepted, count(*) filter (triggered) as triggered, round_even(count(*) filter (triggered) / cast(count(*) as double), 4) as trigger_rate, count(*) filter (t1_before_stop) as t1_first,
 count(*) filter (primary_outcome = 'STOP_BEFORE_T1') as stop_first, coalesce(round_even(count(*) filter (t1_before_stop) / nullif(cast(count(*) filter (triggered) as double), 0), 4), 0) as t1_rate_if_triggered,
 coalesce(round_even(count(*) filter (t1_before_stop) / nullif(cast(count(*) filter (t1_before_stop) + count(*) filter (primary_outcome = 'STOP_BEFORE_T1') as double), 0), 4), 0) as t1_rate_if_resolved,
 coalesce(round_even(count(*) filter (primary_outcome = 'STOP_BEFORE_T1') / nullif(cast(count(*) filter (t1_before_stop) + count(*) filter (primary_outcome = 'STOP_BEFORE_T1') as double), 0), 4), 0) as stop_rate_if_resolved,
 count(*) filter (primary_outcome = 'NOT_TRIGGERED') as not_triggered, count(*) filter (primary_outcome = 'AMBIGUOUS_STOP_T1_SAME_BAR') as ambiguous, count(*) filter (primary_outcome = 'OPEN_AT_CLOSE') as open_at_close,
 count(r) as resolved, coalesce(round_even(count(r) / nullif(cast(count(*) filter (triggered) as double), 0), 4), 0) as coverage_if_triggered,
 coalesce(round_even(count(*) filter (r > 0) / nullif(cast(count(r) as double), 0), 4), 0) as win_rate, round_even(avg(r), 4) as mean_r, round_even(median(r), 4) as median_r, round_even(sum(r), 4) as total_r,
 round_even(sum(r) filter (r > 0) / nullif(-sum(r) filter (r < 0), 0), 4) as profit_factor, round_even(avg(r) filter (r > 0), 4) as mean_win, round_even(-avg(r) filter (r < 0), 4) as mean_loss,
 round_even(1 / (1 + avg(r) filter (r > 0)), 4) as break_even_rate, round_even(sum(r) / nullif(cast(count(*) filter (triggered) as double), 0), 4) as expectancy_per_triggered"""
LATEST = """
lat as (select *, cast(resolved_r as double) as r from scenario_summary where scenario_id is not null qualify row_number() over (partition by scenario_id order by known_utc desc, version_no desc) = 1)"""
BY = ["direction", "entry_type", "grade", "selection_tier"]


@R.query(
    "metric_block",
    f"with {LATEST} select 'all' as dimension, 'all' as value, {METRICS} from lat " + " ".join(f"union all select '{c}', coalesce({c}, '(none)'), {METRICS} from lat group by 2" for c in BY),
)
def metric_block(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.metric_block(evidence.latest_outcomes(table(spark, folder, "scenario_summary")), BY)


@R.query(
    "outcome_combinations",
    f"""with {LATEST}, g as (select record_id, coalesce(array_to_string(list_sort(list_distinct(list(primary_outcome))), '+'), '') as combination, count(*) as n from lat group by 1)
select combination, count(*) as groups, cast(sum(n) as bigint) as rows from g group by 1""",
)
def outcome_combinations(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.combinations(evidence.latest_outcomes(table(spark, folder, "scenario_summary")), "record_id", "primary_outcome")


EV = """
ev as (select evidence_id, evidence_window, session_date_et, selection_tier, scenario_rank, query_record_id, returned_records, actual_win, evidence_band, cast(average_distance as double) as distance, cast(evidence_mean_r as double) as mean_r,
  cast(evidence_expectancy_per_triggered as double) as expectancy, cast(actual_resolved_r as double) as actual_r from temporal_evidence where evidence_id is not null qualify row_number() over (partition by evidence_id order by recorded_utc) = 1),
 lg as (select *, 'mean_r' as measure, mean_r as x from ev union all select *, 'expectancy', expectancy from ev union all select *, 'distance', distance from ev),
 lo as (select * from lg where returned_records >= 5 and x is not null)"""
BUCKET = """count(*) as rows, round_even(min(x), 4) as evidence_min, round_even(max(x), 4) as evidence_max, round_even(avg(x), 4) as evidence_mean, round_even(avg(actual_r), 4) as actual_mean_r,
 round_even(count(*) filter (actual_win) / cast(count(*) as double), 4) as actual_win_rate, round_even(sum(actual_r), 4) as actual_total_r"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.distinct_evidence(table(spark, folder, "temporal_evidence"))


@R.query(
    "calibration",
    f"""with {EV} select measure, count(*) as rows, round_even(count(*) / cast((select count(*) from ev) as double), 4) as coverage, round_even(avg(x), 4) as evidence_mean, round_even(avg(actual_r), 4) as actual_mean_r,
 if(count(*) >= 3 and var_pop(x) > 1e-18 and var_pop(actual_r) > 1e-18, round_even(corr(x, actual_r), 4), null) as pearson from lo where actual_r is not null group by 1""",
)
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.calibration(_rows(spark, folder))


@R.query(
    "calibration_quintiles",
    f"""with {EV}, n as (select *, row_number() over (partition by measure order by x, evidence_id) as rn, count(*) over (partition by measure) as n from lo)
select measure, 'Q' || cast(cast(ceil(5.0 * rn / n) as bigint) as varchar) as bucket, {BUCKET} from n group by 1, 2""",
)
def calibration_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.quintiles(_rows(spark, folder))


@R.query(
    "sample_buckets",
    f"""with {EV}, b as (select *, cast(returned_records as double) as x from ev where returned_records >= 0)
select case when returned_records < 5 then '0-4' when returned_records < 10 then '5-9' when returned_records < 15 then '10-14' when returned_records < 20 then '15-19' else '20+' end as bucket, {BUCKET} from b group by 1""",
)
def sample_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.sample_buckets(_rows(spark, folder))


@R.query("sign_buckets", f"with {EV} select measure, case when x < 0 then 'negative' when x > 0 then 'positive' else 'zero' end as bucket, {BUCKET} from lo group by 1, 2")
def sign_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.sign_buckets(_rows(spark, folder))


THRESHOLD = """
th as (select count(*) as rows, if(count(*) > 0, greatest(quantile_disc(expectancy, 0.8), 0), null) as threshold from ev where lower(evidence_window) = 'training' and returned_records >= 5 and expectancy is not null)"""


@R.query("strong_threshold", f"with {EV}, {THRESHOLD} select * from th")
def strong_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.strong_threshold(_rows(spark, folder))


@R.query(
    "evidence_bands",
    f"""with {EV}, {THRESHOLD}, b as (select *, case when returned_records < 5 or returned_records is null or expectancy is null then 'INSUFFICIENT' when expectancy < 0 then 'NEGATIVE' when expectancy >= (select threshold from th) then 'STRONG' else 'NEUTRAL' end as band from ev),
 g as (select distinct evidence_window, unnest(['STRONG', 'NEUTRAL', 'NEGATIVE', 'INSUFFICIENT']) as band from ev),
 m as (select evidence_window, band, count(*) as n, round_even(avg(actual_r), 4) as mean_r, round_even(count(*) filter (actual_win) / cast(count(*) as double), 4) as win_rate, round_even(sum(actual_r), 4) as total_r from b group by 1, 2)
select g.evidence_window, g.band, coalesce(n, 0) as rows, mean_r, win_rate, total_r from g left join m on g.evidence_window is not distinct from m.evidence_window and g.band = m.band""",
)
def evidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.bands(_rows(spark, folder))


@R.query(
    "paired_choices",
    f"""with {EV}, o as (select *, case evidence_band when 'STRONG' then 0 when 'NEUTRAL' then 1 when 'NEGATIVE' then 2 else 3 end as o from ev),
 g as (select query_record_id, count(*) as candidates, arg_min(struct_pack(e := evidence_id, r := actual_r), (scenario_rank, evidence_id)) as a, arg_min(struct_pack(e := evidence_id, r := actual_r), (o, scenario_rank, evidence_id)) as b from o group by 1)
select query_record_id, candidates, a.e as by_rank, b.e as by_band, a.e <> b.e as changed, round(b.r - a.r, 6) as delta_r from g where candidates > 1""",
)
def paired_choices(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.paired_choices(_rows(spark, folder))
