"""Queries over what was known at an instant, links between records, measures by code, and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clean, text
from tickloom.operators import analogues, bars, context, evidence, sampling, tape
from tickloom.plans.data import NY_DATE, TICKER
from tickloom.plans.evidence import EV, LATEST, METRICS, RECORDS
from tickloom.plans.market import BARS, FEATURES
from tickloom.registry import Registry, table

R = Registry()
SOURCE = "lower(trim(source, ' ' || chr(9) || chr(10) || chr(13)))"


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return analogues.distinct_records(table(spark, folder, "analogue_record"))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "temporal_evidence").filter("evidence_id is not null").dropDuplicates(["evidence_id"])


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.latest_outcomes(table(spark, folder, "scenario_summary"))


@R.query(
    "news_as_of",
    f"""with a as (select evidence_id as ask, any_value({TICKER}) as ticker, any_value(as_of_utc) as asked from temporal_evidence where evidence_id is not null group by 1),
 nw as (select doc_id as news, {TICKER} as ticker, published_utc as published from documents where {SOURCE} in ('newswire', 'press_note') and published_utc is not null)
select ask, news, cast(row_number() over (partition by ask order by published desc, news) as int) as n from a join nw on (nw.ticker is null or nw.ticker = a.ticker) and published between asked - interval 2 day and asked qualify n <= 5""",
)
def news_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The five latest news that each evidence row could have seen at its instant."""
    asks = _evidence(spark, folder).select(F.col("evidence_id").alias("ask"), "ticker", F.col("as_of_utc").alias("at"))
    docs = table(spark, folder, "documents").filter(clean.source("source").isin("newswire", "press_note"))
    return context.news_as_of(asks, docs.select(F.col("doc_id").alias("news"), F.array_compact(F.array("ticker")).alias("tickers"), F.col("published_utc").alias("published")), 2, 5)


@R.query(
    "matching_evidence",
    f"""with {RECORDS}, e as (select evidence_id, any_value(query_record_id) as query_record_id, any_value(evidence_band) as band from temporal_evidence where evidence_id is not null group by 1)
select evidence_id, query_record_id from e where query_record_id is null or query_record_id in (select record_id from rec where upper(raw_verdict) = 'TRADE')""",
)
def matching_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of records with a trade, and evidence without a record."""
    wanted = _records(spark, folder).filter(F.upper("raw_verdict") == "TRADE").select(F.col("record_id").alias("query_record_id"))
    return context.matching(_evidence(spark, folder).select("evidence_id", "query_record_id"), wanted, "query_record_id")


@R.query(
    "tiered_scenarios",
    f"""with {RECORDS}, x as (select record_id, unnest(scenarios) as s from rec),
 t as (select record_id, scenario_rank, arg_max(selection_tier, (known_utc, version_no, scenario_id)) as tier from scenario_summary where record_id is not null and scenario_rank is not null and selection_tier is not null group by 1, 2)
select x.record_id, x.s.scenario_id as scenario_id, x.s.scenario_rank as scenario_rank, coalesce(t.tier, 'UNKNOWN') as tier from x left join t on t.record_id = x.record_id and t.scenario_rank = x.s.scenario_rank""",
)
def tiered_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Each scenario of a record with the last tier of its rank."""
    s = analogues.scenario_rows(table(spark, folder, "analogue_record")).select("record_id", "scenario_id", "scenario_rank")
    tiers = table(spark, folder, "scenario_summary").filter("selection_tier is not null").withColumnRenamed("selection_tier", "tier")
    return context.with_last(s, tiers, ["record_id", "scenario_rank"], ["known_utc", "version_no", "scenario_id"], "tier", "UNKNOWN").select("record_id", "scenario_id", "scenario_rank", "tier")


@R.query("full_sessions", f"with {BARS} select ticker, session_date, count(*) as bars, max(ts) as last_ts from bars group by 1, 2 having count(*) >= 8")
def full_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions with at least eight bars."""
    b = context.enough(bars.clean_bars(table(spark, folder, "minute_bar")), 8)
    return b.groupBy("ticker", "session_date").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("last_ts"))


@R.query(
    "cooled_records",
    f"""with {RECORDS}, x as (select record_id, ticker, as_of_utc, cast(floor((epoch_us(as_of_utc) - epoch_us(lag(as_of_utc) over (partition by ticker order by as_of_utc, record_id))) / 60000000.0) as bigint) as since from rec)
select *, coalesce(since >= 10, true) as cooled from x""",
)
def cooled_records(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes since a ticker's record before, and whether they are ten or more."""
    return context.cooled(_records(spark, folder).select("record_id", "ticker", "as_of_utc"), "ticker", ["as_of_utc", "record_id"], 10)


@R.query("peak_volumes", f"with {FEATURES} select ticker, session_date, ts, round(max(rel_volume) over (partition by ticker, session_date order by ts), 6) as peak from feats")
def peak_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest relative volume of each session so far."""
    f = bars.session_features(bars.clean_bars(table(spark, folder, "minute_bar")))
    return context.peaks(f, ["ticker", "session_date"], ["ts"], "rel_volume").select("ticker", "session_date", "ts", F.round("peak", 6).alias("peak"))


PART_MINUTES = "(hour(timezone('America/New_York', as_of_utc at time zone 'UTC')) * 60 + minute(timezone('America/New_York', as_of_utc at time zone 'UTC')))"


@R.query(
    "session_parts",
    f"""with {RECORDS}, m as (select {PART_MINUTES} as m from rec where as_of_utc is not null),
 p as (select 6 as parts, case when m < 570 then 'premarket' when m < 600 then 'open30' when m < 690 then 'morning' when m < 840 then 'midday' when m < 930 then 'afternoon' else 'close30' end as part from m
  union all select 4, case when m < 600 then 'open' when m < 690 then 'morning' when m < 840 then 'midday' else 'close' end from m)
select parts, part, count(*) as records from p group by 1, 2""",
)
def session_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Records by part of the day, in six parts and in four."""
    r = _records(spark, folder).filter("as_of_utc is not null")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("parts"), context.session_part("as_of_utc", n).alias("part")) for n in (6, 4))))
    return r.select(each.alias("x")).select("x.*").groupBy("parts", "part").agg(F.count(F.lit(1)).alias("records"))


def _codes() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("grade").isNull(), "no_grade"), F.when(~F.coalesce("structurally_valid", F.lit(False)), "invalid"), F.when(F.col("selection_tier").isNull(), "no_tier"),
        F.when(F.col("resolved_r").isNull(), "unresolved"),
    ))


CODES = f"""{LATEST}, coded as (select *, list_filter([if(grade is null, 'no_grade', null), if(not coalesce(structurally_valid, false), 'invalid', null), if(selection_tier is null, 'no_tier', null), if(resolved_r is null, 'unresolved', null)], lambda x: x is not null) as codes from lat)"""


@R.query("metrics_by_code", f"with {CODES}, x as (select *, unnest(codes) as code from coded) select code, {METRICS} from x group by 1")
def metrics_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """The metric block of the scenarios with each fault; one with several faults counts under each."""
    return evidence.metrics_by_code(_latest(spark, folder), _codes())


@R.query("metrics_by_combination", f"with {CODES}, x as (select *, coalesce(array_to_string(list_sort(codes), '+'), '') as combination from coded) select combination, {METRICS} from x group by 1")
def metrics_by_combination(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.metrics_by_combination(_latest(spark, folder), _codes())


@R.query(
    "scenario_histograms",
    f"""with {LATEST}, g as (select record_id, count(*) as scenarios, count(*) filter (triggered) as triggered, count(*) filter (structurally_valid) as valid, count(resolved_r) as resolved from lat group by 1),
 x as (select 'scenarios' as counter, scenarios as value from g union all select 'triggered', triggered from g union all select 'valid', valid from g union all select 'resolved', resolved from g)
select counter, value, count(*) as groups from x group by 1, 2""",
)
def scenario_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have how many scenarios, triggered, valid and resolved ones."""
    g = _latest(spark, folder).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("scenarios"), F.count_if("triggered").alias("triggered"), F.count_if("structurally_valid").alias("valid"), F.count("resolved_r").alias("resolved")
    )
    return evidence.histogram(g, {c: F.col(c) for c in ("scenarios", "triggered", "valid", "resolved")})


@R.query(
    "line_shapes",
    rf"""with l as (select unnest(string_split(text, chr(10))) as line from documents where {SOURCE} = 'app_log' and text is not null),
 g as (select nullif(regexp_extract(line, '^\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z ([A-Z_]+)', 1), '') as code, regexp_replace(regexp_replace(line, 'ticker=[^ ]+', 'ticker=?', 'g'), '[0-9]+', '#', 'g') as detail from l)
select code, detail, count(*) as lines from g where code is not null group by 1, 2""",
)
def line_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines by event and shape: numbers and tickers are masked."""
    d = table(spark, folder, "documents").filter((clean.source("source") == "app_log") & F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("line"))
    detail = F.regexp_replace(F.regexp_replace("line", "ticker=[^ ]+", "ticker=?"), "[0-9]+", "#")
    code = F.nullif(F.regexp_extract("line", r"^[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z ([A-Z_]+)", 1), F.lit(""))
    return d.select(code.alias("code"), detail.alias("detail")).filter("code is not null").groupBy("code", "detail").agg(F.count(F.lit(1)).alias("lines"))


@R.query(
    "usage_totals",
    rf"""with l as (select cast(published_utc as date) as day, unnest(string_split(text, chr(10))) as line from documents where {SOURCE} = 'app_log' and text is not null),
 g as (select coalesce(cast(day as varchar), '(none)') as day, nullif(regexp_extract(line, '^\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}Z ([A-Z_]+)', 1), '') as event, coalesce(upper(nullif(regexp_extract(line, '\bticker=(\S+)', 1), '')), '(none)') as ticker,
  try_cast(nullif(regexp_extract(line, '\blatency_ms=(\d+)', 1), '') as bigint) as ms from l),
 e as (select * from g where event is not null)
select 'day' as dimension, day as value, count(*) as calls, cast(sum(ms) as bigint) as total_ms from e group by 2 union all select 'event', event, count(*), cast(sum(ms) as bigint) from e group by 2
union all select 'ticker', ticker, count(*), cast(sum(ms) as bigint) from e group by 2""",
)
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and their time by day, by kind and by ticker, in one pass."""
    d = table(spark, folder, "documents").filter((clean.source("source") == "app_log") & F.col("text").isNotNull())
    line = F.col("line")
    e = d.select(F.coalesce(F.col("published_utc").cast("date").cast("string"), F.lit("(none)")).alias("day"), F.explode(F.split("text", "\n")).alias("line")).select(
        "day", F.nullif(F.regexp_extract(line, r"^[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z ([A-Z_]+)", 1), F.lit("")).alias("event"),
        F.coalesce(F.upper(text.field(line, "ticker")), F.lit("(none)")).alias("ticker"), F.expr(r"try_cast(nullif(regexp_extract(line, '\\blatency_ms=([0-9]+)', 1), '') as bigint)").alias("ms"),
    ).filter("event is not null")
    out = e.groupingSets([["day"], ["event"], ["ticker"]], "day", "event", "ticker").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("calls"), F.sum("ms").alias("total_ms"))
    return out.select(F.when(F.col("_g") == 3, "day").when(F.col("_g") == 5, "event").otherwise("ticker").alias("dimension"), F.coalesce("day", "event", "ticker").alias("value"), "calls", "total_ms")


@R.query(
    "holdout_ordering",
    f"""with {EV}, thr as (select greatest(quantile_disc(expectancy, 0.8), 0) as t from ev where lower(evidence_window) = 'training' and returned_records >= 5 and expectancy is not null),
 b as (select *, returned_records >= 5 and expectancy is not null as enough, case when returned_records < 5 or returned_records is null or expectancy is null then 'INSUFFICIENT' when expectancy < 0 then 'NEGATIVE' when expectancy >= (select t from thr) then 'STRONG' else 'NEUTRAL' end as band from ev),
 g as (select evidence_window, count(*) as rows, round_even(count(*) filter (enough) / cast(count(*) as double), 4) as coverage, round_even(corr(expectancy, actual_r) filter (enough), 4) as pearson,
  round_even(avg(actual_r) filter (band = 'STRONG'), 4) as strong, round_even(avg(actual_r) filter (band = 'NEUTRAL'), 4) as neutral, round_even(avg(actual_r) filter (band = 'NEGATIVE'), 4) as negative from b group by 1)
select *, round_even(strong - neutral, 4) as strong_minus_neutral, round_even(neutral - negative, 4) as neutral_minus_negative, case when strong is not null and neutral is not null and negative is not null then strong > neutral and neutral > negative end as ordered from g""",
)
def holdout_ordering(spark: SparkSession, folder: str) -> DataFrame:
    """Whether strong evidence did better than neutral, and neutral better than negative, in each window."""
    return evidence.ordering_test(evidence.distinct_evidence(table(spark, folder, "temporal_evidence")))


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    part = context.session_part("as_of_utc", 4)
    r = _records(spark, folder).select("record_id", "ticker", F.concat_ws("|", part, F.coalesce("regime", F.lit("?"))).alias("stratum"), "raw_verdict", "scenarios")
    return r.withColumn("r", F.get(F.filter("scenarios", lambda s: s["resolved_r"].isNotNull()), 0)["resolved_r"]).drop("scenarios")


SIDES = f"""{RECORDS}, base as (select record_id, ticker, case when {PART_MINUTES} < 600 then 'open' when {PART_MINUTES} < 690 then 'morning' when {PART_MINUTES} < 840 then 'midday' else 'close' end || '|' || coalesce(regime, '?') as stratum,
  raw_verdict, list_filter(scenarios, lambda s: s.resolved_r is not null)[1].resolved_r as r from rec)"""


def _sha(seed: str, key: str) -> str:
    return f"upper(sha256(cast({seed} as varchar) || '|' || cast({key} as varchar)))"


def _balanced_sql(side: str, size: int, seed: int) -> str:
    return f"""with {SIDES}, sided as (select *, {side} as side from base where ({side}) is not null),
 n as (select count(*) filter (side) as y, count(*) filter (not side) as x from sided), n1 as (select y, least(y, {size // 2}) as y0, least(x, {size} - least(y, {size // 2})) as no from n),
 n2 as (select y0 + least({size} - y0 - no, y - y0) as yes, no from n1),
 a as (select sided.*, if(side, yes, no) as take, if(side, {seed}, {seed + 100_003}) as seed from sided, n2),
 c as (select *, row_number() over (partition by side, ticker order by {_sha("seed", "record_id")}, record_id) <= greatest(1, ceil(take / 4.0)) as fits from a),
 h as (select *, if(fits, {_sha("seed", "record_id")}, {_sha("seed + 17", "record_id")}) as h from c),
 k as (select *, row_number() over (partition by side, fits, stratum order by h, record_id) as k from h),
 o as (select *, row_number() over (partition by side order by fits desc, if(fits, k, null), if(fits, {_sha("seed + 1", "stratum")}, null), if(fits, null, h), record_id) as place from k)"""


@R.query("balanced_sample", _balanced_sql("upper(raw_verdict) = 'TRADE'", 60, 42) + " select record_id, stratum, side from o where place <= take")
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    """60 records, half with a trade and half without, spread over parts of the day and regimes, few of one ticker."""
    return sampling.balanced(_sides(spark, folder), "record_id", "stratum", "ticker", F.upper("raw_verdict") == "TRADE", 60, 42).select("record_id", "stratum", "side")


@R.query("resolved_sample", _balanced_sql("case when r > 0 then true when r < 0 then false end", 40, 41_045) + " select record_id, stratum, side from o where place <= take")
def resolved_sample(spark: SparkSession, folder: str) -> DataFrame:
    """40 records with a result, half gains and half losses."""
    side = F.when(F.col("r") > 0, True).when(F.col("r") < 0, False)
    return sampling.balanced(_sides(spark, folder), "record_id", "stratum", "ticker", side, 40, 41_045).select("record_id", "stratum", "side")


@R.query(
    "first_entries",
    f"""with {RECORDS}, x as (select record_id, ticker, as_of_utc, unnest(scenarios) as s, generate_subscripts(scenarios, 1) as ordinal from rec),
 t as (select *, row_number() over (partition by record_id order by coalesce(s.scenario_rank, ordinal), ordinal) as place from x qualify place <= 3),
 e as (select *, row_number() over (partition by record_id order by place) as n from t where s.structurally_valid and s.triggered)
select record_id, ticker, s.scenario_id as scenario_id, cast(place as int) as place from e where n = 1""",
)
def first_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first three scenarios of each record, the first that is valid and triggered."""
    at = F.coalesce("scenario_rank", "ordinal")
    s = analogues.scenario_rows(table(spark, folder, "analogue_record")).withColumn("o", F.struct(at.alias("r"), "ordinal"))
    # a record has a few scenarios: their places are found in its own list
    listed = s.groupBy("record_id", "ticker").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "scenario_id", (F.col("structurally_valid") & F.col("triggered")).alias("ok")))), 1, 3).alias("l"))
    each = listed.select("record_id", "ticker", F.posexplode("l").alias("i", "x")).filter("x.ok")
    return each.groupBy("record_id", "ticker").agg(F.min(F.struct((F.col("i") + 1).alias("place"), F.col("x.scenario_id").alias("scenario_id"))).alias("e")).select("record_id", "ticker", "e.scenario_id", "e.place")


@R.query(
    "linked_tickers",
    f"""with {RECORDS}, e as (select evidence_id, any_value(analogue_scenario_ids) as ids from temporal_evidence where evidence_id is not null group by 1), x as (select evidence_id, unnest(list_distinct(ids)) as scenario_id from e),
 s as (select scenario_id, min(record_id) as record_id from scenario_summary where record_id is not null group by 1)
select distinct evidence_id, ticker from x join s using (scenario_id) join rec using (record_id)""",
)
def linked_tickers(spark: SparkSession, folder: str) -> DataFrame:
    """The tickers that each evidence row draws on: from its scenarios to their records."""
    x = _evidence(spark, folder).select("evidence_id", F.explode(F.array_distinct("analogue_scenario_ids")).alias("scenario_id"))
    s = table(spark, folder, "scenario_summary").filter("record_id is not null").groupBy("scenario_id").agg(F.min("record_id").alias("record_id"))
    return x.join(s, "scenario_id").join(_records(spark, folder).select("record_id", "ticker"), "record_id").select("evidence_id", "ticker").distinct()


@R.query("repair_needed", f"with {RECORDS} select record_id, upper(raw_verdict) = 'TRADE' and len(scenarios) > 0 and len(list_filter(scenarios, lambda s: s.structurally_valid)) = 0 as repair from rec where raw_verdict is not null and scenarios is not null")
def repair_needed(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a record has a trade and scenarios, but none that is valid."""
    none = F.size(F.filter("scenarios", lambda s: F.coalesce(s["structurally_valid"], F.lit(False)))) == 0
    r = _records(spark, folder).filter("raw_verdict is not null and scenarios is not null")
    return r.select("record_id", ((F.upper("raw_verdict") == "TRADE") & (F.size("scenarios") > 0) & none).alias("repair"))


@R.query(
    "running_vwap",
    f"""with {BARS},
 tk as (select distinct tick_id, {TICKER} as ticker, {NY_DATE.format("time_utc")} as session_date, time_utc as ts, cast(price as double) as price, size from scanner_tick where {TICKER} is not null and time_utc is not null and price is not null and tick_id is not null and size is not null),
 b as (select *, cast(round((h + l + c) * 1000000) as hugeint) * v as pv from bars where (h + l + c) is not null and v is not null),
 seed as (select t.tick_id, sum(b.pv) as pv, cast(sum(b.v) as double) as v from tk t join b on b.ticker = t.ticker and b.session_date = t.session_date and b.ts + interval 1 minute <= t.ts group by 1),
 open as (select t.tick_id, sum(3 * cast(round(u.price * 1000000) as hugeint) * u.size) as pv, cast(sum(u.size) as double) as v from tk t join tk u on u.ticker = t.ticker and u.session_date = t.session_date and (u.ts, u.tick_id) <= (t.ts, t.tick_id)
   left join b on b.ticker = u.ticker and b.session_date = u.session_date and b.ts = date_trunc('minute', u.ts) where b.ts is null or b.ts + interval 1 minute > t.ts group by 1)
select ticker, session_date, tick_id, ts, round(cast(coalesce(s.pv, 0) + coalesce(o.pv, 0) as double) / nullif(3000000 * (coalesce(s.v, 0) + coalesce(o.v, 0)), 0), 6) as vwap from tk left join seed s using (tick_id) left join open o using (tick_id)""",
)
def running_vwap(spark: SparkSession, folder: str) -> DataFrame:
    """The session's volume-weighted price after each tick, from its closed bars and the ticks since."""
    b = bars.clean_bars(table(spark, folder, "minute_bar"))
    t = tape.clean_ticks(table(spark, folder, "scanner_tick"))
    return context.running_vwap(b, t).withColumn("vwap", F.round("vwap", 6))
