"""Queries over paths, keyed rows, samples, texts and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clean, text
from tickloom.operators import bars, evidence, merge, outcomes, sampling
from tickloom.plans.data import NY_DATE, TICKER
from tickloom.plans.evidence import EV, LATEST, RECORDS
from tickloom.plans.market import BARS
from tickloom.registry import Registry, table

R = Registry()

# Levels of a path: from the close of every seventh bar on, risk and targets are fixed shares of it.
PATHS = """
ps as (select ticker || '@' || epoch(ts)::bigint as id, ticker, session_date, ts as start, if(cast(epoch(ts) as bigint) // 60 % 2 = 0, 'long', 'short') as side, c as entry, if(cast(epoch(ts) as bigint) // 60 % 2 = 0, 1, -1) as sg from bars
  where c is not null),
 paths as (select *, entry * (1 - sg * 0.002::double) as stop, entry * (1 + sg * 0.003::double) as t1, entry * (1 + sg * 0.006::double) as t2 from ps)"""


def _paths(b: DataFrame) -> DataFrame:
    even = (F.unix_seconds("ts") / 60).cast("bigint") % 2 == 0
    sign = F.when(even, 1).otherwise(-1)
    e = F.col("c")
    return b.filter("c is not null").select(
        F.concat(F.col("ticker"), F.lit("@"), F.unix_seconds("ts").cast("string")).alias("id"), "ticker", "session_date", F.col("ts").alias("start"), F.when(even, "long").otherwise("short").alias("side"),
        e.alias("entry"), (e * (1 - sign * F.lit(0.002))).alias("stop"), (e * (1 + sign * F.lit(0.003))).alias("t1"), (e * (1 + sign * F.lit(0.006))).alias("t2"),
    )


@R.query(
    "first_touches",
    f"""with {BARS}, {PATHS}, x as (select p.id, b.ts, if(sg = 1, h, -l) as good, if(sg = 1, l, -h) as bad, sg * entry as e, sg * (entry - stop) as risk, if(sg = 1, l, -h) <= sg * stop as s, if(sg = 1, h, -l) >= sg * t1 as a,
   if(sg = 1, h, -l) >= sg * t2 as b from paths p join bars b on b.ticker = p.ticker and b.session_date = p.session_date and b.ts > p.start and b.h is not null and b.l is not null),
 f as (select id, min(ts) filter (s) as fs, min(ts) filter (a) as f1, max(ts) as last from x group by 1),
 g as (select f.*, (select min(ts) from x where x.id = f.id and s and ts > f1) as s2, (select min(ts) from x where x.id = f.id and b and ts > f1) as t2 from f),
 k as (select *, case when fs = f1 then 'AMBIGUOUS' when fs is not null and (f1 is null or fs < f1) then 'STOP' when f1 is not null and t2 is not null and (s2 is null or t2 <= s2) then 'T2' when f1 is not null then 'T1' else 'OPEN' end as kind from g),
 m as (select k.id, greatest(0, max((good - e) / nullif(risk, 0))) as mfe, least(0, min((bad - e) / nullif(risk, 0))) as mae from k join x on x.id = k.id and x.ts <= if(kind in ('AMBIGUOUS', 'STOP'), fs, coalesce(s2, last)) group by 1)
select p.id, coalesce(kind, 'NO_BARS') as outcome, case when kind in ('AMBIGUOUS', 'STOP') then fs when kind = 'T1' then s2 end as stop_ts, if(kind <> 'STOP', f1, null) as t1_ts, round(mfe, 3) as mfe, round(mae, 3) as mae
from paths p left join k using (id) left join m using (id)""",
)
def first_touches(spark: SparkSession, folder: str) -> DataFrame:
    b = bars.clean_bars(table(spark, folder, "minute_bar"))
    return outcomes.first_touches(_paths(b), b)


@R.query(
    "further_course",
    f"""with {BARS}, {PATHS} select p.id, count(b.ts) as bars, round((max(h) - any_value(entry)) / nullif(any_value(entry), 0) * 100, 4) as max_up, round((min(l) - any_value(entry)) / nullif(any_value(entry), 0) * 100, 4) as max_down,
 round((arg_max(b.c, b.ts) - any_value(entry)) / nullif(any_value(entry), 0) * 100, 4) as close_change
from paths p left join bars b on b.ticker = p.ticker and b.session_date = p.session_date and b.ts > p.start group by 1""",
)
def further_course(spark: SparkSession, folder: str) -> DataFrame:
    b = bars.clean_bars(table(spark, folder, "minute_bar"))
    return outcomes.further_course(_paths(b).select("id", "ticker", "session_date", "start", F.col("entry").alias("base")), b)


FEATURE = ["vwap", "avg_volume_5", "rel_volume", "above_vwap", "ingested_utc"]


@R.query(
    "upsert_features",
    f"""select {TICKER} as ticker, ts_utc, arg_max(struct_pack(vwap, avg_volume_5, rel_volume, above_vwap, ingested_utc), (ingested_utc, coalesce(rel_volume, -1))) as r from minute_bar_features
where {TICKER} is not null and ts_utc is not null group by 1, 2""".replace("select", "with x as (select", 1)
    + ") select ticker, ts_utc, r.vwap, r.avg_volume_5, r.rel_volume, r.above_vwap, r.ingested_utc from x",
)
def upsert_features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature rows in force: of equal ticker and time the one ingested last."""
    f = table(spark, folder, "minute_bar_features").select(clean.ticker("ticker").alias("ticker"), "ts_utc", *FEATURE, F.coalesce("rel_volume", F.lit(-1)).alias("_rv"))
    return merge.upsert(f, ["ticker", "ts_utc"], ["ingested_utc", "_rv"]).drop("_rv")


@R.query(
    "patched_scenarios",
    """select scenario_id, arg_max(grade, (known_utc, version_no)) filter (grade is not null) as grade, arg_max(resolved_r, (known_utc, version_no)) filter (resolved_r is not null) as resolved_r,
 arg_max(primary_outcome, (known_utc, version_no)) filter (primary_outcome is not null) as primary_outcome from scenario_summary where scenario_id is not null group by 1""",
)
def patched_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Each scenario's versions applied as patches in which nulls change nothing."""
    return merge.patch(table(spark, folder, "scenario_summary"), ["scenario_id"], ["known_utc", "version_no"], ["grade", "resolved_r", "primary_outcome"])


@R.query("unresolved_scenarios", f"with {LATEST} select distinct scenario_id from lat where scenario_id not in (select scenario_id from scenario_summary where resolved_r is not null and scenario_id is not null)")
def unresolved_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenarios that no version resolves: an anti-join."""
    s = table(spark, folder, "scenario_summary")
    return merge.without(evidence.latest_outcomes(s).select("scenario_id"), s.filter("resolved_r is not null"), ["scenario_id"])


@R.query(
    "decision_changes",
    f"""with {RECORDS}, s as (select record_id, unnest(scenarios) as s, generate_subscripts(scenarios, 1) as i from rec), top as (select record_id, arg_min(struct_pack(e := s.entry_type), (coalesce(s.scenario_rank, 2147483647), i)).e as top from s group by 1),
 r as (select rec.*, top from rec left join top using (record_id)),
 c as (select *, lag(raw_verdict) over w is distinct from raw_verdict or lag(top) over w is distinct from top or row_number() over w = 1 as changed from r window w as (partition by ticker order by as_of_utc, record_id))
select record_id, ticker, changed, changed or upper(raw_verdict) = 'TRADE' or minute(as_of_utc) % 15 = 0 as captured from c""",
)
def decision_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a record's verdict or the entry type of its first scenario by rank differs from its ticker's record before it, and
    whether it is captured: a change, a trade, or a quarter of an hour."""
    from tickloom.operators.analogues import distinct_records

    ranked = F.transform("scenarios", lambda s, i: F.struct(F.coalesce(s["scenario_rank"], F.lit(2147483647)).alias("r"), i.alias("i"), s["entry_type"].alias("e")))
    top = F.array_min(ranked)["e"]
    r = merge.changes(distinct_records(table(spark, folder, "analogue_record")), "ticker", ["as_of_utc", "record_id"], [F.col("raw_verdict"), top])
    return r.select("record_id", "ticker", "changed", (F.col("changed") | (F.upper("raw_verdict") == "TRADE") | (F.minute("as_of_utc") % 15 == 0)).alias("captured"))


@R.query(
    "cold_runs",
    f"""with {RECORDS}, c as (select record_id, ticker, sum(coalesce(upper(raw_verdict) <> 'TRADE', false)::int) over (partition by ticker order by as_of_utc, record_id rows 2 preceding) = 3 as run from rec) select * from c""",
)
def cold_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a ticker's last three records all have no trade."""
    from tickloom.operators.analogues import distinct_records

    r = merge.runs(distinct_records(table(spark, folder, "analogue_record")), "ticker", ["as_of_utc", "record_id"], F.upper("raw_verdict") != "TRADE")
    return r.select("record_id", "ticker", "run")


@R.query(
    "cadence_slots",
    f"""with k as (select distinct {TICKER} as ticker from analogue_record where {TICKER} is not null), s as (select ticker, (dense_rank() over (order by ticker) - 1) % 15 as slot from k)
select ticker, cast(m as int) as minute from s, (select unnest(generate_series(570, 599)) as m) where m % 15 = slot""",
)
def cadence_slots(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "analogue_record").select(clean.ticker("ticker").alias("ticker")).dropna()
    return merge.cadence(keys, "ticker", spark.range(570, 600).select(F.col("id").cast("int").alias("minute")), 15)


INVENTORY = [("minute_bar", "bar_start_utc"), ("minute_bar_features", "ts_utc"), ("scanner_tick", "time_utc"), ("scanner_quote", "time_utc"), ("analogue_record", "as_of_utc"), ("temporal_evidence", "as_of_utc")]


@R.query("inventory", " union all ".join(f"select '{t}' as name, count(*) as rows, min({c}) as first_utc, max({c}) as last_utc, count(distinct {TICKER}) as tickers from {t}" for t, c in INVENTORY))
def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first and last time and tickers of each table."""
    one = lambda t, c: table(spark, folder, t).agg(
        F.count(F.lit(1)).alias("rows"), F.min(c).alias("first_utc"), F.max(c).alias("last_utc"), F.count_distinct(clean.ticker("ticker")).alias("tickers")
    ).select(F.lit(t).alias("name"), "*")
    return reduce(DataFrame.unionAll, [one(t, c) for t, c in INVENTORY])


@R.query(
    "train_holdout",
    """with e as (select evidence_id, any_value(session_date_et) as d from temporal_evidence where evidence_id is not null group by 1)
select case when d between date '2026-02-16' and date '2026-03-06' then 'training' when d between date '2026-03-09' and date '2026-03-20' then 'holdout' else 'outside' end as evidence_window, count(*) as rows, count(distinct d) as days from e group by 1""",
)
def train_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence by window, both bounds of a window included."""
    e = table(spark, folder, "temporal_evidence").filter("evidence_id is not null").groupBy("evidence_id").agg(F.first("session_date_et").alias("d"))
    window = F.when(F.col("d").between("2026-02-16", "2026-03-06"), "training").when(F.col("d").between("2026-03-09", "2026-03-20"), "holdout").otherwise("outside")
    return e.groupBy(window.alias("evidence_window")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("d").alias("days"))


STRATA = f"""
st as (select record_id, strftime(session_date_et, '%G-%V') || '|' || coalesce(raw_verdict, '?') || '|' || coalesce(regime, '?') as stratum from rec),
 q0 as (select stratum, count(*) as n, least(200, sum(count(*)) over ()) as size, sum(count(*)) over () as total from st group by 1),
 q1 as (select *, size * n // total as whole, size * n % total as rest from q0),
 quota as (select stratum, n, cast(whole + if(row_number() over (order by rest desc, stratum) <= size - sum(whole) over (), 1, 0) as bigint) as take from q1)"""


def _strata(spark: SparkSession, folder: str) -> DataFrame:
    from tickloom.operators.analogues import distinct_records

    r = distinct_records(table(spark, folder, "analogue_record"))
    d = F.col("session_date_et")
    # the ISO year is that of the week's Thursday
    week = F.format_string("%d-%02d", F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3)), F.weekofyear(d))
    return r.select("record_id", F.concat_ws("|", week, F.coalesce("raw_verdict", F.lit("?")), F.coalesce("regime", F.lit("?"))).alias("stratum"))


@R.query("sample_quotas", f"with {RECORDS}, {STRATA} select * from quota")
def sample_quotas(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.quotas(_strata(spark, folder), "stratum", 200)


@R.query(
    "stratified_sample",
    f"with {RECORDS}, {STRATA}, k as (select *, row_number() over (partition by stratum order by upper(sha256('42|' || record_id)), record_id) as i from st) select record_id, k.stratum from k join quota using (stratum) where i <= take",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """200 records in proportion to week, verdict and regime."""
    return sampling.stratified(_strata(spark, folder), "record_id", "stratum", 200, 42).select("record_id", "stratum")


@R.query(
    "round_robin_sample",
    f"""with {RECORDS}, {STRATA}, k as (select *, row_number() over (partition by stratum order by upper(sha256('42|' || record_id)), record_id) as i from st), o as (select record_id, stratum, row_number() over (order by i, stratum, record_id) as place from k)
select record_id, stratum, cast(place as int) as place from o where place <= 40""",
)
def round_robin_sample(spark: SparkSession, folder: str) -> DataFrame:
    """40 records taken from the strata in turn."""
    return sampling.round_robin(_strata(spark, folder), "record_id", "stratum", 40, 42)


@R.query(
    "card_levels",
    r"""with d as (select doc_id, text from documents where lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) = 'card_rationale'),
 x as (select doc_id, nullif(regexp_extract(text, '([A-Z]{3,6}) (long|short) ([a-z_]+): entry', 2), '') as direction, nullif(regexp_extract(text, '([A-Z]{3,6}) (long|short) ([a-z_]+): entry', 3), '') as entry_type,
  try_cast(nullif(regexp_extract(text, '(?i)\bentry\s+([0-9]+(?:\.[0-9]+)?)', 1), '') as double) as entry, try_cast(nullif(regexp_extract(text, '(?i)\bstop\s+([0-9]+(?:\.[0-9]+)?)', 1), '') as double) as stop,
  try_cast(nullif(regexp_extract(text, '(?i)\bT1\s+([0-9]+(?:\.[0-9]+)?)', 1), '') as double) as t1, nullif(regexp_extract(text, '\bgrade ([A-F])\b', 1), '') as grade from d)
select *, round(abs(t1 - entry) / nullif(abs(entry - stop), 0), 3) as reward_risk from x where direction is not null""",
)
def card_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Direction, entry type, levels and grade read from rationale texts."""
    t = F.col("text")
    part = lambda i: F.nullif(F.regexp_extract(t, r"([A-Z]{3,6}) (long|short) ([a-z_]+): entry", i), F.lit(""))
    d = table(spark, folder, "documents").filter(clean.source("source") == "card_rationale")
    x = d.select("doc_id", part(2).alias("direction"), part(3).alias("entry_type"), text.level(t, "entry").alias("entry"), text.level(t, "stop").alias("stop"), text.level(t, "T1").alias("t1"),
                 F.nullif(F.regexp_extract(t, r"\bgrade ([A-F])\b", 1), F.lit("")).alias("grade")).filter("direction is not null")
    risk = F.abs(F.col("entry") - F.col("stop"))
    return x.withColumn("reward_risk", F.round(F.try_divide(F.abs(F.col("t1") - F.col("entry")), F.nullif(risk, F.lit(0.0))), 3))


LOGS = r"""
l as (select unnest(string_split(text, chr(10))) as line from documents where lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) = 'app_log' and text is not null),
 g as (select nullif(regexp_extract(line, '^\d{2}:\d{2}:\d{2}\.\d{3}Z ([A-Z_]+)', 1), '') as event, nullif(regexp_extract(line, '\bticker=(\S+)', 1), '') as ticker, nullif(regexp_extract(line, '\bstatus=(\S+)', 1), '') as status,
  try_cast(nullif(regexp_extract(line, '\blatency_ms=(\d+)', 1), '') as bigint) as latency_ms from l)"""


@R.query(
    "log_rollup",
    f"""with {LOGS}, e as (select event, coalesce(status, '(none)') as status, latency_ms from g where event is not null)
select 'event' as dimension, event as value, count(*) as lines, count(latency_ms) as timed, cast(sum(latency_ms) as bigint) as total_ms, max(latency_ms) as max_ms from e group by 2
union all select 'status', status, count(*), count(latency_ms), cast(sum(latency_ms) as bigint), max(latency_ms) from e group by 2
union all select 'all', 'all', count(*), count(latency_ms), cast(sum(latency_ms) as bigint), max(latency_ms) from e""",
)
def log_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines by event, by status and in all, in one pass; lines that begin otherwise are skipped."""
    d = table(spark, folder, "documents").filter((clean.source("source") == "app_log") & F.col("text").isNotNull())
    line = F.col("line")
    g = d.select(F.explode(F.split("text", "\n")).alias("line")).select(
        F.nullif(F.regexp_extract(line, r"^[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z ([A-Z_]+)", 1), F.lit("")).alias("event"), F.coalesce(text.field(line, "status"), F.lit("(none)")).alias("status"),
        F.expr(r"try_cast(nullif(regexp_extract(line, '\\blatency_ms=([0-9]+)', 1), '') as bigint)").alias("latency_ms"),
    ).filter("event is not null")
    out = g.groupingSets([["event"], ["status"], []], "event", "status").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("lines"), F.count("latency_ms").alias("timed"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms")
    )
    name = F.when(F.col("_g") == 1, "event").when(F.col("_g") == 2, "status").otherwise("all")
    return out.select(name.alias("dimension"), F.coalesce("event", "status", F.lit("all")).alias("value"), "lines", "timed", "total_ms", "max_ms")


@R.query(
    "clipped_texts",
    r"""with x as (select doc_id, text, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') as t from documents)
select doc_id, if(length(t) > 120, left(t, 120) || '…', t) as clipped, sha256(text) as sha, cast(ceil(length(text) / 4.0) as bigint) as about_tokens from x""",
)
def clipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with white space collapsed and clipped, their hash, and about how many tokens they have (a quarter of the length)."""
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", text.clip(t, 120).alias("clipped"), text.sha_hex(t).alias("sha"), F.ceil(F.length(t) / 4).alias("about_tokens"))


@R.query(
    "news_top",
    f"""with d as (select doc_id, {TICKER} as ticker, {NY_DATE.format("published_utc")} as day, published_utc from documents where lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) in ('newswire', 'press_note') and {TICKER} is not null and published_utc is not null)
select ticker, day, doc_id, cast(row_number() over (partition by ticker, day order by published_utc desc, doc_id) as int) as n from d qualify n <= 5""",
)
def news_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five latest news of each ticker and day."""
    d = table(spark, folder, "documents").filter(clean.source("source").isin("newswire", "press_note") & F.col("published_utc").isNotNull())
    d = d.select("doc_id", clean.ticker("ticker").alias("ticker"), clean.ny_date("published_utc").alias("day"), (-clean.micros("published_utc")).alias("_late")).filter("ticker is not null")
    ranked = d.withColumn("_key", F.concat_ws("|", "ticker", F.col("day").cast("string")))
    return merge.first_per_reason(ranked, "_key", ["_late", "doc_id"], 5).select("ticker", "day", "doc_id", "n")
