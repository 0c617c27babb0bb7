"""Measures of outcomes and of evidence: metric blocks, calibration, bands and hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clean


def latest_outcomes(versions: DataFrame) -> DataFrame:
    """The last version of each scenario by known_utc, then version_no."""
    kept = [c for c in versions.columns if c not in ("scenario_id", "received_utc", "ticker")]
    best = F.max_by(F.struct(*kept), F.struct("known_utc", "version_no"))
    return versions.filter("scenario_id is not null").groupBy("scenario_id").agg(best.alias("s")).select("scenario_id", "s.*")


def metric_columns() -> list[Column]:
    """The measures of a set of scenarios with structurally_valid, triggered, t1_before_stop, primary_outcome and resolved_r.
    Rates over nothing are 0, means and ratios over nothing null. The break-even rate is the one at which a mean win pays for
    losses of one unit."""
    r = F.col("resolved_r").cast("double")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    is_ = lambda name: F.count_if(F.col("primary_outcome") == name)
    n, triggered, resolved, t1, stop = F.count(F.lit(1)), F.count_if("triggered"), F.count("resolved_r"), F.count_if("t1_before_stop"), is_("STOP_BEFORE_T1")
    rate = lambda a, b: F.coalesce(clean.half_even(F.try_divide(a.cast("double"), b), 4), F.lit(0.0))
    mean_win, mean_loss = F.avg(win), F.avg(loss)
    return [
        n.alias("scenarios"), F.count_if("structurally_valid").alias("accepted"), triggered.alias("triggered"), rate(triggered, n).alias("trigger_rate"), t1.alias("t1_first"), stop.alias("stop_first"),
        rate(t1, triggered).alias("t1_rate_if_triggered"), rate(t1, t1 + stop).alias("t1_rate_if_resolved"), rate(stop, t1 + stop).alias("stop_rate_if_resolved"),
        is_("NOT_TRIGGERED").alias("not_triggered"), is_("AMBIGUOUS_STOP_T1_SAME_BAR").alias("ambiguous"), is_("OPEN_AT_CLOSE").alias("open_at_close"),
        resolved.alias("resolved"), rate(resolved, triggered).alias("coverage_if_triggered"), rate(F.count(win), resolved).alias("win_rate"),
        clean.half_even(F.avg(r), 4).alias("mean_r"), clean.half_even(F.median(r), 4).alias("median_r"), clean.half_even(F.sum(r), 4).alias("total_r"),
        clean.half_even(F.try_divide(F.sum(win), -F.sum(loss)), 4).alias("profit_factor"), clean.half_even(mean_win, 4).alias("mean_win"), clean.half_even(-mean_loss, 4).alias("mean_loss"),
        clean.half_even(1 / (1 + mean_win), 4).alias("break_even_rate"), clean.half_even(F.try_divide(F.sum(r), triggered), 4).alias("expectancy_per_triggered"),
    ]


def metrics_by_code(outcomes: DataFrame, codes: Column) -> DataFrame:
    """metric_columns for each code of an array column; a scenario counts once for each distinct code of its own."""
    return outcomes.withColumn("code", F.explode(F.array_distinct(codes))).groupBy("code").agg(*metric_columns())


def metrics_by_combination(outcomes: DataFrame, codes: Column) -> DataFrame:
    """metric_columns for each combination of codes: the distinct ones sorted and joined with +, empty without any."""
    joined = F.array_join(F.array_sort(F.array_distinct(codes)), "+")
    return outcomes.withColumn("combination", joined).groupBy("combination").agg(*metric_columns())


def histogram(groups: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """How many groups have each value of each named count: counter, value, groups."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("counter"), c.cast("bigint").alias("value")) for k, c in counts.items())))
    return groups.select(each.alias("x")).select("x.*").groupBy("counter", "value").agg(F.count(F.lit(1)).alias("groups"))


def ordering_test(rows: DataFrame, least: int = 5) -> DataFrame:
    """For each window: rows, coverage (share with enough records and an expectancy), the correlation of expectancy and result,
    the mean results of the bands STRONG, NEUTRAL and NEGATIVE, their gaps, and whether they fall in this order; null unless
    all three have rows. The bands are those of `bands`, so the threshold comes from the training window alone."""
    b = bands(rows, least)
    of = lambda name: F.max(F.when(F.col("band") == name, F.col("mean_r")))
    means = b.groupBy("evidence_window").agg(of("STRONG").alias("strong"), of("NEUTRAL").alias("neutral"), of("NEGATIVE").alias("negative"))
    enough = (F.col("returned_records") >= least) & F.col("expectancy").isNotNull()
    x, y = F.when(enough, F.col("expectancy")), F.when(enough, F.col("actual_r"))
    x = F.when(y.isNotNull(), x)
    corr = F.when((F.count(x) >= 3) & (F.var_pop(x) > 1e-18) & (F.var_pop(F.when(x.isNotNull(), y)) > 1e-18), clean.half_even(F.corr(x, y), 4))
    n = F.count(F.lit(1))
    base = rows.groupBy("evidence_window").agg(n.alias("rows"), clean.half_even(F.count_if(enough) / n, 4).alias("coverage"), corr.alias("pearson"))
    out = base.join(means, base["evidence_window"].eqNullSafe(means["evidence_window"])).drop(means["evidence_window"])
    return out.withColumns({
        "strong_minus_neutral": clean.half_even(F.col("strong") - F.col("neutral"), 4), "neutral_minus_negative": clean.half_even(F.col("neutral") - F.col("negative"), 4),
        "ordered": F.when(F.col("strong").isNotNull() & F.col("neutral").isNotNull() & F.col("negative").isNotNull(), (F.col("strong") > F.col("neutral")) & (F.col("neutral") > F.col("negative"))),
    })


def metric_block(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """metric_columns over all scenarios and by each of the columns `by` apart: dimension, value and the measures. The columns
    are strings; null is a value of its own. One pass: grouping sets."""
    df = outcomes.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in by})
    out = df.groupingSets([[], *([f"_{c}"] for c in by)], *(f"_{c}" for c in by)).agg(F.grouping_id().alias("_g"), *metric_columns())
    n = len(by)
    name = F.lit("all")
    for i, c in enumerate(by):
        name = F.when(F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i)), c).otherwise(name)
    value = F.coalesce(*(f"_{c}" for c in by), F.lit("all"))
    return out.withColumns({"dimension": name, "value": value}).drop("_g", *(f"_{c}" for c in by))


def combinations(outcomes: DataFrame, group: str, code: str) -> DataFrame:
    """How many groups have each combination of distinct codes, sorted and joined with +: combination, groups, rows. Groups
    without a code have the empty combination. A group holds as many codes as there are different ones."""
    one = outcomes.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(code)), "+").alias("combination"), F.count(F.lit(1)).alias("n"))
    return one.groupBy("combination").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each evidence_id, with double figures: x (average distance), mean_r, expectancy, y (the actual result)."""
    d = lambda c, n: F.col(c).cast("double").alias(n)
    return evidence.filter("evidence_id is not null").dropDuplicates(["evidence_id"]).select(
        "evidence_id", "evidence_window", "session_date_et", "selection_tier", "scenario_rank", "query_record_id", "returned_records", "actual_win", "evidence_band",
        d("average_distance", "distance"), d("evidence_mean_r", "mean_r"), d("evidence_expectancy_per_triggered", "expectancy"), d("actual_resolved_r", "actual_r"),
    )


MEASURES = ["mean_r", "expectancy", "distance"]


def _bucket(evidence: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"), clean.half_even(F.min(evidence), 4).alias("evidence_min"), clean.half_even(F.max(evidence), 4).alias("evidence_max"), clean.half_even(F.avg(evidence), 4).alias("evidence_mean"),
        clean.half_even(F.avg("actual_r"), 4).alias("actual_mean_r"), clean.half_even(F.try_divide(F.count_if("actual_win").cast("double"), F.count(F.lit(1))), 4).alias("actual_win_rate"), clean.half_even(F.sum("actual_r"), 4).alias("actual_total_r"),
    ]


def _long(rows: DataFrame, least: int) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES)))
    return rows.filter(F.col("returned_records") >= least).select("*", each.alias("m")).select(*rows.columns, "m.*").filter("x is not null")


def calibration(rows: DataFrame, least: int = 5) -> DataFrame:
    """For each measure of the evidence with enough records: rows, coverage, means and the correlation with the actual
    result, which is null below three rows or without variance."""
    long = _long(rows, least).filter("actual_r is not null")
    every = rows.count()
    corr = F.when((F.count(F.lit(1)) >= 3) & (F.var_pop("x") > 1e-18) & (F.var_pop("actual_r") > 1e-18), clean.half_even(F.corr("x", "actual_r"), 4))
    out = long.groupBy("measure").agg(F.count(F.lit(1)).alias("rows"), clean.half_even(F.avg("x"), 4).alias("evidence_mean"), clean.half_even(F.avg("actual_r"), 4).alias("actual_mean_r"), corr.alias("pearson"))
    return out.select("measure", "rows", clean.half_even(F.try_divide(F.col("rows").cast("double"), F.lit(every)), 4).alias("coverage"), "evidence_mean", "actual_mean_r", "pearson")


def quintiles(rows: DataFrame, least: int = 5, parts: int = 5) -> DataFrame:
    """Buckets of equal size by each measure: bucket q holds the rows with q*n/parts <= place < (q+1)*n/parts, places in order
    of the measure, then id.

    The place of a row needs no global sort in one task: rows are counted by value range (approximate quantiles of a bounded
    number), ranges before a row's are added up, and only within a range rows are numbered."""
    long = _long(rows, least)
    cuts = {r["measure"]: r["q"] for r in long.groupBy("measure").agg(F.percentile_approx("x", [i / 256 for i in range(1, 256)], 10_000).alias("q")).collect()}
    at = F.lit(0)
    for m, q in cuts.items():
        edges = F.array(*(F.lit(v) for v in sorted(set(q))))
        at = F.when(F.col("measure") == m, F.size(F.filter(edges, lambda e: e < F.col("x")))).otherwise(at)
    long = long.withColumn("range", at)
    sums = long.groupBy("measure", "range").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("measure").orderBy("range")
    sums = sums.select("measure", "range", (F.sum("k").over(w) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("measure")).alias("n"))
    own = F.row_number().over(Window.partitionBy("measure", "range").orderBy("x", "evidence_id"))
    place = long.withColumn("own", own).join(F.broadcast(sums), ["measure", "range"]).withColumn("rn", F.col("before") + F.col("own"))
    q = F.ceil(F.lit(parts) * F.col("rn") / F.col("n"))
    return place.groupBy("measure", F.concat(F.lit("Q"), q.cast("string")).alias("bucket")).agg(*_bucket(F.col("x")))


def sample_buckets(rows: DataFrame) -> DataFrame:
    """Buckets by the number of returned records: 0-4, 5-9, 10-14, 15-19 and 20+; empty ones are left out."""
    n = F.col("returned_records")
    label = F.when(n < 5, "0-4").when(n < 10, "5-9").when(n < 15, "10-14").when(n < 20, "15-19").otherwise("20+")
    return rows.filter("returned_records >= 0").groupBy(label.alias("bucket")).agg(*_bucket(n.cast("double")))


def sign_buckets(rows: DataFrame, least: int = 5) -> DataFrame:
    """Buckets by the sign of each measure: negative, zero, positive."""
    sign = F.when(F.col("x") < 0, "negative").when(F.col("x") > 0, "positive").otherwise("zero")
    return _long(rows, least).groupBy("measure", sign.alias("bucket")).agg(*_bucket(F.col("x")))


def strong_threshold(rows: DataFrame, least: int = 5, quantile: float = 0.8) -> DataFrame:
    """The nearest-rank quantile (place ceil(q*n)) of the expectancy of the training rows with enough records, not below 0."""
    train = rows.filter((F.lower("evidence_window") == "training") & (F.col("returned_records") >= least) & F.col("expectancy").isNotNull())
    disc = F.expr(f"percentile_disc({quantile}) within group (order by expectancy)")
    return train.agg(F.count(F.lit(1)).alias("rows"), F.when(F.count(F.lit(1)) > 0, F.greatest(disc, F.lit(0.0))).alias("threshold"))


BANDS = ["STRONG", "NEUTRAL", "NEGATIVE", "INSUFFICIENT"]


def bands(rows: DataFrame, least: int = 5) -> DataFrame:
    """For each window and band, also those without rows: rows, mean result, win rate and total. A row without enough records
    or without an expectancy is INSUFFICIENT, below 0 NEGATIVE, from the training threshold on STRONG, else NEUTRAL."""
    t = F.lit(strong_threshold(rows, least).first()["threshold"]).cast("double")
    x = F.col("expectancy")
    band = F.when((F.col("returned_records") < least) | F.col("returned_records").isNull() | x.isNull(), "INSUFFICIENT").when(x < 0, "NEGATIVE").when(x >= t, "STRONG").otherwise("NEUTRAL")
    got = rows.withColumn("band", band)
    every = got.select("evidence_window").distinct().select("evidence_window", F.explode(F.array(*map(F.lit, BANDS))).alias("band"))
    out = got.groupBy("evidence_window", "band").agg(
        F.count(F.lit(1)).alias("n"), clean.half_even(F.avg("actual_r"), 4).alias("mean_r"), clean.half_even(F.try_divide(F.count_if("actual_win").cast("double"), F.count(F.lit(1))), 4).alias("win_rate"), clean.half_even(F.sum("actual_r"), 4).alias("total_r")
    )
    same = (every["evidence_window"].eqNullSafe(out["evidence_window"])) & (every["band"] == out["band"])
    return every.join(out, same, "left").select(every["evidence_window"], every["band"], F.coalesce("n", F.lit(0)).alias("rows"), "mean_r", "win_rate", "total_r")


def paired_choices(rows: DataFrame) -> DataFrame:
    """Of each query record with several evidence rows, the scenario chosen by rank and the one chosen by band (STRONG,
    NEUTRAL, NEGATIVE, other), then rank: both results and how they differ, in one aggregation."""
    order = F.when(F.col("evidence_band") == "STRONG", 0).when(F.col("evidence_band") == "NEUTRAL", 1).when(F.col("evidence_band") == "NEGATIVE", 2).otherwise(3)
    pick = F.struct("evidence_id", "actual_r")
    out = rows.groupBy("query_record_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.min_by(pick, F.struct("scenario_rank", "evidence_id")).alias("a"),
        F.min_by(pick, F.struct(order.alias("o"), "scenario_rank", "evidence_id")).alias("b"),
    ).filter("candidates > 1")
    return out.select(
        "query_record_id", "candidates", F.col("a.evidence_id").alias("by_rank"), F.col("b.evidence_id").alias("by_band"), (F.col("a.evidence_id") != F.col("b.evidence_id")).alias("changed"),
        F.round(F.col("b.actual_r") - F.col("a.actual_r"), 6).alias("delta_r"),
    )


def _tier() -> Column:
    return F.when(F.upper("selection_tier") == "PREFERRED", 0).when(F.upper("selection_tier") == "SECONDARY", 1).otherwise(2)


def _band_rank() -> Column:
    return F.when(F.col("evidence_band") == "STRONG", 0).when(F.col("evidence_band") == "NEUTRAL", 1).when(F.col("evidence_band") == "NEGATIVE", 2).otherwise(3)


def policy_choices(rows: DataFrame) -> DataFrame:
    """What three orders choose among the candidates of each window and query record: by rank (raw), by tier, then rank (tier),
    and by tier, band, then rank (aware); equal ones by id. One aggregation."""
    pick = F.struct("evidence_id", "actual_r", F.coalesce("evidence_band", F.lit("INSUFFICIENT")).alias("band"))
    by = {"raw": [], "tier": [_tier().alias("t")], "aware": [_tier().alias("t"), _band_rank().alias("b")]}
    return rows.groupBy("evidence_window", "query_record_id").agg(*(F.min_by(pick, F.struct(*o, "scenario_rank", "evidence_id")).alias(k) for k, o in by.items()))


def ranking_windows(rows: DataFrame) -> DataFrame:
    """For each window, how often the orders of policy_choices choose differently, their results where both are resolved, and
    how often each band is chosen (all four bands, with zeros)."""
    c = policy_choices(rows)
    raw, tier, aware = (F.col(f"{k}.actual_r") for k in ("raw", "tier", "aware"))
    changed = F.col("tier.evidence_id") != F.col("aware.evidence_id")
    both, both_raw = tier.isNotNull() & aware.isNotNull(), raw.isNotNull() & tier.isNotNull()
    mean = lambda x, on: clean.half_even(F.avg(F.when(on, x)), 4)
    total = lambda x, on: F.round(F.sum(F.when(on, x)), 6)
    known = F.when(F.col("aware.band").isin(BANDS), F.col("aware.band")).otherwise("INSUFFICIENT")
    count = lambda on: F.count_if(on)
    n = F.count(F.lit(1))
    return c.withColumn("_band", known).groupBy("evidence_window").agg(
        n.alias("cards"), count(F.col("raw.evidence_id") != F.col("tier.evidence_id")).alias("tier_changed"), count(changed).alias("evidence_changed"),
        clean.half_even(count(changed) / n, 4).alias("evidence_changed_rate"), count(both_raw).alias("raw_pairs"), mean(raw, both_raw).alias("raw_mean_r"), mean(tier, both_raw).alias("tier_mean_r_vs_raw"),
        count(both).alias("pairs"), mean(tier, both).alias("tier_mean_r"), mean(aware, both).alias("aware_mean_r"), total(aware - tier, both).alias("delta_total_r"),
        count(changed & both & (aware > tier)).alias("better"), count(changed & both & (aware < tier)).alias("worse"), count(changed & both & (aware == tier)).alias("equal"),
        *(count(F.col("_band") == b).alias(b.lower()) for b in BANDS),
    )


def arm_summary(rows: DataFrame) -> DataFrame:
    """The results of each order of policy_choices as an arm: states, resolved, wins, losses, mean, median and total."""
    arms = F.explode(F.array(*(F.struct(F.lit(k).alias("arm"), F.col(f"{k}.actual_r").alias("r")) for k in ("raw", "tier", "aware"))))
    x = policy_choices(rows).select(arms.alias("a")).select("a.*")
    return x.groupBy("arm").agg(
        F.count(F.lit(1)).alias("states"), F.count("r").alias("resolved"), F.count_if(F.col("r") > 0).alias("wins"), F.count_if(F.col("r") < 0).alias("losses"),
        clean.half_even(F.avg("r"), 4).alias("mean_r"), clean.half_even(F.median("r"), 4).alias("median_r"), clean.half_even(F.sum("r"), 4).alias("total_r"),
    )


def tier_orders(scenarios: DataFrame) -> DataFrame:
    """For each record the ranks of its scenarios in their own order and by tier, then rank, whether the orders differ, and the
    scenario chosen: the lowest preferred rank, else the lowest. A record has a few scenarios."""
    own = F.array_sort(F.collect_list(F.struct("ordinal", "scenario_rank")))
    tiers = F.array_sort(F.collect_list(F.struct(_tier().alias("t"), "scenario_rank", "ordinal")))
    rank = lambda a: F.transform(a, lambda x: x["scenario_rank"])
    out = scenarios.groupBy("record_id").agg(rank(own).alias("own_order"), rank(tiers).alias("tier_order"), F.min_by("scenario_id", F.struct(
        F.when(F.upper("selection_tier") == "PREFERRED", 0).otherwise(1).alias("p"), "scenario_rank", "scenario_id"
    )).alias("chosen"))
    return out.withColumn("changed", F.col("own_order") != F.col("tier_order"))
