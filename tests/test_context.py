"""What was known at an instant, links, balanced samples, measures by code, and functions over texts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import context, evidence, sampling

T0 = datetime(2026, 3, 6, 15)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


ASK, NEWS = "ask bigint, ticker string, at timestamp", "news bigint, tickers array<string>, published timestamp"


def test_news_never_come_from_later(spark):
    r = random.Random(2)
    asks = [(i, r.choice([" hot", "HOT", "b", None]), at(r.randrange(-4000, 4000))) for i in range(60)] + [(None, "B", T0), (99, "B", None)]
    news = [(i, r.choice([["Hot "], ["b", "HOT"], [], None, [None]]), at(r.randrange(-6000, 6000))) for i in range(300)] + [(None, [], T0), (500, [], None), (501, ["B"], at(0)), (502, ["B"], at(0))]
    asks.append((100, "B", at(0)))
    def run(n):
        return {(x.ask, x.n): x.news for x in context.news_as_of(spark.createDataFrame(asks, ASK), spark.createDataFrame(n, NEWS), 1, 3).collect()}
    got, want = run(news), {}
    for i, t, when in asks:
        if i is None or when is None:
            continue
        own = (t or "").strip().upper()
        ok = [(-(p - T0).total_seconds(), n) for n, ts, p in news if n is not None and p is not None and when - timedelta(days=1) <= p <= when and (not [x for x in ts or [] if x] or own in [x.strip().upper() for x in ts if x])]
        want |= {(i, k + 1): n for k, (_, n) in enumerate(sorted(ok)[:3])}
    assert got == want and len(want) > 100
    # news that come later change no row of an earlier ask
    cut = at(0)
    later = run(news + [(1000 + i, [], cut + timedelta(seconds=i + 1)) for i in range(50)])
    early = {a for a, _, w in asks if a is not None and w is not None and w <= cut}
    assert {k: v for k, v in later.items() if k[0] in early} == {k: v for k, v in got.items() if k[0] in early}
    assert not context.news_as_of(spark.createDataFrame([], ASK), spark.createDataFrame(news, NEWS)).collect()


def test_matching_labels_and_first_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (3, "b")], "id int, k string")
    wanted = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, id int")
    assert sorted((x.id, x.k) for x in context.matching(rows, wanted, "k").collect()) == [(1, "a"), (2, None)]
    labels = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, o int, tier string")
    got = context.with_last(rows, labels, ["k"], ["o"], "tier", "UNKNOWN").collect()
    assert sorted((x.id, x.tier) for x in got) == [(1, "y"), (2, "UNKNOWN"), (3, "UNKNOWN"), (3, "UNKNOWN")]


def test_cooling_and_peaks(spark):
    rows = spark.createDataFrame([(1, "a", at(0), 3), (2, "a", at(9), None), (3, "a", at(19), 1), (4, "b", at(3), None)], "id int, t string, at timestamp, v int")
    got = {x.id: (x.since, x.cooled) for x in context.cooled(rows, "t", ["at", "id"]).collect()}
    assert got == {1: (None, True), 2: (9, False), 3: (10, True), 4: (None, True)}
    assert {x.id: x.peak for x in context.peaks(rows, ["t"], ["at"], "v").collect()} == {1: 3, 2: 3, 3: 3, 4: None}


def test_running_vwap_takes_bars_for_their_ticks(spark):
    b = spark.createDataFrame([("a", T0.date(), at(0), 3.0, 3.0, 3.0, 10), ("a", T0.date(), at(2), None, 1.0, 1.0, 5)], "ticker string, session_date date, ts timestamp, h double, l double, c double, v bigint")
    t = [(1, at(0) + timedelta(seconds=10), 1.0, 2), (2, at(1) + timedelta(seconds=5), 6.0, 5), (3, at(2) + timedelta(seconds=1), 9.0, 5), (4, at(9), None, 1)]
    t = spark.createDataFrame([("a", T0.date(), w, i, p, s) for i, w, p, s in t], "ticker string, session_date date, ts timestamp, tick_id bigint, price double, size bigint")
    got = {x.tick_id: round(x.vwap, 9) for x in context.running_vwap(b, t).collect()}
    assert got == {1: 1.0, 2: 4.0, 3: 5.25}  # alone; the bar (30 of 10) and 30 of 5; and 45 of 5


def test_balanced_sample_spills_over_and_limits_tickers(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ABCDEFGH") if i % 3 else "HOT", r.choice("xyz"), i % 10 == 0 if i % 50 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, ticker string, s string, win boolean")
    out = sampling.balanced(df, "id", "s", "ticker", F.col("win"), 40, 7).collect()
    assert len(out) == 40 and sum(x.side for x in out) == 20 and len({x.id for x in out}) == 40
    assert sum(x.ticker == "HOT" for x in out if not x.side) <= 5
    again = sampling.balanced(df.repartition(7).orderBy(F.rand()), "id", "s", "ticker", F.col("win"), 40, 7).collect()
    assert {x.id for x in again} == {x.id for x in out}
    more = sampling.balanced(df, "id", "s", "ticker", F.col("win"), 100, 7).collect()  # only 32 wins
    assert sum(x.side for x in more) == sum(bool(x[3]) for x in rows) and len(more) == 100
    one = df.filter("ticker = 'HOT'")
    assert sampling.balanced(one, "id", "s", "ticker", F.col("win"), 30, 7).count() == 30  # beyond the limit, if there are no others
    assert sampling.balanced(df.limit(0), "id", "s", "ticker", F.col("win"), 40, 7).count() == 0


def test_metrics_by_code_and_break_even(spark):
    line = "scenario_id int, structurally_valid boolean, triggered boolean, t1_before_stop boolean, primary_outcome string, resolved_r double, codes array<string>"
    rows = [(1, True, True, True, "T1_BEFORE_STOP", 2.0, ["b", "a", "a"]), (2, None, True, None, "STOP_BEFORE_T1", -1.0, ["a"]), (3, False, False, False, "NOT_TRIGGERED", None, []), (4, False, None, None, None, None, None)]
    df = spark.createDataFrame(rows, line)
    got = {x.code: x for x in evidence.metrics_by_code(df, F.col("codes")).collect()}
    assert {k: v.scenarios for k, v in got.items()} == {"a": 2, "b": 1} and got["a"].t1_rate_if_resolved == 0.5 and got["a"].break_even_rate == 0.3333
    assert {x.combination: x.scenarios for x in evidence.metrics_by_combination(df, F.coalesce("codes", F.array())).collect()} == {"a+b": 1, "a": 1, "": 2}


def test_first_json_minds_strings_and_depth(spark):
    texts = [None, "", 'so: ```json\n{"a": "}{", "b": [1, 2]}\n``` done', "{not json} then [1, {\"x\": null}] and {}", "{" * 50_000, "[" * 50_000 + "]" * 50_000, 'he said "{" and {"k": 1}', "] } {\"z\":2}"]
    got = [x.j for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.first_json("t").alias("j")).orderBy("i").collect()]
    assert got[:4] == [None, None, '{"a": "}{", "b": [1, 2]}', '[1, {"x": null}]'] and got[4:6] == [None, None] and got[7] == '{"z":2}'


def test_card_scenarios_and_fields(spark):
    card = "ABC long fade_pop: entry 10.1-10.3, stop 9.8, T1 10.9, T2 11.4, runner 12, probability 55%. ABC short break_hold: entry 9, stop 9.5, T1 8; ABC long x: entry 1 ABC short y: entry 2"
    row = spark.createDataFrame([(card, '{"Top_R": "1.5", "ok": true}', "2026-03-06")], "t string, d string, e string").select(
        text.card_scenarios(F.col("t")).alias("s"), text.number_of(F.col("d"), "topR", "Top_R").alias("n"), text.true_of(F.col("d"), "ok").alias("ok"), text.number_of(F.col("d"), "ok").alias("bad"),
        text.eastern(F.col("e")).alias("b"), text.eastern(F.col("e"), True).alias("l"), text.difference_pct(F.lit(1.0), F.lit(3.0)).alias("p"), text.card_scenarios(F.lit("none")).alias("none"),
    ).first()
    assert [tuple(x) for x in row.s] == [("long", "fade_pop", 10.1, 10.3, 9.8, 10.9, 11.4, 12.0, 0.55), ("short", "break_hold", 9.0, 9.0, 9.5, 8.0, None, None, None), ("long", "x", 1.0, 1.0, None, None, None, None, None)]
    assert (row.n, row.ok, row.bad, row.p, row.none) == (1.5, True, None, 100.0, [])
    assert (row.b, row.l) == (datetime(2026, 3, 6, 5), datetime(2026, 3, 7, 4, 59, 59))
