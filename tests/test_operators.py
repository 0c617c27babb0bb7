"""Hand-checked cases and properties of the operators over bars, profiles, paths, samples and texts."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import analogues, bars, evidence, merge, outcomes, profile, sampling, tape

T0 = datetime(2026, 2, 17, 15, 0)
BAR = "ticker string, session_date date, ts timestamp, o double, h double, l double, c double, v bigint"
DAY = date(2026, 2, 17)


def bar_df(spark, rows):
    return spark.createDataFrame([("A", DAY, T0 + timedelta(minutes=i), *r) for i, r in enumerate(rows)], BAR)


def test_session_features_by_hand(spark):
    f = bars.session_features(bar_df(spark, [(10.0, 11.0, 9.0, 10.5, 100), (10.5, 10.6, 9.9, 10.0, 300), (10.0, 10.8, 10.0, 10.7, 50)])).orderBy("ts").collect()
    want = [(10.166667, 0.333333, None, 0.25, 100, 1.0), (10.166667, -0.166667, -0.5, 0.714286, 200, 1.5), (10.203704, 0.496296, 0.7, 0.875, 150, 0.25)]
    for r, (vwap, dist, dc, ratio, avg5, rel) in zip(f, want):
        assert (round(r.vwap, 6), round(r.dist_to_vwap, 6), round(r.body_ratio, 6), r.avg_volume_5, round(r.rel_volume, 6)) == (vwap, dist, ratio, avg5, rel)
        assert (r.delta_close is None) == (dc is None)
    assert [r.vwap_cross_up for r in f] == [False, False, True] and [r.vwap_cross_down for r in f] == [False, True, False]


def test_later_bars_never_change_earlier_features(spark):
    r = random.Random(1)
    rows = [(10 + r.random(), 12 + r.random(), 9 - r.random(), 10 + r.random(), r.randrange(1, 500)) for _ in range(30)]
    short = {x.ts: x for x in bars.session_features(bar_df(spark, rows[:20])).collect()}
    for x in bars.session_features(bar_df(spark, rows)).collect():
        if x.ts in short:
            assert x == short[x.ts]


def test_nulls_and_empty_bars(spark):
    rows = [(None, None, None, None, None), (1.0, 2.0, 0.5, 1.5, 10), (1.0, 1.0, 1.0, 1.0, 0)]
    f = bars.session_features(bar_df(spark, rows)).orderBy("ts").collect()
    assert f[0].vwap is None and not f[0].above_vwap and f[1].vwap == pytest.approx(4 / 3) and f[2].body_ratio == 0
    none = spark.createDataFrame([], BAR)
    g = bars.session_features(none)
    for df in (g, bars.resample(g, 5), bars.session_state(g), bars.structure(none), bars.bar_events(g), bars.documents(g), profile.profiles(profile.profile_bins(none, ["ticker"]), ["ticker"]), tape.sweeps(none)):
        assert df.count() == 0


def test_volume_profile_by_hand(spark):
    b = bar_df(spark, [(10.05, 10.10, 10.00, 10.05, 1000)])
    bins = {r.bin: r.volume for r in profile.profile_bins(b, ["ticker"]).collect()}
    assert bins == {200: 133, 201: 733, 202: 133}
    p = profile.profiles(profile.profile_bins(b, ["ticker"]), ["ticker"]).first()
    assert (p.bin_size, p.poc, p.val, p.vah, p.hvn, p.lvn) == (0.05, 10.05, 10.05, 10.05, [10.05], [])


def test_value_area_against_a_loop(spark):
    r = random.Random(2)
    rows = [(f"k{k}", 5, b, r.randrange(1, 30)) for k in range(40) for b in sorted(r.sample(range(60), r.randrange(1, 25)))]
    df = spark.createDataFrame(rows, "ticker string, cents int, bin bigint, volume bigint")
    for p in profile.profiles(df, ["ticker"]).collect():
        own = [(b, v) for k, _, b, v in rows if k == p.ticker]
        v = [x for _, x in own]
        lo = hi = v.index(max(v))
        acc, target = float(v[lo]), sum(v) * 0.7
        while acc < target and (lo > 0 or hi < len(v) - 1):
            a, b = v[lo - 1] if lo else 0, v[hi + 1] if hi < len(v) - 1 else 0
            if a >= b and lo:
                lo, acc = lo - 1, acc + a
            elif hi < len(v) - 1:
                hi, acc = hi + 1, acc + b
            else:
                break
        assert (p.val, p.vah) == (round(own[lo][0] * 0.05, 2), round(own[hi][0] * 0.05, 2))


PATH = "id string, ticker string, session_date date, start timestamp, side string, entry double, stop double, t1 double, t2 double"


@pytest.mark.parametrize(
    "course,want",
    [
        ([(103, 100), (104.5, 101), (108.2, 103), (110, 107)], ("T2", 3.0, -0.333)),
        ([(104, 98)], ("AMBIGUOUS", 1.0, -1.0)),
        ([(102, 97.5)], ("STOP", 0.333, -1.167)),
        ([(103, 100)], ("OPEN", 0.667, -0.333)),
        ([(104, 100), (103, 98)], ("T1", 1.0, -1.0)),
        ([], ("NO_BARS", None, None)),
    ],
)
def test_first_touches_by_hand(spark, course, want):
    paths = spark.createDataFrame([("x", "A", DAY, T0, "long", 101.0, 98.0, 104.0, 108.0), ("bad", "A", DAY, T0, "long", 101.0, 102.0, 104.0, None)], PATH)
    b = spark.createDataFrame([("A", DAY, T0 + timedelta(minutes=i + 1), float(h), float(low)) for i, (h, low) in enumerate(course)], "ticker string, session_date date, ts timestamp, h double, l double")
    got = {r.id: r for r in outcomes.first_touches(paths, b).collect()}
    assert (got["x"].outcome, got["x"].mfe, got["x"].mae) == want and got["bad"].outcome == "INVALID"


def test_latest_known_over_many_partitions(spark):
    r = random.Random(3)
    name = lambda: "HOT" if r.random() < 0.7 else r.choice("AB")
    records = [(name(), r.randrange(300), r.randrange(2), float(r.randrange(9))) for _ in range(120)]
    asks = [(name(), r.randrange(300), i) for i in range(80)]
    got = tape.latest_known(
        spark.createDataFrame(asks + [(None, 1, 99)], "entity string, time bigint, id bigint"),
        spark.createDataFrame(records + [("A", 1, None, 1.0), ("A", 1, 0, None)], "entity string, time bigint, kind int, value double"), 2, 200, per=11,
    ).collect()
    assert len(got) == 80
    for x in got:
        e, t, _ = asks[x.id]
        for k in (0, 1):
            want = max(((u, v) for f, u, kk, v in records if f == e and kk == k and u <= t), default=(None, None))
            assert (x[f"t{k}"], x[f"v{k}"]) == want


def test_reference_prices(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    q = spark.createDataFrame([("A", at(0), 1.0, 2.0), ("A", at(100), 3.0, None)], "ticker string, ts timestamp, bid double, ask double")
    t = spark.createDataFrame([("A", at(40), 9.0)], "ticker string, ts timestamp, price double")
    b = spark.createDataFrame([("A", at(0), 7.0)], "ticker string, ts timestamp, c double")
    asks = spark.createDataFrame([(1, "A", at(30)), (2, "A", at(31)), (3, "A", at(100)), (4, "A", at(101)), (5, "B", at(0))], "id bigint, ticker string, ts timestamp")
    got = {r.id: (r.price, r.kind) for r in tape.reference_prices(asks, t, q, b, 9).collect()}
    assert got == {1: (1.5, "quote"), 2: (7.0, "bar"), 3: (9.0, "tick"), 4: (7.0, "bar"), 5: (None, None)}


RECORD = "record_id bigint, ticker string, session_date_et date, regime string, features map<string,decimal(18,6)>"


def test_analogues_do_not_depend_on_the_blocks(spark, monkeypatch):
    """A ticker with most of the records is spread over blocks by day; the caps hold over all of them."""
    import random
    from datetime import date, timedelta
    from decimal import Decimal

    r = random.Random(7)
    keys = ["day_change_pct", "session_change_pct", "distance_to_vwap_pct", "rvol_vs_adv", "minutes_since_open", "return_last_5_bars_pct"]
    stats = spark.createDataFrame([(k, Decimal(1)) for k in keys], "feature_key string, std_dev decimal(18,6)")
    rows = [(i, r.choice("ABC") if i % 3 else "HOT", date(2026, 3, 1) + timedelta(days=r.randrange(9)), r.choice("xy"), {k: Decimal(r.randrange(300)) / 100 for k in keys}) for i in range(240)]
    df = spark.createDataFrame(rows, "record_id bigint, ticker string, session_date_et date, regime string, features map<string,decimal(18,6)>")
    q = df.filter("record_id < 40").withColumnRenamed("record_id", "query")
    one = sorted(map(tuple, analogues.analogues(df, q, stats, 12).collect()))
    monkeypatch.setattr(analogues, "BLOCK", 9)
    assert sorted(map(tuple, analogues.analogues(df, q, stats, 12).collect())) == one and len(one) > 200


def test_analogues_keep_to_the_caps(spark):
    one = lambda i, t, d, x: (i, t, date(2026, 1, d), "r", {k: Decimal(x) for k in "abcde"})
    data = [one(1, "A", 1, 1), one(2, "A", 1, 2), one(3, "A", 1, 3), one(4, "B", 1, 4), one(5, "A", 2, 5), one(6, "A", 3, 6), one(7, "A", 4, 7), one(8, "C", 9, 0), (9, "D", date(2026, 1, 1), "r", {"a": Decimal(0)})]
    df = spark.createDataFrame(data, RECORD)
    stats = spark.createDataFrame([(k, 1.0) for k in "abcde"], "feature_key string, std_dev double")
    q = spark.createDataFrame([(100, *one(100, "Z", 9, 0)[1:])], "query bigint, " + RECORD.split(", ", 1)[1])
    got = [r.record_id for r in analogues.analogues(df, q, stats).orderBy("rank").collect()]
    # the third of A on its first day and the fifth of A are left out; 8 is of the same day, 9 shares too little
    assert got == [1, 2, 4, 5, 6]
    assert analogues.analogues(df.limit(0), q, stats).count() == 0


def test_with_fallback(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 0, 2), (1, 9, 3), (1, 9, 4)], "k bigint, rank int, ordinal int")
    look = spark.createDataFrame([(1, 0, 2, "by place"), (1, 1, 1, "first"), (1, 1, 3, "again")], "k bigint, rank int, ordinal int, tier string")
    got = {r.ordinal: r.tier for r in analogues.with_fallback(rows, look, "k", "rank", "ordinal", "tier").collect()}
    assert got == {1: "again", 2: "by place", 3: "again", 4: None}


def test_quintile_sizes_and_partition_independence(spark):
    rows = spark.createDataFrame([(i, 9, float(i % 3), 1.0, True) for i in range(7)], "evidence_id bigint, returned_records int, mean_r double, actual_r double, actual_win boolean")
    rows = rows.withColumns({"expectancy": F.lit(None).cast("double"), "distance": F.lit(None).cast("double")})
    for n in (1, 5):
        got = {r.bucket: r.rows for r in evidence.quintiles(rows.repartition(n)).collect()}
        assert got == {"Q1": 1, "Q2": 1, "Q3": 2, "Q4": 1, "Q5": 2}


def test_merges(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "y"), (None, 3, "z", "z")], "k string, at int, p string, q string")
    assert [tuple(r) for r in merge.patch(rows, ["k"], ["at"], ["p", "q"]).collect()] == [("a", "x", "y")]
    assert [tuple(r) for r in merge.patch(rows, ["k"], ["at"], ["p", "q"], drop_nulls=False).collect()] == [("a", None, "y")]
    assert [tuple(r) for r in merge.upsert(rows, ["k"], ["at"]).collect()] == [("a", 2, None, "y")]
    assert merge.without(rows, rows.filter("k = 'a'"), ["k"]).count() == 1


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("s"))
    a = sorted(map(tuple, sampling.stratified(rows, "id", "s", 50, 9).collect()))
    b = sorted(map(tuple, sampling.stratified(rows.repartition(11), "id", "s", 50, 9).collect()))
    assert a == b and len(a) == 50
    r = sampling.round_robin(rows, "id", "s", 10, 9).orderBy("place").collect()
    assert [x.s for x in r] == [f"s{i}" for i in range(7)] + ["s0", "s1", "s2"]
    assert sampling.stratified(rows.limit(0), "id", "s", 50, 9).count() == 0


def test_stable_hash_against_a_loop(spark):
    texts = ["", "a", "ABC|2026", "é😀x", None]

    def slow(t, seed):
        h = sampling.BASIS ^ seed
        for i in range(0, len(b := t.encode("utf-16-le")), 2):
            h = ((h ^ int.from_bytes(b[i : i + 2], "little")) * sampling.PRIME) % 2**64
        return h & (2**63 - 1)

    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r.h for r in df.select(sampling.stable_hash(F.col("t"), 42).alias("h")).collect()]
    assert got == [None if t is None else slow(t, 42) for t in texts]


def test_texts(spark):
    d = spark.createDataFrame([("  a \n b  " + "c" * 9, 'Sure: ```json\n{"a": "}{", "b": [1]} ``` {"c": 1}', "long: entry 129.99, stop 132, T1 1.5 ticker=ABC ms=3")], "t string, j string, l string")
    r = d.select(text.clip(F.col("t"), 6).alias("c"), text.first_json("j").alias("j"), text.level(F.col("l"), "stop").alias("s"), text.level(F.col("l"), "t2").alias("n"), text.field(F.col("l"), "ticker").alias("f"), text.safe_name(F.lit("a/b é")).alias("safe")).first()
    assert (r.c, r.j, r.s, r.n, r.f, r.safe) == ("a b cc…", '{"a": "}{", "b": [1]}', 132.0, None, "ABC", "a_b__")
