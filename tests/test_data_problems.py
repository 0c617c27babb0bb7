"""The operators of the general data problems against brute force, over many small partitions, and their edge cases."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import asknown, grid, nearest, rolling, spikes
from tickloom import ordered
from tickloom.plans import data

LINE = "entity string, time bigint, id bigint"


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_against_brute_force(spark, hand_over, seed):
    r = random.Random(seed)
    # one entity holds most rows, times repeat, some rows come twice
    name = lambda: "HOT" if r.random() < 0.6 else r.choice(["A", "B", "C"])
    left = [(name(), r.randrange(400), i) for i in range(300)]
    right = [(name(), r.randrange(400), i) for i in range(120)]
    left, right = left + left[:20], right + right[:20]
    nulls = [(None, 1, 900), ("A", None, 901), ("A", 1, None)]
    got = nearest.nearest_in_time(spark.createDataFrame(left + nulls, LINE), spark.createDataFrame(right + nulls, LINE), 460, 3, per=25).collect()
    want = {}
    for e, t, i in set(left):
        best = min(((abs(t - u), j) for f, u, j in set(right) if f == e and abs(t - u) <= 3), default=None)
        if best:
            want[i] = (best[1], best[0])
    assert len(got) == len(want) and {x.left_id: (x.right_id, x.gap_us) for x in got} == want


def test_nearest_empty_sides_and_clashing_columns(spark):
    some = spark.createDataFrame([("A", 1, 1)], LINE).withColumns({"gap_us": F.lit(1), "_pid": F.lit(2), "kind": F.lit(3)})
    none = spark.createDataFrame([], LINE)
    assert nearest.nearest_in_time(some, none, 1, 5).count() == 0
    assert nearest.nearest_in_time(none, some, 1, 5).count() == 0
    assert [tuple(x) for x in nearest.nearest_in_time(some, some, 2, 5).collect()] == [(1, 1, 0)]


@pytest.mark.parametrize("group", [1000, 3])
def test_prefix_and_neighbours_of_partitions(spark, monkeypatch, group):
    monkeypatch.setattr(ordered, "GROUP", group)
    r = random.Random(group)
    edges = [(p, r.choice([None, r.randrange(99)]), r.choice([None, r.randrange(99)])) for p in range(20) if p % 7]  # some partitions are empty
    got = {x._pid: (x.a, x.b) for x in ordered.prefix(spark.createDataFrame(edges, "_pid int, a int, b int"), 20, ["a"], ["b"]).collect()}
    for p, _, _ in edges:
        assert got[p] == (max((a for q, a, _ in edges if q < p and a is not None), default=None), min((b for q, _, b in edges if q > p and b is not None), default=None))
    rows = {p: [(p, i) for i in range(r.choice([1, 2, 9]))] for p, _, _ in edges}
    line = [(p, x[:4], x[-4:]) for p, x in rows.items()]
    kind = "array<struct<p:int,i:int>>"
    near = ordered.neighbours(spark.createDataFrame(line, f"_pid int, head {kind}, tail {kind}"), 20, 4).collect()
    assert {x._pid for x in near} == set(rows)
    for x in near:
        assert [tuple(y) for y in x.before or []] == [y for p in sorted(rows) if p < x._pid for y in rows[p]][-4:]
        assert [tuple(y) for y in x.after or []] == [y for p in sorted(rows) if p > x._pid for y in rows[p]][:4]
    none = spark.createDataFrame([], f"_pid int, a int, head {kind}, tail {kind}")
    assert ordered.prefix(none, 20, ["a"]).count() == ordered.neighbours(none, 20, 4).count() == 0


@pytest.fixture(params=["sent", "shuffled"])
def hand_over(request, monkeypatch):
    """Both ways in which partitions get the records of their neighbours."""
    if request.param == "shuffled":
        monkeypatch.setattr(ordered, "CARRIES", 0)
        monkeypatch.setattr(ordered, "GROUP", 3)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_as_known_against_brute_force(spark, hand_over, seed):
    r = random.Random(seed)
    ent = lambda: 7 if r.random() < 0.5 else r.randrange(5)
    # facts may become known long after they are valid, and before
    facts = [(ent(), r.randrange(100), r.randrange(100), v, r.random() < 0.9) for v in range(150)]
    events = [(ent(), r.randrange(110), i) for i in range(200)]
    f = spark.createDataFrame([(e, v, k, n, (float(n) if x else None,)) for e, v, k, n, x in facts + facts[:10]], "entity bigint, valid bigint, known bigint, version bigint, payload struct<x:double>")
    e = spark.createDataFrame(events + events[:10] + [(None, 1, 999), (1, None, 998)], "entity bigint, time bigint, event bigint")
    got = asknown.as_known(e, f, 350, "struct<x:double>", per=20).collect()
    want = {}
    for ent_, t, i in events:
        best = max(((v, k, n, x) for a, v, k, n, x in facts if a == ent_ and v <= t and k <= t), default=None)
        want[i] = None if best is None else (float(best[2]) if best[3] else None,)
    assert len(got) == len(events)
    for x in got:
        assert (None if x.fact is None else tuple(x.fact)) == want[x.event]


def test_as_known_empty(spark):
    f = spark.createDataFrame([], "entity bigint, valid bigint, known bigint, version bigint, payload struct<x:double>")
    e = spark.createDataFrame([(1, 1, 1)], "entity bigint, time bigint, event bigint")
    assert [x.fact for x in asknown.as_known(e, f, 1, "struct<x:double>").collect()] == [None]
    assert asknown.as_known(e.limit(0), f, 1, "struct<x:double>").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 100])
def test_persistent_tree(n):
    r = np.random.default_rng(n)
    ranks = r.permutation(n)
    t = asknown.PersistentTree(ranks)
    states, bound = r.integers(0, n + 1, 300), r.integers(-1, n, 300)
    got = t.floor(states, bound)
    for s, b, g in zip(states, bound, got):
        ok = [x for x in ranks[:s] if x <= b]
        assert (ranks[g] if g >= 0 else -1) == (max(ok) if ok else -1)


TICK = "tick_id bigint, ticker string, price decimal(18,6), size int, time_utc timestamp, received_utc timestamp"
T0 = datetime(2026, 2, 17, 15, 0)


def tick_series(r, ticker, n, first_id, step=0.01, start=50.0):
    """A random walk with planted spikes, jumps and stuck runs."""
    p, out = start, []
    for i in range(n):
        p = round(p + r.choice([-2, -1, -1, 0, 1, 1, 2]) * step, 4)
        if r.random() < 0.01:
            p = round(p + r.choice([-1, 1]) * 60 * step, 4)  # a jump that stays
        out.append(p)
    i = 20
    while i < n - 30:
        kind = r.random()
        if kind < 0.4:
            for j in range(r.choice([1, 2, 3])):
                out[i + j] = round(out[i + j] + r.choice([-1, 1]) * r.choice([9, 10, 11, 30, 100]) * step, 4)
        elif kind < 0.5:
            k = r.choice([11, 12, 13, 20])
            out[i : i + k] = [out[i]] * len(out[i : i + k])
        elif kind < 0.55:
            out[i] = r.choice([0.0, -1.0])
        i += r.randrange(15, 45)
    return [(first_id + j, ticker, Decimal(str(x)), 1, T0 + timedelta(seconds=j // 2), T0) for j, x in enumerate(out)]


def tick_truth(rows):
    groups = defaultdict(list)
    for r in set(rows):
        groups[r[1].strip().upper()].append(r)
    out = set()
    for g in groups.values():
        g.sort(key=lambda r: (r[4], r[0]))
        p = [int(r[2] * 1_000_000) for r in g]
        moves = [abs(a - b) for a, b in zip(p, p[1:]) if a != b]
        u = median(moves) if moves else None
        for i, x in enumerate(p):
            if x <= 0:
                out.add(g[i][0])
        for k in (1, 2, 3):
            for i in range(1, len(p) - k):
                a, b, mid = p[i - 1], p[i + k], p[i : i + k]
                if u and (min(mid) - max(a, b) >= 10 * u or min(a, b) - max(mid) >= 10 * u):
                    out.update(r[0] for r in g[i : i + k])
        i = 0
        while i < len(p):
            j = i
            while j < len(p) and p[j] == p[i]:
                j += 1
            if j - i >= 12:
                out.update(r[0] for r in g[i:j])
            i = j
    return out


@pytest.mark.parametrize("seed,per", [(1, 60), (2, 23), (3, 100_000)])
def test_tick_flags_against_brute_force(spark, seed, per, hand_over):
    r = random.Random(seed)
    rows = tick_series(r, "HOT", 700, 1000) + tick_series(r, "quiet ", 200, 5000, 0.0001, 3.0) + tick_series(r, "LIVE", 200, 7000, 2.0, 900.0) + tick_series(r, "TINY", 2, 9000)
    r.shuffle(rows)
    again = rows[:30]
    odd = [(1, None, Decimal(1), 1, T0, T0), (2, "HOT", None, 1, T0, T0), (3, "HOT", Decimal(1), 1, None, T0), (None, "HOT", Decimal(1), 1, T0, T0)]
    got = spikes.tick_flags(spark.createDataFrame(rows + again + odd, TICK), per=per).collect()
    assert {x.tick_id for x in got} == tick_truth(rows) and len(got) == len({x.tick_id for x in got})


DAILY = "bar_id bigint, ticker string, bar_date date, o decimal(18,6), h decimal(18,6), l decimal(18,6), c decimal(18,6), v bigint, vw decimal(18,6), received_utc timestamp"


@pytest.mark.parametrize("per", [15, 100_000])
def test_bar_flags_against_brute_force(spark, per, hand_over):
    r, rows, n = random.Random(7), [], 0
    for t in ("AA", "BB"):
        p = 20.0
        for d in range(80):
            o, c = round(p, 2), round(p + r.uniform(-0.3, 0.3), 2)
            h, low = round(max(o, c) + abs(r.gauss(0, 0.05)) + 0.01, 2), round(min(o, c) - abs(r.gauss(0, 0.05)) - 0.01, 2)
            x = r.random()
            h = round(h + 3, 2) if x < 0.05 else None if x < 0.08 else h
            low = -1.0 if 0.1 < x < 0.12 else round(low - 2, 2) if 0.12 < x < 0.16 else low
            if 0.2 < x < 0.23:
                h = low
            rows.append([n, t, date(2026, 1, 1) + timedelta(days=d), o, h, low, c])
            p, n = c, n + 1
    for i in range(100, 104):
        rows[i][4:6] = [25.0, 15.0]
    for i in range(110, 113):
        rows[i][4:6] = [25.5, 14.0]
    dec = lambda x: None if x is None else Decimal(str(x))
    data = [(a, b, d, dec(o), dec(h), dec(low), dec(c), 1, None, T0) for a, b, d, o, h, low, c in rows]
    got = {x.bar_id for x in spikes.bar_flags(spark.createDataFrame(data + data[:9], DAILY), per=per).collect()}
    want = set()
    for t in ("AA", "BB"):
        g = [x for x in rows if x[1] == t]
        up = [None if x[4] is None else (x[4] - max(x[3], x[6])) / max(x[3], x[6]) for x in g]
        dn = [None if x[5] is None else (min(x[3], x[6]) - x[5]) / min(x[3], x[6]) for x in g]
        u = median(x for x in up + dn if x is not None)
        for i, x in enumerate(g):
            _, _, _, o, h, low, c = x
            bad = (low is not None and (low <= 0 or low > min(o, c))) or (h is not None and (h < max(o, c) or (low is not None and h < low)))
            if bad or max(y for y in (up[i], dn[i], -9) if y is not None) >= 8 * u:
                want.add(x[0])
            j = i
            while j < len(g) and h is not None and g[j][4:6] == x[4:6]:
                j += 1
            if j - i >= 4:
                want.update(y[0] for y in g[i:j])
    assert got == want


def test_flags_of_empty_tables(spark):
    assert spikes.implausible(spark.createDataFrame([], TICK), spark.createDataFrame([], DAILY)).count() == 0


def test_kalman_keeps_real_jumps_and_withholds_spikes():
    y = np.r_[np.full(30, 10.0), 11.0, np.full(30, 10.0), np.full(40, 15.0)] + np.tile([0, 0.01, -0.01], 40)[:101]
    flagged = spikes.kalman_flags(y, np.zeros(101, int), np.full(101, 0.015), 0.9, 0.3, 3.5)
    assert flagged[30] and not flagged[31:61].any() and flagged[61] and not flagged[70:].any()


BAR = "ticker string, bar_start_utc timestamp, bar_close_utc timestamp, o decimal(18,6), h decimal(18,6), l decimal(18,6), c decimal(18,6), v bigint, is_final boolean, provider_ts_utc timestamp, source string"


def bar(t, at, c, final=True, v=100):
    x = None if c is None else Decimal(str(c))
    return (t, at, None, x, x, x, x, v, final, at, "rest")


def test_minute_grid(spark):
    at = datetime(2026, 3, 6, 4, 58)  # past midnight UTC, still the fifth in New York until 05:00
    rows = [bar(" abc", at, 1), bar("ABC", at + timedelta(seconds=58), 2), bar("ABC", at + timedelta(minutes=4), 5), bar("ABC", at + timedelta(minutes=6), 7)]
    rows += [bar("ABC", at, 9, final=False), bar("ABC", at, 1), bar(None, at, 1), bar("ABC", None, 1), bar("NUL", at, None), bar("NUL", at + timedelta(minutes=1), None)]
    got = grid.minute_grid(spark.createDataFrame(rows, BAR)).orderBy("ticker", "minute_epoch").collect()
    abc = [x for x in got if x.ticker == "ABC"]
    # 23:58 and 23:59 on the fifth; 00:02, then 00:03 missing, 00:04 on the sixth
    assert [x.filled for x in abc] == [False, False, False, True, False] and [x.session_date.day for x in abc] == [5, 5, 6, 6, 6]
    assert abc[0].c == 1 and 5 < abc[3].c < 7 and abc[3].h == abc[3].c
    assert [x.filled for x in got if x.ticker == "NUL"] == [False, False]
    assert grid.minute_grid(spark.createDataFrame([], BAR)).count() == 0


def test_ssa_beats_interpolation_on_a_rhythm():
    t = np.arange(300)
    x = np.sin(t / 5) + 0.3 * np.cos(t / 2.5)
    gaps = np.zeros(300, bool)
    for s in (40, 100, 170, 230):
        gaps[s : s + 9] = True
    y = np.where(gaps, np.nan, x)
    got = grid.ssa_fill(y, rank=4)
    flat = np.interp(t, t[~gaps], x[~gaps])
    assert np.abs(got - x)[gaps].mean() < 0.2 * np.abs(flat - x)[gaps].mean() and (got[~gaps] == x[~gaps]).all()
    assert np.isnan(grid.ssa_fill(np.full(5, np.nan))).all() and (grid.ssa_fill(np.array([1.0, np.nan, 3.0])) == [1, 2, 3]).all()


def test_ssa_runs_until_it_converges(spark):
    r = np.random.default_rng(4)
    x = np.cumsum(r.normal(0, 1, 200))
    gaps = r.random(200) < 0.1
    gaps[80:110] = True
    gaps[[0, -1]] = False
    y = np.where(gaps, np.nan, x)
    got = grid.ssa_fill(y)
    dev = x[~gaps].std()
    # one more round from the result moves it by less than the tolerance
    z = (got - x[~gaps].mean()) / dev
    hankel = np.lib.stride_tricks.sliding_window_view(z, 171)
    u = np.linalg.svd(hankel, full_matrices=False)[0][:, :3]
    low, at = u @ u.T @ hankel, np.add.outer(np.arange(30), np.arange(171))
    again = np.bincount(at.ravel(), low.ravel()) / np.bincount(at.ravel())
    assert np.abs(again - z)[gaps].max() < 1e-3
    assert grid.imputed(y)[1] and not grid.imputed(y, rounds=4)[1]  # too few rounds are told
    rows = [bar("A", datetime(2026, 3, 6, 15) + timedelta(minutes=i), 50 + round(float(v), 3)) for i, v in enumerate(y) if v == v]
    out = grid.minute_grid(spark.createDataFrame(rows, BAR)).collect()
    assert len(out) == 200 and all(x.converged for x in out)


def test_ssa_side_by_side_finds_the_fixed_points_of_plain_rounds():
    r = np.random.default_rng(0)
    x = np.cumsum(r.normal(0, 1, (12, 40)), 1)
    gaps = r.random((12, 40)) < 0.15
    gaps[:, [0, -1]] = False
    gaps[:, 7] = True
    got, done = grid.impute_all(np.where(gaps, np.nan, x))
    assert done.all() and (got[~gaps] == x[~gaps]).all()
    at = np.add.outer(np.arange(20), np.arange(21))
    for y, g, v in zip(got, gaps, x):
        mean, dev = v[~g].mean(), v[~g].std()
        z = np.where(g, np.interp(np.arange(40), np.flatnonzero(~g), v[~g]) - mean, v - mean) / dev
        for _ in range(4000):
            hankel = np.lib.stride_tricks.sliding_window_view(z, 21)
            u = np.linalg.svd(hankel, full_matrices=False)[0][:, :3]
            z = np.where(g, np.bincount(at.ravel(), (u @ u.T @ hankel).ravel()) / np.bincount(at.ravel()), z)
        assert np.abs((y - mean) / dev - z).max() < 0.02


READ = "entity string, key bigint, day date, arrived int, x decimal(18,6), y decimal(18,6)"


def reading(r, k, d):
    v = lambda: None if r.random() < 0.2 else Decimal(r.randrange(100))
    return ("HOT" if r.random() < 0.5 else r.choice("AB"), k, d, r.randrange(5), v(), v())


def test_rolling_state_against_brute_force_and_advance(spark):
    r = random.Random(11)
    first = date(2026, 1, 1)
    rows = [reading(r, k, first + timedelta(days=r.choice([0, 1, 2, 9, 20, 34, 50]))) for k in range(60)]
    rows += [(e, k, d, a + 10, None if x is None else x + 5, None) for e, k, d, a, x, _ in rows[:12]]  # superseded
    rows += rows[:5] + [(None, 1, first, 1, Decimal(1), None), ("A", None, first, 1, Decimal(1), None)]
    df = spark.createDataFrame(rows, READ)
    state = rolling.rolling_state(df, ["x", "y"])
    last = {}
    for e, k, d, a, x, y in rows:
        if e and k is not None and ((e, k) not in last or a >= last[e, k][1]):
            last[e, k] = (d, a, x, y)
    until = max(d for _, _, d, *_ in rows)
    days = defaultdict(list)
    for (e, _), (d, _, x, y) in last.items():
        for m, v in (("x", x), ("y", y)):
            if v is not None:
                days[e, m, d].append(v)
    got = {(s.entity, s.measure, s.day): s for s in state.collect()}
    for e in ("HOT", "A", "B"):
        for m in "xy":
            for i in range((until - first).days + 40):
                day = first + timedelta(days=i)
                tot = lambda n: sum((sum(days.get((e, m, day - timedelta(days=j)), [])) for j in range(n)), Decimal(0))
                act = sum(bool(days.get((e, m, day - timedelta(days=j)))) for j in range(30))
                s = got.get((e, m, day))
                if act or s is not None:
                    assert (s.total_7, s.total_30, s.active_30) == (tot(7), tot(30), act), (e, m, day)
    assert any(s.version == 2 for s in got.values()) and max(d for *_, d in got) == until + timedelta(days=29)


def test_daily_state_is_advanced_and_corrected_over_sessions(spark, tmp_path):
    r, first = random.Random(5), date(2026, 1, 1)
    day = lambda i: first + timedelta(days=i)
    amounts = {(r.choice("AB"), day(r.choice([0, 1, 3, 8, 9, 15, 60, 61]))): Decimal(r.randrange(50)) for _ in range(14)}
    line = "entity string, measure string, day date, amount decimal(28,6), active int"
    frame = lambda d: spark.createDataFrame([(e, "x", k, v, 1) for (e, k), v in d.items()], line)

    def check(state, upto):
        got = {(s.entity, s.day): (s.total_7, s.total_30, s.active_30) for s in rolling.current(state.rows()).filter("active_30 > 0").collect()}
        want = {}
        for e in "AB":
            for i in range(upto + 1):
                tot = lambda n: sum((amounts.get((e, day(i - j)), Decimal(0)) for j in range(n)), Decimal(0))  # noqa: E731, B023
                if n := sum((e, day(i - j)) in amounts for j in range(30)):
                    want[e, day(i)] = (tot(7), tot(30), n)
        assert got == want

    path = str(tmp_path / "state")
    state = rolling.DailyState(spark, path)
    state.advance(frame(amounts), day(4), first - timedelta(days=1))
    check(state, 4)
    for i in (5, 6, 20):  # a day, a day, two weeks
        state = rolling.DailyState(spark, path)  # as a later session finds it
        state.advance(frame(amounts), day(i))
        check(state, i)
    # amounts of past days are corrected: one changes, one is withdrawn, one is new
    old = [k for k in amounts if k[1] <= day(15)][:2]
    change = [(old[0][0], "x", old[0][1], Decimal(7), 0), (old[1][0], "x", old[1][1], -amounts[old[1]], -1), ("B", "x", day(12), Decimal(3), 1)]
    amounts[old[0]] += 7
    del amounts[old[1]]
    amounts["B", day(12)] = Decimal(3)
    state.correct(spark.createDataFrame(change, line), 2)
    check(state, 20)
    state = rolling.DailyState(spark, path)
    state.advance(frame(amounts), day(95))  # goes on from the corrected state, over days without any amount
    check(state, 95)
    assert rolling.rolling_state(spark.createDataFrame([], READ), ["x"]).count() == 0


def test_bursts_of_days_after_the_last_row(spark, tmp_path):
    """Every calendar day of TESTDATA's definition is judged: a ticker that is lively in its last week has cases after it."""
    first, r, rows = date(2026, 1, 5), random.Random(2), []
    for t, days in (("END", range(40)), ("OLD", range(0, 30, 2))):
        for i in days:
            for v in (Decimal(50), Decimal(1000) if i > days[-1] - 4 else Decimal(10)):
                at = datetime(2026, 1, 5, 15) + timedelta(days=i, minutes=r.randrange(10**6) % 300)
                rows.append((t, at, v, None if i % 3 == 0 else v / 7, at + timedelta(minutes=len(rows))))
    rows.append((*rows[-1][:2], Decimal(5), None, rows[-1][4] + timedelta(days=1)))  # supersedes the last row
    line = "ticker string, ts_utc timestamp, avg_volume_5 decimal(18,6), rel_volume decimal(18,6), ingested_utc timestamp"
    spark.createDataFrame(rows, line).write.parquet(str(tmp_path / "minute_bar_features.parquet"))
    last = {}
    for x in sorted(rows, key=lambda x: x[4]):
        last[x[:2]] = x
    want = set()
    for t in ("END", "OLD"):
        for m, c in (("avg_volume_5", 2), ("rel_volume", 3)):
            day = defaultdict(list)
            for x in last.values():
                if x[0] == t and x[c] is not None:
                    day[(x[1].date() - first).days].append(x[c].quantize(Decimal("0.000001")))
            for i in range(80):
                tot = lambda n: sum((v for j in range(n) for v in day.get(i - j, [])), Decimal(0))  # noqa: E731, B023
                if sum(i - j in day for j in range(30)) >= 12 and tot(30) > 0 and tot(7) * 30 >= tot(30) * 14:
                    want.add((t, int((first + timedelta(days=i)).strftime("%Y%m%d")), m))
    got = [tuple(x) for x in data.p4_found(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(t == "END" and d > 20260213 for t, d, _ in want)  # 13 February is the last day of the table


def test_tick_flags_where_an_edge_cuts_a_lively_part_off(spark):
    """The usual move is the whole day's, also in a partition that holds only its lively open."""
    r, p, out = random.Random(8), 50.0, []
    for i in range(900):
        p += r.choice([-1, 1]) * 0.01 * (r.uniform(3.5, 4.5) if i < 200 else r.uniform(0.9, 1.1))
        out.append(p)
    for i in range(10, 190, 9):
        out[i] = max(out[i - 1], out[i + 1]) + 0.01 * r.uniform(10.5, 15)
    rows = [(j, "HOT", Decimal(f"{x:.6f}"), 1, T0 + timedelta(seconds=j), T0) for j, x in enumerate(out)]
    got = {x.tick_id for x in spikes.tick_flags(spark.createDataFrame(rows, TICK), per=200).collect()}
    want = tick_truth(rows)
    assert got == want and len(want & set(range(10, 190, 9))) > 12


def test_bar_flags_where_an_edge_cuts_a_lively_part_off(spark):
    r, rows = random.Random(9), []
    for i in range(400):
        size = 4 if i < 90 else 1
        up, down = (size * r.uniform(0.09, 0.11) for _ in range(2))
        if i % 10 == 5 and i < 90:
            up = r.uniform(0.9, 1.2)
        rows.append((i, "AA", date(2024, 1, 1) + timedelta(days=i), *(Decimal(f"{x:.6f}") for x in (100, 100 + up, 100 - down, 100)), 1, None, T0))
    got = {x.bar_id for x in spikes.bar_flags(spark.createDataFrame(rows, DAILY), per=90).collect()}
    reach = [(x[4] - 100, 100 - x[5]) for x in rows]
    u = median(y for x in reach for y in x)
    want = {x[0] for x, y in zip(rows, reach) if max(y) >= 8 * u}
    assert got == want and len(want) == 9
