"""The search for analogues: as all pairs compared one by one, also on odd inputs, and with little work."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import analogues


def _records(n, seed, setups=1, regimes=4, tickers=40):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, 12))
    z[r.random((n, 12)) < 0.05] = np.nan
    z[: n // 20] = np.nan_to_num(z[: n // 20], nan=1e7) * 1e6  # far out
    z[n // 20 : n // 10] = z[n // 10 : n // 10 + n // 10 - n // 20]  # equal vectors
    z[-10:, 3:] = np.nan  # too few known
    code = lambda k: r.integers(0, k, n).astype(np.int32)
    return r.permutation(10 * n)[:n].astype(np.int64), r.integers(0, 25, n), code(tickers), code(regimes) - 1, code(setups), z


def _one_by_one(data, asked, weight, n):
    ids, days, ticker, regime, setup, z = data
    out = []
    for i, day, own, kind, form, v in zip(*asked):
        both = ~np.isnan(z) & ~np.isnan(v)
        total, norm = np.zeros(len(z)), np.zeros(len(z))
        for j, w in enumerate(weight):
            total += np.where(both[:, j], w * (z[:, j] - v[j]) ** 2, 0)
            norm += both[:, j] * w
        with np.errstate(all="ignore"):
            d = np.round(np.maximum(np.sqrt(total / norm) + (analogues.REGIME_PENALTY * (regime != kind) + analogues.SAME_TICKER * (ticker == own)), 0), 9)
        can = np.flatnonzero((both.sum(1) >= analogues.SHARED) & (days < day) & (setup == form))
        by_day, by_ticker, got = {}, {}, []
        for k in can[np.lexsort((ids[can], d[can]))]:
            at = ticker[k], days[k]
            if by_day.get(at, 0) < analogues.PER_DAY and by_ticker.get(ticker[k], 0) < analogues.PER_TICKER:
                got.append((i, ids[k], d[k], both[k].sum(), len(got) + 1, ticker[k]))
                by_ticker[ticker[k]] = by_ticker.get(ticker[k], 0) + 1
                by_day[at] = by_day.get(at, 0) + 1
            if len(got) == n:
                break
        out += got
    return sorted(out)


def _search(data, asked, weight, n, seen=None):
    block = analogues._Block(data, weight, n)
    if seen is not None:
        block.columns = type("Seen", (np.ndarray,), {"__getitem__": lambda self, at: (seen.append(np.asarray(self)[at].shape[1]), np.asarray(self)[at])[1]})(
            block.columns.shape, block.columns.dtype, block.columns
        )
    return sorted(x for found in block.search(*asked) for x in zip(*found))


WEIGHT = np.array([1.6, 1.4, 1.3, 1.4, 1.3, 1.4, 1.2, 0.8, 1, 1, 1, 1])


def _some(data, k):
    at = np.random.default_rng(9).choice(len(data[0]), k, replace=False)
    return tuple(c[at] for c in data)


def test_a_setup_is_searched_alone():
    data = _records(6_000, 1, setups=10, regimes=1)
    asked = _some(data, 100)
    seen = []
    assert _search(data, asked, WEIGHT, 24, seen) == _one_by_one(data, asked, WEIGHT, 24)
    assert sum(seen) < 3 * len(data[0])  # before, each query was compared with all records: here ten setups' queries with a tenth each


def test_few_pairs_are_computed_exactly(monkeypatch):
    for seed, regimes in ((2, 4), (3, 12)):  # more regimes than lie apart
        data = _records(5_000, seed, regimes=regimes)
        usual = tuple(c[500:] for c in data)  # without those far out
        exact, pairs = analogues._Tile._exact, []
        monkeypatch.setattr(analogues._Tile, "_exact", lambda self, row, col, f=exact: (pairs.append(len(row)), f(self, row, col))[1])
        asked = _some(usual, 150)
        assert _search(usual, asked, WEIGHT, 24) == _one_by_one(usual, asked, WEIGHT, 24)
        assert sum(pairs) < 0.25 * 150 * len(usual[0])  # before, all pairs were brought into figures, sorted out query by query
        monkeypatch.setattr(analogues._Tile, "_exact", exact)


def test_slices_tiles_and_large_distances(monkeypatch):
    monkeypatch.setattr(analogues, "TILE", 7)
    monkeypatch.setattr(analogues, "COLUMNS", 50)
    monkeypatch.setattr(analogues, "FIRST", 90)
    monkeypatch.setattr(analogues, "MOST", 400)
    for seed, tickers in ((4, 3), (5, 400)):  # three tickers cannot give 24 analogues
        data = _records(1_500, seed, setups=2, tickers=tickers)
        asked = _some(data, 120)
        assert _search(data, asked, WEIGHT, 24) == _one_by_one(data, asked, WEIGHT, 24)


def test_far_leaves_are_left_out(monkeypatch):
    monkeypatch.setattr(analogues, "LEAF", 64, raising=False)
    data = _records(8_000, 6, regimes=1)
    r = np.random.default_rng(7)
    data[5][:] = r.normal(size=(30, 12))[r.integers(0, 30, 8_000)] * 4 + r.normal(size=(8_000, 12)) * 0.3  # thirty clusters
    data[5][:1_500, 3] = np.nan  # a form of its own, and many rare ones
    data[5][1_500:2_000][r.random((500, 12)) < 0.1] = np.nan
    asked, pairs, matmul = _some(data, 200), [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: (pairs.append(out.size), matmul(a, b, out=out))[1])
    expected = _one_by_one(data, asked, WEIGHT, 24)
    assert _search(data, asked, WEIGHT, 24) == expected and len(expected) > 4_000
    assert sum(pairs) < 0.25 * 200 * 8_000  # before, all earlier records: half of them


def test_small_leaves_stages_and_own_tickers(monkeypatch):
    for name, value in (("LEAF", 16), ("NEAR", 2), ("OWN", 30), ("TILE", 64)):
        monkeypatch.setattr(analogues, name, value)
    for seed, tickers in ((8, 60), (9, 5)):  # tickers of some 25 records, compared one by one, and of 300
        data = _records(1_500, seed, setups=2, regimes=3, tickers=tickers)
        data[5][:, 4][:700] = np.nan
        data[2][:400] = 0
        asked = _some(data, 150)
        assert _search(data, asked, WEIGHT, 24) == _one_by_one(data, asked, WEIGHT, 24)
        usual = tuple(c[150:] for c in data)  # single precision
        asked = _some(usual, 150)
        assert _search(usual, asked, WEIGHT, 24) == _one_by_one(usual, asked, WEIGHT, 24)


def test_one_block_is_ranked_once(spark, monkeypatch):
    """What a task returns of all records is ranked already; only with several blocks are their results ranked again."""
    import random
    from datetime import date, timedelta
    from decimal import Decimal

    r = random.Random(3)
    keys = ["day_change_pct", "session_change_pct", "distance_to_vwap_pct", "rvol_vs_adv", "minutes_since_open"]
    stats = spark.createDataFrame([(k, Decimal(1)) for k in keys], "feature_key string, std_dev decimal(18,6)")
    form = lambda: (r.choice(["long", "SHORT"]), r.choice("ab"), True, r.choice(["PREFERRED", "x"]), r.random() < 0.5, r.random() < 0.5, r.choice(["STOP_BEFORE_T1", None]), Decimal(r.randrange(9)))
    rows = [(i, r.choice("ABCDE"), None, date(2026, 3, 1) + timedelta(days=r.randrange(6)), "x", {k: Decimal(r.randrange(300)) / 100 for k in keys}, [form() for _ in range(i % 3)]) for i in range(120)]
    kind = "scenarios array<struct<direction string, entry_type string, structurally_valid boolean, selection_tier string, triggered boolean, t1_before_stop boolean, primary_outcome string, resolved_r decimal(18,6)>>"
    df = spark.createDataFrame(rows, f"record_id bigint, ticker string, as_of_utc timestamp, session_date_et date, regime string, features map<string,decimal(18,6)>, {kind}")
    q = df.withColumnRenamed("record_id", "query")
    out = analogues.setup_aggregates(df, q, stats)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    one = sorted(map(str, out.collect()))
    monkeypatch.setattr(analogues, "BLOCK", 9)
    many = analogues.setup_aggregates(df, q, stats)
    assert "Window" in many._jdf.queryExecution().optimizedPlan().toString() and sorted(map(str, many.collect())) == one and len(one) > 100


def test_setups_are_summed_where_the_search_ends(spark, monkeypatch):
    """One block's analogues are not written and joined with their scenarios: these go with the records, sent as few large rows."""
    import random
    from datetime import date, timedelta
    from decimal import Decimal

    r = random.Random(5)
    keys = ["day_change_pct", "session_change_pct", "distance_to_vwap_pct", "rvol_vs_adv", "minutes_since_open"]
    stats = spark.createDataFrame([(k, Decimal(1)) for k in keys], "feature_key string, std_dev decimal(18,6)")
    value = lambda: r.choice([None, Decimal("-999999999999.999999"), Decimal("999999999999.999999"), Decimal(r.randrange(-(10**8), 10**8)).scaleb(-6)])
    form = lambda: (r.choice(["long", "SHORT", None]), r.choice(["a", "B", "", None]), r.choice([True, True, False, None]), r.choice(["preferred", "Secondary", None]), r.choice([True, False, None]), r.choice([True, None]), r.choice(["stop_before_t1", None]), value())
    lists = lambda i: None if i % 7 == 0 else [form() for _ in range(i % 4)]
    rows = [(i, r.choice("ABCDEFG"), date(2026, 3, 1) + timedelta(days=r.randrange(6)), r.choice("xy"), {k: Decimal(r.randrange(300)) / 100 for k in keys[: r.choice([4, 5, 5, 5])]}, lists(i)) for i in range(300)]
    kind = "scenarios array<struct<direction string, entry_type string, structurally_valid boolean, selection_tier string, triggered boolean, t1_before_stop boolean, primary_outcome string, resolved_r decimal(18,6)>>"
    df = spark.createDataFrame(rows, f"record_id bigint, ticker string, session_date_et date, regime string, features map<string,decimal(18,6)>, {kind}").withColumn("as_of_utc", F.lit(None).cast("timestamp"))
    queries = df.withColumnRenamed("record_id", "query")
    out = analogues.setup_aggregates(df, queries, stats)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # before, each analogue was joined with its scenarios
    one = sorted(map(str, out.collect()))
    monkeypatch.setattr(analogues, "SENT", 7)
    assert sorted(map(str, analogues.setup_aggregates(df, None, stats).collect())) == one and len(one) > 500
    monkeypatch.setattr(analogues, "BLOCK", 60)
    many = analogues.setup_aggregates(df, queries, stats)
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString() and many.dtypes == out.dtypes
    assert sorted(map(str, many.collect())) == one
    assert sorted(map(str, analogues.setup_aggregates(df, None, stats).collect())) == one
