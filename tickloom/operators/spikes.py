"""Implausible readings: spikes, stuck values and impossible values, relative to each source's own normal behaviour.

A local-level state-space model is filtered for each source: the forecast of a reading is the level after the readings
before it, and a reading whose standardised innovation exceeds a threshold is flagged and withheld from the update. After
`HOLD` withheld readings in a row the level moves to the new one (a real jump). A source whose innovation variance over a
window of readings vanishes is stuck there. The filter proposes the cases; an exact check against the source's usual move or
reach, or the length of the run, follows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.ordered import Ranged, change, neighbours, ranged, scan, written

#: Readings withheld in a row before the level is moved to them.
HOLD = 3
#: Rows that a partition gets of its neighbours: more than the longest run or spike to be seen, and the filter's warm-up.
HALO = 16
SEGMENT = 512


def kalman(
    y: np.ndarray, source: np.ndarray, scale: np.ndarray, drift: float, noise: float, threshold: float, ceiling: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Which readings have a standardised innovation above the threshold under a local-level model of their source, and the
    innovations (0 for the first reading of a source).

    y: readings; source: non-decreasing group numbers; scale: normal deviation of each reading's source. The level's variance
    grows by (drift * scale)^2 a step and a reading's is (noise * scale)^2. Flagged readings do not update the level. With a
    ceiling, the forecast never exceeds it and only innovations upward count. Long sources are cut into segments that start
    HALO readings early, and all segments are filtered side by side.
    """
    n = len(y)
    out, innovation = np.zeros(n, bool), np.zeros(n)
    if not n:
        return out, innovation
    begin = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
    end = np.r_[begin[1:], n]
    cuts = (end - begin + SEGMENT - 1) // SEGMENT
    of = np.repeat(np.arange(len(begin)), cuts)
    first = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * SEGMENT
    last = np.minimum(first + SEGMENT, end[of])
    warm = np.maximum(first - HALO, begin[of])
    order = np.argsort(warm - last, kind="stable")  # longest first
    first, last, warm = first[order], last[order], warm[order]
    length = last - warm
    s2 = np.maximum(scale[warm], 1e-12) ** 2
    q, r = drift**2 * s2, noise**2 * s2
    x, p = y[warm].astype(float), r.copy()
    held = np.zeros(len(warm), np.int64)
    for t in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -t, "left"))
        i = warm[:m] + t
        p[:m] += q[:m]
        var = p[:m] + r[:m]
        forecast = x[:m] if ceiling is None else np.minimum(x[:m], ceiling[i])
        nu = y[i] - forecast
        size = np.abs(nu) if ceiling is None else nu
        odd = size > threshold * np.sqrt(var)
        mine = i >= first[:m]
        out[i[odd & mine]] = True
        innovation[i[mine]] = nu[mine]
        moved = odd & (held[:m] >= HOLD)
        gain = np.where(moved, 1.0, np.where(odd, 0.0, p[:m] / var))
        x[:m] += gain * (y[i] - x[:m])
        p[:m] = np.where(moved, r[:m], (1 - gain) * p[:m])
        held[:m] = np.where(odd & ~moved, held[:m] + 1, 0)
    return out, innovation


def kalman_flags(y: np.ndarray, source: np.ndarray, scale: np.ndarray, drift: float, noise: float, threshold: float, ceiling: np.ndarray | None = None) -> np.ndarray:
    """The flags alone; see kalman."""
    return kalman(y, source, scale, drift, noise, threshold, ceiling)[0]


#: Share of a source's normal deviation below which the root of the innovation variance counts as vanished.
VANISHED = 0.01


def vanishing(innovation: np.ndarray, source: np.ndarray, scale: np.ndarray, window: int) -> np.ndarray:
    """The readings in whose window (they and the `window` - 1 before them, of their source) the innovation variance vanishes,
    and those before them in the window."""
    n = len(innovation)
    out = np.zeros(n, bool)
    if n < window:
        return out
    power = np.lib.stride_tricks.sliding_window_view(innovation**2, window).mean(1)  # of the window that ends window - 1 later
    still = (power <= (VANISHED * scale[window - 1 :]) ** 2) & (source[: n - window + 1] == source[window - 1 :])
    for j in range(window):
        out[j : n - window + 1 + j] |= still
    return out


def run_lengths(same: np.ndarray) -> np.ndarray:
    """For each row the length of the run it lies in; same: whether a row equals the one before it."""
    run = np.cumsum(~same)
    return np.bincount(run)[run] if len(run) else run


def deviations(p: np.ndarray, source: np.ndarray, longest: int = 3) -> np.ndarray:
    """For each reading the largest distance by which it and its neighbours, up to `longest` readings in a row, all lie above
    or all below both the reading before and the one after them; 0 without such a distance."""
    n = len(p)
    out = np.zeros(n, np.int64)
    for k in range(1, longest + 1):
        if n < k + 2:
            break
        i = np.arange(1, n - k)  # first of the k readings
        ok = source[i - 1] == source[i + k]
        high, low = p[i].copy(), p[i].copy()
        for j in range(1, k):
            high, low = np.maximum(high, p[i + j]), np.minimum(low, p[i + j])
        a, b = p[i - 1], p[i + k]
        d = np.where(ok, np.maximum(low - np.maximum(a, b), np.minimum(a, b) - high), 0)
        for j in range(k):
            np.maximum.at(out, i + j, d)
    return out


def _edges(table: Ranged, columns: list[str]) -> DataFrame:
    """The first and last HALO rows of each partition, without repeated rows: _pid, head, tail. Written, as it is read twice."""
    kinds, keys = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in table.df.select(*columns).schema), table.keys

    def ends(pid: int, t: pa.Table, _: pa.Table | None) -> pa.Table:
        t = _distinct(t, columns, keys)
        parts = [t.slice(0, HALO), t.slice(max(0, t.num_rows - HALO))]
        lists = [pa.ListArray.from_arrays(pa.array([0, x.num_rows], pa.int32()), x.combine_chunks().to_struct_array().combine_chunks()) for x in parts]
        return pa.table({"_pid": pa.array([pid], pa.int32()), "head": lists[0], "tail": lists[1]})

    return written(scan(table, ends, f"_pid int, head array<struct<{kinds}>>, tail array<struct<{kinds}>>"), "edges")


def _distinct(t: pa.Table, columns: list[str], keys: list[str]) -> pa.Table:
    return t.select(columns).filter(pa.array(change(t, *keys)))


def _view(t: pa.Table, own: pa.Table, columns: list[str], keys: list[str]) -> tuple[pa.Table, int, int]:
    """A partition without repeated rows, with HALO rows of its neighbours on either side, and how many rows come before its
    own and how many are its own."""
    t = _distinct(t, columns, keys)
    parts = []
    for side in ("before", "after"):
        rows = own.column(side).chunk(0).flatten()
        parts.append(pa.Table.from_struct_array(rows).select(columns).cast(t.schema) if len(rows) else t.slice(0, 0))
    return pa.concat_tables([parts[0], t, parts[1]]), parts[0].num_rows, t.num_rows


def _with_usual(carry: DataFrame, edges: DataFrame, usual: DataFrame, source: list[str]) -> DataFrame:
    """carry with the usual value of the sources of each partition's first and last row, which alone its edges may cut."""
    ends = edges.select("_pid", F.col("head")[0].alias("a"), F.element_at("tail", -1).alias("b"))
    for x, name in (("a", "usual_first"), ("b", "usual_last")):
        at = ends.select("_pid", *(F.col(f"{x}.{c}").alias(c) for c in source))
        carry = carry.join(at.join(usual, source).select("_pid", F.col("usual").alias(name)), "_pid", "left")
    return carry


def _whole(scale: np.ndarray, g: np.ndarray, own: pa.Table, a: int, n: int) -> np.ndarray:
    """scale with the values of the partition's first and last source taken from the whole source: the view may hold only a
    part of these."""
    for i, c in ((a, "usual_first"), (a + n - 1, "usual_last")):
        if (x := own.column(c)[0].as_py()) is not None:
            scale[g[i]] = x
    return scale


def _scales(values: np.ndarray, source: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The median of the used values of each source, 0 without any; by group number."""
    groups = int(source[-1]) + 1 if len(source) else 0
    g, v = source[use], values[use]
    o = np.lexsort((v, g))
    g, v = g[o], v[o]
    count = np.bincount(g, minlength=groups)
    start = np.cumsum(count) - count
    out = np.zeros(groups)
    has = count > 0
    s, c = start[has], count[has]
    out[has] = (v[s + (c - 1) // 2] + v[s + c // 2]) / 2
    return out


#: Fixed values of the definition of a case.
TICK_MOVES, TICK_RUN, BAR_REACHES, BAR_RUN = 10, 12, 8, 4
#: Standardised innovations above which a reading is proposed. A case of 10 usual moves lies beyond 6 normal deviations of
#: any forecast, one of 8 usual reaches beyond 5; proposals a little below lose none.
TICK_THRESHOLD, BAR_THRESHOLD = 3.5, 2.5
#: Readings of the window in which the innovation variance is to vanish. Of a run of equal prices the first innovation may be
#: anything and is followed until the level moves (HOLD readings); each later one is a tenth of the one before.
TICK_STILL, BAR_STILL = 7, 3


def tick_flags(ticks: DataFrame, per: int | None = None) -> DataFrame:
    """Implausible prices of ticks, by ticker and New York date: tick_id, reason (impossible, stuck, spike), moves (how many
    usual moves a spike lies outside its neighbours).

    Distinct ticks with a price are ordered by (ticker, time, id) and range-partitioned, so a ticker of any size is spread
    over tasks; a partition sees HALO rows of its neighbours. Three scans: edges, usual moves, filter, which gets the usual
    moves of the sources that its edges cut. Nulls: ticks without ticker, time, price or id are left out. Repeated deliveries count once. Equal times are ordered by id. An empty table
    gives no rows.
    """
    rows = ticks.count()
    t = ticks.select(
        clean.ticker("ticker").alias("entity"), F.datediff(clean.ny_date("time_utc"), F.lit("1970-01-01").cast("date")).alias("day"),
        clean.micros("time_utc").alias("time"), F.col("tick_id").cast("bigint").alias("id"), (F.col("price") * 1_000_000).cast("bigint").alias("p"),
    ).dropna()
    keys = ["entity", "time", "id"]
    table = ranged(t, keys, rows, "ticks", per)
    columns, source = ["entity", "day", "time", "id", "p"], ["entity", "day"]
    edges = _edges(table, columns)
    carry = neighbours(edges, table.parts, HALO)

    def moves(v: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, fresh = v.column("p").to_numpy(), change(v, "entity", "day")
        move = np.zeros(len(p), np.int64)
        move[1:] = np.abs(np.diff(p))
        move[fresh] = 0
        return p, np.cumsum(fresh) - 1, move

    def histogram(pid: int, t: pa.Table, own_: pa.Table) -> pa.Table:
        v, a, n = _view(t, own_, columns, keys)
        _, g, move = moves(v)
        own = np.arange(a, a + n)
        own = own[move[own] > 0]
        o = own[np.lexsort((move[own], g[own]))]
        new = np.r_[True, (np.diff(g[o]) != 0) | (np.diff(move[o]) != 0)] if len(o) else np.zeros(0, bool)
        at = o[new]
        n_each = np.diff(np.r_[np.flatnonzero(new), len(o)])
        return v.select(["entity", "day"]).take(pa.array(at)).append_column("move", pa.array(move[at])).append_column("n", pa.array(n_each, pa.int64()))

    usual = (
        scan(table, histogram, "entity string, day int, move bigint, n bigint", carry)
        .groupBy("entity", "day")
        .agg(F.percentile(F.col("move").cast("double"), F.lit(0.5), F.col("n")).alias("usual"))
    )
    usual = written(usual, "usual")
    carry = _with_usual(carry, edges, usual, source)

    def propose(pid: int, t: pa.Table, own_: pa.Table) -> pa.Table:
        v, a, n = _view(t, own_, columns, keys)
        p, g, move = moves(v)
        scale = _whole(_scales(move, g, move > 0), g, own_, a, n)[g]
        flagged, innovation = kalman(p, g, 1.4826 * scale, 0.9, 0.3, TICK_THRESHOLD)
        near = np.convolve(flagged, np.ones(2 * HOLD + 1), "same") > 0.5 if len(p) >= 2 * HOLD + 1 else np.full(len(p), flagged.any())
        # a run of equal prices is looked at if the innovation variance vanishes anywhere in it
        same = (move == 0) & ~change(v, *source)
        of = np.cumsum(~same) - 1
        still = np.bincount(of, vanishing(innovation, g, scale, TICK_STILL)) > 0 if len(p) else np.zeros(0, bool)
        run = np.where(still[of], run_lengths(same), 0)
        own = np.arange(len(p))
        own = (own >= a) & (own < a + n)
        dev = np.where(near, deviations(p, g), 0)
        keep = own & ((p <= 0) | (run >= TICK_RUN) | (dev > 0))
        out = v.select(["id", *source]).filter(pa.array(keep))
        return out.append_column("p", pa.array(p[keep])).append_column("run", pa.array(run[keep], pa.int64())).append_column("dev", pa.array(dev[keep]))

    found = scan(table, propose, "id bigint, entity string, day int, p bigint, run bigint, dev bigint", carry)
    reason = F.when(F.col("p") <= 0, "impossible").when(F.col("run") >= TICK_RUN, "stuck").when(
        (F.col("dev") > 0) & (F.col("dev") >= TICK_MOVES * F.col("usual")), "spike"
    )
    return (
        found.join(usual, ["entity", "day"], "left")
        .select(F.col("id").alias("tick_id"), reason.alias("reason"), F.round(F.try_divide("dev", "usual"), 3).alias("moves"))
        .filter("reason is not null")
    )


def bar_flags(bars: DataFrame, per: int | None = None) -> DataFrame:
    """Implausible highs and lows of daily bars, by ticker: bar_id, reason (impossible, stuck, spike), reaches (the larger
    reach in usual reaches).

    As tick_flags, over bars ordered by (ticker, date, id); the measurements are the reach of h above and of l below the body.
    The usual reach is the median over a ticker's bars, which are as many as its days. A null h or l makes no case by itself
    and joins no run; a null o or c gives no reach. Bars without ticker, date or id are left out.
    """
    rows = bars.count()
    micro = lambda c: (F.col(c) * 1_000_000).cast("bigint").alias(c)
    t = bars.select(
        clean.ticker("ticker").alias("entity"), F.datediff("bar_date", F.lit("1970-01-01").cast("date")).cast("bigint").alias("time"),
        F.col("bar_id").cast("bigint").alias("id"), micro("o"), micro("h"), micro("l"), micro("c"),
    ).dropna(subset=["entity", "time", "id"])
    keys = ["entity", "time", "id"]
    table = ranged(t, keys, rows, "bars", per)
    top, low = "greatest(o, c)", "least(o, c)"
    reach = F.expr(
        f"array(if(o is null or c is null, null, try_divide(cast(h - {top} as double), cast({top} as double))),"
        f" if(o is null or c is null, null, try_divide(cast({low} - l as double), cast({low} as double))))"
    )
    usual = (
        table.df.dropDuplicates(keys).select("entity", F.explode(reach).alias("reach")).filter("reach is not null")
        .groupBy("entity").agg(F.percentile("reach", 0.5).alias("usual"))
    )
    usual = written(usual, "usual")
    columns = ["entity", "time", "id", "o", "h", "l", "c"]
    edges = _edges(table, columns)
    carry = _with_usual(neighbours(edges, table.parts, HALO), edges, usual, ["entity"])

    def propose(pid: int, t: pa.Table, own_: pa.Table) -> pa.Table:
        v, a, n = _view(t, own_, columns, keys)
        o, h, low, c = (v.column(x).to_numpy().astype(float) for x in "ohlc")  # nulls become NaN
        fresh = change(v, "entity")
        g = np.cumsum(fresh) - 1
        body_top, body_low = np.maximum(o, c), np.minimum(o, c)
        with np.errstate(all="ignore"):
            up, down = (h - body_top) / body_top, (body_low - low) / body_low
            impossible = (low <= 0) | (h < low) | (h < body_top) | (low > body_low)
        up, down = (np.where(np.isfinite(x), x, np.nan) for x in (up, down))
        both, twice = np.r_[up, down], np.r_[g, g]
        scale = _scales(both, twice, ~np.isnan(both))
        s = np.maximum(_whole(scale, g, own_, a, n)[g], 1e-9)
        far = [kalman_flags(np.where(np.isnan(x), s, x), g, 1.2 * s, 0.1, 1.0, BAR_THRESHOLD, 2 * s) for x in (up, down)]
        # a source's first reading has no forecast; it is proposed too
        odd = far[0] | far[1] | fresh
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (low[1:] == low[:-1]) & ~fresh[1:]
        # h and l as levels without noise: the innovation variance of both vanishes where they stay the same
        ones = np.ones(len(g))
        still = [vanishing(kalman(np.where(np.isnan(x), -1.0 - np.arange(len(x)), x), g, ones, 1.0, 0.0, np.inf)[1], g, ones, BAR_STILL) for x in (h, low)]
        of = np.cumsum(~same) - 1
        run = np.where((np.bincount(of, still[0] & still[1]) > 0)[of], run_lengths(same), 0)
        worst = np.where(odd, np.fmax(up, down), np.nan)
        own = np.arange(len(h))
        own = (own >= a) & (own < a + n)
        keep = own & (impossible | (run >= BAR_RUN) | (worst > 0))
        out = v.select(["id", "entity"]).filter(pa.array(keep)).append_column("impossible", pa.array(impossible[keep]))
        return out.append_column("run", pa.array(run[keep], pa.int64())).append_column("reach", pa.array(worst[keep], from_pandas=True))

    found = scan(table, propose, "id bigint, entity string, impossible boolean, run bigint, reach double", carry)
    reason = F.when(F.col("impossible"), "impossible").when(F.col("run") >= BAR_RUN, "stuck").when(
        (F.col("reach") > 0) & (F.col("reach") >= BAR_REACHES * F.col("usual")), "spike"
    )
    return (
        found.join(usual, "entity", "left")
        .select(F.col("id").alias("bar_id"), reason.alias("reason"), F.round(F.try_divide("reach", "usual"), 3).alias("reaches"))
        .filter("reason is not null")
    )


def implausible(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """record_table, record_id and reason of every implausible reading of both tables."""
    a = tick_flags(ticks).select(F.lit("scanner_tick").alias("record_table"), F.col("tick_id").alias("record_id"), "reason")
    b = bar_flags(bars).select(F.lit("daily_bar").alias("record_table"), F.col("bar_id").alias("record_id"), "reason")
    return a.unionAll(b)
