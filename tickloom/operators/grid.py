"""Irregular readings onto a regular grid, missing periods filled by singular-spectrum imputation and marked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean

MINUTE = 60_000_000


#: Rounds after which a series that does not converge is left as it is, and marked.
ROUNDS = 5_000
#: Rounds after which a series is taken nearer to its fixed point by itself.
SLOW = 150
#: Entries of the trajectory matrices that are worked on side by side: bounds a task's memory.
CELLS = 2_000_000


def ssa_fill(x: np.ndarray, window: int = 30, rank: int = 3, tolerance: float = 1e-3, rounds: int = ROUNDS) -> np.ndarray:
    """x with its NaNs replaced by iterative singular-spectrum imputation; see imputed."""
    return imputed(x, window, rank, tolerance, rounds)[0]


def imputed(x: np.ndarray, window: int = 30, rank: int = 3, tolerance: float = 1e-3, rounds: int = ROUNDS) -> tuple[np.ndarray, bool]:
    """One series filled, and whether its iteration converged; see impute_all."""
    y, done = impute_all(np.asarray(x, float)[None], window, rank, tolerance, rounds)
    return y[0], bool(done[0])


def impute_all(x: np.ndarray, window: int = 30, rank: int = 3, tolerance: float = 1e-3, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Series of one length (rows of x) with their NaNs replaced by iterative singular-spectrum imputation, and whether each
    converged.

    Starting from linear interpolation, each series is embedded into its trajectory (Hankel) matrix, the matrix is cut to its
    `rank` leading singular vectors and averaged along its anti-diagonals, and the missing entries take the result, until a
    round moves them by less than tolerance times the series' deviation, for `rounds` rounds at most. Steps are lengthened by
    the ratio of successive moves (squared extrapolation), and a series that still moves after SLOW rounds is taken nearer by
    damped Newton steps; both leave the fixed point where it is, and whether a series has converged is always judged by a
    plain round. All series are worked on side by side, each until it converges. Known
    entries never change. A series without a known entry stays NaN; with fewer than two windows of two, or without any
    deviation, the interpolation is the fixed point that is taken.
    """
    x = np.asarray(x, float)
    gap = np.isnan(x)
    m, n = x.shape
    out, done = x.copy(), np.ones(m, bool)
    todo = np.flatnonzero(gap.any(1) & ~gap.all(1))
    at = np.arange(n)
    for i in todo:
        g = gap[i]
        out[i, g] = np.interp(at[g], at[~g], x[i, ~g])
    length = min(window, n // 2)
    if length < 2 or not len(todo):
        return out, done
    known = np.where(gap[todo], 0, x[todo])
    size = (~gap[todo]).sum(1)
    mean = known.sum(1) / size
    dev = np.sqrt((np.where(gap[todo], 0, x[todo] - mean[:, None]) ** 2).sum(1) / size)
    todo, mean, dev = todo[dev > 0], mean[dev > 0], dev[dev > 0]
    z, g = (out[todo] - mean[:, None]) / dev[:, None], gap[todo]
    wide, r = n - length + 1, min(rank, length - 1)
    count = np.minimum(np.minimum(at + 1, n - at), min(length, wide))

    def move(z: np.ndarray, g: np.ndarray) -> np.ndarray:
        """What one round changes."""
        hankel = np.lib.stride_tricks.sliding_window_view(z, length, axis=1)  # series, windows, length
        vectors = np.linalg.eigh(hankel.transpose(0, 2, 1) @ hankel)[1][:, :, -r:]
        low = (hankel @ vectors) @ vectors.transpose(0, 2, 1)
        total = np.zeros_like(z)
        for j in range(length):
            total[:, j : j + wide] += low[:, :, j]
        return np.where(g, total / count - z, 0)

    def settle(z: np.ndarray, g: np.ndarray) -> np.ndarray:
        """One series nearer to its fixed point, by damped Newton steps on what a round changes."""
        at, damp = np.flatnonzero(g), 1e-3
        f = move(z[None], g[None])[0, at]
        for _ in range(25):
            if np.abs(f).max() < tolerance:
                break
            near = np.repeat(z[None], len(at), 0)
            near[np.arange(len(at)), at] += 1e-5
            slope = ((move(near, np.repeat(g[None], len(at), 0))[:, at] - f) / 1e-5).T
            normal, down = slope.T @ slope, slope.T @ f
            for _ in range(8):
                new = z.copy()
                new[at] -= np.linalg.solve(normal + damp * np.eye(len(at)), down)
                then = move(new[None], g[None])[0, at]
                if (then**2).sum() < (f**2).sum():
                    z, f, damp = new, then, damp / 10
                    break
                damp *= 10
            else:
                break
        return z

    # extrapolated steps may not lead further from the fixed point than where plain rounds would: a longer move is undone
    best, least, step = z, np.full(len(z), np.inf), 0
    while len(todo) and step < rounds:
        first = move(z, g)
        size = np.abs(first).max(1)
        step += 1
        ended = size < tolerance
        worse = size > 2 * least
        if worse.any():
            z = np.where(worse[:, None], best, z)
            first[worse] = move(z[worse], g[worse])
            size[worse] = np.abs(first[worse]).max(1)
            least[worse] = np.inf
        z = z + first
        if ended.any():
            out[todo[ended]] = np.where(g[ended], z[ended] * dev[ended, None] + mean[ended, None], x[todo[ended]])
            left = ~ended
            todo, z, g, mean, dev, first, size, least, worse = (v[left] for v in (todo, z, g, mean, dev, first, size, least, worse))
            if not len(todo):
                return out, done
        best, least = z, np.minimum(least, size)
        second = move(z, g)
        step += 1
        turn = second - first
        norm = np.sqrt((turn**2).sum(1))
        alpha = np.where(worse | (norm == 0), 1.0, np.clip(np.sqrt((first**2).sum(1)) / np.maximum(norm, 1e-300), 1.0, 64.0))[:, None]
        # from the point before the first move: twice alpha along it, alpha squared along the turn
        z = z - first + 2 * alpha * first + alpha**2 * turn
        if step in (SLOW, 5 * SLOW):
            for i in range(len(z)):
                z[i] = settle(best[i], g[i])
            least = np.full(len(z), np.inf)
    out[todo] = np.where(g, z * dev[:, None] + mean[:, None], x[todo])
    done[todo] = False
    return out, done


def minute_grid(bars: DataFrame) -> DataFrame:
    """One row for each ticker, New York date and minute between the first and the last bar of the date: ticker,
    session_date, minute_epoch (seconds), o, h, l, c, v, filled, converged.

    A bar belongs to the whole minute nearest to its start (half a minute rounds up). Of the bars of one minute a final one
    goes before an unfinished one, then the latest provider time, then the highest volume. Bars are reduced to one a minute
    before they are brought together, so a series has at most 1,440 readings however many bars a ticker has. Missing
    minutes get close and volume by singular-spectrum imputation (of log close and log volume), open, high and low equal to
    the close, and filled = true. converged is false throughout a series whose imputation still moved after ROUNDS rounds.

    Nulls: bars without ticker or start are left out; a bar with a null or non-positive close, or a null volume, keeps its
    minute and the value as it is, which counts as unknown in the imputation. Repeated bars count once; an empty table gives no rows.
    """
    minute = F.floor((clean.micros("bar_start_utc") + MINUTE // 2) / F.lit(MINUTE)).cast("bigint")
    one = (
        bars.select(clean.ticker("ticker").alias("ticker"), minute.alias("minute"), "o", "h", "l", "c", "v", "is_final", "provider_ts_utc")
        .filter("ticker is not null and minute is not null")
        .groupBy("ticker", "minute")
        .agg(F.max(F.struct(F.coalesce("is_final", F.lit(False)).alias("f"), "provider_ts_utc", "v", "c", "o", "h", "l")).alias("b"))
    )
    day = F.datediff(clean.ny_date(F.timestamp_seconds(F.col("minute") * 60)), F.lit("1970-01-01").cast("date"))
    number = lambda c: F.col(f"b.{c}").cast("double").alias(c)
    series = (
        one.select("ticker", day.alias("day"), "minute", number("o"), number("h"), number("l"), number("c"), number("v"))
        .groupBy("ticker", "day")
        .agg(F.array_sort(F.collect_list(F.struct("minute", "o", "h", "l", "c", "v"))).alias("bars"))
    )

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("bars")
            flat, off = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            minutes = flat.field("minute").to_numpy()
            bars = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in "ohlcv"}  # nulls become NaN
            first = minutes[off[:-1]]
            size = minutes[off[1:] - 1] - first + 1
            base = np.cumsum(size) - size
            which = np.repeat(np.arange(len(size)), size)
            grid = first[which] + np.arange(len(which)) - base[which]
            at = np.repeat(base - first, np.diff(off)) + minutes  # where on the grid each bar lies
            filled = np.ones(len(grid), bool)
            filled[at] = False
            close, volume = np.full((2, len(grid)), np.nan)
            with np.errstate(all="ignore"):
                close[at] = np.where(bars["c"] > 0, np.log(bars["c"]), np.nan)
                volume[at] = np.log1p(np.maximum(bars["v"], 0))
            done = np.ones(len(size), bool)
            gaps = np.bincount(which, filled, len(size)) > 0
            for n in np.unique(size[gaps]):  # series of one length side by side
                same = np.flatnonzero(gaps & (size == n))
                step = max(1, CELLS // (int(n) * 60))
                for k in range(0, len(same), step):
                    part = same[k : k + step]
                    cells = base[part][:, None] + np.arange(n)
                    both, ended = impute_all(np.concatenate([close[cells], volume[cells]]))
                    close[cells], volume[cells] = both[: len(part)], both[len(part) :]
                    done[part] = ended[: len(part)] & ended[len(part) :]
            close, volume = np.exp(close), np.expm1(volume)
            cols = {x: (volume if x == "v" else close).copy() for x in "ohlcv"}
            for x, v in cols.items():
                v[at] = bars[x]
            data = [b.column("ticker").take(pa.array(which)), b.column("day").take(pa.array(which)), pa.array(grid * 60), pa.array(filled), pa.array(done[which])]
            data += [pa.array(v, from_pandas=True) for v in cols.values()]
            yield from pa.table(data, names=["ticker", "day", "minute_epoch", "filled", "converged", *cols]).to_batches(max_chunksize=50_000)

    out = series.mapInArrow(fill, "ticker string, day int, minute_epoch bigint, filled boolean, converged boolean, o double, h double, l double, c double, v double")
    return out.withColumn("session_date", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).drop("day")
