"""Historical analogues: the most similar earlier records of a query, spread over tickers and days, and what came of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tickloom.functions import clean

#: Weights of the features in the distance (1 for the others), and what another regime and the same ticker add.
WEIGHTS = {
    "distance_to_vwap_pct": 1.6, "session_change_pct": 1.4, "day_change_pct": 1.3, "return_last_5_bars_pct": 1.4, "return_last_15_bars_pct": 1.3,
    "rvol_vs_adv": 1.4, "position_in_session_range": 1.2, "minutes_since_open": 0.8,
}
REGIME_PENALTY, SAME_TICKER = 0.35, -0.05
#: Most records of one ticker and day, and of one ticker, among a query's analogues; features that must be known in both.
PER_DAY, PER_TICKER, SHARED = 2, 4, 5
#: Records of a block, and queries asked together in it; rows sent as one.
BLOCK, BATCH, SENT = 600_000, 200_000, 2_500
#: Queries of a tile, and those of it that lie close together; records of a leaf, of one product and of a first limit; an eighth
#: of the leaves that are searched before all others; pairs that are settled together; regimes that lie apart; records of a
#: ticker that are computed exactly.
TILE, CLOSE, LEAF, COLUMNS, FIRST, NEAR, MOST, REGIMES, OWN = 2048, 32, 512, 512, 2048, 4, 1_000_000, 7, 256
#: What sums of squares count as at most.
FAR = 3e38


def distinct_records(records: DataFrame) -> DataFrame:
    """One row for each record_id with a ticker, as-of time and session date; repeated deliveries agree in all but spelling."""
    r = records.withColumn("ticker", clean.ticker("ticker"))
    return r.filter("record_id is not null and ticker is not null and session_date_et is not null").dropDuplicates(["record_id"])


def feature_stats(records: DataFrame) -> DataFrame:
    """Mean, sample deviation (6 digits) and number of the known values of each feature with at least two of them."""
    f = distinct_records(records).select(F.explode("features").alias("feature_key", "value")).filter("value is not null")
    return f.groupBy("feature_key").agg(
        clean.half_even(F.avg(F.col("value").cast("double")), 6).alias("mean"), clean.half_even(F.stddev_samp(F.col("value").cast("double")), 6).alias("std_dev"),
        F.count(F.lit(1)).alias("sample_count"),
    ).filter("sample_count >= 2")


def scenario_rows(records: DataFrame) -> DataFrame:
    """The scenarios of each record, one row each, with their place in the list (from 1)."""
    return distinct_records(records).select(
        "record_id", "ticker", "as_of_utc", "session_date_et", F.posexplode("scenarios").alias("at", "s")
    ).select("record_id", "ticker", "as_of_utc", "session_date_et", (F.col("at") + 1).alias("ordinal"), "s.*")


def analogues(records: DataFrame, queries: DataFrame | None, stats: DataFrame, n: int = 24) -> DataFrame:
    """The n most similar records of sessions before the query's, at most PER_DAY of one ticker and day and PER_TICKER of one
    ticker: query, record_id, rank, distance, shared.

    records: record_id, ticker, session_date_et, regime, features and optionally setup string; queries: the same and query
    bigint, or None for all records by their id. A query with a setup sees only records with the same one. The distance is the weighted root mean square of the
    differences over the known features in deviations, plus REGIME_PENALTY for another regime and SAME_TICKER for the same
    ticker, not below 0; at least SHARED features must be known in both. Distances equal to nine digits go by
    record_id.

    Records are dealt into blocks by ticker and day, so a ticker of any size is spread over blocks, and the cap for a ticker
    and day is settled within one. A block returns its first n under both caps, and with several blocks the cap for a ticker is
    applied once more to what all blocks return. No record of the result is lost by that: where the last cap removes a record
    of a ticker, as many better ones of the same ticker stand in its place. The queries are asked in every block, a task for
    each block and batch of queries; see _Block for the search.
    Nulls: records without id, ticker or session date are left out; a null regime or setup is one of its own.
    """
    return _Search(records, queries, stats, n).found()


class _Search:
    """The search of the queries' analogues as a plan; see analogues. carried: a column of the records for what is made of them."""

    def __init__(self, records: DataFrame, queries: DataFrame | None, stats: DataFrame, n: int, carried: Column | None = None) -> None:
        stats_ = stats.orderBy("feature_key").collect()  # a small fixed table
        keys, scale = [r["feature_key"] for r in stats_], {r["feature_key"]: float(r["std_dev"]) for r in stats_}
        self.weight, self.n = np.array([WEIGHTS.get(k, 1.0) for k in keys]), n
        vec = F.array(*(F.try_element_at("features", F.lit(k)).cast("double") / F.lit(scale[k] if scale[k] > 0.0001 else 1.0) for k in keys))
        day = F.datediff("session_date_et", F.lit("1970-01-01").cast("date"))
        setup = lambda df: F.coalesce("setup", F.lit("")) if "setup" in df.columns else F.lit("")
        cols = lambda df: ["ticker", day.alias("day"), F.lower("regime").alias("regime"), setup(df).alias("setup"), vec.alias("vec")]
        sides = records.select(F.lit(1).alias("r"), F.lit(0).alias("q"))
        if queries is not None:
            sides = sides.unionAll(queries.select(F.lit(0), F.lit(1)))
        size, many = (x or 0 for x in sides.agg(F.sum("r"), F.sum("q")).first())
        many = size if queries is None else many
        self.blocks = size // BLOCK + 1
        tasks = records.sparkSession.sparkContext.defaultParallelism
        self.batches = max(1, min(-(-tasks // self.blocks), many // 200 + 1), many // BATCH + 1)
        part = lambda k, *c: F.pmod(F.xxhash64(*c), F.lit(k)).cast("int")
        block, batch = part(self.blocks, "ticker", "day").alias("block"), part(self.batches, "id").alias("batch")
        data = records.select(F.col("record_id").alias("id"), *cols(records), *([] if carried is None else [carried.alias("carried")]))
        if queries is None:
            self.rows = _sent(data.select("*", block, batch), max(self.blocks, self.batches), True, False)
        else:
            asked = queries.select(F.col("query").alias("id"), *cols(queries))
            self.rows = _sent(data.select("*", block), self.blocks, True).unionAll(_sent(asked.select("*", batch), self.batches, False))

    def each(self, make: Callable, kind: str) -> DataFrame:
        """What make(records' table, queries' ids, block, tile) gives for each tile of queries that has analogues; one task for
        each block and batch of queries."""
        weight, n = self.weight, self.n

        def search(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_, data = _received(batches_)
            if not asked_ or not data:
                return
            asked_, data = pa.concat_tables(asked_), pa.concat_tables(data)
            code, size = {}, data.num_rows
            for c in ("ticker", "regime", "setup"):
                e = pa.chunked_array([*data.column(c).chunks, *asked_.column(c).chunks]).combine_chunks()
                e = e.dictionary_encode() if isinstance(e, pa.Array) else e.combine_chunks().dictionary_encode()
                code[c] = e.indices.fill_null(-1).to_numpy()
                if c == "ticker":
                    names = e.dictionary
            sides = []
            for t, at in ((data, slice(size)), (asked_, slice(size, None))):
                z = pa.concat_arrays(t.column("vec").chunks).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                enough = np.flatnonzero((~np.isnan(z)).sum(1) >= SHARED)  # others share too few with any
                own = (t.column("id").to_numpy(), t.column("day").to_numpy(), *(code[c][at] for c in ("ticker", "regime", "setup")), z)
                sides.append((enough, tuple(c[enough] for c in own)))
            (at, records), (_, queries) = sides
            rest = data.select(["carried"]).take(at) if "carried" in data.column_names else names
            del data, asked_, t, z, own, code, sides, e
            pa.default_memory_pool().release_unused()
            if len(at) and len(queries[0]):
                block = _Block(records, weight, n)
                del records
                for tile in block.tiles(*queries):
                    yield make(rest, queries[0], block, tile)

        many = F.when(F.col("kept"), F.lit(self.batches)).otherwise(F.lit(self.blocks))
        task = F.when(F.col("kept"), F.col("part") * self.batches + F.col("other")).otherwise(F.col("other") * self.batches + F.col("part"))
        rows = self.rows.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("other"))
        return rows.withColumn("task", task).repartitionById(self.blocks * self.batches, "task").select("kept", "rows").mapInArrow(search, kind)

    def found(self) -> DataFrame:
        def make(names: pa.Array, ids: np.ndarray, block: _Block, tile: tuple) -> pa.RecordBatch:
            q, row, col, dist, shared, rank = tile
            out = [*map(pa.array, (ids[q][row], block.ids[col], dist, shared, rank.astype(np.int32))), names.take(pa.array(block.ticker[col]))]
            return pa.RecordBatch.from_arrays(out, ["query", "record_id", "distance", "shared", "rank", "ticker"])

        found = self.each(make, "query bigint, record_id bigint, distance double, shared bigint, rank int, ticker string")
        if self.blocks == 1:  # one task has seen all records
            return found.drop("ticker")
        own = Window.partitionBy("query", "ticker").orderBy("distance", "record_id")
        found = found.drop("rank").withColumn("_t", F.row_number().over(own)).filter(F.col("_t") <= PER_TICKER).drop("_t", "ticker")
        w = Window.partitionBy("query").orderBy("distance", "record_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= self.n)


def _received(batches: Iterable[pa.RecordBatch]) -> tuple[list, list]:
    """Tables of what _sent sent: queries, records."""
    held: tuple[list, list] = ([], [])
    for b in batches:
        for kept, rows in zip(b.column("kept").to_pylist(), b.column("rows")):
            held[kept].append(pa.ipc.open_stream(rows.as_buffer()).read_all())
    return held


def _sent(df: DataFrame, parts: int, *kept: bool) -> DataFrame:
    """The rows as few ones of up to SENT, which are cheap to send to many tasks: kept, part, rows as an Arrow stream. For records
    (kept) the part is their block, for queries their batch; a table may be both. parts: how many there are."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(b)
            if not held or b is not None and sum(x.num_rows for x in held) < SENT * parts:
                continue
            t, held = pa.Table.from_batches(held), []
            for side in kept:
                part = t.column("block" if side else "batch").to_numpy()
                u = t.select([c for c in t.column_names if c not in ("block", "batch") and (side or c != "carried")])
                if part.min() < part.max():
                    order = np.argsort(part, kind="stable")
                    u, part = u.take(order), part[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                for lo, size in ((k, min(SENT, hi - k)) for lo, hi in zip(cuts, cuts[1:]) for k in range(lo, hi, SENT)):
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, u.schema) as w:
                        w.write_table(u.slice(lo, size).combine_chunks())
                    yield pa.RecordBatch.from_arrays([pa.array([side]), pa.array([part[lo]], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["kept", "part", "rows"])

    return df.mapInArrow(pack, "kept boolean, part int, rows binary")


class _Block:
    """The records of a block, laid out for exact search by matrix products, by setup and regime, and there in leaves that are
    small in days and features.

    A pair lies within T if the weighted sum over the shared features of (difference squared - T squared) is not above 0. As
    the known features are columns of their own, that is one product of a row for the query, which holds its T, and a column
    for the record, whatever features are known; where all are, a shorter row and column do. T is what the query's n-th
    analogue so far lets in, so hardly any pair is more than one figure compared with 0, and leaves whose nearest corner is
    farther than T are left out. Products are in single precision where that is fine enough; a bound of their error is part of
    the row and the column, so no pair within T is missed. Pairs that pass are computed exactly. The query's own regime comes
    first; for another one T is less by the penalty. Pairs of one ticker, which lie nearer than their features, are computed
    exactly unless the ticker is large.
    """

    def __init__(self, records: tuple, weight: np.ndarray, n: int) -> None:
        ids, days, ticker, regime, setup, z = records
        self.weight, self.n = weight, n
        sizes = np.bincount(regime + 1)
        large = np.argsort(-sizes, kind="stable")[:REGIMES]
        self.layout = np.full(len(sizes), REGIMES)  # regimes beyond the largest ones lie together
        self.layout[large] = np.arange(len(large))
        group = setup.astype(np.int64) * (REGIMES + 1) + self.layout[regime + 1]
        order, self.starts = _leaves(group, days, z, weight, LEAF)
        self.order = order
        self.ids, self.days, self.ticker, self.regime, self.group = (c[order] for c in (ids, days, ticker, regime, group))
        z = z[order]
        self.known = ~np.isnan(z)
        self.full = self.known.all(1)
        self.x, self.share = np.nan_to_num(z), self.known @ weight
        first = self.starts[:-1]
        self.leaf_group, self.leaf_day = self.group[first], np.minimum.reduceat(self.days, first)
        everywhere = np.logical_and.reduceat(self.known, first)
        self.form = np.where((everywhere | ~np.logical_or.reduceat(self.known, first)).all(1)[:, None], everywhere, np.nan)  # where all know the same
        low, high = np.minimum.reduceat(self.x, first), np.maximum.reduceat(self.x, first)
        self.root = np.sqrt(weight)
        self.middle, half = self.root * (low + high) / 2, self.root * (high - low) / 2
        self.half = np.where(everywhere, half + 1e-6 * (3 * np.abs(self.middle) + 2 * half), np.inf)
        self.centre = self.x.sum(0) / np.maximum(self.known.sum(0), 1)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.by_id] = np.arange(len(order))
        self.bits = len(order).bit_length()
        self.by_ticker = np.lexsort((self.days, self.group // (REGIMES + 1), self.ticker))
        self.ticker_key = np.stack([c[self.by_ticker] for c in (self.ticker, self.group // (REGIMES + 1))]).astype(np.int64)
        self.setups = int(self.ticker_key[1].max()) + 1
        self.ticker_key = self.ticker_key[0] * self.setups + self.ticker_key[1]
        near = (self.x - self.centre) * self.known
        size = near**2 @ weight
        terms = 3 * len(weight) + 10
        single = 1.1 * terms * 2.0**-24
        self.kind, self.unit = np.float32, single
        if (size * single > 0.02).mean() > 0.001 or size.max() > 1e30:
            self.kind, self.unit = np.float64, 1.1 * terms * 2.0**-53
        self.coarse = np.float32 if size.max() < 1e30 else np.float64
        self.middle, self.half = (np.ascontiguousarray(x.T.astype(self.coarse)) for x in (self.middle, self.half))
        ones = np.ones(len(order))
        self.columns = np.empty((3 * len(weight) + 2, len(order)), self.kind)
        f = len(weight)
        self.columns[:f], self.columns[f : 2 * f] = self.known.T, near.T
        self.columns[3 * f], self.columns[3 * f + 1] = ones, -2 * self.unit * size
        self.short = np.empty((f + 2, len(order)), self.kind)
        self.short[:f], self.short[f], self.short[f + 1] = near.T, ones, size * (1 - 2 * self.unit)
        near *= near  # in place, as all records have it
        self.columns[2 * f : 3 * f] = near.T
        self.values, self.passed = np.empty(TILE * COLUMNS, self.kind), np.zeros(TILE * COLUMNS + 8, bool)

    def search(self, ids: np.ndarray, days: np.ndarray, ticker: np.ndarray, regime: np.ndarray, setup: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        """(query, record, distance, shared, rank, ticker) of the queries' first n under both caps."""
        for q, row, col, dist, shared, rank in self.tiles(ids, days, ticker, regime, setup, z):
            yield ids[q][row], self.ids[col], dist, shared, rank, self.ticker[col]

    def tiles(self, ids: np.ndarray, days: np.ndarray, ticker: np.ndarray, regime: np.ndarray, setup: np.ndarray, z: np.ndarray) -> Iterator[tuple]:
        """The same for each tile: places of its queries, and by place in it and in the block."""
        at = np.minimum(regime + 1, len(self.layout) - 1)
        own = np.where(regime + 1 < len(self.layout), self.layout[at], REGIMES)
        group = setup.astype(np.int64) * (REGIMES + 1) + own
        order, _ = _leaves(group, days, z, self.weight, CLOSE)
        cuts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
        for lo, hi in zip(cuts, cuts[1:]):
            for k in range(lo, hi, TILE):
                q = order[k : min(k + TILE, hi)]
                found = _Tile(self, days[q], ticker[q], regime[q], z[q]).search(int(group[q[0]]))
                if found is not None:
                    yield q, *found


def _leaves(group: np.ndarray, days: np.ndarray, z: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows by group, and where each leaf of at most size rows starts in it, with the end. Rows of a leaf have one
    group and lie close together in days and features; those with all features known have leaves of their own."""
    x = z * np.sqrt(weight)
    unknown = np.isnan(z)
    form = np.zeros(len(z), np.int64)
    some = np.flatnonzero(unknown.any(1))
    _, code, many = np.unique(np.packbits(unknown[some], axis=1), axis=0, return_inverse=True, return_counts=True)
    form[some] = np.where(many[code.ravel()] >= size, code.ravel() + 2, 1)  # forms of few rows lie together
    x[unknown] = 0
    order = np.lexsort((form, group))
    cuts = np.flatnonzero(np.r_[True, (group[order][1:] != group[order][:-1]) | (form[order][1:] != form[order][:-1])])
    starts = []

    def cut(lo: int, hi: int, by_day: int) -> None:
        if hi - lo <= size:
            starts.append(lo)
            return
        rows = order[lo:hi]
        mid = (hi - lo) // 2
        values = days[rows]
        if by_day <= 0 or values[0] == values[-1] == values[mid]:
            some = x[rows[:: max(1, (hi - lo) // 256)]]
            values = x[rows, np.argmax(np.ptp(np.clip(some, *np.quantile(some, (0.1, 0.9), axis=0)), axis=0))]
        order[lo:hi] = rows[np.argpartition(values, mid)]
        cut(lo, lo + mid, by_day - 1)
        cut(lo + mid, hi, by_day - 1)

    for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)]):
        cut(int(lo), int(hi), 2)
    return order, np.r_[np.array(starts, np.int64), len(order)]


class _Tile:
    """Up to TILE queries of one setup and regime, and their analogues so far: row of the query, distance and rank of the
    record's id, in this order."""

    def __init__(self, block: _Block, days: np.ndarray, ticker: np.ndarray, regime: np.ndarray, z: np.ndarray) -> None:
        self.b, self.days, self.ticker, self.regime = block, days, ticker, regime
        self.known, self.x = ~np.isnan(z), np.nan_to_num(z)
        self.full = self.known.all(1)
        self.near, self.share = (self.x - block.centre) * self.known, self.known @ block.weight
        self.size = self.near**2 @ block.weight
        self.row, self.dist, self.rank = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.limit = np.full(len(days), np.inf)
        self.same = np.full(len(days), -SAME_TICKER)  # how much nearer than by its features a record to be searched may lie

    def search(self, group: int) -> tuple | None:
        b = self.b
        setup, own = divmod(group, REGIMES + 1)
        lo, hi = np.searchsorted(b.leaf_group, [setup * (REGIMES + 1), (setup + 1) * (REGIMES + 1)])
        leaves = np.arange(lo, hi)
        mine = leaves[b.leaf_group[lo:hi] == group]
        corner = self._corners(mine)
        self._guess(mine, corner)
        self._own_ticker(setup)
        done = np.full((len(self.days), 1), -1, corner.dtype)
        for nearest in (8 * NEAR, len(mine)):  # near ones first, as T shrinks
            if nearest < len(mine) // 2 or nearest == len(mine):
                upto = np.partition(corner, nearest, axis=1)[:, nearest, None] if nearest < len(mine) else np.inf
                self._leaves(mine, corner, 0.0, (corner > done) & (corner <= upto))
                done = upto
        others = leaves[b.leaf_group[lo:hi] != group]
        if len(others):
            self._leaves(others, self._corners(others), REGIME_PENALTY)
        if not len(self.row):
            return None
        col = b.by_id[self.rank]
        shared = (b.known.take(col, 0) & self.known.take(self.row, 0)).sum(1)
        return self.row, col, self.dist, shared, _place(self.row) + 1

    def _corners(self, leaves: np.ndarray) -> np.ndarray:
        """For each query and leaf the weighted sum over the features of the distance squared to the leaf, not too large; infinite
        where the leaf has no earlier session."""
        b = self.b
        out = np.full((len(self.days), len(leaves)), np.inf, b.coarse)
        x = (self.x * b.root).clip(-1e18, 1e18).astype(b.coarse) if b.coarse == np.float32 else self.x * b.root
        for k in range(0, len(out), 64):
            days, y, known = self.days[k : k + 64, None], x[k : k + 64], self.known[k : k + 64]
            can = np.flatnonzero(b.leaf_day[leaves] < days.max())
            middle, half = b.middle[:, leaves[can]], b.half[:, leaves[can]]
            total = np.zeros((len(y), len(can)), b.coarse)
            gap = np.empty_like(total)
            for j in range(len(half)):
                np.subtract(y[:, j, None], middle[j], out=gap)
                np.abs(gap, out=gap)
                gap -= half[j]
                np.maximum(gap, 0, out=gap)
                gap *= gap
                if not known[:, j].all():
                    gap[~known[:, j]] = 0
                total += gap
            total *= 1 - 1e-5
            np.minimum(total, FAR, out=total)
            total[b.leaf_day[leaves[can]][None] >= days] = np.inf
            out[k : k + 64, can] = total
        return out

    def _reach(self, extra: float) -> np.ndarray:
        return self.limit - extra + self.same + 1e-8

    def _room(self, extra: float) -> np.ndarray:
        """The weighted sum of squares within the queries' reach, infinite where all is; -1 where nothing is."""
        reach = self._reach(extra)
        return np.where(reach >= 0, reach**2 * self.share * (1 + 1e-6), -1).clip(max=1.1 * FAR)

    def _leaves(self, leaves: np.ndarray, corner: np.ndarray, extra: float, among: np.ndarray | None = None) -> None:
        """Takes in the records of the leaves that the queries reach."""
        b, w, f = self.b, self.b.weight, len(self.b.weight)
        k = 0
        while k < len(leaves):
            reach, t2 = self._reach(extra), self._reach(extra) ** 2
            none = np.isinf(reach)
            t2[none] = 0
            can = corner[:, k:] <= self._room(extra)[:, None]
            if among is not None:
                can &= among[:, k:]
            can = np.ascontiguousarray(can.T)
            share = w * self.known
            slack = b.unit * (2 * self.size + t2 * w.sum())
            long = np.concatenate([share * (self.near**2 - t2[:, None]), -2 * share * self.near, share, -slack[:, None], np.ones((len(t2), 1))], axis=1)
            long[none] = 0  # all pass
            long, short = long.astype(b.kind), {}
            got, count, at = [], 0, k
            for k in range(k, len(leaves)):
                rows = np.flatnonzero(can[k - at])
                if not len(rows):
                    continue
                lo, hi, form = b.starts[leaves[k]], b.starts[leaves[k] + 1], b.form[leaves[k]]
                whole = self.full[rows] if form[0] == form[0] else np.zeros(len(rows), bool)
                all_ = whole.all()
                new = [] if all_ else self._passing(rows[~whole], long, b.columns, lo, hi)
                if all_ or whole.any():
                    mine = short.get(form.tobytes())
                    if mine is None:  # these records' shared features are the ones that they know
                        v = w * form
                        mine = np.concatenate([-2 * v * self.near, (self.near**2 @ v - t2 * v.sum() - slack)[:, None], np.ones((len(t2), 1))], axis=1)
                        mine[none] = 0
                        mine = short[form.tobytes()] = mine.astype(b.kind)
                    new += self._passing(rows if all_ else rows[whole], mine, b.short, lo, hi)
                got += new
                count += sum(len(x[0]) for x in new)
                if count >= MOST:
                    break
            k += 1
            if got:
                r, c, v = (np.concatenate(x) for x in zip(*got))
                ok = np.flatnonzero((b.days.take(c) < self.days.take(r)) & ((self.same.take(r) > 0) | (b.ticker.take(c) != self.ticker.take(r))))
                self._nearest(r.take(ok), c.take(ok), v.take(ok), np.where(none, np.inf, t2), extra)

    def _nearest(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, t2: np.ndarray, extra: float) -> None:
        """Takes in those of the pairs that lie within the limits, the likely nearest ones first. value: what was found not to be
        above 0, with t2 for T squared."""
        b, steps = self.b, 64
        share = np.maximum(self.share[row] + b.share[col] - b.weight.sum(), 1e-3)  # not more than the shared features' weights
        with np.errstate(invalid="ignore"):
            step = np.clip(steps * (1 + value / (share * np.maximum(t2[row], 1e-12))), 0, steps - 1)
        step = np.where(np.isfinite(step), step, 0).astype(np.int64)
        many = np.bincount(row * steps + step, minlength=len(t2) * steps).reshape(-1, steps).cumsum(1)
        last = (many < 2 * b.n).sum(1)
        first = step <= last[row]
        self._settle(*self._exact(row[first], col[first]))
        row, col, value, share = (x[~first] for x in (row, col, value, share))
        if len(row):
            now = np.maximum(self._reach(extra), 0) ** 2
            ok = value <= np.where(np.isinf(t2), np.inf, now - np.where(np.isinf(t2), 0, t2))[row] * share
            self._settle(*self._exact(row[ok], col[ok]))

    def _passing(self, rows: np.ndarray, queries: np.ndarray, records: np.ndarray, lo: int, hi: int) -> list:
        """Pairs of the rows and the records lo to hi of which the product is not above 0, and the product."""
        b, out = self.b, []
        if not len(rows):
            return out
        a = queries.take(rows, 0)
        for lo in range(lo, hi, COLUMNS):
            width = min(COLUMNS, hi - lo)
            size = len(rows) * width
            np.matmul(a, records[:, lo : lo + width], out=b.values[:size].reshape(len(rows), width))
            np.less_equal(b.values[:size], 0, out=b.passed[:size])
            up = -(-size // 8) * 8
            b.passed[size:up] = False
            words = np.flatnonzero(b.passed[:up].view(np.uint64))  # eight at once, as few pass
            if len(words):
                j = np.flatnonzero(b.passed[:up].view(np.uint64).take(words).view(bool))
                place = (words * 8).take(j >> 3) + (j & 7)
                r = place // width
                out.append((rows.take(r), place - r * width + lo, b.values.take(place)))
        return out

    def _own_ticker(self, setup: int) -> None:
        """Takes in the earlier records of the queries' tickers, unless they are many."""
        b = self.b
        lo, hi = (np.searchsorted(b.ticker_key, self.ticker.astype(np.int64) * b.setups + setup, side) for side in ("left", "right"))
        many = hi - lo
        rows = np.flatnonzero(many <= OWN)
        self.same[rows] = 0
        r = np.repeat(rows, many[rows])
        c = b.by_ticker[np.repeat(lo[rows], many[rows]) + _place(r)]
        ok = b.days[c] < self.days[r]
        if ok.any():
            self._settle(*self._exact(r[ok], c[ok]))

    def _exact(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, distance and rank of those pairs that share enough and lie within the row's limit."""
        b = self.b
        out, whole = [], 0.0
        for w in b.weight:  # in the order of the sums
            whole += w
        for k in range(0, max(len(row), 1), 4_000):
            r, c = row[k : k + 4_000], col[k : k + 4_000]
            full = b.full.take(c) & self.full.take(r)
            square = b.x.take(c, 0)
            square -= self.x.take(r, 0)
            square *= square
            square *= b.weight
            total, norm = np.zeros(len(r)), np.full(len(r), whole)
            part = np.flatnonzero(~full)
            both = b.known.take(c[part], 0) & self.known.take(r[part], 0)
            square[part] *= both
            for j in range(len(b.weight)):
                total += square[:, j]
            some = np.zeros(len(part))
            for j in range(len(b.weight)):
                some += both[:, j] * b.weight[j]
            norm[part] = some
            enough = np.full(len(r), len(b.weight) >= SHARED)
            enough[part] = both.sum(1) >= SHARED
            with np.errstate(all="ignore"):
                dist = np.sqrt(total / norm) + (REGIME_PENALTY * (self.regime.take(r) != b.regime.take(c)) + SAME_TICKER * (self.ticker.take(r) == b.ticker.take(c)))
            dist = np.round(np.maximum(dist, 0), 9)
            ok = np.flatnonzero(enough & (dist <= self.limit.take(r)))
            out.append((r.take(ok), dist.take(ok), b.rank.take(c.take(ok))))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _guess(self, leaves: np.ndarray, corner: np.ndarray) -> None:
        """First limits of the queries, from the nearest few records of the nearest leaves: what more records bring is only nearer."""
        b, f, few = self.b, len(self.b.weight), 3 * self.b.n
        if not len(leaves):
            return
        m = min(max(1, FIRST // LEAF), len(leaves))
        near = np.argpartition(corner, m - 1, axis=1)[:, :m]
        order = np.argsort(near, axis=None, kind="stable")
        row, place = np.divmod(order, m)
        of = near.ravel()[order]
        width = np.diff(b.starts)[leaves].max()
        share = b.weight * self.known
        a = np.concatenate([share * self.near**2, -2 * share * self.near, share], axis=1).astype(b.kind)
        short = np.concatenate([-2 * share * self.near, self.size[:, None], np.ones((len(share), 1))], axis=1).astype(b.kind)
        share = share.astype(b.kind)
        rough = np.full((len(corner), m, width), np.inf, b.kind)
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        with np.errstate(all="ignore"):
            for i, j in zip(cuts, cuts[1:]):
                leaf, r = leaves[of[i]], row[i:j]
                lo, hi = b.starts[leaf], b.starts[leaf + 1]
                if b.form[leaf].all() and self.full[r].all():  # not nan, not 0
                    values = short[r] @ b.short[:, lo:hi] / share[0].sum()
                else:
                    records = b.columns[: 3 * f, lo:hi]
                    values = (a[r] @ records) / (share[r] @ records[:f])
                values[np.isnan(values) | (b.days[lo:hi][None] >= self.days[r][:, None])] = np.inf
                rough[r, place[i:j], : hi - lo] = values
        rough = rough.reshape(len(corner), -1)
        few = min(few, rough.shape[1])
        c = np.argpartition(rough, few - 1, axis=1)[:, :few]
        r, c = np.repeat(np.arange(len(c)), few), c.ravel()
        ok = np.isfinite(rough[r, c])
        r, c = r[ok], c[ok]
        row, dist, rank = self._exact(r, b.starts[leaves[near[r, c // width]]] + c % width)
        row, dist, _ = self._capped(row, dist, rank)
        self.limit = np.minimum(self.limit, self._limits(row, dist))

    def _settle(self, row: np.ndarray, dist: np.ndarray, rank: np.ndarray) -> None:
        self.row, self.dist, self.rank = self._capped(np.r_[self.row, row], np.r_[self.dist, dist], np.r_[self.rank, rank])
        self.limit = np.minimum(self.limit, self._limits(self.row, self.dist))

    def _limits(self, row: np.ndarray, dist: np.ndarray) -> np.ndarray:
        out = np.full(len(self.limit), np.inf)
        last = _place(row) == self.b.n - 1
        out[row[last]] = dist[last]
        return out

    def _capped(self, row: np.ndarray, dist: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs in order of row, distance and id, as far as both caps and n let them in."""
        b = self.b
        whole = np.rint(dist * 1e9)
        room = 52 - b.bits  # TILE rows take eleven of 63 bits
        if room > 0 and (not len(whole) or whole.max() < 2.0**room):
            key = row << (b.bits + room) | whole.astype(np.int64) << b.bits | rank
            key.sort()
            row, dist, rank = key >> (b.bits + room), (key >> b.bits & ((1 << room) - 1)) / 1e9, key & ((1 << b.bits) - 1)
        else:
            order = np.lexsort((rank, dist, row))
            row, dist, rank = row[order], dist[order], rank[order]
        col = b.by_id[rank]
        ticker = b.ticker[col].astype(np.int64)
        key = (row * (ticker.max(initial=0) + 1) + ticker) << 24 | np.arange(len(row))
        key.sort()
        of, place = key >> 24, key & ((1 << 24) - 1)
        nth = _place(of)
        crowd = np.isin(of, of[nth == PER_DAY]) if (nth == PER_DAY).any() else np.zeros(len(of), bool)
        keep = np.ones(len(row), bool)
        if crowd.any():  # only tickers of more records than a day may have can be capped
            of, place = of[crowd], place[crowd]
            days = b.days[col[place]].astype(np.int64)
            ok = _nth(of * (days.max() - days.min() + 1) + days - days.min()) < PER_DAY
            keep[place[~ok]] = False
            of, place = of[ok], place[ok]
            keep[place[_place(of) >= PER_TICKER]] = False
        row, dist, rank = row[keep], dist[keep], rank[keep]
        first = _place(row) < b.n
        return row[first], dist[first], rank[first]


def _place(group: np.ndarray) -> np.ndarray:
    """How many rows before it the row's group has, where groups lie together."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))


def _nth(group: np.ndarray) -> np.ndarray:
    """How many earlier rows have the row's group."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return out


def setups(records: DataFrame) -> DataFrame:
    """For each record and setup (direction|entry_type) its best valid scenario: by tier (PREFERRED, SECONDARY, other), then
    rank, then id. record_id, setup, scenario fields."""
    tier = F.when(F.upper("selection_tier") == "PREFERRED", 0).when(F.upper("selection_tier") == "SECONDARY", 1).otherwise(2)
    s = scenario_rows(records).filter("structurally_valid").withColumn("setup", F.concat_ws("|", F.lower("direction"), F.lower("entry_type")))
    best = s.groupBy("record_id", "setup").agg(F.min(F.struct(
        tier.alias("tier"), F.col("scenario_rank"), "scenario_id", "selection_tier", "triggered", "primary_outcome", "t1_before_stop", "resolved_r"
    )).alias("s"))
    return best.select("record_id", "setup", "s.scenario_id", "s.selection_tier", "s.triggered", "s.primary_outcome", "s.t1_before_stop", "s.resolved_r")


def candidate_evidence(evidence: DataFrame, records: DataFrame, stats: DataFrame, n: int = 24) -> DataFrame:
    """For each distinct evidence row, what came of the n analogues of its record with its setup: numbers, rates, results and
    mean distance, from the best scenario of the setup of each analogue."""
    r = distinct_records(records).select("record_id", "ticker", "session_date_et", "regime", "features")
    s = setups(records)
    e = evidence.filter("evidence_id is not null and query_record_id is not null").groupBy("evidence_id").agg(
        F.first("query_record_id").alias("record_id"), F.concat_ws("|", F.lower(F.first("direction")), F.lower(F.first("entry_type"))).alias("setup")
    )
    near = analogues(r.join(s.select("record_id", "setup"), "record_id"), e.join(r, "record_id").withColumnRenamed("evidence_id", "query"), stats, n)
    who = e.join(r.select("record_id", F.col("ticker").alias("q_ticker")), "record_id").select(F.col("evidence_id").alias("query"), "setup", "q_ticker")
    x = near.join(who, "query").join(s, ["record_id", "setup"]).join(r.select("record_id", "ticker"), "record_id")
    t1 = F.coalesce(F.col("t1_before_stop"), F.lit(False)) | F.coalesce(F.upper("primary_outcome") == "T1_BEFORE_STOP", F.lit(False))
    value, total = F.col("resolved_r").cast("double"), F.sum("resolved_r").cast("double")  # decimal sums are exact in any order
    rate = lambda a, b: clean.half_even(F.try_divide(a.cast("double"), b), 4)
    triggered, stops, wins = F.count_if("triggered"), F.count_if(F.upper("primary_outcome") == "STOP_BEFORE_T1"), F.count_if(t1)
    return x.groupBy(F.col("query").alias("evidence_id")).agg(
        F.count(F.lit(1)).alias("returned"), clean.half_even(F.avg("distance"), 4).alias("average_distance"), F.count_if(F.col("ticker") == F.col("q_ticker")).alias("same_ticker"),
        F.count("triggered").alias("known_trigger"), triggered.alias("triggered"), rate(triggered, F.count("triggered")).alias("trigger_rate"), wins.alias("t1"), stops.alias("stops"),
        F.count("resolved_r").alias("resolved"), F.count_if(F.col("resolved_r") > 0).alias("positive"), F.count_if(F.col("resolved_r") < 0).alias("negative"),
        rate(total, F.count("resolved_r")).alias("mean_r"), clean.half_even(F.median(value), 4).alias("median_r"), rate(wins, wins + stops).alias("t1_rate_if_resolved"),
        clean.half_even(F.try_divide(F.coalesce(total, F.lit(0.0)), triggered), 4).alias("expectancy"),
        F.count_if(F.upper("selection_tier") == "PREFERRED").alias("preferred"), F.count_if(F.upper("selection_tier") == "SECONDARY").alias("secondary"),
    )


COUNTED = ["scenarios", "preferred", "secondary", "triggered", "t1_first", "stop_first", "resolved"]


def setup_aggregates(records: DataFrame, queries: DataFrame | None, stats: DataFrame, n: int = 24) -> DataFrame:
    """For each query (None: all records) and setup, the valid scenarios of the query's analogues: numbers and results.

    Where one task sees all records, it also sums up: the scenarios go with their records, and no analogue is written."""
    upper = lambda c: F.upper(c)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    form = lambda s: F.struct(
        F.lower(s["direction"]).alias("direction"), F.lower(s["entry_type"]).alias("entry_type"), one(upper(s["selection_tier"]) == "PREFERRED").alias("preferred"), one(upper(s["selection_tier"]) == "SECONDARY").alias("secondary"),
        one(s["triggered"]).alias("triggered"), one(s["t1_before_stop"]).alias("t1_first"), one(upper(s["primary_outcome"]) == "STOP_BEFORE_T1").alias("stop_first"), s["resolved_r"].alias("resolved_r"),
    )
    search = _Search(records, queries, stats, n, F.transform(F.filter("scenarios", lambda s: s["structurally_valid"]), form))
    kind = records.schema["scenarios"].dataType.elementType["resolved_r"].dataType
    if search.blocks == 1 and isinstance(kind, DecimalType) and kind.precision <= 18:
        sums = search.each(_summed(kind.scale), f"query bigint, direction string, entry_type string, {', '.join(f'{c} bigint' for c in COUNTED)}, total decimal(28,{kind.scale})")
        return sums.select("query", "direction", "entry_type", *COUNTED, clean.half_even(F.try_divide(F.col("total").cast("double"), F.col("resolved")), 3).alias("mean_r"))
    near = analogues(records.drop("scenarios"), queries, stats, n).select("query", "record_id")
    s = scenario_rows(records).filter("structurally_valid").select("record_id", F.lower("direction").alias("direction"), F.lower("entry_type").alias("entry_type"), "selection_tier", "triggered", "t1_before_stop", "primary_outcome", "resolved_r")
    return near.join(s, "record_id").groupBy("query", "direction", "entry_type").agg(
        F.count(F.lit(1)).alias("scenarios"), F.count_if(upper("selection_tier") == "PREFERRED").alias("preferred"), F.count_if(upper("selection_tier") == "SECONDARY").alias("secondary"),
        F.count_if("triggered").alias("triggered"), F.count_if("t1_before_stop").alias("t1_first"), F.count_if(upper("primary_outcome") == "STOP_BEFORE_T1").alias("stop_first"),
        F.count("resolved_r").alias("resolved"), clean.half_even(F.try_divide(F.sum("resolved_r").cast("double"), F.count("resolved_r")), 3).alias("mean_r"),
    )


def _summed(scale: int) -> Callable:
    """Sums of the carried scenarios of a tile's analogues by query and setup; decimals as two halves, exact at any size."""
    held: dict = {}

    def prepare(carried: pa.Table) -> tuple:
        lists = pa.concat_arrays(carried.column("carried").chunks)
        s = lists.flatten()
        many = lists.value_lengths().fill_null(0).to_numpy()
        setup = [s.field(c).dictionary_encode() for c in ("direction", "entry_type")]
        a, b = (e.indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for e in setup)
        known = s.field("resolved_r").is_valid().to_numpy(zero_copy_only=False)
        r = s.field("resolved_r").cast(pa.decimal128(28, scale)).fill_null(0)
        low = np.frombuffer(r.buffers()[1], np.int64)[2 * r.offset : 2 * (r.offset + len(r)) : 2]  # with 18 digits one word holds all
        flags = [s.field(c).to_numpy(zero_copy_only=False).astype(np.int8) for c in COUNTED[1:-1]]
        counted = np.stack([np.ones(len(s), np.int8), *flags, known.astype(np.int8)], axis=1)
        return many, np.cumsum(many) - many, a * (len(setup[1].dictionary) + 1) + b, [e.dictionary for e in setup], counted, low.copy()

    def make(carried: pa.Table, ids: np.ndarray, block: _Block, tile: tuple) -> pa.RecordBatch:
        q, row, col = tile[:3]
        if "of" not in held or held["of"] is not carried:
            held.update(of=carried, ready=prepare(carried))
        many, start, code, names, counted, value = held["ready"]
        record = block.order[col]
        row = np.repeat(row, many[record])
        at = np.repeat(start[record] - np.r_[0, np.cumsum(many[record])[:-1]], many[record]) + np.arange(len(row))
        key = row * ((len(names[0]) + 1) * (len(names[1]) + 1)) + code[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        value = value[at]
        sums, high, low = (np.add.reduceat(x, first, dtype=np.int64) if len(key) else x[:0].astype(np.int64) for x in (counted[at], value >> 32, value & 0xFFFFFFFF))
        high, low = high + (low >> 32), low & 0xFFFFFFFF
        words = np.ascontiguousarray(np.stack([(high & 0xFFFFFFFF) << 32 | low, high >> 32], axis=1))
        total = pa.Array.from_buffers(pa.decimal128(28, scale), len(first), [None, pa.py_buffer(words)])
        a, b = np.divmod(code[at[first]], len(names[1]) + 1)
        setup = [x.take(pa.array(c - 1, mask=c == 0)) for x, c in zip(names, (a, b))]
        out = [pa.array(ids[q][row[order][first]]), *setup, *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(len(COUNTED))), total]
        return pa.RecordBatch.from_arrays(out, ["query", "direction", "entry_type", *COUNTED, "total"])

    return make


def with_fallback(rows: DataFrame, lookup: DataFrame, key: str, rank: str, ordinal: str, value: str) -> DataFrame:
    """rows with a value looked up by (key, rank) where the rank is positive and found, else by (key, place): lookup has key,
    rank, ordinal (from 1) and the value; of repeated ranks the last place counts."""
    by_rank = lookup.filter(F.col(rank) > 0).groupBy(key, rank).agg(F.max_by(value, ordinal).alias("_r"), F.lit(True).alias("_has"))
    by_place = lookup.groupBy(key, ordinal).agg(F.max_by(value, ordinal).alias("_o"))
    x = rows.join(by_rank, [key, rank], "left").join(by_place, [key, ordinal], "left")
    return x.withColumn(value, F.when(F.col("_has"), F.col("_r")).otherwise(F.col("_o"))).drop("_r", "_o", "_has")
