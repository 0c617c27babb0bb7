"""Most similar vectors, by collision-counting hashing.

A vector is projected on single directions, and each projection is kept as a sorted array. A query opens a window
around its own value in every array; virtual rehashing widens the windows step by step instead of building new tables. A
vector that lies in the windows of enough arrays (the collision threshold) is verified by its exact distance.

The distance of two vectors is the root mean square of their differences over the components known in both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.ordered import parts_for, written

#: Rows of a cell that are matched as one block.
CELL = 20_000
#: Projections in which a pair need not collide.
SPARE = 3
#: Equal vectors that meet as one part when their pairs are written.
COPIES = 2_000


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row for each id: id bigint, vec array<double>. Rows without id, vector or any known component are left out; of rows
    that repeat an id one is kept."""
    known = F.size(F.filter("vec", lambda x: x.isNotNull() & ~F.isnan(x))) > 0
    return vectors.select(F.col("id").cast("bigint"), F.col("vec").cast("array<double>")).filter(F.col("id").isNotNull() & known).dropDuplicates(["id"])


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != dims * len(col):
        raise ValueError(f"every vector must have {dims} components, null where unknown")
    return flat.reshape(-1, dims)


def _distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of shared components of rows of a and b; summed in the order of the components."""
    d = (a - b) ** 2
    known = ~np.isnan(d)
    n = known.sum(-1)
    with np.errstate(all="ignore"):
        return np.sqrt(np.where(known, d, 0).sum(-1) / n), n


def _basis(dims: int, seed: int) -> np.ndarray:
    """A random orthonormal basis."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def class_pairs(vectors: DataFrame, dims: int, radius: float, least_shared: int, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The similar pairs between classes of equal vectors, which stand for all pairs: (id_a, id_b, distance, shared) of the
    classes' smallest ids; the members (id, vec); and the classes (vec, id, n). A class of n equal vectors is one row here,
    whatever n is. See similar_pairs."""
    groups = max(1, dims - least_shared + 1)
    parts = [list(range(g, dims, groups)) for g in range(groups)]
    bases = [_basis(len(p), seed + g) for g, p in enumerate(parts)]
    half = radius * dims**0.5 * (1 + 1e-9) + 1e-12
    narrow = half / (SPARE + 1) ** 0.5
    width = 8 * half
    spark = vectors.sparkSession
    members = written(distinct_vectors(vectors).withColumn("vec", F.transform("vec", lambda x: F.when(~F.isnan(x), x + F.lit(0.0)))), "vectors")
    classes = written(members.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    rows = classes.count()

    def hashes(z: np.ndarray) -> np.ndarray:
        """The projections of all groups, NaN where a component of the group is unknown."""
        out = np.empty_like(z)
        for p, b in zip(parts, bases):
            out[:, p] = z[:, p] @ b.T
        return out

    def cells(z: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Group, rows, cell key and whether the row is at home there."""
        h = hashes(z)
        for g, p in enumerate(parts):
            at = np.flatnonzero(~np.isnan(h[:, p]).any(1))
            route = p[: max(1, min(3, len(p) - 1))]
            low, high = (np.floor((h[at][:, route] + s) / width).astype(np.int64) for s in (-half, half))
            mine = np.floor(h[at][:, route] / width).astype(np.int64)
            for corner in range(2 ** len(route)):
                pick = np.array([corner >> j & 1 for j in range(len(route))], bool)
                c = np.where(pick, high, low)
                first = ~((low == high) & pick).any(1)  # each cell once
                key = np.full(first.sum(), g, np.uint64)
                for j in range(len(route)):
                    key = (key ^ c[first, j].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield g, at[first], key.view(np.int64), (c[first] == mine[first]).all(1)

    def homes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [k[home] for _, _, k, home in cells(_matrix(b.column("vec"), dims))]
            u, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["cell", "n"])

    counted = classes.select("vec").mapInArrow(homes, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    # at most one cell for each CELL vectors and group
    found = sorted((r["cell"], -(-r["n"] // CELL)) for r in counted.filter(F.col("n") > CELL).collect())
    crowded, dealt = np.array([k for k, _ in found], np.int64), np.array([m for _, m in found] + [1], np.int64)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "block", "grp", "home", "id", "n", "vec"]
        for b in batches:
            ids, z = b.column("id").to_numpy(), _matrix(b.column("vec"), dims)
            raw = z.astype("<f8").view(f"V{8 * dims}").ravel()
            for g, at, key, home in cells(z):
                slot = np.searchsorted(crowded, key)
                hit = np.isin(key, crowded)
                blocks = np.where(hit, dealt[np.where(hit, slot, -1)], 1)
                own = (ids[at] % 1_000_003 * 7919 % 1_000_003) % blocks
                asks = np.repeat(np.arange(len(key)), blocks)  # asked in every block, kept in its own
                block = np.arange(len(asks)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                kept = home[asks] & (block == own[asks])
                vec = pa.array([x.tobytes() for x in raw[at[asks]]], pa.binary())
                data = [key[asks], block, np.full(len(asks), g), kept, ids[at[asks]], b.column("n").to_numpy()[at[asks]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in data] + [vec], names)

    routed = classes.select("id", "n", "vec").mapInArrow(route, "cell bigint, block bigint, grp bigint, home boolean, id bigint, n bigint, vec binary")
    n_parts = parts_for(spark, 2 * groups * rows, 200_000)

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held or not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        cell, block, grp, ids = (t.column(c).to_numpy() for c in ("cell", "block", "grp", "id"))
        kept = t.column("home").to_numpy()
        z = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(-1, dims)
        h = hashes(z)
        line = np.choose(grp, [h[:, p[-1]] for p in parts])  # the sorted array of each row's group
        place = np.lexsort((line, block, cell))
        new = np.r_[True, (np.diff(cell[place]) != 0) | (np.diff(block[place]) != 0)]
        table = np.empty(len(place), np.int64)
        table[place] = np.cumsum(new) - 1
        data = place[kept[place]]
        # one key that grows with (table, line): tables lie further apart than any two values
        step = float(np.ptp(line)) + 4 * half
        key = table[data] * step + line[data]
        slack = np.finfo(float).eps * abs(float(key[-1] if len(key) else 0)) * 4
        q = table * step + line
        lo, hi = np.searchsorted(key, q - half - slack, "left"), np.searchsorted(key, q + half + slack, "right")
        begin = 0
        todo = np.argsort(lo, kind="stable")
        size = np.cumsum((hi - lo)[todo])
        while begin < len(todo):
            stop = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + 2_000_000, "right")))
            part = todo[begin:stop]
            begin = stop
            many = hi[part] - lo[part]
            a = np.repeat(part, many)
            b = data[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[part], many)]
            ok = (ids[a] < ids[b]) & (table[a] == table[b])
            a, b = a[ok], b[ok]
            missed = np.zeros(len(a), np.int8)  # of the projections that both have, those that do not collide
            for j in range(dims):
                missed += np.abs(h[a, j] - h[b, j]) > narrow
            ok = missed <= SPARE
            a, b = a[ok], b[ok]
            first = np.full(len(a), -1)
            for g in range(groups - 1, -1, -1):
                first[~np.isnan(h[a][:, parts[g]] + h[b][:, parts[g]]).any(1)] = g
            ok = first == grp[a]  # a pair counts in the first group that both know
            a, b = a[ok], b[ok]
            d, shared = _distance(z[a], z[b])
            ok = (d <= radius) & (shared >= least_shared)
            a, b = a[ok], b[ok]
            out = [ids[a], ids[b], d[ok], shared[ok].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["id_a", "id_b", "distance", "shared"])

    pairs = routed.repartition(n_parts, "cell", "block").mapInArrow(match, "id_a bigint, id_b bigint, distance double, shared bigint")
    return pairs, members, classes


def similar_pairs(vectors: DataFrame, dims: int, radius: float, least_shared: int, seed: int = 7) -> DataFrame:
    """All pairs of vectors with at least least_shared components known in both and a distance of at most radius: id_a < id_b,
    distance, shared.

    The components are dealt into dims - least_shared + 1 groups, so that any such pair has a group that both know fully. In
    each group the projections on an orthonormal basis are the hash functions. The first ones route the vectors: a vector is
    kept in one cell of a grid on them and asks in each cell its window reaches. In a cell the last projection of the group is
    the sorted array that the windows are cut from, radius * sqrt(dims) to either side, which no such pair exceeds. Collisions
    are then counted over the projections that both have, in windows of radius * sqrt(dims / (SPARE + 1)): the squares of
    the differences add up to radius^2 * dims at most, so no more than SPARE of them lie outside, and what collides in all
    but SPARE is verified by distance. None is lost. Cells of more than CELL vectors are dealt into blocks that are asked
    apart, so a crowded cell is spread over tasks. Equal vectors are taken together (one representative, see `classes`), and
    only their pairs are written out one by one.

    Nulls: see distinct_vectors. An empty table gives no rows.
    """
    pairs, members, classes = class_pairs(vectors, dims, radius, least_shared, seed)
    # members of the classes: of two different ones, and within one
    shared = F.size(F.filter("vec", lambda x: x.isNotNull()))
    of = members.join(classes.filter("n > 1").select("vec", F.col("id").alias("head"), F.ceil(F.col("n") / COPIES).cast("int").alias("parts")), "vec")
    of = of.select("head", "id", shared.cast("bigint").alias("shared"), "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    each = of.select("head", F.col("id").alias("member"))
    wide = pairs.join(each.withColumnRenamed("head", "id_a").withColumnRenamed("member", "m_a"), "id_a", "left").join(
        each.withColumnRenamed("head", "id_b").withColumnRenamed("member", "m_b"), "id_b", "left"
    )
    x, y = F.coalesce("m_a", "id_a"), F.coalesce("m_b", "id_b")
    across = wide.select(F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"), "distance", "shared")
    # a class of many copies is dealt into parts, and its members meet a part at a time
    asks = of.filter(F.col("shared") >= least_shared).select("head", F.col("id").alias("id_a"), "shared", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    within = asks.join(of.select("head", "part", F.col("id").alias("id_b")), ["head", "part"]).filter(F.col("id_a") < F.col("id_b"))
    return across.unionAll(within.select("id_a", "id_b", F.lit(0.0).alias("distance"), "shared"))


def links(vectors: DataFrame, dims: int, radius: float, least_shared: int, seed: int = 7) -> DataFrame:
    """One row for each vector: id, class (the smallest id of the vectors equal to it) and links, the number of other vectors
    that similar_pairs pairs it with. Pairs are counted between classes, so equal vectors cost no more than one."""
    pairs, members, classes = class_pairs(vectors, dims, radius, least_shared, seed)
    both = pairs.select(F.col("id_a").alias("head"), F.col("id_b").alias("other")).unionAll(pairs.select("id_b", "id_a"))
    size = classes.select(F.col("id").alias("other"), "n")
    across = both.join(size, "other").groupBy("head").agg(F.sum("n").alias("across"))
    within = F.when(F.size(F.filter("vec", lambda x: x.isNotNull())) >= least_shared, F.col("n") - 1).otherwise(F.lit(0))
    of = classes.select("vec", F.col("id").alias("head"), within.alias("within")).join(across, "head", "left")
    of = of.select("vec", F.col("head").alias("class"), (F.col("within") + F.coalesce("across", F.lit(0))).alias("links"))
    return members.join(of, "vec").select("id", "class", "links")


#: Half-width of a window over the radius that it is to cover, and the share of the arrays known to both in whose windows a
#: vector must lie to be verified. A vector within the radius lies in a window with probability 0.77.
REACH, THRESHOLD = 1.2, 2 / 3
#: The first radius, and by how much virtual rehashing widens it each time.
START, WIDEN = 0.25, 1.3
#: Half-width of a window over the radius in the arrays that the vectors are partitioned by.
ROUTE = 1.5
#: Vectors of a leaf, leaves at most (beyond them leaves hold more), and vectors of the sample that the splits are taken from,
#: for each leaf and in all at least.
LEAF, LEAVES, SAMPLE = 2_000, 1 << 16, (8, 50_000)
#: Pairs of a query and a vector of a leaf that are looked at side by side, and queries that are held at most.
PAIRS, ASKS = 4_000_000, 20_000


class Splits:
    """A partition of vectors by ranges of single components: each node splits the sorted array of one component in its middle.
    A vector that does not know the component lies on both sides, and a query that does not know it asks on both."""

    def __init__(self, z: np.ndarray, leaves: int):
        self.comp, self.at, self.child = [], [], []
        self.leaves = 0
        self._grow(z, np.arange(len(z)), leaves)

    def _grow(self, z: np.ndarray, rows: np.ndarray, leaves: int) -> int:
        x = z[rows]
        if leaves > 1 and len(rows) > 1:
            known = ~np.isnan(x)
            with np.errstate(all="ignore"):
                spread = np.where(known.sum(0) > 1, np.nanstd(np.where(known.any(0), x, 0.0), 0), 0) * known.mean(0) ** 2
            j = int(np.argmax(spread))
            at = float(np.nanmedian(x[:, j])) if spread[j] > 0 else np.inf
            if (x[:, j] > at).any():
                node = len(self.comp)
                self.comp.append(j)
                self.at.append(at)
                self.child.append((0, 0))
                halves = [self._grow(z, rows[side], -(-leaves // 2)) for side in (~(x[:, j] > at), ~(x[:, j] <= at))]
                self.child[node] = tuple(halves)
                return node
        self.leaves += 1
        return -self.leaves

    def reached(self, z: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows and leaves of which the windows of half-width `wide` around a row reach the leaf."""
        rows, leaf = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0 if self.comp else -1, np.arange(len(z)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                leaf.append(np.full(len(at), -node - 1))
                continue
            x, w = z[at, self.comp[node]], wide[at]
            low, high = self.child[node]
            todo += [(low, at[~(x - w > self.at[node])]), (high, at[~(x + w <= self.at[node])])]
        return np.concatenate(rows), np.concatenate(leaf)

    def home(self, z: np.ndarray) -> np.ndarray:
        """One leaf of each row; where it does not know a component, the low side."""
        rows, leaf = self.reached(np.where(np.isnan(z), -np.inf, z), np.zeros(len(z)))
        out = np.empty(len(z), np.int64)
        out[rows] = leaf
        return out


class SortedArrays:
    """The vectors of a leaf with a sorted array for each component, kept as the rank of each vector. A vector is left out of
    the arrays of the components that it does not know, so the collision threshold counts only arrays that both are in."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, z: np.ndarray):
        self.ids, self.n, self.z, self.known = ids, n, z, ~np.isnan(z)
        kind = np.uint16 if len(z) < 30_000 else np.uint32
        self.rank = np.full(z.shape[::-1], np.iinfo(kind).max, kind)
        self.line = []
        for j, k in enumerate(self.known.T):
            at = np.flatnonzero(k)
            at = at[np.argsort(z[at, j], kind="stable")]
            self.rank[j, at] = np.arange(len(at))
            self.line.append(z[at, j])

    def colliding(self, q: np.ndarray, wide: np.ndarray, least_shared: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and vectors that lie in each other's windows in enough of the arrays that both are in."""
        count = np.zeros((len(q), len(self.ids)), np.uint8)
        for j, line in enumerate(self.line):
            x = np.where(np.isnan(q[:, j]), np.inf, q[:, j])
            lo, hi = np.searchsorted(line, x - wide), np.searchsorted(line, x + wide, "right")
            hi = np.where(np.isnan(q[:, j]), lo, hi)
            kind = self.rank.dtype
            count += (self.rank[j] - lo.astype(kind)[:, None]) < (hi - lo).astype(kind)[:, None]
        shared = (~np.isnan(q)).astype(np.float32) @ self.known.T.astype(np.float32)
        return np.nonzero((count >= np.maximum(1, np.ceil(THRESHOLD * shared))) & (shared >= least_shared))

    def nearest(self, q: np.ndarray, radius: np.ndarray | None, want: int, least_shared: int) -> tuple[np.ndarray, ...]:
        """For each query the most similar vectors of the leaf that stand for `want` rows together: rows of q, positions,
        distances and shared components. Windows start narrow and are widened until so many verified vectors lie within
        the radius that they cover; with a radius, they cover that one, and what lies beyond it is left out."""
        out: list[tuple[np.ndarray, ...]] = []
        todo, wide = np.arange(len(q)), np.full(len(q), START) if radius is None else radius
        span = max([0.0, *(float(x[-1] - x[0]) for x in self.line if len(x))])
        far = np.nanmax(np.abs(np.where(np.isnan(q), 0, q)), 1) + span + max([0.0, *(float(np.abs(x).max()) for x in self.line if len(x))])
        step = max(1, PAIRS // max(1, len(self.ids)))
        while len(todo):
            left = []
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                a, b = self.colliding(q[part], REACH * wide[part], least_shared)
                d, shared = _distance(q[part[a]], self.z[b])
                order = np.lexsort((self.ids[b], d, a))
                a, b, d, shared = a[order], b[order], d[order], shared[order]
                n = np.minimum(self.n[b], want)
                total = np.cumsum(n)
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
                before = total - n - np.repeat((total - n)[first], np.diff(np.r_[first, len(a)]))
                keep = before < want
                if radius is None:
                    enough = np.zeros(len(part), bool)  # so many rows within the radius covered
                    enough[a[keep & (before + n >= want) & (d <= wide[part[a]])]] = True
                    enough |= REACH * wide[part] >= far[part]
                    left.append(part[~enough])
                    keep &= enough[a]
                else:
                    keep &= d <= wide[part[a]]
                out.append((part[a[keep]], b[keep], d[keep], shared[keep].astype(np.int64)))
            todo = np.concatenate(left) if left else todo[:0]
            if radius is None:
                wide[todo] *= WIDEN
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2 + (np.zeros(0), np.zeros(0, int))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, dims: int, k: int, least_shared: int = 5) -> DataFrame:
    """For each query the k most similar other vectors, with a small loss: id, neighbour, rank, distance, shared.

    vectors, queries: id bigint, vec array<double> of at most 255 components of comparable scale; queries may be all vectors
    or some. Every vector is indexed. The vectors are partitioned into leaves of about LEAF by ranges of single components
    (Splits, taken from a hash sample of at most SAMPLE[0] vectors for each leaf, SAMPLE[1] at least), each leaf with its own
    sorted arrays. A query first asks in the leaf it lies in: its windows are widened, without building anything new, until
    the k best verified vectors lie within the radius covered (virtual rehashing). That radius then opens windows in the arrays
    that the vectors are partitioned by, ROUTE times as wide, and the query asks in the other leaves they reach, at the
    width it has come to. Vectors in the windows of THRESHOLD of the arrays known to both are verified by distance. The k best
    of all leaves are ranked by distance, then id. Equal vectors are indexed and asked for once. A query meets the leaves near
    it, not all vectors.

    Nulls: see distinct_vectors; queries are treated alike. Fewer than k vectors that share enough components give fewer rows.
    """
    spark, want = vectors.sparkSession, k + 1  # the query itself may be one
    clean_ = lambda df: distinct_vectors(df).withColumn("vec", F.transform("vec", lambda x: F.when(~F.isnan(x), x + F.lit(0.0))))
    # of equal vectors the smallest ids, as many as can be asked for; the window is cut before its shuffle
    v = clean_(vectors).withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("_n") <= want)
    v = written(v.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("vec", F.col("ids")[0].alias("cid"), "ids"), "indexed")
    q = clean_(queries)
    q = written(q.join(q.groupBy("vec").agg(F.min("id").alias("qid")), "vec"), "queries")
    asked = q.filter(F.col("id") == F.col("qid")).select("qid", "vec")
    rows = v.count()
    leaves = min(LEAVES, max(1, rows // LEAF))
    sample = v.orderBy(F.xxhash64("cid"), "cid").limit(max(SAMPLE[0] * leaves, SAMPLE[1])).select("vec").toArrow().column("vec")
    splits = spark.sparkContext.broadcast(Splits(_matrix(pa.concat_arrays(sample.chunks), dims) if sample.length() else np.zeros((0, dims)), leaves))
    names = ["leaf", "kept", "id", "n", "radius", "vec"]
    line = "leaf bigint, kept boolean, id bigint, n bigint, radius double, vec binary"

    def packed(leaf: np.ndarray, kept: bool, ids: np.ndarray, n: np.ndarray, radius: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        vec = pa.array([x.tobytes() for x in z.astype("<f8").view(f"V{8 * dims}").ravel()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(np.full(len(leaf), kept)), pa.array(ids), pa.array(n.astype(np.int64)), pa.array(radius), vec], names)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _matrix(b.column("vec"), dims)
            at, leaf = splits.value.reached(z, np.zeros(len(z)))
            yield packed(leaf, True, b.column("cid").to_numpy()[at], b.column("n").to_numpy()[at], np.zeros(len(at)), z[at])

    def home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _matrix(b.column("vec"), dims)
            yield packed(splits.value.home(z), False, b.column("qid").to_numpy(), np.zeros(len(z)), np.zeros(len(z)), z)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, radius = _matrix(b.column("vec"), dims), b.column("radius").to_numpy()
            at, leaf = splits.value.reached(z, ROUTE * radius)
            other = leaf != splits.value.home(z)[at]
            at, leaf = at[other], leaf[other]
            yield packed(leaf, False, b.column("qid").to_numpy()[at], np.zeros(len(at)), radius[at], z[at])

    kept = v.select("cid", F.size("ids").cast("bigint").alias("n"), "vec").mapInArrow(place, line)

    def ask(asks: DataFrame, given: bool) -> DataFrame:
        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, index, held, waiting = -1, None, [], []

            def flush() -> Iterator[pa.RecordBatch]:
                nonlocal index, held, waiting
                if held:  # all vectors of a leaf come before its queries
                    t = pa.Table.from_batches(held)
                    index, held = SortedArrays(t.column("id").to_numpy(), t.column("n").to_numpy(), unpacked(t)), []
                if waiting and index is not None:
                    t = pa.Table.from_batches(waiting)
                    i, where, d, shared = index.nearest(unpacked(t), t.column("radius").to_numpy() if given else None, want, least_shared)
                    data = [t.column("id").to_numpy()[i], index.ids[where], np.minimum(index.n[where], want), d, shared]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], ["qid", "cid", "n", "distance", "shared"])
                waiting = []

            for b in batches:
                leaf, is_kept = b.column("leaf").to_numpy(), b.column("kept").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((np.diff(leaf) != 0) | (is_kept[1:] != is_kept[:-1])) + 1).tolist(), len(leaf)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if hi == lo:
                        continue
                    if leaf[lo] != at:
                        yield from flush()
                        at, index = leaf[lo], None
                    (held if is_kept[lo] else waiting).append(b.slice(lo, hi - lo))
                    if sum(x.num_rows for x in waiting) >= ASKS:
                        yield from flush()
            yield from flush()

        both = kept.unionAll(asks).repartition(max(2 * spark.sparkContext.defaultParallelism, leaves // 16), "leaf").sortWithinPartitions("leaf", F.desc("kept"))
        return both.mapInArrow(search, "qid bigint, cid bigint, n bigint, distance double, shared bigint")

    def unpacked(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("vec").to_pylist()), "<f8").reshape(-1, dims)

    near = written(ask(asked.mapInArrow(home, line), False), "near")
    radius = near.groupBy("qid").agg(F.sum("n").alias("n"), F.max("distance").alias("d")).select("qid", F.when(F.col("n") >= want, F.col("d")).alias("radius"))
    more = asked.join(radius, "qid", "left").select("qid", "vec", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    found = near.unionAll(ask(more.mapInArrow(spread, line), True)).groupBy("qid", "cid").agg(F.first("n").alias("n"), F.first("distance").alias("distance"), F.first("shared").alias("shared"))
    best = Window.partitionBy("qid").orderBy("distance", "cid")
    found = found.withColumn("_before", F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < want)
    found = found.join(v.select("cid", "ids"), "cid").select("qid", F.explode("ids").alias("neighbour"), "distance", "shared")
    w = Window.partitionBy("qid").orderBy("distance", "neighbour")
    lists = found.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= want).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbour", "shared"))).alias("list")  # want rows at most
    )
    own = q.select("id", "qid").join(lists, "qid").select("id", F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("list"))
    out = own.select("id", F.posexplode("list").alias("rank", "x"))
    return out.select("id", F.col("x.neighbour").alias("neighbour"), (F.col("rank") + 1).alias("rank"), F.col("x.distance").alias("distance"), F.col("x.shared").alias("shared"))


def record_vectors(records: DataFrame, stats: DataFrame, centre: bool) -> DataFrame:
    """id and vec of feature records: each feature of feature_stat divided by its standard deviation, null where the key is
    absent or the value null; with centre, less the mean first. feature_stat is a small fixed table, one row for a feature."""
    features = stats.orderBy("feature_key").collect()
    value = lambda r: F.try_element_at("features", F.lit(r["feature_key"])).cast("double")
    mean = lambda r: float(r["mean"]) if centre else 0.0
    return records.select(F.col("record_id").alias("id"), F.array(*((value(r) - mean(r)) / float(r["std_dev"]) for r in features)).alias("vec"))
