"""Events combined with the attributes of their entities as they were known at the events' time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.ordered import change, prefix, ranged, scan


class PersistentTree:
    """A search tree over a fixed set of keys (their ranks 0..n-1) with a root for each state, by path copying.

    Insertion v copies the nodes from the root to the leaf of its rank and shares every other subtree with the state before
    it, so state v's root shows the first v insertions and n insertions take n * (depth + 1) nodes. All insertions are laid
    out at once: the node that insertion v makes on level d is d * n + v, and the sibling it shares is the one made by the
    latest earlier insertion into that sibling's block.
    """

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.n, self.depth = n, max(1, int(n - 1).bit_length())
        order = np.arange(n)
        self.left, self.right = np.full((2, self.depth, n), -1, np.int32)
        for d in range(self.depth):
            block = ranks >> (self.depth - d - 1)  # on the level below
            key = block.astype(np.int64) * n + order
            made = np.argsort(key, kind="stable")
            want = (block ^ 1).astype(np.int64) * n + order
            at = np.searchsorted(key[made], want) - 1
            sib = np.where(at >= 0, made[np.maximum(at, 0)], -1)
            sib = np.where((sib >= 0) & (block[np.maximum(sib, 0)] == (block ^ 1)), sib, -1)
            right = (block & 1) == 1
            self.left[d], self.right[d] = np.where(right, sib, order), np.where(right, order, sib)
        self.ranks = ranks

    def floor(self, states: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each query, the insertion with the largest rank of at most `bound` among the first `states` insertions, or -1."""
        node = states.astype(np.int64) - 1
        bound = np.minimum(bound, self.n - 1).astype(np.int64)
        alive = (node >= 0) & (bound >= 0)
        # the last left sibling passed on the way down holds the answer when the path itself ends without one
        spare, spare_level = np.full(len(node), -1, np.int64), np.zeros(len(node), np.int64)
        at = np.where(alive, node, -1)
        for d in range(self.depth):
            ok, i = at >= 0, np.maximum(at, 0)
            right = (bound >> (self.depth - d - 1)) & 1 == 1
            left, rght = self.left[d][i].astype(np.int64), self.right[d][i].astype(np.int64)
            keep = ok & right & (left >= 0)
            spare, spare_level = np.where(keep, left, spare), np.where(keep, d + 1, spare_level)
            at = np.where(ok, np.where(right, rght, left), -1)
        out = at.copy()
        rest = np.flatnonzero((out < 0) & (spare >= 0) & alive)
        at, level = spare[rest], spare_level[rest]
        for d in range(self.depth):  # the largest rank below the spare node
            step = level <= d
            r, l_ = self.right[d][at].astype(np.int64), self.left[d][at].astype(np.int64)
            at = np.where(step, np.where(r >= 0, r, l_), at)
        out[rest] = at
        return out


def as_known(events: DataFrame, facts: DataFrame, rows: int, payload: str, per: int | None = None) -> DataFrame:
    """Each event with the fact about its entity in force at the event's time, among the facts known by then.

    events: entity bigint, time bigint, event bigint. facts: entity bigint, valid bigint, known bigint, version bigint,
    payload struct. A fact counts for an event from max(valid, known) on; in force is the one with the latest valid, then
    known, then version. Returns event, entity, fact (null where none was known).

    Facts and events are range-partitioned together by (entity, time), so an entity may have any number of both. In each
    partition a path-copied persistent tree keeps a root for each known time; an event takes the root of its time and
    searches it by entity and valid time. The fact in force at a partition's start comes from a prefix scan over one record
    for each partition.

    Nulls: events without entity, time or event, facts without entity or known, and facts without valid, are left out; null payload fields stay. Equal facts
    and equal events count once. Empty facts give every event a null fact; empty events give no rows.
    """
    f = facts.select(
        "entity", F.greatest("valid", "known").alias("time"), F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("bigint").alias("event"),
        "valid", "known", "version", "payload",
    ).filter("entity is not null and valid is not null and known is not null")
    e = events.select(
        "entity", "time", F.lit(1).cast("tinyint").alias("kind"), "event",
        *(F.lit(None).cast("bigint").alias(c) for c in ("valid", "known", "version")), F.lit(None).cast(payload).alias("payload"),
    ).filter("entity is not null and time is not null and event is not null")
    table = ranged(f.unionAll(e), ["entity", "time", "kind", "valid", "known", "version", "event"], rows, "asknown", per)
    best = F.max(F.when(F.col("kind") == 0, F.struct("entity", "valid", "known", "version", "payload")))
    carry = prefix(table.df.groupBy("_pid").agg(best.alias("last")), table.parts, ["last"])

    def lookup(pid: int, t: pa.Table, own: pa.Table | None) -> pa.Table | None:
        kind = t.column("kind").to_numpy()
        facts, asks = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
        if not asks.num_rows:
            return None
        asks = asks.filter(pa.array(change(asks, "entity", "time", "event")))  # once each
        entity, time = (asks.column(c).to_numpy() for c in ("entity", "time"))
        pay = facts.column("payload").combine_chunks()
        if isinstance(pay, pa.ChunkedArray):
            pay = pay.combine_chunks()
        pay_type = t.schema.field("payload").type
        cols = [facts.column(c).fill_null(0).to_numpy() for c in ("entity", "time", "valid", "known", "version")]
        x = own.column("last")[0].as_py() if own is not None else None
        if x is not None and x["entity"] == t.column("entity")[0].as_py():
            cols = [np.r_[v, c] for v, c in zip((x["entity"], max(x["valid"], x["known"]), x["valid"], x["known"], x["version"] or 0), cols)]
            pay = pa.concat_arrays([pa.array([x["payload"]], pay_type), pay.cast(pay_type)])
        fe, ft, fv, fk, fn = cols
        found = np.full(len(entity), -1)
        if len(fe):
            by_key = np.lexsort((fn, fk, fv, fe))
            rank = np.empty(len(fe), np.int64)
            rank[by_key] = np.arange(len(fe))
            inserted = np.lexsort((rank, ft))  # in the order in which they became known
            tree = PersistentTree(rank[inserted])
            states = np.searchsorted(ft[inserted], time, "right")
            # the last key of the event's entity with valid <= time
            key = np.stack([fe[by_key], fv[by_key]], 1)
            both = np.lexsort((np.r_[np.zeros(len(key)), np.ones(len(entity))], np.r_[key[:, 1], time], np.r_[key[:, 0], entity]))
            is_key = both < len(key)
            bound = np.empty(len(entity), np.int64)
            bound[both[~is_key] - len(key)] = (np.cumsum(is_key) - 1)[~is_key]
            hit = tree.floor(states, bound)
            src = inserted[np.maximum(hit, 0)]
            found = np.where((hit >= 0) & (fe[src] == entity), src, -1)
        take = pa.array(found, pa.int64(), mask=found < 0)
        return pa.table({"event": asks.column("event"), "entity": asks.column("entity"), "fact": pay.cast(pay_type).take(take)})

    return scan(table, lookup, f"event bigint, entity bigint, fact {payload}", carry)


PAYLOAD = "struct<resolved_r:decimal(18,6),triggered:boolean>"


def evidence_as_known(evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Each distinct evidence row's analogue scenarios with their outcome as known at as_of_utc: event (evidence_id), entity
    (scenario_id), fact. A scenario named twice by one row counts once."""
    rows = (evidence.agg(F.sum(F.size("analogue_scenario_ids"))).first()[0] or 0) + versions.count()
    events = evidence.select(
        F.explode(F.array_distinct("analogue_scenario_ids")).alias("entity"), clean.micros("as_of_utc").alias("time"), F.col("evidence_id").alias("event")
    ).filter("event is not null")
    known = clean.micros("known_utc")
    facts = versions.select(
        F.col("scenario_id").alias("entity"), known.alias("valid"), known.alias("known"), F.col("version_no").cast("bigint").alias("version"),
        F.struct("resolved_r", "triggered").alias("payload"),
    )
    return as_known(events, facts, rows, PAYLOAD)


def unfounded_evidence(evidence: DataFrame, versions: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """evidence_id, stated and expectancy of the rows whose evidence_expectancy_per_triggered does not follow from the
    outcomes known at as_of_utc: it differs by more than the tolerance, or no version in force is triggered. Rows without a
    stated figure or without an id are no cases; a row without as_of_utc knows nothing."""
    stated = (
        evidence.filter("evidence_expectancy_per_triggered is not null and evidence_id is not null")
        .groupBy("evidence_id")
        .agg(F.first("evidence_expectancy_per_triggered").alias("stated"))
    )
    known = (
        evidence_as_known(evidence.filter("evidence_expectancy_per_triggered is not null"), versions)
        .groupBy(F.col("event").alias("evidence_id"))
        .agg(F.sum("fact.resolved_r").alias("r"), F.count_if("fact.triggered").alias("n"))
    )
    got = F.try_divide(F.coalesce("r", F.lit(0)).cast("decimal(28,6)"), F.col("n").cast("decimal(20,0)"))
    both = stated.join(known, "evidence_id", "left").withColumn("expectancy", got)
    wrong = F.coalesce(F.abs(F.col("stated") - F.col("expectancy")) > F.lit(tolerance).cast("decimal(18,6)"), F.lit(True))
    return both.filter(wrong).select("evidence_id", "stated", "expectancy")
