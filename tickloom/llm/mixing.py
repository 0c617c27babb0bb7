"""Mixing sources to target weights, by min-cost flow over membership patterns.

Documents are reduced to patterns (the set of sources they belong to) with their number of tokens. A small flow network
routes tokens from patterns to source quotas: the r-th use of a document costs more than the ones before it (a convex cost),
so nothing is repeated while fresh text is left. The routed amounts are then turned into documents: whole passes, and a
seeded selection for the rest, cut where a running total over hash ranges reaches it.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.llm import tokens
from tickloom.ordered import written

#: Hash ranges that the documents of a pattern are dealt into for the running totals.
RANGES = 4096
#: Times that the gap left at a cut is filled with smaller documents.
ROUNDS = 3


class Flow:
    """Min-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.to: list[list[list]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> list:
        e = [b, capacity, cost, None, capacity]
        back = [a, 0, -cost, e, 0]
        e[3] = back
        self.to[a].append(e)
        self.to[b].append(back)
        return e

    def run(self, s: int, t: int) -> int:
        n, total = len(self.to), 0
        high = [0] * n
        while True:
            far, via, queue = [None] * n, [None] * n, [(0, s)]
            far[s] = 0
            while queue:
                d, u = heapq.heappop(queue)
                if d > far[u]:
                    continue
                for e in self.to[u]:
                    if e[1] > 0 and (far[e[0]] is None or d + e[2] + high[u] - high[e[0]] < far[e[0]]):
                        far[e[0]] = d + e[2] + high[u] - high[e[0]]
                        via[e[0]] = e
                        heapq.heappush(queue, (far[e[0]], e[0]))
            if far[t] is None:
                return total
            high = [h + (f if f is not None else far[t]) for h, f in zip(high, far)]
            push, v = None, t
            while v != s:
                e = via[v]
                push, v = e[1] if push is None else min(push, e[1]), e[3][0]
            v = t
            while v != s:
                e = via[v]
                e[1] -= push
                e[3][1] += push
                v = e[3][0]
            total += push


def plan(patterns: dict[frozenset, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[dict[tuple[frozenset, str], list[int]], int]:
    """How many tokens of each pattern go to each of its sources, by number of the use (1st, 2nd, ...), and the total size.

    patterns: tokens by set of sources. targets: share and most repeats by source. A document is used for a source at most
    that many times, and by all sources together at most as often as the largest of their limits. Without a total, the
    largest total is taken that all sources with a share and with tokens can fill; the shares of sources without tokens fall
    to the others in proportion.
    """
    own = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and any(s in p and n for p, n in patterns.items())}
    weight = sum(w for w, _ in own.values())
    if not own or weight <= 0:
        return {}, 0
    live = {p: n for p, n in patterns.items() if n and any(s in own for s in p)}

    def build(size: int) -> tuple[int, dict]:
        names, kinds = sorted(own), sorted(live, key=sorted)
        flow = Flow(2 + len(names) + len(kinds))
        at_s, at_p = {s: 2 + i for i, s in enumerate(names)}, {p: 2 + len(names) + i for i, p in enumerate(kinds)}
        uses = {}
        for p in kinds:
            mine = [s for s in p if s in own]
            for r in range(1, max(own[s][1] for s in mine) + 1):
                flow.edge(0, at_p[p], live[p], r)
            uses |= {(p, s): [flow.edge(at_p[p], at_s[s], live[p], r) for r in range(1, own[s][1] + 1)] for s in mine}
        quota = {s: int(size * own[s][0] / weight) for s in names}
        for s in names:
            flow.edge(at_s[s], 1, quota[s], 0)
        return sum(quota.values()) - flow.run(0, 1), {k: [e[4] - e[1] for e in v] for k, v in uses.items()}

    if total is None:
        low, high = 0, sum(n * max(own[s][1] for s in p if s in own) for p, n in live.items()) + 1
        while high - low > max(1, low // 1_000_000):
            mid = (low + high) // 2
            short, _ = build(mid)
            low, high = (mid, high) if short == 0 else (low, mid)
        total = low
    _, routed = build(total)
    return {k: v for k, v in routed.items() if sum(v)}, total


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents of each mixture, and the shares that come of it.

    sizes: id, sources array<string> (in the targets' spelling), size bigint; one row for each document. targets: mix_name,
    source, target_share, max_repeats; a small table. Returns (mix_name, source, id, uses, size) with one row for each source
    that uses a document, and (mix_name, source, target_share, actual_share, planned, tokens, documents,
    most_uses), planned being the tokens that the flow routes to the source.

    Token sums go to the driver by membership pattern only. For each pattern and source, the last, partial use is given to
    the documents with the smallest seeded hashes until the tokens routed are reached; their running totals are kept by hash
    range, and only the range in which the cut lies is looked at document by document. What the document at the cut leaves
    open is filled, where the pattern feeds one source only, with documents of at most a quarter of the gap, ROUNDS times; so
    a source misses its quota by less than one document for each pattern, and mostly by far less.

    Nulls: documents without id, sources or a positive size are never used. Targets without a name, a source, a share or
    repeats count as a share of 0. Sources without documents have an actual share of 0.
    """
    spark = sizes.sparkSession
    goals = targets.select("mix_name", clean.source("source").alias("source"), "target_share", "max_repeats").dropna(subset=["mix_name", "source"]).collect()
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    docs = sizes.filter("id is not null and size > 0 and size(sources) > 0").select(
        "id", F.array_sort(F.array_distinct("sources")).alias("sources"), "size", u.alias("u"), (u / F.lit((1 << 40) // RANGES)).cast("int").alias("range")
    )
    docs = written(docs, "sizes")
    sums = docs.groupBy("sources").agg(F.sum("size").alias("n")).collect()
    patterns = {frozenset(r["sources"]): int(r["n"]) for r in sums}
    wanted, planned = [], {}
    for name in sorted({g["mix_name"] for g in goals}):
        own = {g["source"]: (float(g["target_share"] or 0), int(g["max_repeats"] or 0)) for g in goals if g["mix_name"] == name}
        routed, _ = plan(patterns, own, total)
        for (_, s), n in routed.items():
            planned[name, s] = planned.get((name, s), 0) + sum(n)
        for p in {p for p, _ in routed}:
            begin = 0  # where on the pattern's circle of documents the next source's partial use begins
            for s in sorted(s for q, s in routed if q == p):
                n = sum(routed[p, s])
                whole, rest = divmod(n, patterns[p])
                wanted.append((name, s, sorted(p), whole, begin, rest, sum(q == p for q, _ in routed) == 1))
                begin = (begin + rest) % patterns[p]
    schema = "mix_name string, source string, sources array<string>, whole int, begin bigint, rest bigint, alone boolean"
    want = F.broadcast(spark.createDataFrame(wanted, schema))  # a row for each mixture, pattern and source
    pattern_size = F.broadcast(spark.createDataFrame([(sorted(p), n) for p, n in patterns.items()], "sources array<string>, all bigint"))
    by_range = docs.groupBy("sources", "range").agg(F.sum("size").alias("n"))
    w = Window.partitionBy("sources").orderBy("range")
    before = by_range.select("sources", "range", "n", (F.sum("n").over(w) - F.col("n")).alias("low")).join(pattern_size, "sources").join(want, "sources")
    # the interval of a use, [begin, begin + rest) on the circle, may wrap around
    offset = F.pmod(F.col("low") - F.col("begin"), F.col("all"))
    place = before.withColumn("at", offset).withColumn(
        "part", (F.col("at") < F.col("rest")) & (F.col("at") + F.col("n") > F.col("rest")) | (F.col("at") + F.col("n") > F.col("all")) & (F.col("rest") > 0)
    )
    place = place.withColumn("take", F.col("at") < F.col("rest"))
    plain = docs.join(place.filter("not part"), ["sources", "range"])
    inner = Window.partitionBy("mix_name", "source", "sources", "range").orderBy("u", "id")
    cut = docs.join(place.filter("part").drop("take"), ["sources", "range"])
    start = F.pmod(F.col("low") + F.sum("size").over(inner) - F.col("size") - F.col("begin"), F.col("all"))
    cut = cut.withColumn("start", start).withColumn("take", F.col("start") + F.col("size") <= F.col("rest"))
    cols = ["mix_name", "source", "sources", "id", "u", "range", "at", "size", "whole", "rest", "alone", "take"]
    picked = written(plain.select(cols).unionAll(cut.select(cols)), "picked")
    key = ["mix_name", "source", "sources"]
    for _ in range(ROUNDS):
        gap = picked.filter("alone").groupBy(key).agg((F.max("rest") - F.sum(F.when(F.col("take"), F.col("size")).otherwise(0))).alias("gap"))
        small = picked.join(F.broadcast(gap.filter("gap > 4")), key).filter(~F.col("take") & (F.col("size") * 4 <= F.col("gap")))
        sums = small.groupBy(*key, "at", "gap").agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy(key).orderBy("at")) - F.col("n")
        reach = sums.withColumn("low", before).filter("low < gap")
        row = F.sum("size").over(Window.partitionBy(*key, "at").orderBy("u", "id"))
        more = small.drop("gap").join(reach.select(*key, "at", "low", "gap"), [*key, "at"]).withColumn("end", F.col("low") + row).filter("end <= gap")
        found = more.select(*key, "id", F.lit(True).alias("more"))
        picked = written(picked.join(found, [*key, "id"], "left").withColumn("take", F.col("take") | F.coalesce("more", F.lit(False))).select(cols), "picked")
    rows = picked.select("mix_name", "source", "id", (F.col("whole") + F.col("take").cast("int")).alias("uses"), "size")
    rows = rows.filter("uses > 0").withColumn("uses", F.col("uses").cast("int"))
    chosen = rows.groupBy("mix_name", "source").agg(
        F.sum(F.col("uses") * F.col("size")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses")
    )
    every = Window.partitionBy("mix_name")
    table = spark.createDataFrame([(g["mix_name"], g["source"], g["target_share"], planned.get((g["mix_name"], g["source"]), 0)) for g in goals], "mix_name string, source string, target_share double, planned bigint")
    zero = lambda c: F.coalesce(c, F.lit(0))
    shares = table.join(F.broadcast(chosen), ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.coalesce(F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(every)), 6), F.lit(0.0)).alias("actual_share"),
        "planned", zero(F.col("tokens")).alias("tokens"), zero(F.col("documents")).alias("documents"), zero(F.col("most_uses")).alias("most_uses"),
    )
    return rows.select("mix_name", "source", "id", "uses", "size"), shares


def document_sizes(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """id, sources (the document's one source, trimmed and in lower case) and size in byte_bpe_50k tokens of its whole text."""
    ids = tokens.encode(docs, folder=folder).select("doc_id", F.size("ids").cast("bigint").alias("size"))
    own = docs.select("doc_id", F.array_compact(F.array(clean.source("source"))).alias("sources"))
    return own.join(ids, "doc_id").select(F.col("doc_id").alias("id"), "sources", "size")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """mix over documents: (mix_name, source, doc_id, uses, n_tokens) and the report of shares."""
    rows, shares = mix(document_sizes(docs), targets, seed)
    return rows.withColumnsRenamed({"id": "doc_id", "size": "n_tokens"}), shares
