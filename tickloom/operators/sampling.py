"""Deterministic samples: by stable hashes, proportional to strata, balanced, and round-robin over strata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Basis and prime of the 64-bit hash.
BASIS, PRIME = 1469598103934665603, 1099511628211


def stable_hash(text: Column, seed: int) -> Column:
    """A 63-bit hash over UTF-16 code units: the seed is mixed into the basis, and each unit is mixed in before a
    multiplication that wraps around. Null for null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        texts = [None if t is None else np.frombuffer(t.encode("utf-16-le"), "<u2") for t in s]
        longest = max((len(t) for t in texts if t is not None), default=0)
        h = np.full(len(texts), np.uint64(BASIS ^ seed), np.uint64)
        with np.errstate(over="ignore"):
            size = np.array([-1 if t is None else len(t) for t in texts])
            order = np.argsort(-size, kind="stable")
            for i in range(longest):  # all texts side by side, the longer ones first
                on = order[: int(np.searchsorted(-size[order], -i, "left"))]
                units = np.array([texts[j][i] for j in on], np.uint64)
                h[on] = (h[on] ^ units) * np.uint64(PRIME)
        return pd.Series([None if n < 0 else int(x & np.uint64(0x7FFFFFFFFFFFFFFF)) for n, x in zip(size, h)], dtype="Int64")

    return run(text)


def sha_order(key: Column, seed: int) -> Column:
    """An order by the SHA-256 of seed|key, in upper-case hex."""
    return F.upper(F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256))


def quotas(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """How many rows each stratum gives to a sample of `size`: the whole part of its share, and the rest by the largest
    remainder, then by name. stratum, n, take. One row for each stratum."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    size_ = F.least(F.lit(size), total)
    x = counts.withColumns({"_size": size_, "_whole": F.floor(F.try_divide(size_ * F.col("n"), total)).cast("bigint"), "_rest": F.pmod(size_ * F.col("n"), total)})
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), stratum))
    left = F.col("_size") - F.sum("_whole").over(Window.partitionBy(F.lit(1)))
    x = x.withColumns({"_rank": rank, "_left": left})
    return x.select(stratum, "n", (F.col("_whole") + (F.col("_rank") <= F.col("_left")).cast("bigint")).alias("take"))


def stratified(rows: DataFrame, key: str, stratum: str, size: int, seed: int) -> DataFrame:
    """A sample of `size` rows in proportion to the strata, by the hash order within each. The same for any partitioning and
    input order. Only the rows at the front of each stratum are kept on the way (a limit within the window)."""
    w = Window.partitionBy(stratum).orderBy(sha_order(F.col(key), seed), key)
    ranked = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size)
    return ranked.join(quotas(rows, stratum, size).select(stratum, "take"), stratum).filter(F.col("_n") <= F.col("take")).drop("_n", "take")


def round_robin(rows: DataFrame, key: str, stratum: str, size: int, seed: int) -> DataFrame:
    """A sample of `size` rows taken from the strata in turn: the first of each stratum by hash order, then the second of
    each, strata in order of name. Adds place."""
    w = Window.partitionBy(stratum).orderBy(sha_order(F.col(key), seed), key)
    ranked = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size)
    top = ranked.orderBy("_n", stratum, key).limit(size)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_n", stratum, key))).drop("_n")


def diverse(rows: DataFrame, key: str, stratum: str, limit: str, take: int, seed: int) -> DataFrame:
    """`take` rows spread over strata: of each value of `limit` (a ticker, say) only the first ceil(take / 4) by hash order
    are let through at first, and of these the strata give their first by hash order in turn, then their second, strata in
    the order of their own hash. If they do not suffice, the others follow in another hash order (seed + 17). Adds place
    (from 1). Of each stratum at most 2 * take rows are carried beyond the windows."""
    h = lambda s: sha_order(F.col(key), s)
    x = rows.withColumn("_in", F.row_number().over(Window.partitionBy(limit).orderBy(h(seed), key)) <= max(1, -(-take // 4)))
    x = x.withColumn("_h", F.when(F.col("_in"), h(seed)).otherwise(h(seed + 17)))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("_in", stratum).orderBy("_h", key))).filter(F.col("_n") <= take)
    order = [F.desc("_in"), F.when(F.col("_in"), F.col("_n")), F.when(F.col("_in"), sha_order(F.col(stratum), seed + 1)), F.when(~F.col("_in"), F.col("_h")), F.col(key)]
    top = x.orderBy(*order).limit(take)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_in", "_h", "_n")


def balanced(rows: DataFrame, key: str, stratum: str, limit: str, side: Column, size: int, seed: int) -> DataFrame:
    """A sample of `size` rows, half with `side` true and half without, each spread as by `diverse`; what one side lacks comes
    from the other. With an odd size the false side gets one more. Rows with a null side are left out. Adds side."""
    x = rows.withColumn("side", side).filter("side is not null")
    n = x.agg(F.count_if("side"), F.count_if(~F.col("side"))).first()
    yes = min(n[0], size // 2)
    no = min(n[1], size - yes)
    yes += min(size - yes - no, n[0] - yes)
    a = diverse(x.filter("side"), key, stratum, limit, yes, seed)
    return a.unionByName(diverse(x.filter(~F.col("side")), key, stratum, limit, no, seed + 100_003)).drop("place")
