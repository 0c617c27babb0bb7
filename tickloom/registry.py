"""The registry of queries: each takes (spark, folder of tables) and gives a DataFrame; `sql` is the same in DuckDB's SQL."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the session's Python workers, once, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="tickloom-code-"), f"{root.name}.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def even(sql: str) -> str:
    """SQL with each round_even(x, k) as functions.clean.half_even rounds: ties are seen in decimal, not in binary figures."""
    out, at = "", 0
    while (i := sql.find("round_even(", at)) >= 0:
        depth, end = 0, i + len("round_even")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        x, k = sql[i + len("round_even(") : end].rsplit(",", 1)
        if k.strip() == "0":
            out += sql[at : end + 1]
        else:
            unit = f"cast({10 ** int(k)} as double)"
            out += sql[at:i] + f"(round_even(round(({even(x)}) * {unit}, 4), 0) / {unit})"
        at = end + 1
    return out + sql[at:]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            @functools.wraps(f)
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return f(spark, folder)

            self.queries[name] = run
            if sql:
                self.sql[name] = even(sql)
            return f

        return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
