"""Totals and averages over trailing calendar days, kept as a versioned daily state.

A state row holds, for an entity, measure and day, the totals of the last 7 and 30 days and the number of active days. The
next day's state follows from yesterday's: plus the day's arrivals, minus the amounts of the day that expires. `DailyState`
keeps the state as a table that grows by blocks of days, each made from the last day of the one before. When amounts of past
days are corrected, only the dates that they reach are computed again, under a higher version; the state in force of a date
is the one with the highest version.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clean
from tickloom.ordered import drop_at_exit, shared_dir, written

SHORT, LONG = 7, 30
STATE = ["total_7", "total_30", "active_30"]
#: Days that one job advances the state by, at most.
DAYS = 30
ROW = "entity string, measure string, day date, total_7 decimal(38,6), total_30 decimal(38,6), active_30 bigint, version int"


def _steps(amounts: DataFrame) -> DataFrame:
    """What each day adds to the running totals: an amount enters on its day and expires after 7 or 30 days."""
    w = lambda days, sign, a, n, m: F.struct(
        F.date_add("day", days).alias("day"), (F.lit(sign * a) * F.col("amount")).alias("d7"), (F.lit(sign * n) * F.col("amount")).alias("d30"), F.lit(sign * m).alias("dn")
    )
    steps = F.array(w(0, 1, 1, 1, 1), w(SHORT, -1, 1, 0, 0), w(LONG, -1, 0, 1, 1))
    return (
        amounts.select("entity", "measure", "active", F.explode(steps).alias("s"))
        .select("entity", "measure", "s.day", "s.d7", "s.d30", (F.col("s.dn") * F.col("active")).alias("dn"))
    )


def advance(state: DataFrame, amounts: DataFrame, since: date, until: date, version: int = 1) -> DataFrame:
    """The state of the days after `since` up to `until`, from the state on `since`: yesterday's totals joined with each
    day's arrivals and the amounts that expire on it, day after day. amounts: entity, measure, day date, amount decimal,
    active int; one row for each entity, measure and day, of which those of the last LONG days before `since` and of the
    days to make are read. An entity without an active day left drops out, and comes back with its next amount."""
    keys, first, last = ["entity", "measure"], F.lit(since), F.lit(until)
    was = state.filter(F.col("day") == first).select(*keys, "day", F.col("total_7").alias("d7"), F.col("total_30").alias("d30"), F.col("active_30").alias("dn"))
    near = amounts.filter((F.col("day") > F.date_sub(first, LONG)) & (F.col("day") <= last))
    changes = _steps(near).filter((F.col("day") > first) & (F.col("day") <= last))
    steps = was.unionByName(changes).groupBy(*keys, "day").agg(*(F.sum(c).alias(c) for c in ("d7", "d30", "dn")))
    w = Window.partitionBy(*keys).orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    made = steps.select(
        *keys, "day", *(F.sum(c).over(run).alias(n) for c, n in zip(("d7", "d30", "dn"), STATE)), F.lead("day").over(w).alias("next"),
    )
    # between two steps nothing arrives and nothing expires: the days between keep yesterday's totals
    days = F.sequence(F.col("day"), F.date_sub(F.coalesce("next", F.date_add(last, 1)), 1))
    made = made.filter("active_30 > 0").withColumn("day", F.explode(days)).filter(F.col("day") > first)
    kinds = dict(x.split(" ", 1) for x in ROW.split(", "))
    return made.withColumn("version", F.lit(version)).select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def revise(state: DataFrame, corrections: DataFrame, version: int) -> DataFrame:
    """The state rows, under a new version, of the dates that corrections reach. corrections: entity, measure, day, and by how
    much the day's amount and active (-1, 0, 1) change. Dates that the state lacks yet start from zero."""
    keys = ["entity", "measure", "day"]
    reach = corrections.select("entity", "measure", "amount", "active", F.posexplode(F.sequence("day", F.date_add("day", LONG - 1))).alias("age", "day"))
    delta = reach.groupBy(*keys).agg(
        F.sum(F.when(F.col("age") < SHORT, F.col("amount")).otherwise(F.lit(0))).alias("d7"), F.sum("amount").alias("d30"), F.sum("active").alias("dn")
    )
    old = current(state)
    zero = F.lit(0)
    new = delta.join(old, keys, "left").select(
        *keys, (F.coalesce("total_7", zero) + F.col("d7")).alias("total_7"), (F.coalesce("total_30", zero) + F.col("d30")).alias("total_30"),
        (F.coalesce("active_30", zero) + F.col("dn")).alias("active_30"), F.lit(version).alias("version"),
    )
    kinds = dict(state.dtypes)
    return new.select(*(F.col(c).cast(kinds[c]).alias(c) for c in state.columns))


def current(state: DataFrame) -> DataFrame:
    """The state in force: of each entity, measure and day the highest version."""
    keys = ["entity", "measure", "day"]
    best = state.groupBy(*keys).agg(F.max(F.struct("version", *STATE)).alias("s"))
    return best.select(*keys, *(f"s.{c}" for c in STATE), "s.version")


def daily_amounts(readings: DataFrame, measures: list[str]) -> DataFrame:
    """The daily amounts of the readings as they arrived first (was) and as they stand now (is): entity, measure, day, was,
    was_active, is, is_active.

    readings: entity, key (what identifies a reading of the entity), day, arrived, and a decimal column for each measure. Of
    equal entity and key the first arrival makes `was` and the last one `is`; of equal arrivals the larger values count, so
    repeated rows change nothing. A null value adds nothing; a day is active if it has a value. Rows without entity or key are
    left out. Readings are reduced to days with partial sums, so a hot entity costs no more than its days afterwards.
    """
    values = F.struct("arrived", *measures)
    one = readings.filter("entity is not null and key is not null").groupBy("entity", "key").agg(
        F.first("day").alias("day"), F.min(values).alias("a"), F.max(values).alias("b")
    )
    total = lambda side, m: F.coalesce(F.sum(f"{side}.{m}"), F.lit(0)).cast("decimal(28,6)")
    sums = [x for m in measures for x in (
        total("a", m).alias(f"was_{m}"), total("b", m).alias(f"is_{m}"), (F.count(f"a.{m}") > 0).cast("int").alias(f"wasn_{m}"), (F.count(f"b.{m}") > 0).cast("int").alias(f"isn_{m}")
    )]
    days = one.groupBy("entity", "day").agg(*sums)
    each = F.array(*(F.struct(
        F.lit(m).alias("measure"), F.col(f"was_{m}").alias("was"), F.col(f"is_{m}").alias("is"), F.col(f"wasn_{m}").alias("was_active"), F.col(f"isn_{m}").alias("is_active")
    ) for m in measures))
    return days.select("entity", "day", F.explode(each).alias("x")).select("entity", "day", "x.*")


class DailyState:
    """A daily state kept as a table of blocks of days at `path` in a folder that all executors share. It goes on from where an
    earlier session left it: `advance` makes the days that are not there yet, `correct` adds rows of a higher version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.blocks = spark, path, 0
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            self.blocks = sum(x.isDirectory() for x in fs.listStatus(at))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(path)

    def rows(self) -> DataFrame:
        """All rows of all versions."""
        return self._read(f"{self.path}/*") if self.blocks else self.spark.createDataFrame([], ROW)

    def _add(self, rows: DataFrame) -> DataFrame:
        at = f"{self.path}/{self.blocks:06d}"
        rows.write.option("compression", "zstd").mode("overwrite").parquet(at)
        self.blocks += 1
        return self._read(at)

    def advance(self, amounts: DataFrame, until: date, since: date | None = None) -> None:
        """Makes the days after the last one there, up to `until`, at most DAYS a job. since: the day before the first one to
        be made, of a table that is still empty."""
        since = self.rows().filter("version = 1").agg(F.max("day")).first()[0] if self.blocks else since
        last = current(self.rows().filter(F.col("day") == F.lit(since)))
        while since is not None and since < until:
            to = min(since + timedelta(DAYS), until)
            last = self._add(advance(last, amounts, since, to))
            since = to

    def correct(self, corrections: DataFrame, version: int) -> None:
        """Adds the rows, under a new version, of the dates there that corrections reach; see revise."""
        end = self.rows().filter("version = 1").agg(F.max("day")).first()[0]
        self._add(revise(self.rows(), corrections, version).filter(F.col("day") <= F.lit(end)))


def rolling_state(readings: DataFrame, measures: list[str]) -> DataFrame:
    """The state in force of all readings: entity, measure, day, total_7, total_30, active_30, version (2 where corrections
    reach), of every calendar day with an active day among the LONG that end with it, so also of the days after an entity's
    or the table's last reading. The daily step makes version 1 from the first deliveries; what later deliveries supersede
    comes in as corrections. An empty table gives no rows."""
    spark = readings.sparkSession
    days = written(daily_amounts(readings, measures), "days")
    first = days.filter("was_active > 0").select("entity", "measure", "day", F.col("was").alias("amount"), F.col("was_active").alias("active"))
    later = days.filter("was <> is or was_active <> is_active").select(
        "entity", "measure", "day", (F.col("is") - F.col("was")).cast("decimal(28,6)").alias("amount"), (F.col("is_active") - F.col("was_active")).alias("active")
    )
    begin, end = days.agg(F.min("day"), F.max("day")).first()
    state = DailyState(spark, drop_at_exit(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"))
    if begin is not None:
        until = end + timedelta(LONG - 1)
        state.advance(first, until, begin - timedelta(1))
        state._add(revise(state.rows(), later, 2))
    return current(state.rows())


def bar_feature_state(features: DataFrame) -> DataFrame:
    """The rolling state of avg_volume_5 and rel_volume of bar features, by ticker and New York day."""
    readings = features.select(
        clean.ticker("ticker").alias("entity"), F.col("ts_utc").alias("key"), clean.ny_date("ts_utc").alias("day"),
        F.col("ingested_utc").alias("arrived"), "avg_volume_5", "rel_volume",
    )
    return rolling_state(readings, ["avg_volume_5", "rel_volume"])


def bursts(state: DataFrame, active: int = 12, factor: int = 2) -> DataFrame:
    """The state rows with at least `active` active days, a positive 30-day total and a 7-day daily average of at least
    `factor` times the 30-day one."""
    return state.filter(
        (F.col("active_30") >= active) & (F.col("total_30") > 0) & (F.col("total_7") * LONG >= F.col("total_30") * (factor * SHORT))
    )
