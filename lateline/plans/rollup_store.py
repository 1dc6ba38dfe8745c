"""Stored rollups: one table per kind, partitioned by date, kept up to date by what changed.

Every insert of facts logs the quarters it touched. A refresh recomputes exactly these quarters from
the facts, the hours that hold them from the stored quarters, and the local days of those from the
stored hours, however old they are; all other rows and partitions stay as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType, TimestampType

from lateline.constants import ROLLUP_DEFINITION_VERSION, STOP_ROLLUP_RETENTION_DAYS, TIME_ZONE
from lateline.functions.clock import bucket, local_date
from lateline.operators.rollups import (
    ROLLUPS, expire_stop_rollup, refresh_between, rollup_15min, rollup_15min_stop, rollup_1h, rollup_day,
)
from lateline.schema import DELAY_FACT
from lateline.session import materialize
from lateline.sources.sinks import drop_partitions
from lateline.sources.tables import read_or_empty

_TOUCHED = StructType([StructField("bucket", TimestampType()), StructField("batch", StringType())])
_VERSION = StructType([StructField("version", IntegerType())])


@dataclass(frozen=True)
class Level:
    """A stored rollup: its function, time column, input (None: the facts) and input's time."""
    rollup: Callable[..., DataFrame]
    time: str
    source: str | None
    place: Callable[[str], Column]      # the row's own time from the input's time column


LEVELS = {
    "15min": Level(rollup_15min, "bucket", None, lambda ts: bucket(ts, 15)),
    "15min_stop": Level(rollup_15min_stop, "bucket", None, lambda ts: bucket(ts, 15)),
    "1h": Level(rollup_1h, "hour", "15min", lambda quarter: bucket(quarter, 60)),
    "day": Level(rollup_day, "day", "1h", lambda hour: local_date(hour)),
}


def write_rollup(rollup: DataFrame, kind: str, path: str) -> None:
    (rollup.withColumn("dt", F.col(LEVELS[kind].time).cast("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("dt").parquet(path))


def _replace(spark: SparkSession, path: str, kind: str, rows: DataFrame, dates: list[dt.date]) -> None:
    """Put ``rows`` in place of the partitions of ``dates``; a date without rows loses its partition.

    The new rows are written aside first: a table is never read and overwritten by one job.
    """
    fresh = materialize(rows, "refresh")
    write_rollup(fresh, kind, path)
    filled = {r.dt for r in fresh.select(F.col(LEVELS[kind].time).cast("date").alias("dt")).distinct().collect()}
    drop_partitions(spark, path, "dt", sorted(set(dates) - filled))


def refresh_stored(spark: SparkSession, path: str, source: DataFrame, kind: str,
                   start: dt.datetime, end: dt.datetime) -> None:
    """Recompute the buckets of [start, end) in the stored table, whose dates alone are read."""
    schema = ROLLUPS[kind][0](source).schema.add("dt", DateType())
    first, last = (t.astimezone(dt.timezone.utc).date() for t in (start, end))
    stored = read_or_empty(spark, path, schema).where(F.col("dt").between(F.lit(first), F.lit(last)))
    fresh = refresh_between(stored.drop("dt"), source, kind, F.lit(start), F.lit(end))
    dates = [r.dt for r in stored.select("dt").distinct().collect()]
    _replace(spark, path, kind, fresh, dates)


@dataclass(frozen=True)
class RollupStore:
    """All stored rollups below ``root``, the log of touched quarters and the definition's version."""
    spark: SparkSession
    root: str

    def path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def read(self, kind: str) -> DataFrame:
        """The stored rows with their partition column ``dt``."""
        level, empty = LEVELS[kind], self.spark.createDataFrame([], DELAY_FACT)
        chain = [level]
        while chain[0].source:
            chain.insert(0, LEVELS[chain[0].source])
        for step in chain:
            empty = step.rollup(empty)
        return read_or_empty(self.spark, self.path(kind), empty.schema.add("dt", DateType()))

    def log_touched(self, inserted: DataFrame) -> None:
        """Log the quarters of newly inserted facts; to be called with every insert."""
        (inserted.select(bucket("ts", 15).alias("bucket")).distinct()
         .withColumn("batch", F.lit(uuid.uuid4().hex)).coalesce(1)
         .write.mode("append").partitionBy("batch").parquet(self.path("touched")))

    def refresh_touched(self, fact: DataFrame, facts_from: dt.datetime | None = None) -> int:
        """Recompute what the log names; returns the number of quarters.

        Facts before ``facts_from`` are purged: their quarters cannot be recomputed and stay as they
        are, in the rollups and in the log. The log entries go last, so a refresh that breaks off
        is repeated, and entries that come in meanwhile wait for the next one.
        """
        log = read_or_empty(self.spark, self.path("touched"), _TOUCHED)
        batches = [r.batch for r in log.select("batch").distinct().collect()]
        pending = materialize(log.where(F.col("batch").isin(batches)).select("bucket").distinct(), "touched")
        late = pending.limit(0)
        if facts_from is not None:
            late = materialize(pending.where(F.col("bucket") < F.lit(facts_from)), "late")
            pending = pending.where(F.col("bucket") >= F.lit(facts_from))
        n = pending.count()
        if n:
            self._recompute("15min", pending, fact)
            self._recompute("15min_stop", pending, fact)
            hours = materialize(pending.select(bucket("bucket", 60).alias("hour")).distinct(), "hours")
            self._recompute("1h", hours, self.read("15min"))
            days = materialize(hours.select(local_date("hour").alias("day")).distinct(), "days")
            self._recompute("day", days, self.read("1h"))
        if not late.isEmpty():
            (late.withColumn("batch", F.lit(uuid.uuid4().hex)).coalesce(1)
             .write.mode("append").partitionBy("batch").parquet(self.path("touched")))
        drop_partitions(self.spark, self.path("touched"), "batch", batches)
        return n

    def _recompute(self, kind: str, touched: DataFrame, source: DataFrame) -> None:
        """Recompute the rows at the ``touched`` times from ``source``, whose needed dates are read."""
        level = LEVELS[kind]
        source_time = "ts" if level.source is None else LEVELS[level.source].time
        dates = [r.dt for r in touched.select(F.col(level.time).cast("date").alias("dt")).distinct().collect()]
        if "dt" in source.columns and dates:
            # Partition dates are local days or UTC dates; a local day reaches into two of either.
            near = sorted({d + dt.timedelta(days=k) for d in dates for k in (-1, 0, 1)})
            source = source.where(F.col("dt").isin(near))
        rows = source.withColumn("_time", level.place(source_time)).join(
            touched.select(F.col(level.time).alias("_time")), "_time", "left_semi").drop("_time")
        stored = self.read(kind).where(F.col("dt").isin(dates)).drop("dt")
        kept = stored.join(touched, level.time, "left_anti")
        fresh = level.rollup(rows)
        _replace(self.spark, self.path(kind), kind, kept.unionByName(fresh.select(*kept.columns)), dates)

    def rebuild(self, fact: DataFrame, version: int = ROLLUP_DEFINITION_VERSION) -> None:
        """Build all kinds anew from the facts, each from the level below, and note the version."""
        for kind, level in LEVELS.items():
            source = fact if level.source is None else self.read(level.source).drop("dt")
            dates = [r.dt for r in self.read(kind).select("dt").distinct().collect()]
            _replace(self.spark, self.path(kind), kind, level.rollup(source), dates)
        (self.spark.createDataFrame([(version,)], _VERSION).coalesce(1)
         .write.mode("overwrite").parquet(self.path("definition")))

    def ensure_definition(self, fact: DataFrame, version: int = ROLLUP_DEFINITION_VERSION) -> bool:
        """Rebuild if the stored rollups follow another definition; says whether they did.

        As a new definition cannot be applied to facts that are gone, history before the oldest
        fact is lost with it. The version is noted last, so a broken rebuild is begun again.
        """
        noted = read_or_empty(self.spark, self.path("definition"), _VERSION).first()
        if noted is not None and noted.version == version:
            return False
        self.rebuild(fact, version)
        return True

    def expire_stops(self, now: dt.datetime, days: int = STOP_ROLLUP_RETENTION_DAYS) -> None:
        """Drop stop buckets older than the retention: whole dates, and the rest of the oldest one."""
        oldest = (now - dt.timedelta(days=days)).astimezone(dt.timezone.utc)
        stored = self.read("15min_stop")
        old = [r.dt for r in stored.where(F.col("dt") < F.lit(oldest.date())).select("dt").distinct().collect()]
        drop_partitions(self.spark, self.path("15min_stop"), "dt", old)
        edge = stored.where(F.col("dt") == F.lit(oldest.date())).drop("dt")
        if not edge.where(F.col("bucket") < F.lit(oldest)).isEmpty():
            _replace(self.spark, self.path("15min_stop"), "15min_stop",
                     expire_stop_rollup(edge, now, days), [oldest.date()])


def lost_hours(stored: DataFrame, fact: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Hours of [start, end) that the stored rollup has rows for, but the facts no longer do.

    A refresh of such a range would wipe out rows that nothing can bring back.
    """
    inside = lambda c: (F.col(c) >= F.lit(start)) & (F.col(c) < F.lit(end))
    if "dt" in fact.columns:
        fact = fact.where(F.col("dt").between(*(local_date(F.lit(t), TIME_ZONE) for t in (start, end))))
    hours = fact.where(inside("ts")).select(bucket("ts", 60).alias("hour")).distinct()
    known = stored.where(inside("bucket")).select(bucket("bucket", 60).alias("hour")).distinct()
    return known.join(hours, "hour", "left_anti")
