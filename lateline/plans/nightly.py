"""Nightly run: refresh rollups, export a day, verify the copy, purge what is verified."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from lateline.constants import FACT_RETENTION_HOURS
from lateline.operators.retention import purgeable_days, verify_export
from lateline.plans.rollup_store import RollupStore, lost_hours, refresh_stored
from lateline.schema import DELAY_FACT
from lateline.session import materialize, temporary_tables
from lateline.sources.sinks import (
    between, day_bounds, drop_partitions, export_dimensions, export_facts_day, export_rollup_day,
    export_runs_day,
)
from lateline.sources.tables import read_or_empty

PURGED = StructType([StructField("day", DateType()), StructField("n_rows", LongType())])


@dataclass(frozen=True)
class NightlyPaths:
    rollups: str        # root of the stored rollups
    export: str
    verified: str       # register of verified days
    purged: str         # register of purged days
    facts: str | None = None    # the fact table, by local day (dt), to purge; None: purge nothing


def nightly(spark: SparkSession, *arguments, **options) -> DataFrame:
    """`night`, whose intermediate tables are deleted when it ends or fails."""
    with temporary_tables(spark):
        return night(spark, *arguments, **options)


def night(spark: SparkSession, fact: DataFrame, runs: DataFrame, dims: dict[str, DataFrame],
          paths: NightlyPaths, day: dt.date, now: dt.datetime,
          hours: int = FACT_RETENTION_HOURS) -> DataFrame:
    """Days purged (or, without a fact table, purgeable) after ``day`` is exported and verified.

    The order is fixed and every failing step raises, so data goes only behind a verified copy.
    Rollups are refreshed from an hour before the day, but never for a day that is purged: its facts
    are gone and its rollups final. A run whose range lacks facts in any other way is refused
    before it touches a rollup.
    """
    store = RollupStore(spark, paths.rollups)
    purged = read_or_empty(spark, paths.purged, PURGED)
    # First, so that a run for a purged day refuses before it touches the rollups.
    if export_facts_day(fact, day, f"{paths.export}/facts") == 0:
        raise RuntimeError(f"no facts for {day}: nothing may be purged")
    last = purged.agg(F.max("day").alias("day")).first().day
    begin = day_bounds(day)[0] - dt.timedelta(hours=1)
    known = day_bounds(last)[1] if last else None
    start = max(begin, known) if known else begin
    end = now - dt.timedelta(minutes=10)
    store.ensure_definition(fact)
    gone = lost_hours(store.read("15min"), fact, start, end)
    if not gone.isEmpty():
        raise RuntimeError(f"facts before {now} are missing: the rollups from {start} may not be refreshed")
    store.refresh_touched(fact, known)
    for kind in ("15min", "15min_stop"):
        refresh_stored(spark, store.path(kind), fact, kind, start, end)
    store.expire_stops(now)
    # The stored rollup's dt is the UTC date of the bucket: a local day lies in two of them.
    rollup = store.read("15min").where(F.col("dt").between(F.date_sub(F.lit(day), 1), F.lit(day))).drop("dt")
    export_rollup_day(rollup, day, f"{paths.export}/rollup_15min")
    export_runs_day(runs, day, f"{paths.export}/runs")
    export_dimensions(dims, f"{paths.export}/dimensions")

    columns = DELAY_FACT.fieldNames()
    copy = spark.read.parquet(f"{paths.export}/facts").where(F.col("dt") == F.lit(day))
    checked = materialize(verify_export(between(fact, "ts", day, day), copy, "ts", columns),
                          "checked")
    if checked.where(~F.col("verified")).count():
        raise RuntimeError(f"the copy of {day} differs: nothing may be purged")
    checked.write.mode("append").parquet(paths.verified)

    verified = spark.read.parquet(paths.verified).select("day", "n_source", "verified").distinct()
    due = purgeable_days(fact, verified, now, hours).select("day", "n_rows").collect()  # days, not facts
    due = spark.createDataFrame(due, PURGED)
    if paths.facts:
        # Noted before it happens: a day that is half purged must not be refreshed.
        due.write.mode("append").parquet(paths.purged)
        drop_partitions(spark, paths.facts, "dt", [r.day for r in due.select("day").collect()])
    return due
