"""Delay measures by time bucket: 15 minutes, 1 hour, local day, and 15 minutes per stop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateline.constants import (
    CANCELED, OBSERVED, ON_TIME_MAX, ON_TIME_MIN, REFRESH_15MIN, ROLLUP_DEFINITION_VERSION,
    SANE_MAX, SANE_MIN, SKIPPED, STOP_ROLLUP_RETENTION_DAYS, TIME_ZONE,
)
from lateline.functions.clock import add_seconds, bucket, local_date, local_midnight

KEYS = ["service_date", "version_id", "line_id", "operator_id"]
STOP_KEYS = ["service_date", "version_id", "stop_id", "line_id"]
MEASURES = ["delay_sum", "n_obs", "n_on_time", "min_delay", "max_delay", "n_rejected",
            "n_canceled", "n_skipped"]


def measures() -> list[Column]:
    delay = F.col("delay_s")
    observed = F.col("status") == OBSERVED
    sane = observed & delay.between(SANE_MIN, SANE_MAX)
    counted = F.when(sane, delay)
    return [
        F.sum(counted).alias("delay_sum"),
        F.count_if(sane).alias("n_obs"),
        F.count_if(observed & delay.between(ON_TIME_MIN, ON_TIME_MAX)).alias("n_on_time"),
        F.min(counted).alias("min_delay"),
        F.max(counted).alias("max_delay"),
        F.count_if(observed & ~delay.between(SANE_MIN, SANE_MAX)).alias("n_rejected"),
        F.count_if(F.col("status") == CANCELED).alias("n_canceled"),
        F.count_if(F.col("status") == SKIPPED).alias("n_skipped"),
    ]


def merged_measures() -> list[Column]:
    merge = {"min_delay": F.min, "max_delay": F.max}
    return [merge.get(m, F.sum)(m).alias(m) for m in MEASURES]


def rollup_15min(fact: DataFrame) -> DataFrame:
    return fact.groupBy(bucket("ts", 15).alias("bucket"), *KEYS).agg(*measures())


def rollup_15min_stop(fact: DataFrame) -> DataFrame:
    return fact.groupBy(bucket("ts", 15).alias("bucket"), *STOP_KEYS).agg(*measures())


def rollup_1h(quarters: DataFrame) -> DataFrame:
    return (quarters.groupBy(bucket("bucket", 60).alias("hour"), *KEYS)
            .agg(*merged_measures()))


def rollup_day(hours: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    return (hours.groupBy(local_date("hour", zone).alias("day"), *KEYS)
            .agg(*merged_measures()))


ROLLUPS = {
    "15min": (rollup_15min, "bucket", 15 * 60),
    "15min_stop": (rollup_15min_stop, "bucket", 15 * 60),
    "1h": (rollup_1h, "hour", 60 * 60),
}


def refresh_between(stored: DataFrame, source: DataFrame, kind: str, start: Column,
                    end: Column) -> DataFrame:
    """``stored`` with the buckets that lie wholly in [start, end) recomputed from ``source``.

    Whole buckets only, so a recomputed bucket never misses rows outside the range. Buckets
    without rows any more vanish from the range; all others stay as they are.
    """
    rollup, time, width = ROLLUPS[kind]
    source_time = "ts" if kind.startswith("15min") else "bucket"
    low, high = _whole_buckets(start, end, width)

    def inside(c):
        return (F.col(c) >= low) & (F.col(c) < high)

    if source_time == "ts" and "dt" in source.columns:
        # Stored facts: their local day prunes partitions.
        source = source.where(F.col("dt").between(local_date(low), local_date(high)))
    fresh = rollup(source.where(inside(source_time)))
    return stored.where(~inside(time)).unionByName(fresh.select(*stored.columns))


def _whole_buckets(start: Column, end: Column, seconds: int) -> tuple[Column, Column]:
    width = seconds * 1_000_000
    first, last = F.unix_micros(start), F.unix_micros(end)
    return (F.timestamp_micros(first + F.pmod(-first, F.lit(width))),
            F.timestamp_micros(last - F.pmod(last, F.lit(width))))


def refresh_window(stored: DataFrame, source: DataFrame, kind: str, now: dt.datetime,
                   window: tuple[str, str] = REFRESH_15MIN) -> DataFrame:
    """Recompute the buckets from ``now - window[0]`` to ``now - window[1]``."""
    back, lag = (F.expr(f"INTERVAL {w}") for w in window)
    instant = F.lit(now).cast("timestamp")
    return refresh_between(stored, source, kind, instant - back, instant - lag)


def refresh_day_window(stored: DataFrame, hours: DataFrame, now: dt.datetime,
                       window: tuple[str, str], zone: str = TIME_ZONE) -> DataFrame:
    """Recompute the local days that lie wholly between ``now - window[0]`` and ``- window[1]``."""
    back, lag = (F.expr(f"INTERVAL {w}") for w in window)
    instant = F.lit(now).cast("timestamp")
    start, end = instant - back, instant - lag
    first = F.when(local_midnight(local_date(start, zone), zone) == start, local_date(start, zone)) \
        .otherwise(F.date_add(local_date(start, zone), 1))
    last = local_date(end, zone)
    inside_day = (F.col("day") >= first) & (F.col("day") < last)
    inside_hour = ((F.col("hour") >= local_midnight(first, zone))
                   & (F.col("hour") < local_midnight(last, zone)))
    fresh = rollup_day(hours.where(inside_hour), zone)
    return stored.where(~inside_day).unionByName(fresh.select(*stored.columns))


def refresh_before_purge(stored: DataFrame, fact: DataFrame, kind: str, day: dt.date,
                         now: dt.datetime, zone: str = TIME_ZONE) -> DataFrame:
    """Recompute from an hour before local ``day`` to ten minutes before ``now``."""
    start = add_seconds(local_midnight(F.lit(day), zone), -3600)
    end = add_seconds(F.lit(now).cast("timestamp"), -600)
    return refresh_between(stored, fact, kind, start, end)


def rebuild_on_definition_change(stored: DataFrame, fact: DataFrame, kind: str,
                                 stored_version: int | None,
                                 version: int = ROLLUP_DEFINITION_VERSION) -> DataFrame:
    """Keep the stored rollup of the current definition, else build it anew."""
    if stored_version == version:
        return stored
    if kind == "1h":
        return rollup_1h(rollup_15min(fact))
    return ROLLUPS[kind][0](fact)


def expire_stop_rollup(rollup: DataFrame, now: dt.datetime,
                       days: int = STOP_ROLLUP_RETENTION_DAYS) -> DataFrame:
    """Drop stop buckets that are older than the retention."""
    oldest = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return rollup.where(F.col("bucket") >= oldest)
