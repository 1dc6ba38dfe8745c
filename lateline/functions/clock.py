"""Instants, local wall-clock time and tumbling buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lateline.constants import TIME_ZONE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(ts: Column | str, zone: str = TIME_ZONE) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of an instant in ``zone``."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), col(ts).cast("timestamp_ntz"))


def local_date(ts: Column | str, zone: str = TIME_ZONE) -> Column:
    """Date of an instant in ``zone``; a shift and a division, cheap enough for every fact."""
    shifted = F.unix_micros(F.from_utc_timestamp(col(ts), zone))
    day = 86_400_000_000
    return F.date_from_unix_date(((shifted - F.pmod(shifted, F.lit(day))) / day).cast("int"))


def local_midnight(day: Column | str, zone: str = TIME_ZONE) -> Column:
    """Instant at which the local ``day`` begins; right on 23 h and 25 h days."""
    wall = col(day).cast("date").cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.current_timezone(), wall).cast("timestamp")


def bucket(ts: Column | str, minutes: int) -> Column:
    """Start of the absolute tumbling bucket that holds ``ts``."""
    micros = F.unix_micros(col(ts))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(minutes * 60_000_000)))


def add_seconds(ts: Column | str, seconds: Column | int) -> Column:
    """``ts`` plus elapsed (not wall-clock) seconds, to the microsecond."""
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    micros = F.round(seconds.cast("double") * 1_000_000).cast("bigint")
    return F.timestamp_micros(F.unix_micros(col(ts)) + micros)


def hms_to_seconds(text: Column | str) -> Column:
    """"25:30:00" -> 91800.0; hours may pass 24."""
    parts = F.split(col(text), ":")
    hours, minutes, seconds = (F.try_element_at(parts, F.lit(i)).try_cast("double")
                               for i in (1, 2, 3))
    return hours * 3600 + minutes * 60 + seconds


def service_date(ts: Column | str, day_offset: Column | str, zone: str = TIME_ZONE) -> Column:
    """Timetable day of a live report: its local date minus the trip's day offset."""
    return F.date_sub(local_date(ts, zone), col(day_offset).cast("int"))
