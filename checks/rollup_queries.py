"""Rollups by time bucket and their refresh rules."""

import datetime as dt

from checks.registry import query, with_views
from lateline.constants import REFRESH_1H, REFRESH_15MIN, REFRESH_DAY
from lateline.operators import rollups

UTC = dt.timezone.utc
MEASURES = """
  CAST(sum(delay_s) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS BIGINT)
    AS delay_sum,
  count(*) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS n_obs,
  count(*) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -30 AND 60) AS n_on_time,
  min(delay_s) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS min_delay,
  max(delay_s) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS max_delay,
  count(*) FILTER (WHERE status = 'OBSERVED' AND (delay_s < -3600 OR delay_s > 7200))
    AS n_rejected,
  count(*) FILTER (WHERE status = 'CANCELED') AS n_canceled,
  count(*) FILTER (WHERE status = 'SKIPPED') AS n_skipped"""
MERGED = """
  CAST(sum(delay_sum) AS BIGINT) AS delay_sum, CAST(sum(n_obs) AS BIGINT) AS n_obs,
  CAST(sum(n_on_time) AS BIGINT) AS n_on_time, min(min_delay) AS min_delay,
  max(max_delay) AS max_delay, CAST(sum(n_rejected) AS BIGINT) AS n_rejected,
  CAST(sum(n_canceled) AS BIGINT) AS n_canceled, CAST(sum(n_skipped) AS BIGINT) AS n_skipped"""
KEYS = "service_date, version_id, line_id, operator_id"
STOP_KEYS = "service_date, version_id, stop_id, line_id"


def quarter_sql(source, keys=KEYS):
    return (f"SELECT time_bucket(INTERVAL '15 minutes', ts) AS bucket, {keys}, {MEASURES} "
            f"FROM {source} GROUP BY ALL")


def hour_sql(source):
    return (f"SELECT time_bucket(INTERVAL '1 hour', bucket) AS hour, {KEYS}, {MERGED} "
            f"FROM {source} GROUP BY ALL")


def day_sql(source):
    return (f"SELECT CAST(hour + INTERVAL '1' HOUR AS DATE) AS day, {KEYS}, {MERGED} "
            f"FROM {source} GROUP BY ALL")


def patched(old, new, column, low, high):
    inside = f"{column} >= {low} AND {column} < {high}"
    return f"SELECT * FROM {old} WHERE NOT ({inside}) UNION ALL SELECT * FROM {new} WHERE {inside}"


QUARTERS = f"c1 AS ({quarter_sql('delay_fact')})"
HOURS = f"{QUARTERS}, c2 AS ({hour_sql('c1')})"
OLD = f"o1 AS ({quarter_sql('facts_copy')}), o2 AS ({hour_sql('o1')})"
STOPS = f"c4 AS ({quarter_sql('delay_fact', STOP_KEYS)})"


@query("C1_rollup_15min", with_views("delay_fact", quarter_sql("delay_fact")))
def _(v):
    return rollups.rollup_15min(v.delay_fact)


@query("C2_rollup_1h", with_views("delay_fact", hour_sql("c1"), QUARTERS))
def _(v):
    return rollups.rollup_1h(rollups.rollup_15min(v.delay_fact))


@query("C3_rollup_day", with_views("delay_fact", day_sql("c2"), HOURS))
def _(v):
    return rollups.rollup_day(rollups.rollup_1h(rollups.rollup_15min(v.delay_fact)))


@query("C4_rollup_15min_stop", with_views("delay_fact", quarter_sql("delay_fact", STOP_KEYS)))
def _(v):
    return rollups.rollup_15min_stop(v.delay_fact)


@query("C5_refresh_15min", with_views(
    "delay_fact facts_copy",
    patched("o1", "c1", "bucket", "TIMESTAMP '2024-01-10 06:15:00'",
            "TIMESTAMP '2024-01-10 11:45:00'"), f"{QUARTERS}, {OLD}"))
def _(v):
    return rollups.refresh_window(rollups.rollup_15min(v.facts_copy), v.delay_fact, "15min",
                                  dt.datetime(2024, 1, 10, 12, 7, tzinfo=UTC), REFRESH_15MIN)


@query("C5_refresh_1h", with_views(
    "delay_fact facts_copy",
    patched("o2", "c2", "hour", "TIMESTAMP '2024-01-05 13:00:00'",
            "TIMESTAMP '2024-01-19 11:00:00'"), f"{HOURS}, {OLD}"))
def _(v):
    stored = rollups.rollup_1h(rollups.rollup_15min(v.facts_copy))
    return rollups.refresh_window(stored, rollups.rollup_15min(v.delay_fact), "1h",
                                  dt.datetime(2024, 1, 19, 12, 7, tzinfo=UTC), REFRESH_1H)


@query("C5_refresh_day", with_views(
    "delay_fact facts_copy",
    patched("o3", "c3", "day", "DATE '2023-11-22'", "DATE '2024-01-20'"),
    f"{HOURS}, c3 AS ({day_sql('c2')}), {OLD}, o3 AS ({day_sql('o2')})"))
def _(v):
    old = rollups.rollup_day(rollups.rollup_1h(rollups.rollup_15min(v.facts_copy)))
    hours = rollups.rollup_1h(rollups.rollup_15min(v.delay_fact))
    return rollups.refresh_day_window(old, hours, dt.datetime(2024, 1, 20, 12, 0, tzinfo=UTC),
                                      REFRESH_DAY)


@query("C6_refresh_before_purge", with_views(
    "delay_fact facts_copy",
    patched("o1", "c1", "bucket", "TIMESTAMP '2024-01-09 22:00:00'",
            "TIMESTAMP '2024-01-11 02:15:00'"), f"{QUARTERS}, {OLD}"))
def _(v):
    return rollups.refresh_before_purge(
        rollups.rollup_15min(v.facts_copy), v.delay_fact, "15min", dt.date(2024, 1, 10),
        dt.datetime(2024, 1, 11, 2, 30, tzinfo=UTC))


@query("C7_rebuild_on_definition_change",
       with_views("delay_fact", quarter_sql("delay_fact")))
def _(v):
    return rollups.rebuild_on_definition_change(rollups.rollup_15min(v.facts_copy),
                                                v.delay_fact, "15min", stored_version=1)


@query("C8_expire_stop_rollup", with_views(
    "delay_fact", "SELECT * FROM c4 WHERE bucket >= TIMESTAMP '2024-01-17 03:00:00'", STOPS))
def _(v):
    return rollups.expire_stop_rollup(rollups.rollup_15min_stop(v.delay_fact),
                                      dt.datetime(2024, 1, 31, 3, 0, tzinfo=UTC))
