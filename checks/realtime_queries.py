"""From feed snapshots to facts."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import query, with_views
from lateline.operators import realtime

FACT = ("ts, version_id, trip_id, stop_id, stop_sequence, line_id, operator_id, direction, "
        "service_date, delay_s, status")

FLAT = """
  flat AS (
    SELECT header_ts AS ts, trip_id, stop_sequence, skipped, has_arrival, delay_s
    FROM feed_updates WHERE NOT canceled AND stop_sequence IS NOT NULL)"""
MATCHED = FLAT + """,
  one_stop AS (
    SELECT version_id, trip_id, stop_sequence, min(stop_id) AS stop_id, line_id, operator_id,
      direction, day_offset FROM schedule_lookup
    GROUP BY version_id, trip_id, stop_sequence, line_id, operator_id, direction, day_offset),
  matched AS (
    SELECT f.*, version_id, stop_id, line_id, operator_id, direction, day_offset,
      CAST(CAST(ts + INTERVAL '1' HOUR AS DATE) - CAST(day_offset AS INT) AS DATE) AS service_date
    FROM flat f JOIN one_stop s ON s.trip_id = f.trip_id AND s.stop_sequence = f.stop_sequence)"""
FACTS = MATCHED + f""",
  canceled_rows AS (
    SELECT header_ts AS ts, version_id, l.trip_id, stop_id, l.stop_sequence, line_id, operator_id,
      direction,
      CAST(CAST(header_ts + INTERVAL '1' HOUR AS DATE) - CAST(day_offset AS INT) AS DATE)
        AS service_date,
      CAST(NULL AS INT) AS delay_s, 'CANCELED' AS status
    FROM (SELECT DISTINCT trip_id, header_ts FROM feed_updates WHERE canceled) c
    JOIN schedule_lookup l ON l.trip_id = c.trip_id),
  skipped_rows AS (
    SELECT ts, version_id, trip_id, stop_id, stop_sequence, line_id, operator_id, direction,
      service_date, CAST(NULL AS INT) AS delay_s, 'SKIPPED' AS status
    FROM matched WHERE skipped),
  observed_rows AS (
    SELECT ts, version_id, trip_id, stop_id, stop_sequence, line_id, operator_id, direction,
      service_date, delay_s, 'OBSERVED' AS status
    FROM matched WHERE NOT skipped AND delay_s IS NOT NULL),
  facts AS (SELECT {FACT} FROM canceled_rows UNION ALL SELECT {FACT} FROM skipped_rows
            UNION ALL SELECT {FACT} FROM observed_rows)"""


@query("R1_new_snapshots", with_views("polls", """
    SELECT poll_id, arrived_at, header_ts FROM (
      SELECT *, max(header_ts) OVER (ORDER BY arrived_at, poll_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM polls) x
    WHERE seen IS NULL OR header_ts > seen"""))
def _(v):
    return realtime.new_snapshots(v.polls, ["arrived_at", "poll_id"])


@query("R2_current_version", with_views("schedule_version", """
    SELECT version_id FROM schedule_version ORDER BY loaded_at DESC LIMIT 1"""))
def _(v):
    return realtime.current_version(v.schedule_version)


@query("R3_flatten_stops", with_views("feed_updates", "SELECT * FROM flat", FLAT))
def _(v):
    return realtime.flatten_stops(v.snapshots).drop("entity_no", "stop_no")


@query("R4_match_schedule",
       with_views("feed_updates schedule_lookup", "SELECT * FROM matched", MATCHED))
def _(v):
    updates = realtime.flatten_stops(v.snapshots).drop("entity_no", "stop_no")
    return realtime.match_schedule(updates, v.schedule_lookup, 1)


@query("R5_expand_canceled",
       with_views("feed_updates schedule_lookup", f"SELECT {FACT} FROM canceled_rows", FACTS))
def _(v):
    return realtime.expand_canceled(v.snapshots, v.schedule_lookup, 1).drop("entity_no", "stop_no")


def _matched(v):
    return realtime.match_schedule(realtime.flatten_stops(v.snapshots), v.schedule_lookup, 1)


@query("R6_skipped_stops",
       with_views("feed_updates schedule_lookup", f"SELECT {FACT} FROM skipped_rows", FACTS))
def _(v):
    return realtime.skipped_stops(_matched(v)).drop("entity_no", "stop_no")


@query("R7_observed_delays",
       with_views("feed_updates schedule_lookup", f"SELECT {FACT} FROM observed_rows", FACTS))
def _(v):
    return realtime.observed_delays(_matched(v)).drop("entity_no", "stop_no")


@query("R8_process_feed",
       with_views("feed_updates schedule_lookup", "SELECT * FROM facts", FACTS))
def _(v):
    return realtime.process_feed(v.snapshots, v.schedule_lookup, 1).drop("entity_no", "stop_no")


@query("R9_service_date", with_views("feed_updates schedule_lookup", """
    SELECT service_date, day_offset, count(*) AS n FROM matched GROUP BY ALL""", MATCHED))
def _(v):
    return _matched(v).groupBy("service_date", "day_offset").agg(F.count(F.lit(1)).alias("n"))


@query("R10_insert_new_facts", with_views("feed_updates schedule_lookup", """
    SELECT * FROM facts WHERE NOT (status = 'OBSERVED' AND service_date < DATE '2024-01-15')""",
    FACTS))
def _(v):
    rows = realtime.process_feed(v.snapshots, v.schedule_lookup, 1)
    stored = rows.where((F.col("status") == "OBSERVED")
                        & (F.col("service_date") < dt.date(2024, 1, 15)))
    return realtime.insert_new_facts(stored, rows.unionByName(rows))


@query("R11_log_run", with_views("batch_stats", """
    SELECT started_at, snapshot_ts,
      CASE WHEN error IS NULL AND fresh THEN n_observed ELSE 0 END AS n_observed,
      CASE WHEN error IS NULL AND fresh THEN n_inserted ELSE 0 END AS n_inserted,
      CAST((epoch_us(finished_at) - epoch_us(started_at)) / 1000000 AS DECIMAL(12, 3)) AS seconds,
      CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN fresh THEN 'OK' ELSE 'SKIPPED' END AS status,
      substr(error, 1, 500) AS error
    FROM batch_stats"""))
def _(v):
    return realtime.log_run(v.batch_stats)


def _orphans(column, dim, key):
    return f"""SELECT '{column}' AS key_column, count(*) AS n_facts,
        count(DISTINCT {column}) AS n_keys
      FROM delay_fact WHERE {column} IS NOT NULL
        AND {column} NOT IN (SELECT {key} FROM {dim})"""


@query("R12_orphan_facts", with_views(
    "delay_fact dim_line dim_operator dim_stop schedule_version calendar_days",
    " UNION ALL ".join([_orphans("line_id", "dim_line", "line_id"),
                        _orphans("operator_id", "dim_operator", "operator_id"),
                        _orphans("stop_id", "dim_stop", "stop_id"),
                        _orphans("version_id", "schedule_version", "version_id"),
                        _orphans("service_date", "calendar_days", "date")])))
def _(v):
    return realtime.orphan_facts(v.delay_fact, {
        "line_id": (v.dim_line, "line_id"), "operator_id": (v.dim_operator, "operator_id"),
        "stop_id": (v.dim_stop, "stop_id"), "version_id": (v.schedule_version, "version_id"),
        "service_date": (v.calendar_days, "date")})
