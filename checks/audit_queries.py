"""Quality, coverage and gap reports."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import query, with_views
from checks.schedule_queries import DIM_DATE
from lateline.operators import audits

UTC = dt.timezone.utc
RECENT = "recent AS (SELECT * FROM delay_fact WHERE ts > TIMESTAMP '2024-01-20 12:00:00')"
GAPS = """gaps AS (
    SELECT started_at AS gap_from, following AS gap_to,
      (epoch_us(following) - epoch_us(started_at)) / 60000000 AS gap_minutes
    FROM (SELECT started_at, lead(started_at) OVER (ORDER BY started_at) AS following
          FROM run_log) x
    WHERE epoch_us(following) - epoch_us(started_at) > 15 * 60000000)"""


def recent(v):
    return audits.since(v.delay_fact, dt.datetime(2024, 1, 20, 12, 0, tzinfo=UTC))


@query("A1_feed_coverage", with_views("feed_updates schedule_lookup", """
    SELECT n_trips AS n_entities, n_trips AS n_trip_updates, n_trips, n_known_trips, n_canceled,
      n_stop_updates, n_no_sequence, n_matched, n_skipped, n_no_arrival, n_no_delay, n_candidates,
      n_pairs - n_matched AS n_lost, 100 * (n_pairs - n_matched) / n_stop_updates AS loss_pct
    FROM (SELECT
      (SELECT count(DISTINCT trip_id) FROM feed_updates) AS n_trips,
      (SELECT count(DISTINCT trip_id) FROM feed_updates
        WHERE trip_id IN (SELECT trip_id FROM schedule_lookup)) AS n_known_trips,
      (SELECT count(DISTINCT trip_id) FROM feed_updates WHERE canceled) AS n_canceled,
      (SELECT count(*) FROM running) AS n_stop_updates,
      (SELECT count(*) FROM running WHERE stop_sequence IS NULL) AS n_no_sequence,
      (SELECT count(*) FROM running WHERE stop_sequence IS NOT NULL) AS n_pairs,
      (SELECT count(*) FROM running r JOIN schedule_lookup l
        ON l.trip_id = r.trip_id AND l.stop_sequence = r.stop_sequence) AS n_matched,
      (SELECT count(*) FROM running WHERE stop_sequence IS NOT NULL AND skipped) AS n_skipped,
      (SELECT count(*) FROM running WHERE stop_sequence IS NOT NULL AND NOT skipped
        AND NOT has_arrival) AS n_no_arrival,
      (SELECT count(*) FROM running WHERE stop_sequence IS NOT NULL AND NOT skipped
        AND has_arrival AND delay_s IS NULL) AS n_no_delay,
      (SELECT count(*) FROM running WHERE stop_sequence IS NOT NULL AND NOT skipped
        AND delay_s IS NOT NULL) AS n_candidates) x""",
    "running AS (SELECT * FROM feed_updates WHERE NOT canceled)"))
def _(v):
    return audits.feed_coverage(v.snapshots, v.schedule_lookup, 1)


@query("A2_status_distribution", with_views("delay_fact", """
    SELECT status, count(*) AS n, count(*) FILTER (WHERE delay_s IS NULL) AS n_no_delay
    FROM recent GROUP BY status""", RECENT))
def _(v):
    return audits.status_distribution(recent(v))


@query("A3_null_keys", with_views("delay_fact", """
    SELECT count(*) FILTER (WHERE line_id IS NULL) AS no_line,
      count(*) FILTER (WHERE operator_id IS NULL) AS no_operator,
      count(*) FILTER (WHERE direction IS NULL) AS no_direction,
      count(*) FILTER (WHERE service_date IS NULL) AS no_service_date,
      count(*) FILTER (WHERE version_id IS NULL) AS no_version
    FROM recent""", RECENT))
def _(v):
    return audits.null_keys(recent(v))


@query("A4_direction_values", with_views(
    "delay_fact", "SELECT direction, count(*) AS n FROM recent GROUP BY direction", RECENT))
def _(v):
    return audits.direction_values(recent(v))


@query("A5_delay_percentiles", with_views("delay_fact", """
    SELECT min(delay_s) AS min, quantile_disc(delay_s, 0.01) AS p01,
      quantile_disc(delay_s, 0.25) AS p25, quantile_disc(delay_s, 0.5) AS median,
      quantile_disc(delay_s, 0.75) AS p75, quantile_disc(delay_s, 0.99) AS p99,
      max(delay_s) AS max
    FROM recent WHERE status = 'OBSERVED'""", RECENT))
def _(v):
    return audits.delay_percentiles(recent(v))


@query("A6_absurd_values", with_views("delay_fact", """
    SELECT count(*) FILTER (WHERE delay_s < -3600) AS n_too_early,
      count(*) FILTER (WHERE delay_s > 7200) AS n_too_late,
      count(*) FILTER (WHERE stop_sequence < 0) AS n_negative_sequence
    FROM recent""", RECENT))
def _(v):
    return audits.absurd_values(recent(v))


@query("A7_operating_day_shift", with_views("feed_updates schedule_lookup", """
    SELECT CAST(day_offset AS INT) AS shift_days, count(*) AS n FROM feed_updates f
    JOIN (SELECT DISTINCT trip_id, stop_sequence, day_offset FROM schedule_lookup) l
      ON l.trip_id = f.trip_id AND l.stop_sequence = f.stop_sequence
    WHERE NOT canceled GROUP BY ALL"""))
def _(v):
    from lateline.operators.realtime import flatten_stops, match_schedule
    return audits.operating_day_shift(
        match_schedule(flatten_stops(v.snapshots), v.schedule_lookup, 1))


@query("A8_dimension_coverage", with_views("delay_fact dim_line dim_operator dim_stop", """
    SELECT (SELECT count(*) FROM dim_line) AS line_size,
      (SELECT count(DISTINCT line_id) FROM delay_fact) AS line_used,
      (SELECT count(*) FROM dim_operator) AS operator_size,
      (SELECT count(DISTINCT operator_id) FROM delay_fact) AS operator_used,
      (SELECT count(*) FROM dim_stop) AS stop_size,
      (SELECT count(DISTINCT stop_id) FROM delay_fact) AS stop_used"""))
def _(v):
    return audits.dimension_coverage(v.delay_fact, v.dim_line, v.dim_operator, v.dim_stop)


@query("A9_day_type_coverage", with_views("delay_fact calendar services", """
    SELECT day_type, count(DISTINCT service_date) AS n_days
    FROM delay_fact JOIN dim_date ON date = service_date GROUP BY day_type""", DIM_DATE))
def _(v):
    return audits.day_type_coverage(v.delay_fact, v.dim_date)


@query("A10_day_type_distribution", with_views("calendar services", """
    SELECT day_type, count(*) AS n, min(date) AS first_date, max(date) AS last_date
    FROM dim_date GROUP BY day_type""", DIM_DATE))
def _(v):
    return audits.day_type_distribution(v.dim_date)


@query("A10_day_type_damage", with_views("delay_fact calendar services", """
    SELECT count(*) FILTER (WHERE day_type = 'no schedule' AND date < DATE '2024-01-29')
        AS n_no_schedule,
      count(*) FILTER (WHERE date < DATE '2024-01-29') AS n_past,
      count(*) FILTER (WHERE day_type = 'no schedule'
        AND date IN (SELECT service_date FROM delay_fact)) AS n_with_facts
    FROM dim_date""", DIM_DATE))
def _(v):
    return audits.day_type_damage(v.dim_date, v.delay_fact, dt.date(2024, 1, 29))


@query("A11_gaps", with_views("run_log", "SELECT * FROM gaps", GAPS))
def _(v):
    return audits.gaps(v.run_log, 15)


@query("A12_gap_summary", with_views("run_log", """
    SELECT first_run, last_run, n_runs, n_gaps, round(lost, 6) AS lost_minutes,
      round(100 * (1 - lost / ((epoch_us(last_run) - epoch_us(first_run)) / 60000000)), 6)
        AS coverage_pct
    FROM (SELECT min(started_at) AS first_run, max(started_at) AS last_run, count(*) AS n_runs,
      (SELECT count(*) FROM gaps) AS n_gaps,
      (SELECT coalesce(sum(gap_minutes), 0) FROM gaps) AS lost FROM run_log) x""", GAPS))
def _(v):
    return (audits.gap_summary(v.run_log, 15)
            .withColumn("lost_minutes", F.round("lost_minutes", 6))
            .withColumn("coverage_pct", F.round("coverage_pct", 6)))


@query("A13_largest_gaps", with_views(
    "run_log", "SELECT * FROM gaps ORDER BY gap_minutes DESC, gap_from LIMIT 10", GAPS))
def _(v):
    return audits.largest_gaps(audits.gaps(v.run_log, 15))


@query("A15_collector_silence", with_views("run_log", """
    SELECT max(started_at) AS last_run,
      (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(started_at))) / 60000000
        AS silence_minutes,
      CASE WHEN max(started_at) IS NULL THEN 'empty log'
           WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(started_at))
             > 5 * 60000000 THEN 'silent' ELSE 'none' END AS problem
    FROM run_log"""))
def _(v):
    return audits.collector_silence(v.run_log, dt.datetime(2024, 1, 31, tzinfo=UTC))


@query("A16_check_client_mapping", with_views("delay_fact client_map_faulty", """
    SELECT 'operator in two clients' AS problem, operator_id AS detail FROM client_map_faulty
    GROUP BY operator_id HAVING count(DISTINCT client) > 1
    UNION ALL
    SELECT DISTINCT 'operator without client', operator_id FROM delay_fact
    WHERE operator_id NOT IN (SELECT operator_id FROM client_map_faulty)
    UNION ALL
    SELECT 'number of clients', CAST(count(DISTINCT client) AS VARCHAR) FROM client_map_faulty
    HAVING count(DISTINCT client) NOT BETWEEN 6 AND 9"""))
def _(v):
    return audits.check_client_mapping(v.client_map_faulty, v.delay_fact, 6, 9)
