"""Package choice, dimensions, lookup, versions and upserts."""

import datetime as dt

from pyspark.sql import functions as F

from checks.fixtures import END, START
from checks.registry import query, with_views
from lateline.operators import schedule
from lateline.sources import packages

UTC = dt.timezone.utc


PLAIN = {"epoch_us(ts)", "version_id", "stop_sequence", "service_date", "delay_s", "day_offset"}


def digest_sql(source, columns, by=""):
    """The content digest in SQL; ``columns`` are expressions, strings unless in PLAIN."""
    encoded = " || '|' || ".join(
        f"coalesce(CAST({c} AS VARCHAR), '-')" if c in PLAIN else
        f"coalesce(CAST(length({c}) AS VARCHAR) || ':' || {c}, '-')"
        for c in columns)
    sums = " || '|' || ".join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)) AS VARCHAR)"
        for i in range(8))
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return (f"SELECT {lead}count(*) AS n_rows, sha256(CAST(count(*) AS VARCHAR) || '|' || {sums}) "
            f"AS digest FROM (SELECT {lead}sha256({encoded}) AS h FROM {source}) x {group}")


LOOKUP = digest_sql("schedule_lookup", schedule.LOOKUP_CONTENT)
DIM_DATE = f"""
  days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}',
             INTERVAL '1' DAY)) AS DATE) AS date),
  active AS (
    SELECT date, service_id,
      row_number() OVER (PARTITION BY date ORDER BY CAST(service_id AS INT) < 9,
                         CAST(service_id AS INT)) AS rn
    FROM days JOIN calendar
      ON date BETWEEN CAST(strptime(start_date, '%Y%m%d') AS DATE)
                  AND CAST(strptime(end_date, '%Y%m%d') AS DATE)
     AND list_extract([monday, tuesday, wednesday, thursday, friday, saturday, sunday],
                      CAST(isodow(date) AS INT)) = '1'),
  dim_date AS (
    SELECT d.date, CAST(year(d.date) AS SMALLINT) AS year, CAST(month(d.date) AS SMALLINT) AS month,
      CAST(weekofyear(d.date) AS SMALLINT) AS iso_week,
      CAST(isodow(d.date) AS SMALLINT) AS weekday,
      list_extract(['poniedziałek', 'wtorek', 'środa', 'czwartek', 'piątek', 'sobota',
                    'niedziela'], CAST(isodow(d.date) AS INT)) AS day_name,
      coalesce(s.name, 'no schedule') AS day_type
    FROM days d LEFT JOIN active a ON a.date = d.date AND a.rn = 1
    LEFT JOIN services s ON s.service_id = a.service_id)"""


@query("S1_select_packages", with_views("packages", """
    SELECT name, start_date, end_date, count(*) AS n_days FROM ranked WHERE rn = 1
    GROUP BY ALL""", """
    days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-05',
                 TIMESTAMP '2024-01-18', INTERVAL '1' DAY)) AS DATE) AS day),
    ranked AS (
      SELECT day, name, start_date, end_date, row_number() OVER (PARTITION BY day ORDER BY
        CAST(substr(name, 22, 2) AS INT) DESC,
        CAST(regexp_extract(name, '^schedule_ZTM_2024.01.[0-9]+_([0-9]+)_', 1) AS INT) DESC,
        name DESC) AS rn
      FROM days JOIN packages ON day BETWEEN start_date AND end_date
      WHERE name LIKE 'schedule%')"""))
def _(v):
    return packages.select_packages(v.packages, dt.date(2024, 1, 5))


@query("D1_merge_packages", with_views("package_routes", """
    SELECT route_id, route_long_name, route_short_name, route_type FROM (
      SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY package_order, block, line) rn
      FROM package_routes) x WHERE rn = 1"""))
def _(v):
    return schedule.merge_package_table(v.package_routes, ["route_id"])


@query("D1_merge_feed_info", with_views("package_routes", """
    SELECT route_id, route_long_name, route_short_name, route_type FROM package_routes
    WHERE package_order = (SELECT min(package_order) FROM package_routes)"""))
def _(v):
    return schedule.merge_packages({"feed_info": v.package_routes})["feed_info"]


@query("D2_build_dim_line", with_views("routes routes_ext", """
    SELECT r.route_id AS line_id, route_short_name AS short_name, route_long_name AS long_name,
      CASE route_type WHEN '0' THEN 'tram' WHEN '3' THEN 'bus' WHEN '11' THEN 'trolleybus'
        ELSE 'other' END AS transport_mode,
      coalesce(route_type_1, 'Normalna') AS line_type
    FROM routes r LEFT JOIN routes_ext e ON e.route_id = r.route_id"""))
def _(v):
    return schedule.build_dim_line(v.routes, v.routes_ext)


@query("D3_build_dim_stop", with_views("stops stops_ext communities stop_attributes", """
    SELECT s.stop_id, stop_name AS name, TRY_CAST(stop_lat AS DOUBLE) AS lat,
      TRY_CAST(stop_lon AS DOUBLE) AS lon, community_name AS commune, city,
      CASE WHEN e.stop_id IS NOT NULL THEN coalesce(stop_attr_name, 'Standardowy') END
        AS stop_type
    FROM stops s LEFT JOIN stops_ext e ON e.stop_id = s.stop_id
    LEFT JOIN communities c ON c.community_id = split_part(community_ids, '_', 1)
    LEFT JOIN stop_attributes a ON a.stop_type_id = split_part(stop_attribute_ids, '_', 1)"""))
def _(v):
    return schedule.build_dim_stop(v.stops, v.stops_ext, v.communities, v.stop_attributes)


@query("D4_build_dim_operator", with_views(
    "operators", "SELECT operator_id, operator_name AS name FROM operators"))
def _(v):
    return schedule.build_dim_operator(v.operators)


@query("D5_build_dim_date", with_views("calendar services", "SELECT * FROM dim_date", DIM_DATE))
def _(v):
    return v.dim_date


@query("D6_build_schedule_lookup", with_views("stop_times trips trips_ext", """
    SELECT s.trip_id, stop_id, TRY_CAST(stop_sequence AS INT) AS stop_sequence,
      arrival_time AS arrival, route_id AS line_id, direction_id AS direction,
      trip_headsign AS headsign, operator_id,
      CAST(coalesce(CAST(split_part(arrival_time, ':', 1) AS INT) // 24, 0) AS SMALLINT)
        AS day_offset
    FROM stop_times s JOIN trips t ON t.trip_id = s.trip_id
    LEFT JOIN trips_ext e ON e.trip_id = s.trip_id"""))
def _(v):
    return schedule.build_schedule_lookup(v.stop_times, v.trips, v.trips_ext)


@query("D7_schedule_fingerprint", with_views("schedule_lookup", LOOKUP))
def _(v):
    return schedule.schedule_fingerprint(v.schedule_lookup)


LOAD = ("2024-01-20 | 2024-01-21", dt.date(2024, 1, 20), dt.date(2024, 2, 2),
        dt.datetime(2024, 1, 20, 4, tzinfo=UTC))
COLUMNS = "version_id, package_name, valid_from, valid_to, fingerprint, loaded_at"


@query("D8_register_version_new", with_views("schedule_lookup schedule_version", f"""
    SELECT {COLUMNS} FROM schedule_version UNION ALL
    SELECT (SELECT max(version_id) + 1 FROM schedule_version), '2024-01-20 | 2024-01-21',
      DATE '2024-01-20', DATE '2024-02-02', digest, TIMESTAMP '2024-01-20 04:00:00' FROM fp""",
    f"fp AS ({LOOKUP})"))
def _(v):
    return schedule.register_version(
        v.schedule_version, schedule.schedule_fingerprint(v.schedule_lookup), *LOAD)


@query("D8_register_version_same", with_views("schedule_lookup schedule_version", """
    SELECT version_id, package_name, valid_from,
      CASE WHEN latest THEN greatest(valid_to, DATE '2024-02-02') ELSE valid_to END AS valid_to,
      CASE WHEN latest THEN (SELECT digest FROM fp) ELSE fingerprint END AS fingerprint, loaded_at
    FROM (SELECT *, loaded_at = max(loaded_at) OVER () AS latest FROM schedule_version) x""",
    f"fp AS ({LOOKUP})"))
def _(v):
    fingerprint = schedule.schedule_fingerprint(v.schedule_lookup)
    last = v.schedule_version.agg(F.max("loaded_at")).scalar()
    stored = v.schedule_version.withColumn(
        "fingerprint", F.when(F.col("loaded_at") == last, fingerprint.select("digest").scalar())
        .otherwise(F.col("fingerprint")))
    return schedule.register_version(stored, fingerprint, *LOAD)


@query("D9_upsert", with_views("upsert_target upsert_source", """
    SELECT coalesce(t.id, s.id) AS id,
      CASE WHEN s.id IS NOT NULL THEN s.name ELSE t.name END AS name,
      CASE WHEN s.id IS NOT NULL THEN s.balance ELSE t.balance END AS balance,
      CASE WHEN s.id IS NOT NULL THEN s.segment ELSE t.segment END AS segment
    FROM upsert_target t FULL JOIN upsert_source s ON t.id = s.id"""))
def _(v):
    return schedule.upsert(v.upsert_target, v.upsert_source, ["id"])


@query("D10_upsert_dim_date", with_views("calendar services", """
    SELECT date, year, month, iso_week, weekday, day_name,
      CASE WHEN year IS NULL OR day_type <> 'no schedule' THEN day_type
           WHEN date < DATE '2024-01-20' THEN 'stored' ELSE 'no schedule' END AS day_type
    FROM dim_date""", DIM_DATE))
def _(v):
    stored = v.dim_date.where(F.col("date") < dt.date(2024, 1, 20)) \
        .withColumn("day_type", F.lit("stored"))
    return schedule.upsert_dim_date(stored, v.dim_date)


@query("D11_append_lookup", with_views("versioned_lookup schedule_lookup schedule_version", """
    SELECT * FROM versioned_lookup UNION ALL
    SELECT (SELECT max(version_id) + 1 FROM schedule_version) AS version_id, trip_id, stop_id,
      stop_sequence, arrival, line_id, direction, headsign, operator_id, day_offset
    FROM schedule_lookup"""))
def _(v):
    registered = schedule.register_version(
        v.schedule_version, schedule.schedule_fingerprint(v.schedule_lookup), *LOAD)
    return schedule.append_lookup(v.versioned_lookup, v.schedule_lookup, v.schedule_version,
                                  registered)


@query("D12_prune_lookup", with_views("versioned_lookup versioned_fact", """
    SELECT * FROM versioned_lookup WHERE version_id = 3 OR version_id IN (
      SELECT version_id FROM versioned_fact WHERE version_id IS NOT NULL)"""))
def _(v):
    return schedule.prune_lookup(v.versioned_lookup, 3, v.versioned_fact)
