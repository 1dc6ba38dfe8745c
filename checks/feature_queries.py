"""Feature windows, scaling and sequences."""

from pyspark.sql import functions as F

from checks.registry import query, with_views
from checks.schedule_queries import DIM_DATE
from lateline.constants import FEATURES
from lateline.functions.clock import hms_to_seconds
from lateline.operators import audits
from lateline.operators import features as ops
from lateline.plans.feature_build import feature_tables
from lateline.session import materialize

HOURLY = 60
FACT_VIEWS = "delay_fact schedule_lookup client_map"
ALL_VIEWS = FACT_VIEWS + " calendar services"


def chain(minutes):
    """CTEs from facts to raw features with windows of ``minutes``."""
    return f"""
  facts AS (
    SELECT f.*, client, time_bucket(INTERVAL '{minutes} minutes', ts) AS "window"
    FROM delay_fact f JOIN client_map m ON m.operator_id = f.operator_id),
  first_stop AS (
    SELECT version_id, trip_id,
      CAST(split_part(arrival, ':', 1) AS DOUBLE) * 3600
        + CAST(split_part(arrival, ':', 2) AS DOUBLE) * 60
        + CAST(split_part(arrival, ':', 3) AS DOUBLE) AS departure_s
    FROM (SELECT *, row_number() OVER (PARTITION BY version_id, trip_id
                      ORDER BY stop_sequence, stop_id) AS rn FROM schedule_lookup) x
    WHERE rn = 1),
  prim AS (
    SELECT client, "window",
      count(*) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS n,
      CAST(coalesce(sum(delay_s) FILTER (WHERE status = 'OBSERVED'
        AND delay_s BETWEEN -3600 AND 7200), 0) AS BIGINT) AS "S",
      count(*) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -30 AND 60) AS q,
      count(*) FILTER (WHERE status = 'SKIPPED') AS u,
      max(delay_s) FILTER (WHERE status = 'OBSERVED' AND delay_s BETWEEN -3600 AND 7200) AS dmax,
      count(*) FILTER (WHERE status = 'OBSERVED'
        AND (delay_s IS NULL OR delay_s NOT BETWEEN -3600 AND 7200)) AS rejected
    FROM facts GROUP BY client, "window"),
  trip_medians AS (
    SELECT version_id, trip_id, client, line_id, direction, service_date,
      CAST(median(delay_s) AS DOUBLE) AS delay_s
    FROM facts WHERE status = 'OBSERVED' AND delay_s IS NOT NULL GROUP BY ALL),
  departed AS (
    SELECT client, line_id, direction,
      CAST(service_date AS TIMESTAMP) - INTERVAL '1' HOUR
        + to_microseconds(CAST(round((departure_s + delay_s) * 1000000) AS BIGINT)) AS departure,
      t.trip_id, t.version_id, service_date
    FROM trip_medians t JOIN first_stop s
      ON s.version_id = t.version_id AND s.trip_id = t.trip_id),
  gaps AS (
    SELECT * FROM (
      SELECT client, line_id, direction, departure, trip_id,
        (epoch_us(departure) - epoch_us(lag(departure) OVER (PARTITION BY client, line_id, direction
          ORDER BY departure, trip_id, version_id, service_date))) / 1000000 AS headway_s
      FROM departed) x WHERE headway_s IS NOT NULL),
  expanded AS (
    SELECT *, time_bucket(INTERVAL '{minutes} minutes', departure)
        + shift * INTERVAL '{minutes} minutes' AS "window"
    FROM gaps, (SELECT unnest(range(0, {60 // minutes})) AS shift) s),
  line_std AS (
    SELECT client, "window", line_id, direction, stddev_samp(headway_s) AS headway_std,
      count(headway_s) AS n_headways
    FROM expanded GROUP BY ALL HAVING count(headway_s) >= 2),
  irregularity AS (
    SELECT client, "window", avg(headway_std) AS h FROM line_std GROUP BY client, "window"),
  grid AS (
    SELECT client, "window" FROM (SELECT DISTINCT client FROM prim) c,
      (SELECT unnest(generate_series((SELECT min("window") FROM prim),
        (SELECT max("window") FROM prim), INTERVAL '{minutes} minutes')) AS "window") w),
  base AS (
    SELECT g.client, g."window", coalesce(n, 0) AS n, "S", coalesce(q, 0) AS q,
      coalesce(u, 0) AS u, coalesce(rejected, 0) AS rejected, h, coalesce(n, 0) > 0 AS complete,
      "S" / nullif(n, 0) AS d, q / nullif(n, 0) AS w, u / nullif(n, 0) AS p,
      CASE WHEN n > 0 THEN dmax END AS dmax
    FROM grid g LEFT JOIN prim p ON p.client = g.client AND p."window" = g."window"
    LEFT JOIN irregularity i ON i.client = g.client AND i."window" = g."window"),
  {DIM_DATE},
  dated AS (
    SELECT b.*, CAST("window" + INTERVAL '1' HOUR AS DATE) AS date, day_type,
      CAST(hour("window" + INTERVAL '1' HOUR) AS INT) AS hour,
      CASE WHEN day_type LIKE 'dni robocze%' THEN 1 ELSE 0 END AS workday,
      sin(2 * pi() * (hour("window" + INTERVAL '1' HOUR) * 60 + minute("window")) / 1440)
        AS sin_hour,
      cos(2 * pi() * (hour("window" + INTERVAL '1' HOUR) * 60 + minute("window")) / 1440)
        AS cos_hour
    FROM base b LEFT JOIN dim_date x ON x.date = CAST("window" + INTERVAL '1' HOUR AS DATE)),
  raw AS (
    SELECT *, d - lag(d) OVER (PARTITION BY client ORDER BY "window") AS delta_d FROM dated)"""


def scaled_chain(minutes):
    """CTEs on to the split, profile, scaling and sequences."""
    stats = ", ".join(f"avg({f}) AS {f}_mean, stddev_samp({f}) AS {f}_std" for f in FEATURES)
    scaled = ", ".join(
        f"coalesce((v.{f} - {f}_mean) / nullif({f}_std, 0), 0.0) AS {f}" for f in FEATURES)
    last = 'OVER (PARTITION BY client, split ORDER BY "window" ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)'
    vector = ", ".join(f"CAST({f} AS FLOAT)" for f in FEATURES)
    return chain(minutes) + f""",
  boundary AS (SELECT quantile_cont(epoch_us("window"), 0.7) AS boundary_us FROM raw),
  parted AS (
    SELECT *, CASE WHEN epoch_us("window") <= (SELECT boundary_us FROM boundary) THEN 'train'
      ELSE 'test' END AS split FROM raw),
  profile AS (
    SELECT client, hour, workday, median(d) AS m FROM parted
    WHERE split = 'train' AND d IS NOT NULL GROUP BY ALL),
  deviated AS (
    SELECT p.*, d - m AS r FROM parted p LEFT JOIN profile f
      ON f.client = p.client AND f.hour = p.hour AND f.workday = p.workday),
  stats AS (SELECT client, {stats} FROM deviated WHERE split = 'train' GROUP BY client),
  scaled AS (
    SELECT v.client, v."window", complete, split, hour, {scaled}
    FROM deviated v LEFT JOIN stats s ON s.client = v.client),
  framed AS (
    SELECT client, split, "window", list([{vector}]) {last} AS x, min(complete) {last} AS full_run,
      min("window") {last} AS first_window
    FROM scaled),
  seqs AS (
    SELECT client, split, "window", x FROM framed
    WHERE full_run AND len(x) = 8
      AND epoch_us("window") - epoch_us(first_window) = {7 * minutes * 60000000})"""


def rounded(df, *names):
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})


def rsql(*names):
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)


def facts(v, minutes=15):
    return ops.assign_window(ops.assign_client(v.delay_fact, v.client_map), minutes)


def tables(v):
    return feature_tables(v.delay_fact, v.schedule_lookup, v.dim_date, v.client_map,
                          minutes=HOURLY)


def departed(v):
    return ops.departures(ops.trip_median(facts(v)), ops.first_stop(v.schedule_lookup))


def gaps_of(v):
    return ops.headways(materialize(departed(v), "departures"))


RATES = ["d", "w", "p"]
QUARTER = chain(15)
SCALED = scaled_chain(HOURLY)
FACT = ("ts, version_id, trip_id, stop_id, stop_sequence, line_id, operator_id, direction, "
        "service_date, delay_s, status")


@query("L1_assign_client", with_views(FACT_VIEWS + " calendar services",
                                      f"SELECT {FACT}, client FROM facts", QUARTER))
def _(v):
    return ops.assign_client(v.delay_fact, v.client_map)


@query("L2_assign_window", with_views(ALL_VIEWS, """
    SELECT trip_id, ts, "window" FROM facts""", QUARTER))
def _(v):
    return ops.assign_window(v.delay_fact).select("trip_id", "ts", "window")


@query("L3_hms_to_seconds", with_views("schedule_lookup", """
    SELECT arrival, CAST(split_part(arrival, ':', 1) AS DOUBLE) * 3600
      + CAST(split_part(arrival, ':', 2) AS DOUBLE) * 60
      + CAST(split_part(arrival, ':', 3) AS DOUBLE) AS seconds, count(*) AS n
    FROM schedule_lookup GROUP BY ALL"""))
def _(v):
    return (v.schedule_lookup.groupBy("arrival", hms_to_seconds("arrival").alias("seconds"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("L4_first_stop", with_views(ALL_VIEWS, "SELECT * FROM first_stop", QUARTER))
def _(v):
    return ops.first_stop(v.schedule_lookup)


@query("L5_primary_quantities", with_views(ALL_VIEWS, "SELECT * FROM prim", QUARTER))
def _(v):
    return ops.primary_quantities(facts(v))


@query("L6_trip_median", with_views(ALL_VIEWS, "SELECT * FROM trip_medians", QUARTER))
def _(v):
    return ops.trip_median(facts(v))


@query("L7_departures", with_views(ALL_VIEWS, "SELECT * FROM departed", QUARTER))
def _(v):
    return departed(v)


@query("L8_headways", with_views(ALL_VIEWS, "SELECT * FROM gaps", QUARTER))
def _(v):
    return gaps_of(v)


@query("L9_rolling_expand", with_views(ALL_VIEWS, """
    SELECT client, line_id, direction, departure, trip_id, headway_s, "window" FROM expanded""",
    QUARTER))
def _(v):
    return ops.rolling_expand(gaps_of(v))


@query("L10_line_headway_std", with_views(ALL_VIEWS, f"""
    SELECT client, "window", line_id, direction, {rsql('headway_std')}, n_headways
    FROM line_std""", QUARTER))
def _(v):
    return rounded(ops.line_headway_std(ops.rolling_expand(gaps_of(v))),
                   "headway_std")


@query("L11_headway_irregularity", with_views(
    ALL_VIEWS, f'SELECT client, "window", {rsql("h")} FROM irregularity', QUARTER))
def _(v):
    return rounded(ops.headway_irregularity(facts(v), v.schedule_lookup), "h")


@query("L12_time_grid", with_views(ALL_VIEWS, "SELECT * FROM grid", QUARTER))
def _(v):
    return ops.time_grid(facts(v))


@query("L13_base_features", with_views(ALL_VIEWS, f"""
    SELECT client, "window", n, "S", q, u, rejected, complete, dmax, {rsql('h', *RATES)}
    FROM base""", QUARTER))
def _(v):
    primary = ops.primary_quantities(facts(v))
    irregularity = ops.headway_irregularity(facts(v), v.schedule_lookup)
    return rounded(ops.base_features(ops.time_grid(primary), primary, irregularity), "h", *RATES)


@query("L14_calendar_features", with_views(ALL_VIEWS, f"""
    SELECT client, "window", date, day_type, hour, workday, {rsql('sin_hour', 'cos_hour')}
    FROM dated""", QUARTER))
def _(v):
    dated = ops.calendar_features(ops.time_grid(facts(v)), v.dim_date)
    return rounded(dated, "sin_hour", "cos_hour")


@query("L15_delay_change", with_views(
    ALL_VIEWS, f'SELECT client, "window", {rsql("d", "delta_d")} FROM raw', QUARTER))
def _(v):
    primary = ops.primary_quantities(facts(v))
    base = ops.base_features(
        ops.time_grid(primary), primary, ops.headway_irregularity(facts(v), v.schedule_lookup))
    return rounded(ops.delay_change(base.select("client", "window", "d")), "d", "delta_d")


RAW_ROUNDED = ["h", "d", "w", "p", "sin_hour", "cos_hour", "delta_d"]


@query("L16_build_features", with_views(ALL_VIEWS, f"""
    SELECT client, "window", n, "S", q, u, rejected, complete, dmax, date, day_type, hour, workday,
      {rsql(*RAW_ROUNDED)} FROM raw""", QUARTER))
def _(v):
    return rounded(ops.build_features(v.delay_fact, v.schedule_lookup, v.dim_date, v.client_map),
                   *RAW_ROUNDED)


@query("L17_time_split", with_views(ALL_VIEWS, """
    SELECT client, "window", split FROM parted""", SCALED))
def _(v):
    return tables(v).raw.select("client", "window", "split")


@query("L18_daily_profile", with_views(
    ALL_VIEWS, f"SELECT client, hour, workday, {rsql('m')} FROM profile", SCALED))
def _(v):
    return rounded(tables(v).profile, "m")


@query("L19_profile_deviation", with_views(
    ALL_VIEWS, f'SELECT client, "window", {rsql("d", "r")} FROM deviated', SCALED))
def _(v):
    built = tables(v)
    return rounded(ops.profile_deviation(built.raw, built.profile)
                   .select("client", "window", "d", "r"), "d", "r")


STAT_NAMES = [f"{f}_{s}" for f in FEATURES for s in ("mean", "std")]


@query("L20_scaling_stats", with_views(
    ALL_VIEWS, f"SELECT client, {rsql(*STAT_NAMES)} FROM stats", SCALED))
def _(v):
    return rounded(tables(v).stats, *STAT_NAMES)


@query("L21_standardize", with_views(
    ALL_VIEWS, f'SELECT client, "window", split, {rsql(*FEATURES)} FROM scaled', SCALED))
def _(v):
    return rounded(tables(v).features.select("client", "window", "split", *FEATURES), *FEATURES)


@query("L22_sequences", with_views(ALL_VIEWS, """
    SELECT client, split, "window", CAST(step AS INT) AS step, """ + ", ".join(
        f"round(CAST(list_extract(list_extract(x, step + 1), {i + 1}) AS DOUBLE), 4) + 0.0 AS {f}"
        for i, f in enumerate(FEATURES)) + """
    FROM seqs, (SELECT CAST(unnest(range(0, 8)) AS INT) AS step) s""", SCALED))
def _(v):
    steps = tables(v).sequences.select("client", "split", "window",
                                       F.posexplode("x").alias("step", "s"))
    return steps.select("client", "split", "window", "step", *[
        (F.round(F.col("s")[i].cast("double"), 4) + F.lit(0.0)).alias(f)
        for i, f in enumerate(FEATURES)])


@query("L23_sequence_report", with_views(ALL_VIEWS, """
    SELECT client, count(*) AS n_windows, count(*) FILTER (WHERE complete) AS n_complete,
      (SELECT count(*) FROM seqs s WHERE s.client = f.client AND split = 'train') AS n_train,
      (SELECT count(*) FROM seqs s WHERE s.client = f.client AND split = 'test') AS n_test
    FROM scaled f GROUP BY client""", SCALED))
def _(v):
    built = tables(v)
    return ops.sequence_report(built.features, built.sequences)


@query("A17_check_feature_formulas", with_views(ALL_VIEWS, """
    SELECT 'd = S / n' AS rule, count(*) FILTER (WHERE complete AND abs(d - "S" / n) > 1e-9)
      AS n_violations FROM raw UNION ALL
    SELECT 'w = q / n', count(*) FILTER (WHERE complete AND abs(w - q / n) > 1e-9) FROM raw
    UNION ALL
    SELECT 'p = u / n', count(*) FILTER (WHERE complete AND abs(p - u / n) > 1e-9) FROM raw
    UNION ALL
    SELECT 'empty window has no d', count(*) FILTER (WHERE NOT complete AND d IS NOT NULL) FROM raw
    UNION ALL
    SELECT 'grid is contiguous', count(*) FILTER (WHERE step <> 900) FROM (
      SELECT (epoch_us("window") - epoch_us(lag("window") OVER (PARTITION BY client
        ORDER BY "window"))) / 1000000 AS step FROM raw) x""", QUARTER))
def _(v):
    return audits.check_feature_formulas(
        ops.build_features(v.delay_fact, v.schedule_lookup, v.dim_date, v.client_map))


@query("A18_check_no_leakage", with_views(ALL_VIEWS, """
    SELECT last_train, first_test, last_train < first_test AS split_by_time,
      (SELECT count(*) FROM profile o JOIN full_profile f ON f.client = o.client
         AND f.hour = o.hour AND f.workday = o.workday
       WHERE abs(o.m - f.m) > 1e-8 + 1e-5 * abs(f.m)) AS n_profile_differences,
      round(largest, 6) + 0.0 AS max_train_mean, largest < 0.05 AS means_near_zero
    FROM (SELECT max("window") FILTER (WHERE split = 'train') AS last_train,
            min("window") FILTER (WHERE split = 'test') AS first_test FROM scaled) t,
      (SELECT greatest(0.0, """ + ", ".join(
        f"CASE WHEN stddev_samp({f}) > 1e-9 THEN abs(avg({f})) END" for f in FEATURES) + """)
         AS largest FROM scaled WHERE split = 'train') m""",
    SCALED + """, full_profile AS (
      SELECT client, hour, workday, median(d) AS m FROM parted WHERE d IS NOT NULL GROUP BY ALL)"""))
def _(v):
    built = tables(v)
    return rounded(audits.check_no_leakage(built.features, built.raw), "max_train_mean")


@query("A19_check_sequences", with_views(ALL_VIEWS, """
    SELECT n_sequences, n_bad_shape, n_with_nan, n_possible,
      n_sequences <= n_possible AS within_bound
    FROM (SELECT
      (SELECT count(*) FROM seqs) AS n_sequences,
      (SELECT count(*) FROM seqs WHERE len(x) <> 8 OR len(list_filter(x, lambda s: len(s) <> 11)) > 0)
        AS n_bad_shape,
      (SELECT count(*) FROM seqs WHERE len(list_filter(flatten(x), lambda e: e IS NULL OR isnan(e))) > 0)
        AS n_with_nan,
      (SELECT count(*) FROM (
         SELECT min(complete) OVER w AS full_run, count(*) OVER w AS n FROM scaled
         WINDOW w AS (PARTITION BY client ORDER BY "window" ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
       ) r WHERE full_run AND n = 8) AS n_possible) y""", SCALED))
def _(v):
    built = tables(v)
    return audits.check_sequences(built.sequences, built.features)
