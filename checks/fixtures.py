"""Inputs of the operators, as views over whole driver tables.

Each SQL text is valid in Spark and in DuckDB; ``{table}`` stands for a driver table.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateline.session import SETTINGS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS = {
    "delay_fact": """
        SELECT ts, 1 AS version_id, CAST(k AS STRING) AS trip_id,
          CAST(user_id AS STRING) AS stop_id, CAST(1 + event_id % 7 AS INT) AS stop_sequence,
          concat('L', CAST(k % 6 AS STRING)) AS line_id, CAST(k % 6 AS STRING) AS operator_id,
          CAST(CAST(floor(k / 6) AS BIGINT) % 2 AS STRING) AS direction,
          CAST(ts + INTERVAL '1' HOUR AS DATE) AS service_date,
          CASE WHEN event_type IN ('error', 'signup') THEN NULL
               WHEN event_id % 97 = 0 THEN 9000 WHEN event_id % 89 = 0 THEN -4000
               ELSE CAST(CAST(round(value * 100) AS BIGINT) % 400 - 120 AS INT) END AS delay_s,
          CASE event_type WHEN 'error' THEN 'SKIPPED' WHEN 'signup' THEN 'CANCELED'
               ELSE 'OBSERVED' END AS status
        FROM (SELECT *, CAST(floor(event_id / 5) AS BIGINT) AS k FROM {events}) e""",
    "schedule_lookup": """
        SELECT 1 AS version_id, CAST(l_orderkey AS STRING) AS trip_id,
          CAST(l_partkey AS STRING) AS stop_id, l_linenumber AS stop_sequence,
          concat(CAST(h AS STRING), ':', lpad(CAST(m AS STRING), 2, '0'), ':00') AS arrival,
          concat('L', CAST(l_orderkey % 6 AS STRING)) AS line_id,
          CAST(CAST(floor(l_orderkey / 6) AS BIGINT) % 2 AS STRING) AS direction,
          concat('to ', CAST(l_orderkey % 4 AS STRING)) AS headsign,
          CAST(l_orderkey % 6 AS STRING) AS operator_id,
          CAST(floor(h / 24) AS SMALLINT) AS day_offset
        FROM (SELECT *, 22 + CAST(floor(l_orderkey / 12) AS BIGINT) % 4 AS h,
                (l_orderkey * 7 + l_linenumber) % 60 AS m
              FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM {lineitem}) d) x""",
    "versioned_lookup": """
        SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS version_id,
          CAST(l_orderkey AS STRING) AS trip_id, CAST(l_partkey AS STRING) AS stop_id,
          l_linenumber AS stop_sequence, l_shipmode_arrival AS arrival, 'L1' AS line_id,
          '0' AS direction, 'x' AS headsign, '5' AS operator_id, CAST(0 AS SMALLINT) AS day_offset
        FROM (SELECT *, concat(CAST(5 + l_orderkey % 18 AS STRING), ':00:00')
                AS l_shipmode_arrival
              FROM (SELECT DISTINCT l_returnflag, l_orderkey, l_partkey, l_linenumber
                    FROM {lineitem}) d) x""",
    "versioned_fact": """
        SELECT ts, CASE event_type WHEN 'click' THEN NULL ELSE 1 END AS version_id FROM {events}""",
    "calendar": """
        SELECT CAST(n_nationkey + 1 AS STRING) AS service_id,
          replace(CAST(DATE '2023-12-25' + CAST(n_nationkey AS INT) AS STRING), '-', '')
            AS start_date,
          replace(CAST(DATE '2023-12-25' + CAST(n_nationkey + 5 + n_nationkey % 7 AS INT)
            AS STRING), '-', '') AS end_date,
          CASE WHEN (n_nationkey + 0) % 3 = 0 THEN '1' ELSE '0' END AS monday,
          CASE WHEN (n_nationkey + 1) % 3 = 0 THEN '1' ELSE '0' END AS tuesday,
          CASE WHEN (n_nationkey + 2) % 3 = 0 THEN '1' ELSE '0' END AS wednesday,
          CASE WHEN (n_nationkey + 3) % 3 = 0 THEN '1' ELSE '0' END AS thursday,
          CASE WHEN (n_nationkey + 4) % 3 = 0 THEN '1' ELSE '0' END AS friday,
          CASE WHEN (n_nationkey + 5) % 3 = 0 THEN '1' ELSE '0' END AS saturday,
          CASE WHEN (n_nationkey + 6) % 3 = 0 THEN '1' ELSE '0' END AS sunday
        FROM {nation}""",
    "services": """
        SELECT CAST(n_nationkey + 1 AS STRING) AS service_id,
          CASE WHEN n_nationkey + 1 >= 9 AND n_nationkey % 4 = 0 THEN 'holiday'
               WHEN n_nationkey % 2 = 0 THEN 'dni robocze' ELSE 'weekend' END AS name
        FROM {nation}""",
    "run_log": """
        SELECT ts AS started_at, ts AS snapshot_ts, CAST(event_id % 50 AS INT) AS n_observed,
          CAST(event_id % 40 AS INT) AS n_inserted, CAST(0.5 AS DECIMAL(12, 3)) AS seconds,
          CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'SKIPPED' ELSE 'OK' END
            AS status, CAST(NULL AS STRING) AS error
        FROM {events}""",
    "polls": """
        SELECT event_id AS poll_id, ts AS arrived_at,
          CAST(floor((event_id - (event_id % 4) * 3) / 2) AS BIGINT) * 20 AS header_ts
        FROM {events}""",
    "batch_stats": """
        SELECT ts AS started_at, ts + INTERVAL '1' SECOND AS finished_at, ts AS snapshot_ts,
          event_type <> 'view' AS fresh, CAST(event_id % 50 AS INT) AS n_observed,
          CAST(event_id % 40 AS INT) AS n_inserted,
          CASE WHEN event_type = 'error' THEN concat('failed: ', repeat(props, 60)) END AS error
        FROM {events}""",
    "packages": """
        SELECT CASE WHEN s_suppkey % 10 = 9 THEN concat('other_', CAST(s_suppkey AS STRING), '.zip')
               ELSE concat('schedule_ZTM_2024.01.',
                 lpad(CAST(1 + (s_suppkey * 7) % 28 AS STRING), 2, '0'), '_',
                 CAST(s_suppkey AS STRING), '_1.zip') END AS name,
          DATE '2024-01-01' + CAST((s_suppkey * 3) % 20 AS INT) AS start_date,
          DATE '2024-01-01' + CAST((s_suppkey * 3) % 20 + s_suppkey % 6 AS INT) AS end_date
        FROM {supplier}""",
    "feed_info": """
        SELECT s_name AS package,
          replace(CAST(DATE '2024-01-01' + CAST(s_nationkey AS INT) AS STRING), '-', '')
            AS feed_start_date,
          replace(CAST(DATE '2024-01-01' + CAST(s_nationkey + s_suppkey % 9 AS INT) AS STRING),
            '-', '') AS feed_end_date
        FROM {supplier}""",
    "package_routes": """
        SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS route_id, p_name AS route_long_name,
          p_brand AS route_short_name,
          CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '11' ELSE '2' END
            AS route_type,
          concat('p', CAST(p_size % 4 AS STRING)) AS package, p_size % 4 AS package_order,
          CAST(0 AS BIGINT) AS block, p_partkey AS line
        FROM {part}""",
    "routes": """
        SELECT CAST(p_partkey AS STRING) AS route_id, p_brand AS route_short_name,
          p_name AS route_long_name,
          CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '11' WHEN 3 THEN '2' END
            AS route_type
        FROM {part}""",
    "routes_ext": """
        SELECT CAST(s_suppkey * 3 AS STRING) AS route_id,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE concat('kind ', CAST(s_nationkey AS STRING)) END
            AS route_type_1
        FROM {supplier}""",
    "stops": """
        SELECT CAST(c_custkey AS STRING) AS stop_id, c_name AS stop_name,
          CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS stop_lat,
          CASE WHEN c_nationkey = 3 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS stop_lon
        FROM {customer}""",
    "stops_ext": """
        SELECT CAST(s_suppkey * 2 AS STRING) AS stop_id, concat('city ', s_name) AS city,
          CASE WHEN s_nationkey = 5 THEN NULL
               ELSE concat(CAST(s_nationkey AS STRING), '_', CAST(s_suppkey AS STRING)) END
            AS community_ids,
          CASE WHEN s_nationkey % 4 = 0 THEN NULL
               ELSE concat(CAST(s_nationkey % 7 AS STRING), '_9') END AS stop_attribute_ids
        FROM {supplier}""",
    "communities": """
        SELECT CAST(n_nationkey AS STRING) AS community_id, n_name AS community_name
        FROM {nation}""",
    "stop_attributes": """
        SELECT CAST(r_regionkey AS STRING) AS stop_type_id, r_name AS stop_attr_name
        FROM {region}""",
    "operators": """
        SELECT CAST(n_nationkey AS STRING) AS operator_id, n_name AS operator_name
        FROM {nation}""",
    "stop_times": """
        SELECT CAST(l_orderkey AS STRING) AS trip_id, CAST(l_partkey AS STRING) AS stop_id,
          CASE WHEN l_quantity >= 50 THEN 'x' ELSE CAST(l_linenumber AS STRING) END
            AS stop_sequence,
          CASE WHEN l_quantity <= 1 THEN NULL
               ELSE concat(CAST(20 + l_orderkey % 7 AS STRING), ':00:00') END AS arrival_time
        FROM {lineitem}""",
    "trips": """
        SELECT CAST(o_orderkey AS STRING) AS trip_id, CAST(o_custkey AS STRING) AS route_id,
          CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' END AS direction_id,
          o_orderpriority AS trip_headsign
        FROM {orders}""",
    "trips_ext": """
        SELECT CAST(o_orderkey * 2 AS STRING) AS trip_id, CAST(o_custkey % 9 AS STRING)
          AS operator_id
        FROM {orders}""",
    "schedule_version": """
        SELECT r_regionkey + 1 AS version_id, concat('package ', r_name) AS package_name,
          DATE '2024-01-01' + r_regionkey AS valid_from,
          DATE '2024-01-14' + r_regionkey AS valid_to,
          concat('fp', CAST(r_regionkey AS STRING)) AS fingerprint,
          CAST(DATE '2024-01-01' + (r_regionkey * 3) % 5 AS TIMESTAMP) AS loaded_at
        FROM {region}""",
    "upsert_target": """
        SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
        FROM {customer}""",
    "upsert_source": """
        SELECT p_partkey + 500 AS id, p_name AS name,
          CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END AS balance, p_brand AS segment
        FROM {part}""",
    "dim_line": """
        SELECT DISTINCT concat('L', CAST(n_nationkey % 5 AS STRING)) AS line_id FROM {nation}""",
    "dim_operator": """
        SELECT CAST(n_nationkey AS STRING) AS operator_id, n_name AS name FROM {nation}""",
    "dim_stop": """
        SELECT CAST(s_suppkey AS STRING) AS stop_id, s_name AS name FROM {supplier}""",
    "calendar_days": """
        SELECT DATE '2024-01-01' + CAST(n_nationkey AS INT) AS date FROM {nation}""",
    "client_map": """
        SELECT CAST(n_nationkey AS STRING) AS operator_id,
          concat('c', CAST(n_nationkey % 3 AS STRING)) AS client
        FROM {nation}""",
    "client_map_faulty": """
        SELECT CAST(r_regionkey AS STRING) AS operator_id, r_name AS client FROM {region}
        UNION ALL
        SELECT CAST(n_regionkey AS STRING), concat('r', CAST(n_regionkey AS STRING)) FROM {nation}""",
    "feed_updates": """
        SELECT event_id, part, trip_id, canceled, header_ts,
          CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(1 + event_id % 7 AS INT) END
            AS stop_sequence,
          event_type = 'error' AS skipped, event_type NOT IN ('error', 'signup') AS has_arrival,
          CASE WHEN event_type IN ('error', 'signup') OR event_id % 37 = 0 THEN NULL
               ELSE CAST(CAST(round(value * 100) AS BIGINT) % 400 - 120 AS INT) END AS delay_s
        FROM (SELECT *, CAST(k AS STRING) AS trip_id, CAST(floor(k / 20) AS BIGINT) AS part,
                date_trunc('second', max(ts) OVER (PARTITION BY floor(k / 20))) AS header_ts,
                max(CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY k) = 1 AS canceled
              FROM (SELECT *, CAST(floor(event_id / 5) AS BIGINT) AS k FROM {events}) e) x""",
    "facts_copy": """
        SELECT * FROM delay_fact
        WHERE NOT (status = 'CANCELED' AND service_date = DATE '2024-01-10')""",
    "updates": """
        SELECT concat('c', CAST(p_partkey % 7 AS STRING)) AS client, 0 AS layer,
          CAST(floor(p_partkey / 7) AS INT) AS idx,
          CAST((p_partkey * 37) % 101 AS DOUBLE) / 8 AS value,
          CAST(10 + 5 * (p_partkey % 7) AS BIGINT) AS n_examples
        FROM {part}""",
}

START, END = dt.date(2023, 12, 25), dt.date(2024, 2, 2)


def configure(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


class Views:
    """Lazily built views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache
    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        stamps = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps})

    @functools.cache
    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        if name == "facts_copy":
            text = text.replace("delay_fact", "{delay_fact}")
            return self.spark.sql(text, delay_fact=self.delay_fact)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        return self.view(name)

    @functools.cached_property
    def dim_date(self) -> DataFrame:
        from lateline.operators.schedule import build_dim_date
        return build_dim_date(self.calendar, self.services, START, END)

    @functools.cached_property
    def snapshots(self) -> DataFrame:
        """``feed_updates`` as nested feed messages of at most 20 trips (100 stop updates)."""
        stop = F.struct(
            F.col("event_id"),
            F.col("stop_sequence"),
            F.when(F.col("skipped"), "SKIPPED").otherwise("SCHEDULED")
            .alias("schedule_relationship"),
            F.when(F.col("has_arrival"), F.struct(F.col("delay_s").alias("delay")))
            .alias("arrival"))
        trips = (self.feed_updates.groupBy("part", "trip_id", "canceled", "header_ts")
                 .agg(F.transform(F.sort_array(F.collect_list(stop)),
                                  lambda s: s.dropFields("event_id")).alias("stops")))
        entity = F.struct(
            F.col("trip_id").alias("id"),
            F.struct(
                F.struct(F.col("trip_id"),
                         F.when(F.col("canceled"), "CANCELED").otherwise("SCHEDULED")
                         .alias("schedule_relationship")).alias("trip"),
                F.col("stops").alias("stop_time_update")).alias("trip_update"))
        return (trips.groupBy("part", "header_ts")
                .agg(F.collect_list(entity).alias("entity"))
                .select(F.struct(F.unix_seconds("header_ts").alias("timestamp")).alias("header"),
                        "entity"))
