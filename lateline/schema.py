"""Explicit schemas; nothing in the library infers types from data."""

from pyspark.sql.types import (
    ArrayType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
    ShortType, StringType, StructField, StructType, TimestampType,
)

from lateline.constants import BUSINESS_KEYS, WEEKDAYS


def _struct(*fields):
    return StructType([StructField(name, kind) for name, kind in fields])


DIM_LINE = _struct(
    ("line_id", StringType()), ("short_name", StringType()), ("long_name", StringType()),
    ("transport_mode", StringType()), ("line_type", StringType()))

DIM_STOP = _struct(
    ("stop_id", StringType()), ("name", StringType()), ("lat", DoubleType()),
    ("lon", DoubleType()), ("commune", StringType()), ("city", StringType()),
    ("stop_type", StringType()))

DIM_OPERATOR = _struct(("operator_id", StringType()), ("name", StringType()))

DIM_DATE = _struct(
    ("date", DateType()), ("year", ShortType()), ("month", ShortType()),
    ("iso_week", ShortType()), ("weekday", ShortType()), ("day_name", StringType()),
    ("day_type", StringType()))

SCHEDULE_VERSION = _struct(
    ("version_id", IntegerType()), ("package_name", StringType()),
    ("valid_from", DateType()), ("valid_to", DateType()),
    ("fingerprint", StringType()), ("loaded_at", TimestampType()))

SCHEDULE_LOOKUP = _struct(
    ("version_id", IntegerType()), ("trip_id", StringType()), ("stop_id", StringType()),
    ("stop_sequence", IntegerType()), ("arrival", StringType()), ("line_id", StringType()),
    ("direction", StringType()), ("headsign", StringType()),
    ("operator_id", StringType()), ("day_offset", ShortType()))

DELAY_FACT = _struct(
    ("ts", TimestampType()), ("version_id", IntegerType()), ("trip_id", StringType()),
    ("stop_id", StringType()), ("stop_sequence", IntegerType()), ("line_id", StringType()),
    ("operator_id", StringType()), ("direction", StringType()),
    ("service_date", DateType()), ("delay_s", IntegerType()), ("status", StringType()))

FACT_KEY = ["trip_id", "stop_id", "stop_sequence", "ts"]

RUN_LOG = _struct(
    ("started_at", TimestampType()), ("snapshot_ts", TimestampType()),
    ("n_observed", IntegerType()), ("n_inserted", IntegerType()),
    ("seconds", DecimalType(12, 3)),("status", StringType()), ("error", StringType()))

FEED = StructType([
    StructField("header", _struct(("timestamp", LongType()))),
    StructField("entity", ArrayType(StructType([
        StructField("id", StringType()),
        StructField("trip_update", StructType([
            StructField("trip", _struct(
                ("trip_id", StringType()), ("schedule_relationship", StringType()))),
            StructField("stop_time_update", ArrayType(StructType([
                StructField("stop_sequence", IntegerType()),
                StructField("schedule_relationship", StringType()),
                StructField("arrival", _struct(("delay", IntegerType()))),
            ]))),
        ])),
    ]))),
])

WEIGHTS = _struct(("layer", IntegerType()), ("idx", IntegerType()), ("value", DoubleType()))

SEQUENCE = StructType([
    StructField("client", StringType()), StructField("window", TimestampType()),
    StructField("x", ArrayType(ArrayType(FloatType()))),
])

# Package tables are read as strings only. These are the columns the schedule block uses.
PACKAGE_COLUMNS = {
    **{name: list(keys) for name, keys in BUSINESS_KEYS.items()},
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "routes_ext": ["route_id", "route_type_1"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "stops_ext": ["stop_id", "community_ids", "city", "stop_attribute_ids"],
    "stops_attributes_ext": ["stop_type_id", "stop_attr_name"],
    "communities_ext": ["community_id", "community_name"],
    "trips": ["trip_id", "route_id", "direction_id", "trip_headsign"],
    "trips_ext": ["trip_id", "operator_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time"],
    "calendar": ["service_id", "start_date", "end_date", *WEEKDAYS],
    "operators_ext": ["operator_id", "operator_name"],
    "feed_info": ["feed_start_date", "feed_end_date"],
}
