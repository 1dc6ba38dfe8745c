"""Dimensions, schedule lookup, version register and upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateline.constants import (
    BUSINESS_KEYS, DAY_NAMES, DEFAULT_LINE_TYPE, DEFAULT_STOP_TYPE, FIRST_HOLIDAY_SERVICE,
    NO_SCHEDULE, OTHER_MODE, TRANSPORT_MODES, WEEKDAYS,
)
from lateline.functions.digest import content_digest
from lateline.session import few_values

POSITION = ["package_order", "block", "line"]
PLACE = ["package", *POSITION]
LOOKUP_CONTENT = ["trip_id", "stop_id", "stop_sequence", "arrival", "line_id", "direction",
                  "headsign", "operator_id", "day_offset"]

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(c: Column) -> Column:
    """Double of a decimal text, null for anything else."""
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def _whole(c: Column) -> Column:
    """Integer of a text such as "7" or "7.0", null for anything else."""
    text = F.trim(c)
    # The second cast runs only where the first gives null.
    return F.coalesce(text.try_cast("int"), text.try_cast("decimal(20,6)").try_cast("int"))


def _mapped(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def merge_package_table(table: DataFrame, keys: list[str] | None,
                        keep_position: bool = False) -> DataFrame:
    """First record per business key, in package order; all records if there are no keys.

    The winner is found by a partial aggregate, so a key that most packages repeat is reduced
    before the shuffle.
    """
    content = [c for c in table.columns if c not in PLACE]
    position = [c for c in POSITION if keep_position]
    if keys is None:
        return table.select(*content, *position)
    rest = [c for c in content if c not in keys]
    first = table.groupBy(*keys).agg(
        F.min_by(F.struct(*rest, *POSITION), F.struct(*POSITION)).alias("r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"r.{c}")
                          for c in content + position])


def merge_packages(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge every table over the packages; ``feed_info`` is the first package's alone.

    ``service_ext`` keeps its positions, because of several names of a service the last counts.
    """
    merged = {}
    for name, table in tables.items():
        if name == "feed_info":
            first = table.groupBy().agg(F.min("package_order").alias("package_order"))
            table = table.join(first, "package_order", "left_semi")
        merged[name] = merge_package_table(table, BUSINESS_KEYS.get(name),
                                           keep_position=name == "service_ext")
    return merged


def build_dim_line(routes: DataFrame, routes_ext: DataFrame) -> DataFrame:
    kinds = routes_ext.select("route_id", F.col("route_type_1").alias("_kind"))
    return (routes.join(kinds, "route_id", "left")
            .select(F.col("route_id").alias("line_id"),
                    F.col("route_short_name").alias("short_name"),
                    F.col("route_long_name").alias("long_name"),
                    F.coalesce(_mapped(TRANSPORT_MODES, F.col("route_type")),
                               F.lit(OTHER_MODE)).alias("transport_mode"),
                    F.coalesce("_kind", F.lit(DEFAULT_LINE_TYPE)).alias("line_type")))


def build_dim_stop(stops: DataFrame, stops_ext: DataFrame, communities: DataFrame,
                   attributes: DataFrame) -> DataFrame:
    """Stops with commune and stop type; the default type needs an extension record."""
    def first_id(c):
        return F.split(F.coalesce(c, F.lit("")), "_")[0]

    extension = (
        stops_ext
        .select("stop_id", "city", first_id("community_ids").alias("community_id"),
                first_id("stop_attribute_ids").alias("stop_type_id"))
        .join(communities.select("community_id", "community_name"), "community_id", "left")
        .join(attributes.select("stop_type_id", "stop_attr_name"), "stop_type_id", "left")
        .select("stop_id", F.col("community_name").alias("commune"), "city",
                F.coalesce("stop_attr_name", F.lit(DEFAULT_STOP_TYPE)).alias("stop_type")))
    return (stops.select("stop_id", F.col("stop_name").alias("name"),
                         _number(F.col("stop_lat")).alias("lat"),
                         _number(F.col("stop_lon")).alias("lon"))
            .join(extension, "stop_id", "left"))


def build_dim_operator(operators: DataFrame) -> DataFrame:
    return operators.select("operator_id", F.col("operator_name").alias("name"))


def build_dim_date(calendar: DataFrame, services: DataFrame, start: dt.date,
                   end: dt.date) -> DataFrame:
    """One row per day of [start, end] with the day type of its primary active service.

    The calendar's date ranges are cut to the asked period and exploded, so the range join
    becomes an aggregate by day. ``services`` has ``service_id, name`` and optionally
    the position columns: of several names the last one counts.
    """
    spark = calendar.sparkSession
    first, last = F.lit(start), F.lit(end)
    flags = F.array(*[F.col(c) == "1" for c in WEEKDAYS])
    number = F.col("service_id").try_cast("int")
    active = (
        calendar
        .withColumn("_from", F.greatest(F.to_date("start_date", "yyyyMMdd"), first))
        .withColumn("_to", F.least(F.to_date("end_date", "yyyyMMdd"), last))
        .where(F.col("_from") <= F.col("_to"))
        .select("service_id", flags.alias("_flags"),
                F.explode(F.sequence("_from", "_to")).alias("date"))
        .where(F.element_at("_flags", F.weekday("date") + 1)))
    primary = active.groupBy("date").agg(
        F.min_by("service_id", F.struct(number < FIRST_HOLIDAY_SERVICE, number,
                                        F.col("service_id"))).alias("service_id"))

    position = [c for c in POSITION if c in services.columns] or ["name"]
    names = services.groupBy("service_id").agg(
        F.max_by("name", F.struct(*position)).alias("_type"))

    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date"))
    weekday = F.weekday("date")
    return (days.join(primary.join(names, "service_id", "left"), "date", "left")
            .select("date",
                    F.year("date").cast("smallint").alias("year"),
                    F.month("date").cast("smallint").alias("month"),
                    F.weekofyear("date").cast("smallint").alias("iso_week"),
                    (weekday + 1).cast("smallint").alias("weekday"),
                    F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]),
                                 weekday + 1).alias("day_name"),
                    F.coalesce("_type", F.lit(NO_SCHEDULE)).alias("day_type")))


def build_schedule_lookup(stop_times: DataFrame, trips: DataFrame,
                          trips_ext: DataFrame) -> DataFrame:
    """Stop times with line, direction, headsign, operator and day offset of their trip."""
    described = (trips.select("trip_id", "route_id", "direction_id", "trip_headsign")
                 .join(trips_ext.select("trip_id", "operator_id"), "trip_id", "left"))
    hour = _whole(F.split("arrival_time", ":")[0])
    return (stop_times.select("trip_id", "stop_id", "stop_sequence", "arrival_time")
            .join(described, "trip_id")
            .select("trip_id", "stop_id",
                    _whole(F.col("stop_sequence")).alias("stop_sequence"),
                    F.col("arrival_time").alias("arrival"),
                    F.col("route_id").alias("line_id"),
                    F.col("direction_id").alias("direction"),
                    F.col("trip_headsign").alias("headsign"),
                    "operator_id",
                    F.coalesce(F.floor(hour / 24), F.lit(0)).cast("smallint")
                    .alias("day_offset")))


def schedule_fingerprint(lookup: DataFrame) -> DataFrame:
    """One row ``n_rows, digest`` of the lookup's content, without its version."""
    return content_digest(lookup, LOOKUP_CONTENT)


def register_version(versions: DataFrame, fingerprint: DataFrame, package_name: str,
                     valid_from: dt.date, valid_to: dt.date, now: dt.datetime) -> DataFrame:
    """The version register after a load.

    Equal content extends the latest loaded version; other content appends a new one.
    """
    digest = fingerprint.select("digest").scalar()
    by_load = F.struct("loaded_at", "version_id")
    latest = versions.agg(F.max_by("version_id", by_load)).scalar()
    latest_print = versions.agg(F.max_by("fingerprint", by_load)).scalar()
    next_id = versions.agg(F.coalesce(F.max("version_id"), F.lit(0)) + 1).scalar()

    same = (F.col("version_id") == latest) & (F.col("fingerprint") == digest)
    kept = versions.withColumn(
        "valid_to", F.when(same, F.greatest(F.col("valid_to"), F.lit(valid_to)))
        .otherwise(F.col("valid_to")))
    added = (versions.sparkSession.range(1)
             .where(latest_print.isNull() | (latest_print != digest))
             .select(next_id.cast("int").alias("version_id"),
                     F.lit(package_name).alias("package_name"),
                     F.lit(valid_from).alias("valid_from"), F.lit(valid_to).alias("valid_to"),
                     digest.alias("fingerprint"),
                     F.lit(now).cast("timestamp").alias("loaded_at")))
    return kept.unionByName(added.select(*versions.columns))


def upsert(target: DataFrame, source: DataFrame, keys: list[str],
           overrides: dict | None = None) -> DataFrame:
    """Insert new keys and replace the other columns of known ones, nulls included.

    ``overrides`` maps a column to ``f(old, new) -> Column`` for keys present on both sides.
    """
    overrides = overrides or {}
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest, F.lit(1).alias("_")).alias("_old"))
    new = source.select(*keys, F.struct(*rest, F.lit(1).alias("_")).alias("_new"))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def value(c):
        before, after = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        chosen = F.when(F.col("_new").isNotNull(), after).otherwise(before)
        if c in overrides:
            chosen = F.when(both, overrides[c](before, after)).otherwise(chosen)
        return chosen.alias(c)

    joined = old.join(new, keys, "full")
    return joined.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def upsert_dim_date(target: DataFrame, source: DataFrame) -> DataFrame:
    """Upsert by date in which "no schedule" never replaces a stored day type."""
    def keep_known(old, new):
        return F.when(new == NO_SCHEDULE, old).otherwise(new)

    return upsert(target, source, ["date"], {"day_type": keep_known})


def append_lookup(stored: DataFrame, lookup: DataFrame, versions: DataFrame,
                  registered: DataFrame) -> DataFrame:
    """Stored lookup plus ``lookup`` under the version that ``registered`` added, if any."""
    added = (registered.select("version_id")
             .join(versions.select("version_id"), "version_id", "left_anti")
             .agg(F.max("version_id")).scalar())
    new_rows = lookup.drop("version_id").withColumn("version_id", added)
    return stored.unionByName(
        new_rows.where(F.col("version_id").isNotNull()).select(*stored.columns))


def prune_lookup(lookup: DataFrame, active_version: int, fact: DataFrame) -> DataFrame:
    """Rows of the active version and of versions that facts still refer to."""
    used = fact.where(F.col("version_id").isNotNull()).select("version_id").distinct()
    versions = few_values(used)
    if versions is not None:
        return lookup.where(F.col("version_id").isin([active_version, *versions]))
    active = F.col("version_id") == active_version
    return lookup.where(active).unionByName(
        lookup.where(~active).join(used, "version_id", "left_semi"))
