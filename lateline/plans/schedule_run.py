"""Schedule run: packages -> dimensions, version register and lookup."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lateline.constants import HORIZON_DAYS, LOOKBACK_DAYS, PACKAGE_TABLES
from lateline.operators import schedule as ops
from lateline.operators.realtime import current_version
from lateline.schema import (
    DIM_DATE, DIM_LINE, DIM_OPERATOR, DIM_STOP, SCHEDULE_LOOKUP, SCHEDULE_VERSION,
)
from lateline.session import materialize
from lateline.sources.packages import FOLDER_LAYOUT, read_package_table
from lateline.sources.sinks import drop_partitions, export_lookup_snapshot
from lateline.sources.tables import read_or_empty

DIMENSIONS = {"dim_line": (DIM_LINE, "line_id"), "dim_stop": (DIM_STOP, "stop_id"),
              "dim_operator": (DIM_OPERATOR, "operator_id"), "dim_date": (DIM_DATE, "date")}


@dataclass(frozen=True)
class WarehousePaths:
    tables: str         # one folder per dimension, version register and lookup
    snapshots: str      # lookup of every version, by date


def load_packages(spark: SparkSession, root: str, packages: list[str],
                  layout: str = FOLDER_LAYOUT) -> dict[str, DataFrame]:
    tables = {t: read_package_table(spark, root, packages, t, layout) for t in PACKAGE_TABLES}
    return ops.merge_packages({t: df for t, df in tables.items() if df is not None})


def build_dimensions(merged: dict[str, DataFrame], today: dt.date,
                     horizon: int = HORIZON_DAYS) -> dict[str, DataFrame]:
    start = today - dt.timedelta(days=LOOKBACK_DAYS)
    end = today + dt.timedelta(days=horizon - 1)
    return {
        "dim_line": ops.build_dim_line(merged["routes"], merged["routes_ext"]),
        "dim_stop": ops.build_dim_stop(merged["stops"], merged["stops_ext"],
                                       merged["communities_ext"], merged["stops_attributes_ext"]),
        "dim_operator": ops.build_dim_operator(merged["operators_ext"]),
        "dim_date": ops.build_dim_date(merged["calendar"], merged["service_ext"], start, end),
    }


def schedule_run(spark: SparkSession, root: str, packages: list[str], paths: WarehousePaths,
                 today: dt.date, now: dt.datetime, fact: DataFrame,
                 horizon: int = HORIZON_DAYS, layout: str = FOLDER_LAYOUT) -> int:
    """Load the packages (oldest first) into the warehouse; returns the active version.

    Dimensions and lookup are written before the version register, which is what readers look
    at first: a run that breaks off leaves the old version active.
    """
    merged = load_packages(spark, root, packages, layout)
    lookup = materialize(ops.build_schedule_lookup(merged["stop_times"], merged["trips"],
                                                   merged["trips_ext"]), "lookup")
    register = f"{paths.tables}/schedule_version"
    versions = materialize(read_or_empty(spark, register, SCHEDULE_VERSION), "versions")
    registered = materialize(ops.register_version(
        versions, ops.schedule_fingerprint(lookup), " | ".join(packages), today,
        today + dt.timedelta(days=horizon - 1), now), "registered")
    added = registered.join(versions, "version_id", "left_anti").select("version_id").first()

    for name, dim in build_dimensions(merged, today, horizon).items():
        schema, key = DIMENSIONS[name]
        path = f"{paths.tables}/{name}"
        stored = read_or_empty(spark, path, schema)
        new = ops.upsert_dim_date(stored, dim) if name == "dim_date" \
            else ops.upsert(stored, dim, [key])
        materialize(new, name).write.mode("overwrite").parquet(path)

    table = f"{paths.tables}/schedule_lookup"
    stored = read_or_empty(spark, table, SCHEDULE_LOOKUP)
    active = added.version_id if added else current_version(versions).first().version_id
    if added:
        empty = spark.createDataFrame([], SCHEDULE_LOOKUP)
        (ops.append_lookup(empty, lookup, versions, registered)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("version_id").parquet(table))  # a repeated run replaces its version
        export_lookup_snapshot(lookup, active, today, paths.snapshots)
    registered.write.mode("overwrite").parquet(register)
    # Last, when no reader is led to the old versions any more; kept partitions stay as they are.
    kept = ops.prune_lookup(stored, active, fact).select("version_id").distinct()
    stale = stored.select("version_id").distinct().join(kept, "version_id", "left_anti")
    drop_partitions(spark, table, "version_id", [r.version_id for r in stale.collect()])
    return active

