"""Exports: day partitions, dimensions, archives, features and run reports."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lateline.constants import TIME_ZONE
from lateline.functions.clock import local_date, local_time
from lateline.schema import DELAY_FACT, RUN_LOG
from lateline.session import delete_folder
from lateline.sources.tables import read_or_empty


def day_bounds(day: dt.date, zone: str = TIME_ZONE) -> tuple[dt.datetime, dt.datetime]:
    """Instants at which the local ``day`` begins and ends."""
    start = dt.datetime.combine(day, dt.time.min, tzinfo=ZoneInfo(zone))
    end = dt.datetime.combine(day + dt.timedelta(days=1), dt.time.min, tzinfo=ZoneInfo(zone))
    return start, end


def between(table: DataFrame, time: str, first: dt.date, last: dt.date,
            zone: str = TIME_ZONE) -> DataFrame:
    """Rows of the local days first..last.

    The bounds are literals the scan can push down; a ``dt`` column, the local day that stored
    tables are partitioned by, prunes partitions too.
    """
    start, _ = day_bounds(first, zone)
    _, end = day_bounds(last, zone)
    if "dt" in table.columns:
        table = table.where(F.col("dt").between(F.lit(first), F.lit(last)))
    return table.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def _write_days(rows: DataFrame, time: str, order: list[str], path: str,
                zone: str = TIME_ZONE) -> int:
    """Write ``dt=`` partitions, replacing only those that get rows; returns the row count."""
    written = Observation()
    ordered = (rows.withColumn("dt", local_date(time, zone)).orderBy("dt", time, *order)
               .observe(written, F.count(F.lit(1)).alias("n")))
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("dt").parquet(path))
    return written.get["n"]


def export_facts_day(fact: DataFrame, day: dt.date, path: str) -> int:
    """One local day of facts by time, in the fixed schema. Without facts nothing is written."""
    rows = between(fact, "ts", day, day).select(
        *[F.col(f.name).cast(f.dataType) for f in DELAY_FACT])
    return _write_days(rows, "ts", ["trip_id", "stop_sequence"], path)


def export_rollup_day(rollup: DataFrame, day: dt.date, path: str) -> int:
    return _write_days(between(rollup, "bucket", day, day), "bucket", [], path)


def export_runs_day(runs: DataFrame, day: dt.date, path: str) -> int:
    rows = between(runs, "started_at", day, day).select(
        *[F.col(f.name).cast(f.dataType) for f in RUN_LOG])
    return _write_days(rows, "started_at", [], path)


def export_dimensions(dims: dict[str, DataFrame], path: str) -> None:
    for name, dim in dims.items():
        dim.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def days_without_facts(fact: DataFrame, first: dt.date, last: dt.date,
                       zone: str = TIME_ZONE) -> DataFrame:
    days = fact.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    found = between(fact, "ts", first, last, zone).select(
        local_date("ts", zone).alias("day")).distinct()
    return days.join(found, "day", "left_anti")


def backfill_export(fact: DataFrame, rollup: DataFrame, runs: DataFrame, first: dt.date,
                    last: dt.date, path: str) -> DataFrame:
    """Export a range of local days in one write per table; returns the days without facts."""
    facts = between(fact, "ts", first, last).select(
        *[F.col(f.name).cast(f.dataType) for f in DELAY_FACT])
    _write_days(facts, "ts", ["trip_id", "stop_sequence"], f"{path}/facts")
    _write_days(between(rollup, "bucket", first, last), "bucket", [], f"{path}/rollup_15min")
    _write_days(between(runs, "started_at", first, last), "started_at", [], f"{path}/runs")
    return days_without_facts(fact, first, last)


def export_lookup_snapshot(lookup: DataFrame, version_id: int, day: dt.date, path: str) -> None:
    """The lookup of a new version, kept by date and version."""
    (lookup.drop("version_id")
     .withColumn("dt", F.lit(day)).withColumn("version_id", F.lit(version_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("dt", "version_id").parquet(path))


def drop_partitions(spark: SparkSession, path: str, column: str, values: list) -> None:
    """Delete the stored table's partitions of these values; the others are not touched."""
    for value in values:
        delete_folder(spark, f"{path}/{column}={value}")


def archive_snapshots(raw: DataFrame, path: str, zone: str = TIME_ZONE) -> None:
    """Append raw messages (kind, header_ts, payload) that the archive does not hold yet.

    One message per (kind, header_ts); only the archive's partitions of the batch's days are read.
    """
    wall = local_time(F.timestamp_seconds("header_ts"), zone)
    dated = (raw.dropDuplicates(["kind", "header_ts"])
             .withColumn("dt", wall.cast("date")).withColumn("hh", F.hour(wall)))
    span = dated.agg(F.min("dt").alias("low"), F.max("dt").alias("high")).first()
    if span.low is None:
        return
    stored = read_or_empty(raw.sparkSession, path, dated.schema).where(
        F.col("dt").between(F.lit(span.low), F.lit(span.high)))
    (dated.join(stored.select("kind", "header_ts"), ["kind", "header_ts"], "left_anti")
     .write.mode("append").option("compression", "zstd")
     .partitionBy("kind", "dt", "hh").parquet(path))


def write_features(tables, path: str) -> None:
    """Feature matrix, scaling statistics and sequences by client and split.

    The sequences carry their window, which labels them.
    """
    def write(df, name, *parts):
        (df.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts)
         .parquet(f"{path}/{name}"))

    write(tables.features, "features", "client", "split")
    write(tables.stats, "scaling_stats")
    write(tables.sequences, "sequences", "client", "split")


def run_report(strategy: str, rounds: int, mu: float, seed: int, history: DataFrame,
               comparison: DataFrame, thresholds: DataFrame, size: DataFrame) -> DataFrame:
    """One nested row: settings, model size, validation by round, comparison by client.

    Rounds times clients and clients are small by definition, so they fit one row.
    """
    by_round = (history.groupBy("round")
                .agg(F.map_from_entries(F.sort_array(F.collect_list(
                    F.struct("client", "validation")))).alias("validation")))
    rounds_list = by_round.agg(F.array_sort(
        F.collect_list(F.struct("round", "validation")),
        lambda a, b: a["round"] - b["round"])).scalar()
    clients = (comparison.join(thresholds, "client", "left")
               .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
                   "client", F.struct("federated", "local", "gain_pct", "threshold")))))).scalar())
    return size.select(
        F.lit(strategy).alias("strategy"), F.lit(rounds).alias("rounds"), F.lit(mu).alias("mu"),
        F.lit(seed).alias("seed"), F.col("n_parameters").alias("parameters"),
        F.col("mb").alias("mb_per_client_per_round"),
        rounds_list.alias("history"), clients.alias("comparison"))


def write_run_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def export_gaps(gaps: DataFrame, path: str) -> None:
    gaps.orderBy("gap_from").write.mode("overwrite").option("compression", "zstd").parquet(path)
