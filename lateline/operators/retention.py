"""Verified export and purge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateline.constants import FACT_RETENTION_HOURS, TIME_ZONE
from lateline.functions.clock import local_date, local_midnight
from lateline.functions.digest import (
    content_digest, differing, digest_leaves, digest_parents, key_range,
)


def daily_digest(table: DataFrame, time: str, columns: list[str],
                 zone: str = TIME_ZONE) -> DataFrame:
    """``day, n_rows, digest`` of the table's content by local day."""
    return content_digest(table.withColumn("day", local_date(time, zone)), columns, ["day"])


def verify_export(source: DataFrame, copy: DataFrame, time: str = "ts",
                  columns: list[str] | None = None, zone: str = TIME_ZONE) -> DataFrame:
    """Per local day, row counts of both sides and whether their content is equal."""
    columns = columns or source.columns
    left = daily_digest(source, time, columns, zone)
    right = daily_digest(copy, time, columns, zone)
    joined = left.select("day", F.col("n_rows").alias("n_source"), F.col("digest").alias("_a")) \
        .join(right.select("day", F.col("n_rows").alias("n_copy"), F.col("digest").alias("_b")),
              "day", "full")
    return joined.select("day", F.coalesce("n_source", F.lit(0)).alias("n_source"),
                         F.coalesce("n_copy", F.lit(0)).alias("n_copy"),
                         F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("verified"))


def purgeable_days(fact: DataFrame, verified: DataFrame, now: dt.datetime,
                   hours: int = FACT_RETENTION_HOURS, zone: str = TIME_ZONE) -> DataFrame:
    """Local days that ended before the retention and whose copy is verified.

    ``verified``: day, n_source, verified. A day whose facts are no longer as many as its
    verification saw (late ones came in) has to be verified again first.
    """
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    days = (fact.where(F.col("ts") < limit)
            .groupBy(local_date("ts", zone).alias("day"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .where(local_midnight(F.date_add("day", 1), zone) <= limit))
    seen = verified.where("verified").select("day", F.col("n_source").alias("n_rows"))
    return days.join(seen, ["day", "n_rows"], "left_semi")


def write_digest_tree(table: DataFrame, path: str, columns: list[str], time: str = "ts",
                      key: str = "trip_id", zone: str = TIME_ZONE) -> None:
    """Store the digests of a table: leaves per (local day, key range), by day, and their days."""
    leaves = digest_leaves(table.withColumn("day", local_date(time, zone)), columns, ["day"], key)
    (leaves.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(f"{path}/leaves"))
    stored = table.sparkSession.read.parquet(f"{path}/leaves")
    digest_parents(stored, ["day"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/days")


def locate_differences(spark: SparkSession, source: str, copy: str) -> DataFrame:
    """``day, range, n_source, n_copy`` of the key ranges whose content differs, from two stored trees.

    Days are compared first; only the leaves of differing days are read, and no row of the tables.
    """
    days = [spark.read.parquet(f"{p}/days") for p in (source, copy)]
    odd = [r.day for r in differing(*days, ["day"]).select("day").collect()]
    leaves = [spark.read.parquet(f"{p}/leaves").where(F.col("day").isin(odd)) for p in (source, copy)]
    found = differing(*leaves, ["day", "range"])
    return found.select("day", "range", F.col("n_left").alias("n_source"), F.col("n_right").alias("n_copy"))


def differing_rows(source: DataFrame, copy: DataFrame, places: DataFrame, columns: list[str],
                   time: str = "ts", key: str = "trip_id", zone: str = TIME_ZONE) -> DataFrame:
    """The rows of the located ranges that one side has more often: columns, n_source, n_copy.

    Only the partitions (``dt``, the local day) of the located days are read, where the tables
    have them.
    """
    days = [r.day for r in places.select("day").distinct().collect()]

    def counted(table: DataFrame, name: str) -> DataFrame:
        if "dt" in table.columns:
            table = table.where(F.col("dt").isin(days))
        placed = table.withColumns({"day": local_date(time, zone), "range": key_range(key)})
        inside = placed.join(places.select("day", "range"), ["day", "range"], "left_semi")
        return inside.groupBy(F.struct(*columns).alias("_row")).agg(F.count(F.lit(1)).alias(name))

    both = counted(source, "n_source").join(counted(copy, "n_copy"), "_row", "full").na.fill(0)
    return both.where("n_source <> n_copy").select("_row.*", "n_source", "n_copy")
