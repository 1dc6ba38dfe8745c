"""Schedule packages: which to load, and their CSV tables as all-string DataFrames."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateline.constants import HORIZON_DAYS, PACKAGE_NAME, PACKAGE_TABLES

FOLDER_LAYOUT = "{root}/{package}/{table}.txt"
UNPACKED_LAYOUT = "{root}/package={package}/table={table}"


def select_packages(packages: DataFrame, today: dt.date,
                    horizon: int = HORIZON_DAYS) -> DataFrame:
    """The packages to load for ``today`` and the following days.

    ``packages`` has ``name, start_date, end_date``. A package is kept if it is the newest
    one (by the date and sequence in its name) for at least one day of the horizon;
    ``n_days`` says for how many.
    """
    first, last = F.lit(today), F.lit(today + dt.timedelta(days=horizon - 1))
    rank = [F.regexp_extract("name", PACKAGE_NAME, i).try_cast("int") for i in range(1, 5)]
    days = (packages
            .where(F.col("name").rlike(PACKAGE_NAME))
            .where((F.col("end_date") >= first) & (F.col("start_date") <= last))
            .where(F.col("start_date") <= F.col("end_date"))
            .withColumn("_rank", F.struct(*rank, F.col("name")))
            .withColumn("_day", F.explode(F.sequence(F.greatest("start_date", first),
                                                     F.least("end_date", last)))))
    newest = days.groupBy("_day").agg(
        F.max_by(F.struct("name", "start_date", "end_date"), "_rank").alias("p"))
    return (newest.groupBy("p.name", "p.start_date", "p.end_date")
            .agg(F.count(F.lit(1)).alias("n_days"))
            .orderBy("start_date", "name"))


def unpack_packages(spark: SparkSession, zips: str, root: str) -> None:
    """Unpack zip packages into ``root/package=<name>/table=<name>`` text folders.

    One archive (about 10 MB) is one task's work; the lines of a table stay in order.
    """
    def members(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                package = path.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        table = member.rsplit("/", 1)[-1].removesuffix(".txt")
                        if table not in PACKAGE_TABLES:
                            continue
                        with archive.open(member) as raw:
                            text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="\n")
                            lines = [line.rstrip("\r\n") for line in text]
                        yield pd.DataFrame({"value": lines, "package": package, "table": table})

    (spark.read.format("binaryFile").load(zips).select("path", "content")
     .mapInPandas(members, "value string, package string, table string")
     .write.mode("overwrite").partitionBy("package", "table").text(root))


def read_package_table(spark: SparkSession, root: str, packages: list[str], table: str,
                       layout: str = FOLDER_LAYOUT) -> DataFrame | None:
    """One table of all ``packages``, oldest package first; None if no package has it.

    All columns are strings, header names are trimmed, blanks are null. ``package``,
    ``package_order``, ``block`` and ``line`` give each record's place, which
    ``merge_package_table`` needs to tell the first record of a key. Packages may order their
    columns differently, so each is read under its own header.
    """
    frames = []
    for order, package in enumerate(packages):
        path = layout.format(root=root, package=package, table=table)
        try:
            raw = (spark.read.option("header", True).option("quote", '"')
                   .option("escape", '"').csv(path))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        names = [c.lstrip("﻿").strip().strip('"') for c in raw.columns]
        values = [F.nullif(F.col(f"`{c}`"), F.lit("")).alias(n)
                  for c, n in zip(raw.columns, names)]
        frames.append(raw.select(
            *values, F.lit(package).alias("package"), F.lit(order).alias("package_order"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")))
    if not frames:
        return None
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union


def read_feed_period(feed_info: DataFrame) -> DataFrame:
    """Validity period of every package, from the first record of its ``feed_info``."""
    return (feed_info.groupBy("package")
            .agg(F.min_by(F.struct("feed_start_date", "feed_end_date"),
                          F.struct("block", "line")).alias("r"))
            .select("package",
                    F.to_date("r.feed_start_date", "yyyyMMdd").alias("start_date"),
                    F.to_date("r.feed_end_date", "yyyyMMdd").alias("end_date")))
