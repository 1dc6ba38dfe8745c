"""Feed snapshots to facts as a stream: skip old snapshots, match, insert, log."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from lateline.constants import RUN_OK
from lateline.functions.clock import local_date
from lateline.operators.realtime import (
    FACT_COLUMNS, insert_new_facts, log_run, new_snapshots, process_feed, version_in_force,
)
from lateline.schema import DELAY_FACT, RUN_LOG, SCHEDULE_LOOKUP, SCHEDULE_VERSION
from lateline.session import materialize, temporary_tables
from lateline.sources.lookup_store import StoredLookup
from lateline.sources.sinks import archive_snapshots
from lateline.sources.tables import read_or_empty, read_snapshots, stream_snapshots
from lateline.streaming.state import mark_new

#: A poll; its arrival first, so that it is a total order too.
POLL_KEY = ["arrived_at", "source", "header_ts"]
STORED_RUN = StructType(RUN_LOG.fields[:]).add("dt", DateType())
STORED_FACT = StructType(DELAY_FACT.fields[:]).add("dt", DateType())


@dataclass(frozen=True)
class RealtimePaths:
    snapshots: str      # arriving feed messages
    versions: str       # version register
    lookup: str         # schedule lookup
    facts: str          # fact table, by local day (dt)
    runs: str           # run log, by local day of the start (dt)
    checkpoint: str     # stream state
    archive: str | None = None
    lookup_table: str | None = None     # name of the lookup as a table of buckets by trip


def process_batch(batch: DataFrame, paths: RealtimePaths) -> None:
    """A batch of snapshots, by itself: the highest header time so far is taken from the run log.

    For replays and for use without a stream. Replaying a batch changes nothing: facts and log rows
    go in by key.
    """
    with temporary_tables(batch.sparkSession):
        polls = materialize(batch.withColumn("header_ts", F.col("header.timestamp")), "polls")
        runs = read_or_empty(batch.sparkSession, paths.runs, STORED_RUN)
        done = runs.where(F.col("status") == RUN_OK).agg(
            F.max(F.unix_seconds("snapshot_ts")).alias("top")).first().top
        keys = polls.select(*POLL_KEY).distinct()
        fresh = new_snapshots(keys, POLL_KEY, done).withColumn("fresh", F.lit(True))
        marks = keys.join(fresh, POLL_KEY, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        _process(polls, materialize(marks, "marks"), paths)


def process_marked(marks: DataFrame, paths: RealtimePaths) -> None:
    """A micro-batch of polls (source, arrived_at, header_ts, fresh) that the stream's state marked.

    Only here are the messages themselves read, from the files the polls name. There are at most as
    many as the stream takes per batch.
    """
    spark = marks.sparkSession
    with temporary_tables(spark):
        marks = materialize(marks, "marks")
        files = [r.source for r in marks.select("source").distinct().collect()]
        if files:
            polls = read_snapshots(spark, files).withColumn("header_ts", F.col("header.timestamp"))
            _process(materialize(polls, "polls"), marks, paths)


def _process(polls: DataFrame, marks: DataFrame, paths: RealtimePaths) -> None:
    """Archive, match, insert and log the polls of a batch.

    Version register and lookup are read every time; each snapshot is matched to the version in
    force when it arrived. A failing batch is logged and raised again, so that its files stay
    uncommitted and a restarted stream takes them once more.

    The log holds one row per (arrival, header time) that was processed, and one per attempt that
    failed, which starts at the time of the attempt.
    """
    spark = polls.sparkSession
    began = dt.datetime.now(dt.timezone.utc)
    try:
        if paths.archive:
            archive_snapshots(polls.select(
                F.lit("tripUpdates").alias("kind"), "header_ts",
                F.to_json(F.struct("header", "entity")).alias("payload")), paths.archive)
        observed, inserted = _insert(spark, polls, marks.where("fresh").drop("fresh"), paths)
    except Exception as error:
        failed = (marks.select("header_ts").distinct()
                  .withColumns({"started_at": F.lit(began), "fresh": F.lit(True),
                                "n_observed": F.lit(0), "n_inserted": F.lit(0)}))
        _append_log(failed, paths, began, str(error))
        raise
    # Files that share arrival and header time are one run.
    known = (marks.groupBy("header_ts", F.col("arrived_at").alias("started_at"))
             .agg(F.max("fresh").alias("fresh")))
    done = (known.join(observed, "header_ts", "left").join(inserted, "header_ts", "left")
            .withColumns({"n_observed": F.coalesce("n_observed", F.lit(0)),
                          "n_inserted": F.coalesce("n_inserted", F.lit(0))}))
    _append_log(done, paths, began)


def _append_log(batches: DataFrame, paths: RealtimePaths, began: dt.datetime,
                error: str | None = None) -> None:
    """Append the log rows whose key the log does not hold yet; it lies by the day of the start."""
    rows = materialize(log_run(batches.withColumns({
        "snapshot_ts": F.timestamp_seconds("header_ts"), "error": F.lit(error).cast("string"),
        "finished_at": F.col("started_at") + F.make_dt_interval(secs=F.lit(
            (dt.datetime.now(dt.timezone.utc) - began).total_seconds()))}))
        .withColumn("dt", local_date("started_at")), "log")
    span = rows.agg(F.min("dt").alias("low"), F.max("dt").alias("high")).first()
    if span.low is None:
        return
    runs = read_or_empty(rows.sparkSession, paths.runs, STORED_RUN).where(
        F.col("dt").between(F.lit(span.low), F.lit(span.high)))
    key = ["started_at", "snapshot_ts"]
    (rows.join(runs.select(*key), key, "left_anti").select(*RUN_LOG.fieldNames(), "dt").coalesce(1)
     .write.mode("append").partitionBy("dt").parquet(paths.runs))


def _insert(spark, polls, marks, paths):
    versions = read_or_empty(spark, paths.versions, SCHEDULE_VERSION)
    if versions.isEmpty():
        raise RuntimeError("no schedule version is registered")
    dated = materialize(version_in_force(marks, versions), "versions")
    fresh = polls.join(dated, POLL_KEY)
    lookup = (StoredLookup(spark, paths.lookup_table, paths.lookup) if paths.lookup_table
              else _versions_of(read_or_empty(spark, paths.lookup, SCHEDULE_LOOKUP), dated))
    rows = materialize(process_feed(fresh, lookup), "rows")

    dated = rows.withColumn("dt", local_date("ts"))
    span = dated.agg(F.min("dt").alias("low"), F.max("dt").alias("high")).first()
    if span.low is not None:
        # Only the partitions the batch can touch are read for the duplicate check.
        stored = read_or_empty(spark, paths.facts, STORED_FACT).where(
            F.col("dt").between(F.lit(span.low), F.lit(span.high)))
        new = materialize(insert_new_facts(stored, rows), "inserted")
        (new.select(*FACT_COLUMNS, local_date("ts").alias("dt"))
         .write.mode("append").option("compression", "zstd").partitionBy("dt")
         .parquet(paths.facts))
    else:
        new = rows.select(*FACT_COLUMNS)

    def per_snapshot(df, name):
        return (df.groupBy(F.unix_seconds("ts").alias("header_ts"))
                .agg(F.count(F.lit(1)).alias(name)))

    return per_snapshot(rows, "n_observed"), per_snapshot(new, "n_inserted")


def _versions_of(lookup: DataFrame, dated: DataFrame) -> DataFrame:
    """The lookup of the versions a batch needs: literals that prune, as they are one or two."""
    needed = [r.version_id for r in dated.select("version_id").distinct().collect()]
    return lookup.where(F.col("version_id").isin(needed))


def start_realtime(spark: SparkSession, paths: RealtimePaths, trigger: dict | None = None):
    """Start the stream; by default a batch every 20 seconds.

    The state of the stream knows the highest header time, so no batch reads the run log for it.
    """
    polls = stream_snapshots(spark, paths.snapshots).withColumn("header_ts", F.col("header.timestamp"))
    return (mark_new(polls.select(*POLL_KEY)).writeStream
            .foreachBatch(lambda marks, _: process_marked(marks, paths))
            .option("checkpointLocation", paths.checkpoint).outputMode("append")
            .trigger(**(trigger or {"processingTime": "20 seconds"})).start())
