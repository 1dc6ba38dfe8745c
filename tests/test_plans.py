"""Shapes of the physical plans that the scale rules rest on."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from checks import storage_queries  # noqa: F401
from checks.fixtures import Views
from checks.registry import QUERIES
from lateline.operators import features, realtime, rollups, schedule
from lateline.operators.audits import since
from lateline.schema import DELAY_FACT, SCHEDULE_LOOKUP
from lateline.session import materialize
from lateline.sources.sinks import between

import datetime as dt


partition_by = DataFrameWriter.partitionBy


@pytest.fixture(scope="module")
def stored(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    return v, materialize(v.delay_fact, "facts"), materialize(v.schedule_lookup, "lookup")


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_reads_needed_columns_and_combines_first(stored):
    _, fact, _ = stored
    plan = planned(rollups.rollup_15min(fact))
    schema = plan[plan.index("ReadSchema"):]
    assert "trip_id" not in schema and "stop_id" not in schema
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_time_filters_reach_the_scan(stored):
    _, fact, _ = stored
    day = dt.date(2024, 1, 10)
    for df in (between(fact, "ts", day, day),
               since(fact, dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc))):
        assert "GreaterThan" in planned(df).split("PushedFilters")[1]


def test_hot_trip_is_split(spark, stored):
    """A third of all updates on one (trip, sequence): the join splits that partition."""
    _, _, lookup = stored
    hot = lookup.select("trip_id", "stop_sequence").first()
    updates = materialize(
        spark.range(60_000).select(
            F.timestamp_seconds(F.col("id") + 1_704_000_000).alias("ts"),
            F.when(F.col("id") % 3 == 0, hot.trip_id)
            .otherwise((F.col("id") % 1500).cast("string")).alias("trip_id"),
            F.when(F.col("id") % 3 == 0, hot.stop_sequence)
            .otherwise((1 + F.col("id") % 7).cast("int")).alias("stop_sequence"),
            F.lit(False).alias("skipped"), F.lit(True).alias("has_arrival"),
            (F.col("id") % 100).cast("int").alias("delay_s"),
            F.sha2(F.col("id").cast("string"), 512).alias("payload")).repartition(16), "updates")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = realtime.match_schedule(updates, lookup, 1)
        plan = executed(df)
        assert "skew=true" in plan
        n = df.where(F.col("trip_id") == hot.trip_id).count()
        assert n == updates.where((F.col("trip_id") == hot.trip_id) & (
            F.col("stop_sequence") == hot.stop_sequence)).count() + updates.where(
                (F.col("trip_id") == hot.trip_id)
                & (F.col("stop_sequence") != hot.stop_sequence)).join(
                    lookup.select("trip_id", "stop_sequence").distinct(),
                    ["trip_id", "stop_sequence"], "left_semi").count()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_exploded_updates_are_not_broadcast(spark, stored):
    v, _, lookup = stored
    feed = materialize(v.snapshots, "snapshots")
    plan = planned(realtime.process_feed(feed, lookup, 1))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_stops_that_may_match_are_shuffled(spark):
    """A lookup of 10,000 trips in five versions, and a feed of 100 trips of two of them."""
    trips = spark.range(50_000).select(
        (1 + F.col("id") % 5).cast("int").alias("version_id"), F.floor(F.col("id") / 5).cast("string").alias("trip_id"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEDULE_LOOKUP
            if f.name not in ("version_id", "trip_id")]
    lookup = materialize(trips.select("*", *rest), "lookup")
    entities = materialize(trips.where("version_id IN (2, 3) AND CAST(trip_id AS INT) % 200 = 0")
                           .unionByName(spark.createDataFrame([(2, "none"), (None, "0")], trips.schema)), "entities")
    stops = realtime.stops_of_trips(lookup, entities)
    assert sorted((r.version_id, int(r.trip_id)) for r in stops.collect()) == [
        (v, t) for v in (2, 3) for t in range(0, 10_000, 200)]
    lines = planned(stops).splitlines()
    scan = next(k for k, line in enumerate(lines) if "/lookup-" in line)
    above = [line for line in lines[:scan] if "Exchange hash" in line or "BroadcastHashJoin" in line]
    assert "LeftSemi" in above[-1]      # below the exchange, so before the rows move
    kept = realtime._may_match(lookup, entities.distinct())
    assert 100 <= kept.count() < 500
    # The type of the version is no part of the hash.
    wide = lookup.withColumn("version_id", F.col("version_id").cast("bigint"))
    assert realtime.stops_of_trips(wide, entities).count() == 100


def test_versions_of_a_lookup_are_written_without_a_sort(spark, monkeypatch):
    """Rows of all versions in one write are sorted by version, which spills."""
    split = []
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *columns: split.append(columns)
                        or partition_by(self, *columns))
    QUERIES["R13_version_change"](spark, "/root/testdata/sf0.001")
    assert split and ("version_id",) not in split


def test_no_cross_joins(stored):
    v, fact, lookup = stored
    facts = features.assign_window(features.assign_client(fact, v.client_map))
    primary = features.primary_quantities(facts)
    for df in (features.time_grid(primary), schedule.build_dim_date(
            v.calendar, v.services, dt.date(2024, 1, 1), dt.date(2024, 1, 9)),
            features.time_split(primary)):
        plan = planned(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_prune_reads_only_kept_versions(spark, tmp_path):
    rows = [(v, "t", "s", 1, "10:00:00", "L", "0", "h", "6", 0) for v in (1, 2, 3)]
    path = str(tmp_path / "lookup")
    spark.createDataFrame(rows, SCHEDULE_LOOKUP).write.partitionBy("version_id").parquet(path)
    lookup = spark.read.schema(SCHEDULE_LOOKUP).parquet(path)
    fact = spark.createDataFrame([(None, 1, *[None] * 9), (None, None, *[None] * 9)], DELAY_FACT)
    kept = schedule.prune_lookup(lookup, 3, fact)
    assert sorted(r.version_id for r in kept.collect()) == [1, 3]
    assert "PartitionFilters: [version_id" in planned(kept)
