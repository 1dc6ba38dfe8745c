"""Feed edges and the stream: old snapshots, replays, late facts."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from lateline.operators import realtime as ops
from lateline.operators.rollups import rollup_15min
from lateline.schema import DELAY_FACT, FEED, SCHEDULE_LOOKUP, SCHEDULE_VERSION
from lateline.streaming.realtime import RealtimePaths, process_batch, start_realtime
from lateline.streaming.rollups import stream_rollup_15min, write_stream
from lateline.sources.tables import read_snapshots

T0 = 1_711_839_600      # 2024-03-31 00:00 in Warsaw, the day the clock goes forward


def message(ts, *entities):
    return {"header": {"timestamp": ts}, "entity": list(entities)}


def update(trip, *stops, relation="SCHEDULED"):
    return {"id": trip, "trip_update": {
        "trip": {"trip_id": trip, "schedule_relationship": relation},
        "stop_time_update": list(stops)}}


def stop(seq, delay=None, relation="SCHEDULED", arrival=True):
    return {"stop_sequence": seq, "schedule_relationship": relation,
            "arrival": {"delay": delay} if arrival else None}


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [(1, "t1", "s1", 1, "23:50:00", "L1", "0", "x", "6", 0),
            (1, "t1", "s2", 2, "24:10:00", "L1", "0", "x", "6", 1),
            (1, "t1", "s9", 2, "24:10:00", "L1", "0", "x", "6", 1),     # same trip and sequence
            (1, "t2", "s1", 1, "10:00:00", None, None, "x", None, 0),
            (2, "t1", "s7", 1, "23:50:00", "L1", "0", "x", "6", 0)]
    return spark.createDataFrame(rows, SCHEDULE_LOOKUP)


def test_process_feed_paths(spark, lookup):
    feed = spark.createDataFrame([message(
        T0, update("t1", stop(1, 30), stop(2, 10, "SKIPPED"), stop(None, 5), stop(8, 5)),
        update("t2", stop(1, 5), relation="CANCELED"), update("", stop(1, 1)),
        {"id": "v", "trip_update": None},
        update("t1", stop(1, arrival=False), stop(1)))], FEED)
    got = sorted((r.trip_id, r.stop_id, r.status, r.delay_s, r.service_date)
                 for r in ops.process_feed(feed, lookup, 1).collect())
    day = dt.date(2024, 3, 31)
    assert got == [("t1", "s1", "OBSERVED", 30, day),
                   ("t1", "s2", "SKIPPED", None, day - dt.timedelta(1)),
                   ("t2", "s1", "CANCELED", None, day)]


def test_canceled_trip_gives_every_stop(spark, lookup):
    feed = spark.createDataFrame([message(T0, update("t1", relation="CANCELED"))], FEED)
    rows = ops.process_feed(feed, lookup, 1).collect()
    assert sorted(r.stop_id for r in rows) == ["s1", "s2", "s9"]


def test_first_of_equal_keys_wins(spark, lookup):
    feed = spark.createDataFrame([message(
        T0, update("t1", stop(1, 99)), update("t1", stop(1, 5)))], FEED)
    rows = ops.process_feed(feed, lookup, 1)
    new = ops.insert_new_facts(rows.limit(0), rows).collect()
    assert [r.delay_s for r in new] == [99]
    assert ops.insert_new_facts(rows, rows).count() == 0


def test_stream_equals_batch_and_replays(spark, lookup, tmp_path):
    paths = RealtimePaths(**{n: str(tmp_path / n) for n in (
        "snapshots", "versions", "lookup", "facts", "runs", "checkpoint", "archive")})
    os.makedirs(paths.snapshots)
    now = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(1, "p", None, None, "f", now)], SCHEDULE_VERSION) \
        .write.parquet(paths.versions)
    lookup.write.parquet(paths.lookup)

    def arrive(name, *messages):
        with open(f"{paths.snapshots}/{name}.json", "w") as out:
            out.write("\n".join(json.dumps(m) for m in messages))
        stamp = arrive.clock = arrive.clock + 60
        os.utime(f"{paths.snapshots}/{name}.json", (stamp, stamp))
        start_realtime(spark, paths, {"availableNow": True}).awaitTermination()

    arrive.clock = T0
    arrive("a", message(T0, update("t1", stop(1, 30), stop(2, 40))),
           message(T0 + 20, update("t1", stop(1, 35))))
    arrive("b", message(T0 + 20, update("t1", stop(1, 999))))       # seen before
    arrive("c", message(T0 + 40, update("t2", relation="CANCELED")))
    arrive("d", message(T0 + 10, update("t1", stop(1, 888))))       # older

    def facts():
        return sorted((r.ts.timestamp(), r.stop_id, r.delay_s, r.status)
                      for r in spark.read.parquet(paths.facts).collect())

    want = [(T0, "s1", 30, "OBSERVED"), (T0, "s2", 40, "OBSERVED"), (T0 + 20, "s1", 35, "OBSERVED"),
            (T0 + 40, "s1", None, "CANCELED")]
    assert facts() == want
    log = {(int(r.started_at.timestamp()), int(r.snapshot_ts.timestamp())):
           (r.status, r.n_observed, r.n_inserted) for r in spark.read.parquet(paths.runs).collect()}
    assert log == {(T0 + 60, T0): ("OK", 2, 2), (T0 + 60, T0 + 20): ("OK", 1, 1),
                   (T0 + 120, T0 + 20): ("SKIPPED", 0, 0), (T0 + 180, T0 + 40): ("OK", 1, 1),
                   (T0 + 240, T0 + 10): ("SKIPPED", 0, 0)}
    assert spark.read.parquet(paths.archive).count() == 4           # one per header time

    process_batch(read_snapshots(spark, paths.snapshots), paths)    # a replay
    assert facts() == want and spark.read.parquet(paths.runs).count() == 5


@pytest.fixture
def paths(tmp_path):
    os.makedirs(tmp_path / "snapshots")
    return RealtimePaths(**{n: str(tmp_path / n) for n in (
        "snapshots", "versions", "lookup", "facts", "runs", "checkpoint", "archive")})


def register(spark, paths, lookup):
    now = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(1, "p", None, None, "f", now)], SCHEDULE_VERSION) \
        .write.parquet(paths.versions)
    lookup.write.parquet(paths.lookup)


def write_message(paths, name, ts, seconds, *entities):
    file = f"{paths.snapshots}/{name}.json"
    with open(file, "w") as out:
        out.write(json.dumps(message(ts, *entities)))
    os.utime(file, (seconds, seconds))


def test_failing_batch_is_logged_and_taken_again(spark, lookup, paths):
    write_message(paths, "a", T0, T0 + 60, update("t1", stop(1, 30)))

    def run():
        start_realtime(spark, paths, {"availableNow": True}).awaitTermination()

    with pytest.raises(Exception, match="no schedule version"):
        run()
    row = spark.read.parquet(paths.runs).first()
    assert row.status == "ERROR" and "no schedule version" in row.error
    register(spark, paths, lookup)
    run()
    assert [r.delay_s for r in spark.read.parquet(paths.facts).collect()] == [30]
    log = {r.status: (r.n_observed, r.n_inserted) for r in spark.read.parquet(paths.runs).collect()}
    assert log == {"ERROR": (0, 0), "OK": (1, 1)}


def test_failing_archive_is_logged(spark, lookup, paths):
    register(spark, paths, lookup)
    write_message(paths, "a", T0, T0 + 60, update("t1", stop(1, 30)))
    with open(paths.archive, "w") as out:
        out.write("in the way")
    with pytest.raises(Exception):
        process_batch(read_snapshots(spark, paths.snapshots), paths)
    assert [r.status for r in spark.read.parquet(paths.runs).collect()] == ["ERROR"]


def test_equal_arrival_and_header_time_is_one_run(spark, lookup, paths):
    register(spark, paths, lookup)
    for name in "ab":
        write_message(paths, name, T0, T0 + 60, update("t1", stop(1, 30)))
    process_batch(read_snapshots(spark, paths.snapshots), paths)
    assert [(r.status, r.n_inserted) for r in spark.read.parquet(paths.runs).collect()] == [("OK", 1)]


def test_long_runs_keep_their_seconds(spark):
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    row = (start, start + dt.timedelta(seconds=5000), start, True, 1, 1, None)
    batches = spark.createDataFrame([row], "started_at timestamp, finished_at timestamp, "
                                    "snapshot_ts timestamp, fresh boolean, n_observed int, "
                                    "n_inserted int, error string")
    assert float(ops.log_run(batches).first().seconds) == 5000


def test_stream_rollup_drops_only_late_facts(spark, tmp_path):
    source = str(tmp_path / "facts")

    def fact(seconds, delay):
        ts = dt.datetime.fromtimestamp(T0 + seconds, dt.timezone.utc)
        return (ts, 1, "t", "s", seconds, "L1", "6", "0", dt.date(2024, 3, 31), delay, "OBSERVED")

    def run(*rows):
        spark.createDataFrame(rows, DELAY_FACT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(DELAY_FACT).parquet(source)
        write_stream(stream_rollup_15min(stream), str(tmp_path / "out"), str(tmp_path / "state"),
                     {"availableNow": True}).awaitTermination()

    hour = 3600
    run(fact(0, 10), fact(60, 9000))
    run(fact(5 * hour, 20))
    run(fact(30, 15))                       # 5 h late: still counted
    run(fact(8 * hour, 30))                 # watermark 2 h: the first bucket closes
    run(fact(45, 50), fact(20 * hour, 1))   # 20 h late: dropped
    got = {(r.bucket.timestamp() - T0): (r.delay_sum, r.n_obs, r.n_rejected)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (25, 2, 1), 5 * hour: (20, 1, 0), 8 * hour: (30, 1, 0)}


def test_null_delay_is_not_rejected_in_rollup(spark):
    ts = dt.datetime.fromtimestamp(T0, dt.timezone.utc)
    rows = [(ts, 1, "t", "s", i, None, None, None, None, d, "OBSERVED")
            for i, d in enumerate([None, 7201, -3601, 7200, -3600, -30, 60, 61])]
    r = rollup_15min(spark.createDataFrame(rows, DELAY_FACT)).first()
    assert (r.n_obs, r.n_on_time, r.n_rejected, r.min_delay, r.max_delay) == (5, 2, 2, -3600, 7200)
    only = rollup_15min(spark.createDataFrame(rows[:1], DELAY_FACT)).first()
    assert only.delay_sum is None and only.n_obs == 0
