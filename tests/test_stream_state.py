"""Versions in force, stored lookups and streams with state."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lateline.functions.ordered import as_of
from lateline.operators import realtime as ops
from lateline.plans.key_store import KeyStore
from lateline.schema import DELAY_FACT, FEED, SCHEDULE_LOOKUP, SCHEDULE_VERSION
from lateline.session import materialize, temporary_tables
from lateline.sources.lookup_store import StoredLookup
from lateline.streaming.realtime import RealtimePaths, start_realtime
from lateline.streaming.state import mark_new, start_fact_stream, watch_runs
from tests.test_realtime import T0, message, stop, update


def at(seconds):
    return dt.datetime.fromtimestamp(T0 + seconds, dt.timezone.utc)


def test_as_of(spark):
    changes = spark.createDataFrame([(3600, 2), (0, 1), (7200 * 9, 4), (7200 * 9, 3)], "s long, v int") \
        .select(F.timestamp_seconds(F.col("s") + T0).alias("since"), "v")
    times = [-50_000, -1, 0, 1, 3599, 3600, 3601, 7200 * 9 - 1, 7200 * 9, 400_000]
    rows = spark.createDataFrame([(at(t), t) for t in times], "at timestamp, k int")
    got = {r["k"]: r["now"] for r in as_of(rows, "at", changes, "since", "v", "now").collect()}
    assert [got[t] for t in times] == [1, 1, 1, 1, 1, 2, 2, 2, 4, 4]
    none = as_of(rows, "at", changes.limit(0), "since", "v", "now")
    assert {r["now"] for r in none.collect()} == {None} and none.count() == len(times)


def test_payload_stays_out_of_the_window(spark):
    polls = spark.createDataFrame([(at(k), f"f{k}", T0 + k, "x" * 50) for k in range(5)],
                                  "arrived_at timestamp, source string, header_ts long, entity string")
    plan = ops.new_snapshots(polls, ["arrived_at", "source"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("entity" in line for line in windows)


LOOKUP = [(1, "t1", "s1", 1, "23:50:00", "L1", "0", "x", "6", 0),
          (1, "t1", "s2", 2, "24:10:00", "L1", "0", "x", "6", 1),
          (1, "t1", "s9", 2, "24:10:00", "L1", "0", "x", "6", 1),
          (1, "t2", "s1", 1, "10:00:00", None, None, "x", None, 0),
          (2, "t1", "s7", 1, "23:50:00", "L1", "0", "x", "6", 0)]


@pytest.fixture
def stored(spark, tmp_path):
    lookup = StoredLookup(spark, f"lookup_{tmp_path.name}".replace("-", "_"), str(tmp_path / "lookup"), 4)
    rows = spark.createDataFrame(LOOKUP, SCHEDULE_LOOKUP)
    for version in (1, 2, 1):           # a version written again replaces itself
        lookup.write(rows.where(F.col("version_id") == version), version)
    yield lookup
    spark.sql(f"DROP TABLE IF EXISTS {lookup.table}")


def test_stored_lookup_equals_the_table(spark, stored):
    rows = spark.createDataFrame(LOOKUP, SCHEDULE_LOOKUP)
    assert sorted(map(repr, stored.open().select(*rows.columns).collect())) == sorted(map(repr, rows.collect()))
    feed = spark.createDataFrame([
        (*message(T0, update("t1", stop(1, 30), stop(2, 10, "SKIPPED"), stop(7, 1)),
                  update("t9", stop(1, 3)), update("t2", relation="CANCELED")).values(), 1),
        (*message(T0 + 20, update("t1", stop(1, 5)), update("t1", relation="CANCELED")).values(), 2)],
        StructType([*FEED.fields, StructField("version_id", IntegerType())]))
    want = sorted(map(repr, ops.process_feed(feed, rows).collect()))
    assert sorted(map(repr, ops.process_feed(feed, stored).collect())) == want and len(want) == 5
    assert ops.process_feed(feed.limit(0), stored).count() == 0


def test_stored_lookup_is_read_where_it_lies(spark, stored):
    keys = spark.createDataFrame([(1, "t1"), (1, "t2")], "version_id int, trip_id string")
    plan = stored.stops_of(keys)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "Scan parquet" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above = [line for k, line in enumerate(lines[:scan]) if depth(line) < depth(lines[scan])]
    join = max(k for k, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    between = [line for line in lines[join + 1:scan] if depth(line) < depth(lines[scan])]
    assert above and not any(word in line for line in between for word in ("Exchange", "Aggregate"))


def test_files_are_found_again_by_another_session(spark, stored):
    spark.sql(f"DROP TABLE {stored.table}")
    again = StoredLookup(spark, stored.table, stored.path, stored.buckets)
    assert again.open().count() == len(LOOKUP)


def run_marks(spark, folder, out, *polls):
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{len(os.listdir(folder))}.json"
    with open(name, "w") as file:
        file.write("\n".join(json.dumps(dict(zip(("source", "arrived_at", "header_ts"), p))) for p in polls))
    stream = spark.readStream.schema("source string, arrived_at timestamp, header_ts long").json(folder)
    (mark_new(stream).writeStream.format("parquet").option("path", f"{out}/rows")
     .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination())


def test_marks_survive_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    time = lambda s: at(s).isoformat()
    run_marks(spark, folder, out, ("b", time(2), 90), ("a", time(1), 100), ("c", time(3), 110),
              ("d", time(3), 110), ("e", time(4), None))
    run_marks(spark, folder, out, ("f", time(5), 105), ("g", time(6), 111), ("h", time(7), 111))
    run_marks(spark, folder, out, ("i", time(8), None))
    run_marks(spark, folder, out, ("j", time(9), 111), ("k", time(10), 112))
    got = {r["source"]: r["fresh"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert {k for k, fresh in got.items() if fresh} == {"a", "c", "g", "k"} and len(got) == 11


def test_fact_stream_forgets_old_keys(spark, tmp_path):
    arriving, target, state = (str(tmp_path / n) for n in ("in", "facts", "state"))

    def run(*rows):
        facts = [(at(s), 1, "t", "s", n, "L1", "6", "0", dt.date(2024, 3, 31), d, "OBSERVED")
                 for s, n, d in rows]
        spark.createDataFrame(facts, DELAY_FACT).coalesce(1).write.mode("append").parquet(arriving)
        stream = start_fact_stream(spark, arriving, target, state, {"availableNow": True})
        stream.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress if p["stateOperators"]]
        return held[-1] if held else None

    hour = 3600
    run((0, 1, 10), (0, 2, 20))
    run((0, 1, 99), (hour, 1, 11), (0, 3, 30))      # the first key came before
    held = run(*[(100 * hour + k, 1, k) for k in range(5)])
    assert held <= 5 + 4
    assert run((100 * hour, 1, 99), (49 * hour, 1, 7), (300 * hour, 1, 1)) <= 6 + 1
    got = sorted((int(r.ts.timestamp()) - T0, r.stop_sequence, r.delay_s)
                 for r in spark.read.parquet(target).collect())
    want = [(0, 1, 10), (0, 2, 20), (0, 3, 30), (hour, 1, 11), *[(100 * hour + k, 1, k) for k in range(5)],
            (300 * hour, 1, 1)]
    assert [g for g in got if g[0] != 49 * hour] == want


def test_backlog_over_a_version_change_with_stored_lookup(spark, stored, tmp_path):
    paths = RealtimePaths(**{n: str(tmp_path / n) for n in (
        "snapshots", "versions", "lookup", "facts", "runs", "checkpoint")}, lookup_table=stored.table)
    os.makedirs(paths.snapshots)
    spark.createDataFrame([(1, "p", None, None, "f", at(0)), (2, "p", None, None, "g", at(100))],
                          SCHEDULE_VERSION).write.parquet(paths.versions)
    for k, seconds in enumerate((10, 99, 100, 200)):
        name = f"{paths.snapshots}/{k}.json"
        with open(name, "w") as file:
            file.write(json.dumps(message(T0 + seconds, update("t1", stop(1, k)))))
        os.utime(name, (T0 + seconds, T0 + seconds))
    start_realtime(spark, paths, {"availableNow": True}).awaitTermination()
    got = sorted((int(r.ts.timestamp()) - T0, r.version_id, r.stop_id, r.delay_s)
                 for r in spark.read.parquet(paths.facts).collect())
    assert got == [(10, 1, "s1", 0), (99, 1, "s1", 1), (100, 2, "s7", 2), (200, 2, "s7", 3)]


def test_silence_is_told_once(spark, tmp_path):
    arriving, found = str(tmp_path / "runs"), str(tmp_path / "found")
    os.makedirs(arriving)

    def run(name, *seconds):
        spark.createDataFrame([(at(s),) for s in seconds], "started_at timestamp").coalesce(1) \
            .write.mode("append").parquet(arriving)

    run("a", 0, 60, 600)
    stream = spark.readStream.schema("started_at timestamp").parquet(arriving)
    running = (watch_runs(stream, minutes=2, silence=0.05).writeStream.format("parquet").option("path", found)
               .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    try:
        deadline = time.monotonic() + 120

        def rows():
            try:
                return sorted((r.kind, int(r.gap_from.timestamp()) - T0, r.gap_to and int(r.gap_to.timestamp()) - T0)
                              for r in spark.read.schema("kind string, gap_from timestamp, gap_to timestamp")
                              .parquet(found).collect())
            except Exception:
                return []

        while len(rows()) < 2 and time.monotonic() < deadline:
            time.sleep(1)
        time.sleep(8)           # more batches without data: no second alarm
        assert rows() == [("gap", 60, 600), ("silence", 600, None)]
        run("b", 630, 590, 900)
        while len(rows()) < 4 and time.monotonic() < deadline:
            time.sleep(1)
        assert rows() == [("gap", 60, 600), ("gap", 630, 900), ("silence", 600, None), ("silence", 900, None)]
    finally:
        running.stop()


def folders(spark):
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return set(os.listdir(path.removeprefix("file://")))


def test_batches_leave_no_folders(spark, tmp_path):
    paths = RealtimePaths(**{n: str(tmp_path / n) for n in (
        "snapshots", "versions", "lookup", "facts", "runs", "checkpoint")})
    os.makedirs(paths.snapshots)
    spark.createDataFrame([(1, "p", None, None, "f", at(0))], SCHEDULE_VERSION).write.parquet(paths.versions)
    spark.createDataFrame(LOOKUP, SCHEDULE_LOOKUP).write.parquet(paths.lookup)
    before = folders(spark)
    for k in range(3):
        with open(f"{paths.snapshots}/{k}.json", "w") as file:
            file.write(json.dumps(message(T0 + k, update("t1", stop(1, k)))))
        start_realtime(spark, paths, {"availableNow": True}).awaitTermination()
    assert spark.read.parquet(paths.facts).count() == 3
    assert folders(spark) == before


def test_failing_work_leaves_no_folders(spark):
    before = folders(spark)
    with pytest.raises(ValueError):
        with temporary_tables(spark):
            materialize(spark.range(3), "outer")
            with temporary_tables(spark):
                assert materialize(spark.range(2), "inner").count() == 2
            assert len(folders(spark) - before) == 1
            raise ValueError
    assert folders(spark) == before


def test_one_new_day_reads_one_day(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path))
    day = lambda d, lines: spark.createDataFrame(
        [(at(86_400 * d + k), 1, "t", f"s{k % 2}", k, line, None, "0", dt.date(2024, 4, d + 1), 0, "OBSERVED")
         for k, line in enumerate(lines)], DELAY_FACT)
    assert tuple(store.used().first()) == (0, 0, 0, 0)
    store.add(day(0, ["a", "b", "a", None]))
    store.add(day(1, ["b", "c"]))
    assert tuple(store.used().first()) == (3, 0, 2, 2)
    store.add(day(1, ["b"]))                   # the day again, with fewer keys
    assert tuple(store.used().first()) == (2, 0, 2, 2)
    assert tuple(store.used(dt.date(2024, 4, 1), dt.date(2024, 4, 1)).first())[0] == 1
    plan = store.used(dt.date(2024, 4, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert "day" in plan and "Aggregate" in plan
