"""Change-driven rollups, the nightly purge and the digest tree."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from checks.fixtures import Views
from lateline.functions.clock import local_date
from lateline.functions.digest import differing, digest_leaves, digest_parents
from lateline.operators import retention, rollups
from lateline.plans.nightly import NightlyPaths, nightly
from lateline.plans.rollup_store import RollupStore
from lateline.schema import DELAY_FACT
from lateline.session import materialize

SF_DIR = "/root/testdata/sf0.001"
UTC = dt.timezone.utc


@pytest.fixture(scope="module")
def fact(spark):
    return materialize(Views(spark, SF_DIR).delay_fact, "facts")


def rows(df):
    return sorted(map(repr, df.collect()))


def expected(fact):
    quarters = rollups.rollup_15min(fact)
    hours = rollups.rollup_1h(quarters)
    return {"15min": quarters, "15min_stop": rollups.rollup_15min_stop(fact), "1h": hours,
            "day": rollups.rollup_day(hours)}


def check(store, fact):
    for kind, want in expected(fact).items():
        assert rows(store.read(kind).select(*want.columns)) == rows(want), kind


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_late_facts_touch_their_partitions_only(spark, fact, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    day = F.lit(dt.date(2024, 1, 5))
    late = (local_date("ts") == day) & (F.col("stop_sequence") == 3)
    early = materialize(fact.where(~late), "early")
    store.rebuild(early)
    check(store, early)
    before = {kind: files(store.path(kind)) for kind in ("15min", "15min_stop", "1h", "day")}
    store.log_touched(fact.where(late))
    touched = fact.where(late).select(F.floor(F.unix_seconds("ts") / 900)).distinct().count()
    assert touched and store.refresh_touched(fact) == touched
    check(store, fact)
    for kind, old in before.items():
        dates = {p.split("dt=")[1][:10] for p in files(store.path(kind)) ^ old}
        assert dates and dates <= {"2024-01-04", "2024-01-05"}, (kind, dates)
    assert store.refresh_touched(fact) == 0        # the log is used up
    assert files(store.path("touched")) == set()


def test_vanished_facts_leave_no_rows(spark, fact, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.rebuild(fact)
    day = local_date("ts") == F.lit(dt.date(2024, 1, 7))
    store.log_touched(fact.where(day))
    left = materialize(fact.where(~day), "left")
    store.refresh_touched(left)
    check(store, left)


def test_purged_quarters_wait_in_the_log(spark, fact, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    store.rebuild(fact)
    border = dt.datetime(2024, 1, 10, tzinfo=UTC)
    touched = fact.where(F.col("ts").between(F.lit(border - dt.timedelta(hours=2)),
                                             F.lit(border + dt.timedelta(hours=2))))
    store.log_touched(touched)
    left = materialize(fact.where(F.col("ts") >= F.lit(border)), "left")
    n = touched.select(F.floor(F.unix_seconds("ts") / 900).alias("q")).distinct()
    late = n.where(F.col("q") * 900 < border.timestamp()).count()
    assert late and store.refresh_touched(left, border) == n.count() - late
    check(store, fact)
    assert spark.read.parquet(store.path("touched")).count() == late


def test_definition_and_expiry(spark, fact, tmp_path):
    store = RollupStore(spark, str(tmp_path))
    assert store.ensure_definition(fact, 1) and not store.ensure_definition(fact.limit(0), 1)
    part = materialize(fact.where("stop_sequence < 4"), "part")
    assert store.ensure_definition(part, 2)
    check(store, part)
    now = dt.datetime(2024, 1, 25, 5, 20, tzinfo=UTC)
    store.expire_stops(now, 14)
    want = rollups.expire_stop_rollup(rollups.rollup_15min_stop(part), now, 14)
    assert rows(store.read("15min_stop").select(*want.columns)) == rows(want)
    store.expire_stops(now, 14)
    assert rows(store.read("15min_stop").select(*want.columns)) == rows(want)
    dates = {p.split("dt=")[1][:10] for p in files(store.path("15min_stop"))}
    assert min(dates) == "2024-01-11"


def test_nightly_refuses_a_range_without_facts(spark, fact, tmp_path):
    paths = NightlyPaths(*(str(tmp_path / n) for n in ("rollups", "export", "verified", "purged")))
    store = RollupStore(spark, paths.rollups)
    store.rebuild(fact)
    day, now = dt.date(2024, 1, 10), dt.datetime(2024, 1, 12, 3, tzinfo=UTC)
    lost = materialize(fact.where(~F.col("ts").between(
        F.lit(dt.datetime(2024, 1, 9, 22, tzinfo=UTC)), F.lit(dt.datetime(2024, 1, 9, 23, tzinfo=UTC)))), "lost")
    runs = spark.createDataFrame([], "started_at timestamp, snapshot_ts timestamp")
    with pytest.raises(RuntimeError, match="may not be refreshed"):
        nightly(spark, lost, runs, {}, paths, day, now)
    check(store, fact)
    with pytest.raises(RuntimeError, match="no facts"):
        nightly(spark, fact.limit(0), runs, {}, paths, day, now)
    check(store, fact)


def test_digest_tree(spark, fact, tmp_path):
    columns = DELAY_FACT.fieldNames()
    key = fact.where("status = 'OBSERVED'").first()
    changed = fact.withColumn("delay_s", F.when(
        (F.col("trip_id") == key.trip_id) & (F.col("ts") == F.lit(key.ts)), F.lit(-1)).otherwise(F.col("delay_s")))
    paths = [str(tmp_path / n) for n in ("a", "b", "c")]
    for table, path in zip((fact, changed, fact.repartition(7)), paths):
        retention.write_digest_tree(table, path, columns)
    assert retention.locate_differences(spark, paths[0], paths[2]).count() == 0
    places = retention.locate_differences(spark, paths[0], paths[1])
    (place,) = places.collect()
    assert place.n_source == place.n_copy > 0
    odd = retention.differing_rows(fact, changed, places, columns).collect()
    assert {r.trip_id for r in odd} == {key.trip_id} and {r.n_source + r.n_copy for r in odd} == {1}
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert f"= {place.day})" in plan and "s0" in plan


def test_digests_add_up(spark, fact):
    columns = DELAY_FACT.fieldNames()
    whole = digest_parents(digest_leaves(fact, columns, [], "trip_id"), [])
    halves = [digest_leaves(fact.where(c), columns, [], "trip_id") for c in ("stop_sequence < 4", "stop_sequence >= 4")]
    both = digest_parents(halves[0].unionByName(halves[1]), [])
    assert whole.first() == both.first() and whole.first().n_rows == fact.count()
    other = digest_parents(digest_leaves(fact.withColumn("trip_id", F.lit("x")), columns, [], "trip_id"), [])
    one = F.lit(1).alias("one")
    assert differing(whole.select("*", one), other.select("*", one), ["one"]).count() == 1
    nothing = digest_parents(digest_leaves(fact.limit(0), columns, [], "trip_id"), []).first()
    assert nothing.n_rows == 0
