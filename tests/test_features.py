"""Feature edges: clock changes, null keys, empty windows, contiguity, leaks, federation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateline.constants import CLIENTS, FEATURES
from lateline.functions.clock import hms_to_seconds, local_date, local_midnight
from lateline.operators import audits, federated as fed, features as ops
from lateline.plans.federation_run import federated_rounds
from lateline.schema import DELAY_FACT, SCHEDULE_LOOKUP

UTC = dt.timezone.utc


def fact(ts, trip="t1", delay=0, status="OBSERVED", operator="6", line="L", direction="0",
         day=dt.date(2024, 1, 5), seq=1):
    return (ts, 1, trip, "s", seq, line, operator, direction, day, delay, status)


def frame(spark, *rows):
    return spark.createDataFrame(rows, DELAY_FACT)


def at(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


def test_clock_changes(spark):
    df = spark.createDataFrame(
        [("2024-03-31",), ("2024-04-01",), ("2024-10-27",), ("2024-10-28",)], "d string")
    got = [r[0] for r in df.select(F.unix_seconds(local_midnight(F.col("d").cast("date")))).collect()]
    assert got[1] - got[0] == 23 * 3600 and got[3] - got[2] == 25 * 3600
    late = spark.createDataFrame([(at("2024-07-01T22:30:00"),)], "ts timestamp")
    assert late.select(local_date("ts")).first()[0] == dt.date(2024, 7, 2)


def test_hms(spark):
    df = spark.createDataFrame([("25:30:00",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(hms_to_seconds("t")).collect()] == [91800.0, None, None]


def test_unmapped_operator_fails(spark):
    facts = frame(spark, fact(at("2024-01-05T10:00:00"), operator="99"))
    with pytest.raises(Exception, match="operator without a client"):
        ops.assign_client(facts, ops.client_mapping(spark)).collect()


def test_mapping_holds_21_operators(spark):
    mapping = ops.client_mapping(spark)
    assert mapping.count() == 21 and len(CLIENTS) == 9
    facts = frame(spark, fact(at("2024-01-05T10:00:00")))
    assert audits.check_client_mapping(mapping, facts).count() == 0


def test_headways_cross_days_and_skip_null_directions(spark):
    lookup = spark.createDataFrame(
        [(1, f"t{i}", "s", 5, "00:00:00", "L", "0", "x", "6", 0) for i in range(4)]
        + [(1, f"t{i}", "s", 1, f"{10 + i}:00:00", "L", "0", "x", "6", 0) for i in range(4)],
        SCHEDULE_LOOKUP)
    ts = at("2024-01-05T10:00:00")
    facts = frame(
        spark, fact(ts, "t0", 0), fact(ts, "t1", 60), fact(ts, "t1", 120, seq=2),
        fact(ts, "t0", 30, day=dt.date(2024, 1, 6)), fact(ts, "t2", 0, direction=None),
        fact(ts, "t3", None, "SKIPPED")).withColumn("client", F.lit("c"))
    gaps = ops.headways(ops.departures(ops.trip_median(facts), ops.first_stop(lookup)))
    got = [r.headway_s for r in gaps.orderBy("departure").collect()]
    assert got == [3600 + 90.0, 86400 - 3600 - 60.0]


def test_empty_windows_and_rejected_nulls(spark):
    facts = frame(spark, fact(at("2024-01-05T10:00:00"), delay=10),
                  fact(at("2024-01-05T10:01:00"), delay=None),
                  fact(at("2024-01-05T10:02:00"), delay=9000),
                  fact(at("2024-01-05T10:40:00"), delay=None, status="SKIPPED"))
    facts = ops.assign_window(facts.withColumn("client", F.lit("c")))
    primary = ops.primary_quantities(facts)
    empty = spark.createDataFrame([], "client string, window timestamp, h double")
    base = ops.delay_change(ops.base_features(ops.time_grid(primary), primary, empty))
    rows = base.orderBy("window").collect()
    assert [(r.n, r.u, r.rejected, r.complete, r.d, r.dmax) for r in rows] == [
        (1, 0, 2, True, 10.0, 10), (0, 0, 0, False, None, None), (0, 1, 0, False, None, None)]


@pytest.fixture(scope="module")
def grid(spark):
    n = 60
    rows = []
    for i in range(n):
        when = at("2024-01-05T00:00:00") + dt.timedelta(minutes=15 * i)
        rows.append(("a", when, i != 20, "train" if i < 40 else "test",
                     *[float(i * (k + 1) % 7) for k in range(11)]))
    schema = "client string, window timestamp, complete boolean, split string, " + ", ".join(
        f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, schema)


def test_sequences_keep_to_complete_runs_and_split(grid):
    got = ops.sequences(grid)
    ends = sorted((r.split, int(r.window.timestamp())) for r in got.select("split", "window").collect())
    start = int(at("2024-01-05T00:00:00").timestamp())
    want = sorted([("train", start + 900 * i) for i in [*range(7, 20), *range(28, 40)]]
                  + [("test", start + 900 * i) for i in range(47, 60)])
    assert ends == want
    row = got.where("split = 'train'").orderBy("window").first()
    assert np.array(row.x).shape == (8, 11)
    assert np.allclose(np.array(row.x)[:, 0], [i % 7 for i in range(8)])
    possible = audits.complete_runs(grid).first().n_possible
    assert possible == len([*range(7, 20), *range(28, 60)])


def test_sequences_over_a_hole_are_rejected(grid):
    holed = grid.where("window <> timestamp'2024-01-05 08:00:00'")
    assert ops.sequences(holed).count() == ops.sequences(grid).count() - 8


def test_zero_deviation_scales_to_zero(spark, grid):
    flat = grid.withColumn("d", F.lit(3.0)).withColumn("h", F.lit(None).cast("double"))
    scaled = ops.standardize(flat, ops.scaling_stats(flat))
    assert scaled.select("d", "h").distinct().collect() == [(0.0, 0.0)]


@pytest.fixture(scope="module")
def moments(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c, mix in (("a", rng.normal(size=(3, 88))), ("b", rng.normal(size=(3, 88)))):
        for i, x in enumerate(rng.normal(size=(60, 3)) @ mix):
            rows.append((c, at("2024-01-01T00:00:00") + dt.timedelta(hours=i),
                         x.reshape(8, 11).tolist()))
    seqs = spark.createDataFrame(rows, "client string, window timestamp, x array<array<float>>")
    split = fed.client_split(seqs)
    assert {(r.client, r.part): r.n for r in split.groupBy("client", "part").agg(
        F.count(F.lit(1)).alias("n")).collect()} == {
            ("a", "train"): 48, ("a", "val"): 12, ("b", "train"): 48, ("b", "val"): 12}
    return seqs, split, fed.client_moments(split).cache()


def test_moments_equal_numpy(moments):
    _, split, table = moments
    x = np.array([np.ravel(r.x) for r in split.where("client = 'a' AND part = 'train'").collect()])
    got = table.where("client = 'a' AND part = 'train'").toPandas()
    cross = np.zeros((88, 88))
    cross[got.i, got.j] = got.cross
    assert np.allclose(cross, x.T @ x)
    assert set(got.n) == {48}


def test_moment_loss_equals_scores(moments):
    _, split, table = moments
    train = table.where("part = 'train'")
    start = fed.initial_weights(train)
    weights = start.where("client = 'a'").select("layer", "idx", "value")
    by_moments = {r.client: r.error for r in fed.moment_loss(train, start).collect()}
    scored = fed.reconstruction_error(split.where("part = 'train'"), weights)
    by_rows = {r.client: r.e for r in scored.groupBy("client").agg(F.avg("error").alias("e")).collect()}
    assert by_moments == pytest.approx(by_rows)


def test_training_lowers_loss_and_mu_holds_back(moments):
    _, _, table = moments
    train = table.where("part = 'train'")
    start = fed.initial_weights(train)
    before = {r.client: r.error for r in fed.moment_loss(train, start).collect()}

    def update(mu):
        return fed.local_update(train, start, 20, mu).cache()

    plain, none, held = update(0.0), update(0.0), update(5.0)
    after = {r.client: r.loss for r in plain.select("client", "loss").distinct().collect()}
    assert all(after[c] < 0.9 * before[c] for c in before)

    def moved(u):
        far = u.withColumnRenamed("value", "new").join(start, ["client", "layer", "idx"])
        return far.agg(F.sum((F.col("new") - F.col("value")) ** 2)).first()[0]

    assert moved(plain) == moved(none) and moved(held) < moved(plain)


@pytest.mark.parametrize("strategy", list(fed.STRATEGIES))
def test_rounds_lower_validation(moments, strategy):
    run = federated_rounds(moments[2], strategy, rounds=3, epochs=10)
    error = {r["round"]: r.v for r in run.history.groupBy("round").agg(
        F.avg("validation").alias("v")).collect()}
    assert error[3] < error[1] and len(run.seconds) == 3
    assert fed.model_size(run.weights).first().n_parameters == 2 * 8 * 88


def test_aggregation_ignores_order_and_outliers(spark):
    rows = [(f"c{i}", 0, 0, v, 10 * (i + 1)) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 1e6])]
    updates = spark.createDataFrame(rows, "client string, layer int, idx int, value double, n_examples long")
    back = updates.orderBy(F.desc("client"))
    for aggregate in (fed.fedavg, fed.fedmedian, fed.fedtrimmed):
        assert aggregate(updates).first().value == pytest.approx(aggregate(back).first().value)
    assert fed.fedmedian(updates).first().value == 3.0
    assert fed.fedtrimmed(updates).first().value == 3.0
    assert fed.fedavg(updates).first().value == pytest.approx(
        np.average([r[3] for r in rows], weights=[r[4] for r in rows]))
    check = audits.check_fedavg(updates, fed.fedavg(updates)).first()
    assert (check.n_off, check.n_clients_equal) == (0, 0)


def test_threshold_without_errors_is_infinite(spark):
    errors = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "client string, error double")
    clients = spark.createDataFrame([("a",), ("b",)], "client string")
    got = {r.client: r.threshold for r in fed.alarm_threshold(errors, clients).collect()}
    assert got == {"a": pytest.approx(np.percentile([1.0, 2.0], 99.5)), "b": float("inf")}


def test_empty_run_log_is_a_problem(spark):
    runs = spark.createDataFrame([], "started_at timestamp")
    assert audits.collector_silence(runs, at("2024-01-01T00:00:00")).first().problem == "empty log"
