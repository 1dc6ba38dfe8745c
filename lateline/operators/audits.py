"""Coverage, quality, gap and invariant reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateline.constants import (
    FEATURES, GAP_MINUTES, LARGEST_GAPS, MAX_CLIENTS, MIN_CLIENTS, NO_SCHEDULE, OBSERVED,
    SANE_MAX, SANE_MIN, SEQUENCE_LENGTH, SILENCE_MINUTES, STOP_SKIPPED, TIME_ZONE,
    TRIP_CANCELED, WINDOW_MINUTES,
)
from lateline.functions.clock import local_date
from lateline.functions.ordered import overlapping_slices, preceding
from lateline.functions.selection import quantiles
from lateline.operators.features import daily_profile


def since(fact: DataFrame, start: dt.datetime) -> DataFrame:
    """Facts after ``start``; the filter reaches the scan, and partitions of ``dt`` if stored so."""
    if "dt" in fact.columns:
        fact = fact.where(F.col("dt") >= local_date(F.lit(start).cast("timestamp")))
    return fact.where(F.col("ts") > F.lit(start).cast("timestamp"))


def feed_coverage(snapshots: DataFrame, lookup: DataFrame, version: int) -> DataFrame:
    """What the feed holds and how much of it the schedule knows, as one row.

    Stop updates are counted by (trip, sequence) before they meet the lookup, which keeps its
    duplicates: a pair that the schedule lists twice counts twice.
    """
    entities = snapshots.select(F.explode("entity").alias("e"))
    trip = F.col("e.trip_update.trip.trip_id")
    has_update = F.col("e.trip_update").isNotNull()
    named = has_update & (F.coalesce(trip, F.lit("")) != "")
    canceled = named & F.coalesce(
        F.col("e.trip_update.trip.schedule_relationship") == TRIP_CANCELED, F.lit(False))
    stop_list = F.when(named & ~canceled, F.col("e.trip_update.stop_time_update"))

    def stops_with(condition):
        return F.coalesce(F.sum(F.size(F.filter("stops", condition))), F.lit(0))

    def skipped(s):
        return s["stop_sequence"].isNotNull() & F.coalesce(
            s["schedule_relationship"] == STOP_SKIPPED, F.lit(False))

    def running(s):
        return s["stop_sequence"].isNotNull() & ~skipped(s)

    # One pass for all counts; no row is made per stop.
    counts = entities.select("e", stop_list.alias("stops")).agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(has_update).alias("n_trip_updates"),
        F.count_if(canceled).alias("n_canceled"),
        stops_with(lambda s: F.lit(True)).alias("n_stop_updates"),
        stops_with(lambda s: s["stop_sequence"].isNull()).alias("n_no_sequence"),
        stops_with(skipped).alias("n_skipped"),
        stops_with(lambda s: running(s) & s["arrival"].isNull()).alias("n_no_arrival"),
        stops_with(lambda s: running(s) & s["arrival"].isNotNull()
                   & s["arrival"]["delay"].isNull()).alias("n_no_delay"),
        stops_with(lambda s: running(s) & s["arrival"]["delay"].isNotNull())
        .alias("n_candidates"))

    stops = (entities.where(named & ~canceled)
             .select(trip.alias("trip_id"), F.explode("e.trip_update.stop_time_update").alias("s")))
    with_seq = F.col("s.stop_sequence").isNotNull()

    current = lookup.where(F.col("version_id") == version)
    trips = entities.where(named).select(trip.alias("trip_id")).distinct()
    known = current.select("trip_id").distinct().withColumn("_known", F.lit(1))
    trip_counts = trips.join(known, "trip_id", "left").agg(
        F.count(F.lit(1)).alias("n_trips"), F.count("_known").alias("n_known_trips"))

    pairs = (stops.where(with_seq).groupBy("trip_id", F.col("s.stop_sequence").alias("stop_sequence"))
             .agg(F.count(F.lit(1)).alias("_n")))
    listed = (current.groupBy("trip_id", "stop_sequence").agg(F.count(F.lit(1)).alias("_times")))
    pair_counts = pairs.join(listed, ["trip_id", "stop_sequence"], "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_pairs"),
        F.coalesce(F.sum(F.col("_n") * F.col("_times")), F.lit(0)).alias("n_matched"))

    row = counts
    for part in (trip_counts, pair_counts):
        packed = part.select(F.struct("*").alias("_p"))
        row = row.select("*", packed.scalar().alias("_p")).select("*", "_p.*").drop("_p")
    lost = F.col("_pairs") - F.col("n_matched")
    return row.select(
        "n_entities", "n_trip_updates", "n_trips", "n_known_trips", "n_canceled",
        "n_stop_updates", "n_no_sequence", "n_matched", "n_skipped", "n_no_arrival",
        "n_no_delay", "n_candidates", lost.alias("n_lost"),
        (F.lit(100) * lost / F.greatest("n_stop_updates", F.lit(1))).alias("loss_pct"))


def status_distribution(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("status")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("delay_s").isNull()).alias("n_no_delay"))
            .orderBy(F.desc("n"), "status"))


def null_keys(fact: DataFrame) -> DataFrame:
    names = {"line_id": "no_line", "operator_id": "no_operator", "direction": "no_direction",
             "service_date": "no_service_date", "version_id": "no_version"}
    return fact.agg(*[F.count_if(F.col(c).isNull()).alias(n) for c, n in names.items()])


def direction_values(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "direction"))


def delay_percentiles(fact: DataFrame) -> DataFrame:
    """Discrete percentiles; equal delays are counted first, map-side combined."""
    ranks = {"min": 0.0, "p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99, "max": 1.0}
    counted = (fact.where(F.col("status") == OBSERVED)
               .groupBy("delay_s").agg(F.count(F.lit(1)).alias("n")))
    found = quantiles(counted, [], "delay_s", ranks, weight="n", how="disc")
    return found.select(*[F.col(n).cast("int").alias(n) for n in ranks])


def absurd_values(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count_if(F.col("delay_s") < SANE_MIN).alias("n_too_early"),
                    F.count_if(F.col("delay_s") > SANE_MAX).alias("n_too_late"),
                    F.count_if(F.col("stop_sequence") < 0).alias("n_negative_sequence"))


def operating_day_shift(fact: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    shift = F.datediff(local_date("ts", zone), F.col("service_date"))
    return (fact.groupBy(shift.alias("shift_days")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy("shift_days"))


def dimension_coverage(fact: DataFrame, dim_line: DataFrame, dim_operator: DataFrame,
                       dim_stop: DataFrame) -> DataFrame:
    """Size of each dimension beside the distinct keys that facts use."""
    parts = [("line", dim_line, "line_id"), ("operator", dim_operator, "operator_id"),
             ("stop", dim_stop, "stop_id")]
    used = fact.agg(*[F.count_distinct(key).alias(f"{name}_used") for name, _, key in parts])
    return used.select(*[column for name, dim, _ in parts for column in (
        dim.agg(F.count(F.lit(1))).scalar().alias(f"{name}_size"), F.col(f"{name}_used"))])


def key_dictionary(known: DataFrame, fact: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, key, number) for the keys of ``fact`` that the dictionary ``known`` lacks.

    Numbers are unique per dictionary and never change; they have gaps, as every task counts alone.
    """
    keys = fact.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns])).alias("k"))
    new = keys.select("k.*").where("key IS NOT NULL").distinct().join(known, ["column", "key"], "left_anti")
    base = known.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
    return new.withColumn("number", F.monotonically_increasing_id() + F.lit(base).cast("bigint"))


def key_bitmaps(fact: DataFrame, dictionary: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``by``, column, bucket and a bitmap of the numbers of the keys used, to be stored per day.

    Facts shrink to distinct keys map-side; bitmaps of any parts join by ``bitmap_or_agg``.
    """
    keys = fact.select(*by, F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("key")) for c in columns])).alias("k"))
    used = keys.select(*by, "k.*").where("key IS NOT NULL").distinct().join(dictionary, ["column", "key"])
    return used.groupBy(*by, "column", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("keys"))


def keys_used(bitmaps: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact number of distinct keys per column, from stored bitmaps."""
    joined = bitmaps.groupBy("column", "bucket").agg(F.bitmap_or_agg("keys").alias("keys"))
    counted = joined.agg(*[F.coalesce(F.sum(F.when(F.col("column") == c, F.bitmap_count("keys"))), F.lit(0))
                           .cast("bigint").alias(c) for c in columns])
    return counted


def day_type_coverage(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Distinct service dates by day type; dates are reduced before the join."""
    dates = fact.select(F.col("service_date").alias("date")).distinct()
    return (dates.join(dim_date.select("date", "day_type"), "date")
            .groupBy("day_type").agg(F.count(F.lit(1)).alias("n_days"))
            .orderBy(F.desc("n_days"), "day_type"))


def day_type_distribution(dim_date: DataFrame) -> DataFrame:
    return (dim_date.groupBy("day_type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"),
                 F.max("date").alias("last_date"))
            .orderBy(F.desc("n"), "day_type"))


def day_type_damage(dim_date: DataFrame, fact: DataFrame, today: dt.date) -> DataFrame:
    """Past dates, those without a day type, and of all such dates the ones with facts."""
    bare = F.col("day_type") == NO_SCHEDULE
    past = F.col("date") < F.lit(today)
    dates = fact.select(F.col("service_date").alias("date")).distinct()
    touched = (dim_date.where(bare).join(dates, "date", "left_semi")
               .agg(F.count(F.lit(1))).scalar())
    return (dim_date.agg(F.count_if(past & bare).alias("n_no_schedule"),
                         F.count_if(past).alias("n_past"))
            .select("n_no_schedule", "n_past", touched.alias("n_with_facts")))


def gaps(runs: DataFrame, minutes: float = GAP_MINUTES) -> DataFrame:
    """Breaks between consecutive runs longer than ``minutes``."""
    before = preceding(runs.select("started_at"), [], ["started_at"], "started_at", "last",
                       "gap_from")
    length = F.unix_micros("started_at") - F.unix_micros("gap_from")
    return (before.where(length > F.lit(int(minutes * 60_000_000)))
            .select("gap_from", F.col("started_at").alias("gap_to"),
                    (length / 60_000_000).alias("gap_minutes")))


def gap_summary(runs: DataFrame, minutes: float = GAP_MINUTES) -> DataFrame:
    """Window, runs, gaps, minutes lost and coverage in percent, as one row."""
    found = gaps(runs, minutes)
    n_gaps = found.agg(F.count(F.lit(1))).scalar()
    lost = found.agg(F.coalesce(F.sum("gap_minutes"), F.lit(0.0))).scalar()
    span = (F.unix_micros("last_run") - F.unix_micros("first_run")) / 60_000_000
    return (runs.agg(F.min("started_at").alias("first_run"), F.max("started_at").alias("last_run"),
                     F.count(F.lit(1)).alias("n_runs"))
            .select("first_run", "last_run", "n_runs", n_gaps.alias("n_gaps"),
                    lost.alias("lost_minutes"), span.alias("_span"))
            .withColumn("coverage_pct",
                        F.when(F.col("_span") > 0,
                               100 * (1 - F.col("lost_minutes") / F.col("_span"))).otherwise(0.0))
            .drop("_span"))


def largest_gaps(found: DataFrame, k: int = LARGEST_GAPS) -> DataFrame:
    return found.orderBy(F.desc("gap_minutes"), "gap_from").limit(k)


def collector_silence(runs: DataFrame, now: dt.datetime,
                      limit: float = SILENCE_MINUTES) -> DataFrame:
    """Minutes since the last run; an empty log or too long a silence is a problem."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_run"))
    return (runs.agg(F.max("started_at").alias("last_run"))
            .withColumn("silence_minutes", micros / 60_000_000)
            .withColumn("problem", F.when(F.col("last_run").isNull(), "empty log")
                        .when(F.col("silence_minutes") > limit, "silent").otherwise("none")))


def check_client_mapping(mapping: DataFrame, fact: DataFrame, low: int = MIN_CLIENTS,
                         high: int = MAX_CLIENTS) -> DataFrame:
    """Violations: operators in two clients, unmapped operators, too few or many clients."""
    twice = (mapping.groupBy("operator_id").agg(F.count_distinct("client").alias("n"))
             .where("n > 1").select(F.lit("operator in two clients").alias("problem"),
                                    F.col("operator_id").alias("detail")))
    unmapped = (fact.select("operator_id").distinct()
                .join(mapping, "operator_id", "left_anti")
                .select(F.lit("operator without client").alias("problem"),
                        F.col("operator_id").alias("detail")))
    size = (mapping.agg(F.count_distinct("client").alias("n"))
            .where((F.col("n") < low) | (F.col("n") > high))
            .select(F.lit("number of clients").alias("problem"),
                    F.col("n").cast("string").alias("detail")))
    return twice.unionByName(unmapped).unionByName(size)


def check_feature_formulas(features: DataFrame, minutes: int = WINDOW_MINUTES,
                           tolerance: float = 1e-9) -> DataFrame:
    """Number of violations per rule, on raw (not standardized) features."""
    def differs(rate, part):
        expected = F.col(part) / F.nullif(F.col("n"), F.lit(0))
        return F.col("complete") & (F.abs(F.col(rate) - expected)
                                    > tolerance * (1 + F.abs(expected)))

    sliced = overlapping_slices(features, "window", minutes * 60)
    order = Window.partitionBy("client", "slice").orderBy("window")
    step = F.unix_seconds("window") - F.unix_seconds(F.lag("window").over(order))
    stepped = sliced.withColumn("_step", step).where("own")
    # A hole in the grid shows as a step of another length, or, at a slice's edge, as none.
    starts = stepped.groupBy("client").agg(F.min("window").alias("_start"))
    rules = (stepped.join(starts, "client")
             .agg(F.count_if(differs("d", "S")).alias("d"),
                  F.count_if(differs("w", "q")).alias("w"),
                  F.count_if(differs("p", "u")).alias("p"),
                  F.count_if(~F.col("complete") & F.col("d").isNotNull()).alias("empty"),
                  F.count_if((F.col("window") > F.col("_start"))
                             & (F.coalesce(F.col("_step"), F.lit(0)) != minutes * 60))
                  .alias("grid")))
    return rules.select(F.expr("stack(5, 'd = S / n', d, 'w = q / n', w, 'p = u / n', p, "
                               "'empty window has no d', empty, 'grid is contiguous', grid) "
                               "AS (rule, n_violations)"))


def check_no_leakage(scaled: DataFrame, raw: DataFrame, features: list[str] = FEATURES,
                     tolerance: float = 0.05) -> DataFrame:
    """The three leak checks as one row.

    ``scaled`` has the split and the standardized features, ``raw`` the split and raw d.
    """
    train = F.col("split") == "train"
    times = scaled.agg(F.max(F.when(train, F.col("window"))).alias("last_train"),
                       F.min(F.when(~train, F.col("window"))).alias("first_test"))
    means = scaled.where(train).agg(
        *[F.abs(F.avg(c)).alias(f"{c}_m") for c in features],
        *[F.stddev_samp(c).alias(f"{c}_s") for c in features])
    largest = means.select(F.greatest(F.lit(0.0), *[
        F.when(F.col(f"{c}_s") > 1e-9, F.col(f"{c}_m")) for c in features])).scalar()
    keys = ["client", "hour", "workday"]
    own = daily_profile(raw.where(train)).withColumnRenamed("m", "own")
    full = daily_profile(raw).withColumnRenamed("m", "full")
    changed = (own.join(full, keys)
               .agg(F.count_if(F.abs(F.col("own") - F.col("full"))
                               > 1e-8 + 1e-5 * F.abs(F.col("full")))).scalar())
    return times.select(
        "last_train", "first_test",
        (F.col("last_train") < F.col("first_test")).alias("split_by_time"),
        changed.alias("n_profile_differences"),
        largest.alias("max_train_mean"),
    ).withColumn("means_near_zero", F.col("max_train_mean") < tolerance)


def check_sequences(seqs: DataFrame, features: DataFrame, length: int = SEQUENCE_LENGTH,
                    width: int = len(FEATURES)) -> DataFrame:
    """Sequence shapes, NaNs, count, and the number of complete runs they must not exceed."""
    shaped = ((F.size("x") == length)
              & F.forall("x", lambda step: F.size(step) == width))
    holds_nan = F.exists("x", lambda step: F.exists(step, lambda v: v.isNull() | F.isnan(v)))
    facts = seqs.agg(F.count(F.lit(1)).alias("n_sequences"),
                     F.count_if(~shaped).alias("n_bad_shape"),
                     F.count_if(holds_nan).alias("n_with_nan"))
    return facts.withColumn("n_possible", complete_runs(features, length).scalar()) \
        .withColumn("within_bound", F.col("n_sequences") <= F.col("n_possible"))


def complete_runs(features: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """How many rows end a run of ``length`` complete grid windows, as one row.

    A run of complete windows of size s ends s - length + 1 sequences. Runs are told apart by
    the number of incomplete windows before them, so no window looks at neighbours.
    """
    marked = features.select("client", "window", "complete",
                             (~F.col("complete")).cast("bigint").alias("_gap"))
    numbered = preceding(marked, ["client"], ["window"], "_gap", "sum", "_run")
    runs = (numbered.where("complete").groupBy("client", "_run")
            .agg(F.count(F.lit(1)).alias("_size")))
    return runs.agg(F.coalesce(F.sum(F.greatest(F.col("_size") - (length - 1), F.lit(0))),
                               F.lit(0)).alias("n_possible"))


def check_fedavg(updates: DataFrame, aggregated: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Coordinates off the weighted mean, and clients whose update equals the aggregate."""
    expected = updates.groupBy("layer", "idx").agg(
        (F.sum(F.col("value") * F.col("n_examples")) / F.sum("n_examples")).alias("expected"))
    off = (aggregated.join(expected, ["layer", "idx"], "full")
           .agg(F.count_if(F.coalesce(F.abs(F.col("value") - F.col("expected")) > tolerance,
                                      F.lit(True))).alias("n_off"),
                F.count(F.lit(1)).alias("n_coordinates")))
    same = (updates.withColumnRenamed("value", "own")
            .join(aggregated, ["layer", "idx"])
            .groupBy("client").agg(F.max(F.abs(F.col("own") - F.col("value"))).alias("_far"))
            .agg(F.count_if(F.col("_far") <= tolerance)).scalar())
    return off.select("n_coordinates", "n_off", same.alias("n_clients_equal"))
