"""Per-client feature windows, scaling and sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateline.constants import (
    CLIENTS, FEATURES, HEADWAY_WINDOW_MINUTES, MIN_TRIPS_FOR_HEADWAY, OBSERVED, ON_TIME_MAX,
    ON_TIME_MIN, SANE_MAX, SANE_MIN, SEQUENCE_LENGTH, SKIPPED, TIME_ZONE, TRAIN_SHARE,
    WINDOW_MINUTES, WORKDAY_PREFIX,
)
from lateline.functions.clock import (
    add_seconds, bucket, hms_to_seconds, local_date, local_midnight, local_time,
)
from lateline.functions.ordered import DAY, overlapping_slices, preceding
from lateline.functions.selection import quantiles
from lateline.session import materialize

LINE_KEYS = ["client", "line_id", "direction"]


def client_mapping(spark, clients: dict[str, list[str]] = CLIENTS) -> DataFrame:
    rows = [(operator, client) for client, operators in clients.items() for operator in operators]
    return spark.createDataFrame(rows, "operator_id string, client string")


def assign_client(fact: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``client``; a fact of an operator without a client fails the job."""
    unmapped = F.raise_error(F.concat(F.lit("operator without a client: "),
                                      F.coalesce("operator_id", F.lit("null"))))
    return (fact.join(mapping.select("operator_id", F.col("client").alias("_client")),
                      "operator_id", "left")
            .withColumn("client", F.when(F.col("_client").isNull(), unmapped.cast("string"))
                        .otherwise(F.col("_client")))
            .drop("_client"))


def assign_window(fact: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    return fact.withColumn("window", bucket("ts", minutes))


def first_stop(lookup: DataFrame) -> DataFrame:
    """Scheduled departure of every trip: the arrival at its lowest sequence, in seconds."""
    place = F.struct(F.col("stop_sequence").isNull(), "stop_sequence", "stop_id")
    return (lookup.groupBy("version_id", "trip_id")
            .agg(F.min_by("arrival", place).alias("arrival"))
            .select("version_id", "trip_id", hms_to_seconds("arrival").alias("departure_s")))


def primary_quantities(fact: DataFrame) -> DataFrame:
    delay = F.col("delay_s")
    observed = F.col("status") == OBSERVED
    valid = observed & F.coalesce(delay.between(SANE_MIN, SANE_MAX), F.lit(False))
    return fact.groupBy("client", "window").agg(
        F.count_if(valid).alias("n"),
        F.coalesce(F.sum(F.when(valid, delay)), F.lit(0)).alias("S"),
        F.count_if(valid & delay.between(ON_TIME_MIN, ON_TIME_MAX)).alias("q"),
        F.count_if(F.col("status") == SKIPPED).alias("u"),
        F.max(F.when(valid, delay)).alias("dmax"),
        F.count_if(observed & ~valid).alias("rejected"))


def trip_median(fact: DataFrame) -> DataFrame:
    """Median observed delay per trip and day, outliers included.

    The feed reports a trip many times; the median buffer counts distinct delays, so it
    combines map-side and stays small for a trip with any number of reports.
    """
    keys = ["version_id", "trip_id", "client", "line_id", "direction", "service_date"]
    return (fact.where((F.col("status") == OBSERVED) & F.col("delay_s").isNotNull())
            .dropna(subset=keys)
            .groupBy(*keys).agg(F.median("delay_s").alias("delay_s")))


def departures(trips: DataFrame, first_stops: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    """Actual departure from the first stop: local midnight plus elapsed seconds."""
    elapsed = F.col("departure_s") + F.col("delay_s")
    return (trips.join(first_stops, ["version_id", "trip_id"])
            .withColumn("departure", add_seconds(local_midnight("service_date", zone), elapsed))
            .where(F.col("departure").isNotNull())
            .select(*LINE_KEYS, "departure", "trip_id", "version_id", "service_date"))


def headways(departed: DataFrame) -> DataFrame:
    """Seconds since the previous departure of the line and direction, across days.

    A line may hold a large share of all departures, so the lag runs over time slices.
    """
    order = ["departure", "trip_id", "version_id", "service_date"]
    with_previous = preceding(departed, LINE_KEYS, order, "departure", "last", "previous")
    gap = (F.unix_micros("departure") - F.unix_micros("previous")) / 1_000_000
    return (with_previous.where(F.col("previous").isNotNull())
            .select(*LINE_KEYS, "departure", "trip_id", gap.alias("headway_s")))


def rolling_expand(gaps: DataFrame, minutes: int = WINDOW_MINUTES,
                   trailing: int = HEADWAY_WINDOW_MINUTES) -> DataFrame:
    """Each gap once for its own window and once for every later one within ``trailing``."""
    shift = F.explode(F.sequence(F.lit(0), F.lit(trailing // minutes - 1)))
    return (gaps.withColumn("_shift", shift)
            .withColumn("window", add_seconds(bucket("departure", minutes),
                                              F.col("_shift") * (minutes * 60)))
            .drop("_shift"))


def line_headway_std(expanded: DataFrame, min_trips: int = MIN_TRIPS_FOR_HEADWAY) -> DataFrame:
    return (expanded.groupBy("client", "window", "line_id", "direction")
            .agg(F.stddev_samp("headway_s").alias("headway_std"),
                 F.count("headway_s").alias("n_headways"))
            .where(F.col("n_headways") >= min_trips - 1))


def headway_irregularity(fact: DataFrame, lookup: DataFrame, minutes: int = WINDOW_MINUTES,
                         trailing: int = HEADWAY_WINDOW_MINUTES) -> DataFrame:
    """Mean over lines of the headway deviation, per client and window."""
    # One row per trip and day; stored, because the headways read it twice.
    departed = materialize(departures(trip_median(fact), first_stop(lookup)), "departures")
    gaps = headways(departed)
    per_line = line_headway_std(rolling_expand(gaps, minutes, trailing))
    return per_line.groupBy("client", "window").agg(F.avg("headway_std").alias("h"))


def time_grid(windows: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Every client at every window between the first and the last one.

    Built from one aggregate row (clients, first, last) by two explodes: no join at all.
    """
    span = (windows.groupBy("client").agg(F.min("window").alias("low"), F.max("window").alias("high"))
            .agg(F.sort_array(F.collect_list("client")).alias("clients"),
                 F.min("low").alias("low"), F.max("high").alias("high")))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return (span.where(F.col("low").isNotNull())
            .select("clients", F.explode(F.sequence("low", "high", step)).alias("window"))
            .select(F.explode("clients").alias("client"), "window"))


def base_features(grid: DataFrame, primary: DataFrame, irregularity: DataFrame) -> DataFrame:
    """Primary quantities on the grid, with rates that are null where nothing was observed."""
    counts = ["n", "q", "u", "rejected"]
    joined = (grid.join(primary, ["client", "window"], "left")
              .join(irregularity, ["client", "window"], "left"))
    filled = joined.fillna(0, subset=counts)
    n = F.nullif(F.col("n"), F.lit(0))
    return filled.select(
        "client", "window", "n", "S", "q", "u", "rejected", "h",
        (F.col("n") > 0).alias("complete"),
        (F.col("S") / n).alias("d"), (F.col("q") / n).alias("w"), (F.col("u") / n).alias("p"),
        F.when(F.col("n") > 0, F.col("dmax")).alias("dmax"))


def calendar_features(features: DataFrame, dim_date: DataFrame,
                      workday_prefix: str = WORKDAY_PREFIX, zone: str = TIME_ZONE) -> DataFrame:
    wall = local_time("window", zone)
    angle = (F.hour(wall) * 60 + F.minute(wall)) * (2 * math.pi) / 1440
    dated = features.withColumn("date", wall.cast("date"))
    return (dated.join(dim_date.select("date", "day_type"), "date", "left")
            .withColumn("hour", F.hour(wall))
            .withColumn("workday", F.coalesce(F.col("day_type").startswith(workday_prefix),
                                              F.lit(False)).cast("int"))
            .withColumn("sin_hour", F.sin(angle))
            .withColumn("cos_hour", F.cos(angle)))


def delay_change(features: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """``delta_d``: d minus the d of the previous grid window."""
    columns = features.columns
    sliced = overlapping_slices(features, "window", minutes * 60)
    order = Window.partitionBy("client", "slice").orderBy("window")
    return (sliced.withColumn("delta_d", F.col("d") - F.lag("d").over(order))
            .where("own").select(*columns, "delta_d"))


def build_features(fact: DataFrame, lookup: DataFrame, dim_date: DataFrame, mapping: DataFrame,
                   minutes: int = WINDOW_MINUTES, trailing: int = HEADWAY_WINDOW_MINUTES,
                   workday_prefix: str = WORKDAY_PREFIX) -> DataFrame:
    """Raw features per client and window on the full grid."""
    facts = assign_window(assign_client(fact, mapping), minutes)
    primary = primary_quantities(facts)
    irregularity = headway_irregularity(facts, lookup, minutes, trailing)
    base = base_features(time_grid(primary, minutes), primary, irregularity)
    return delay_change(calendar_features(base, dim_date, workday_prefix), minutes)


def split_boundary(features: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """One row ``boundary_us``: the linear quantile of the window times.

    Windows are counted first; the selection then works on distinct windows.
    """
    counted = (features.where(F.col("window").isNotNull())
               .groupBy(F.unix_micros("window").alias("us")).agg(F.count(F.lit(1)).alias("n")))
    return quantiles(counted, [], "us", {"boundary_us": share}, weight="n")


def time_split(features: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Add ``split``: train up to the boundary, test after it."""
    boundary = split_boundary(features, share).scalar()
    return features.withColumn(
        "split", F.when(F.unix_micros("window") <= boundary, "train").otherwise("test"))


def daily_profile(train: DataFrame) -> DataFrame:
    """Median d by client, hour and workday. Pass the training part only."""
    return quantiles(train, ["client", "hour", "workday"], "d", {"m": 0.5})


def profile_deviation(features: DataFrame, profile: DataFrame) -> DataFrame:
    return (features.join(profile, ["client", "hour", "workday"], "left")
            .withColumn("r", F.col("d") - F.col("m")).drop("m"))


def scaling_stats(train: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean and sample deviation per client and feature. Pass the training part only."""
    return train.groupBy("client").agg(
        *[f(c).alias(f"{c}_{name}") for c in features
          for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def standardize(features: DataFrame, stats: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Scaled features; a missing value or a zero deviation gives 0, the training mean."""
    columns = features.columns
    joined = features.join(stats, "client", "left")

    def scaled(c):
        deviation = F.nullif(F.col(f"{c}_std"), F.lit(0.0))
        return F.coalesce((F.col(c) - F.col(f"{c}_mean")) / deviation, F.lit(0.0)).alias(c)

    return joined.select(*[scaled(c) if c in names else F.col(c) for c in columns])


def sequences(features: DataFrame, length: int = SEQUENCE_LENGTH,
              minutes: int = WINDOW_MINUTES, names: list[str] = FEATURES) -> DataFrame:
    """``x`` = the last ``length`` windows of each row, if all are complete and adjoining.

    Sequences stay within one split where the features carry a ``split`` column.
    """
    keys = ["client"] + (["split"] if "split" in features.columns else [])
    reach = (length - 1) * minutes * 60
    # Slices far wider than the look-back keep the copied rows few.
    sliced = overlapping_slices(features.select(*keys, "window", "complete", *names),
                                "window", reach, width=max(7 * DAY, 20 * reach))
    last = (Window.partitionBy(*keys, "slice").orderBy("window")
            .rowsBetween(-(length - 1), Window.currentRow))
    vector = F.array(*[F.col(c).cast("float") for c in names])
    return (sliced
            .withColumn("x", F.collect_list(vector).over(last))
            .withColumn("_complete", F.min("complete").over(last))
            .withColumn("_first", F.min("window").over(last))
            .where(F.col("own") & F.col("_complete") & (F.size("x") == length)
                   & (F.unix_seconds("window") - F.unix_seconds("_first") == reach))
            .select(*keys, "window", "x"))


def sequence_report(features: DataFrame, seqs: DataFrame) -> DataFrame:
    """Per client: windows, complete windows, training and test sequences."""
    windows = features.groupBy("client").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("complete").alias("n_complete"))
    counted = seqs.groupBy("client").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"))
    return windows.join(counted, "client", "left").fillna(0, subset=["n_train", "n_test"])
