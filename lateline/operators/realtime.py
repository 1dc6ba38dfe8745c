"""From feed snapshots to fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateline.constants import (
    CANCELED, ERROR_TEXT_LENGTH, OBSERVED, SKIPPED, STOP_SKIPPED, TRIP_CANCELED,
)
from lateline.functions.clock import service_date
from lateline.functions.ordered import as_of, preceding
from lateline.schema import DELAY_FACT, FACT_KEY, RUN_LOG
from lateline.session import materialize

FACT_COLUMNS = DELAY_FACT.fieldNames()
_SCHEDULE_COLUMNS = ["trip_id", "stop_sequence", "stop_id", "line_id", "operator_id",
                     "direction", "day_offset", "version_id"]
# The planner takes exploded messages for as small as their file and would broadcast any number
# of updates. A merge join spills, and AQE splits its hot partitions.
_JOIN = "merge"
# Bits of the filter that a lookup passes before its rows move: at most 2^26, a million words.
_BITS_PER_KEY, _LEAST_BITS, _MOST_BITS = 16, 1 << 16, 1 << 26


def new_snapshots(polls: DataFrame, order: list[str], processed: int | None = None) -> DataFrame:
    """Polls whose ``header_ts`` is above every earlier poll's (and above ``processed``).

    ``order`` starts with the arrival time and is a total order of the polls. Only these columns and
    ``header_ts`` are ordered; what else a poll carries is joined to the polls that are left.
    """
    if processed is not None:
        polls = polls.where(F.col("header_ts") > F.lit(processed))
    key = list(dict.fromkeys([*order, "header_ts"]))
    seen = preceding(polls.select(*key), [], order, "header_ts", "max", "_seen")
    new = seen.where(F.col("_seen").isNull() | (F.col("header_ts") > F.col("_seen"))).drop("_seen")
    if set(polls.columns) == set(key):
        return new.select(*polls.columns)
    return polls.join(new, key, "left_semi")


def version_in_force(polls: DataFrame, versions: DataFrame, at: str = "arrived_at") -> DataFrame:
    """Add ``version_id``: the schedule version that was loaded last when the poll arrived.

    Polls older than the first version get the first one. A backlog that spans a version change is
    thus matched to the schedule of each snapshot's own time.
    """
    return as_of(polls, at, versions, "loaded_at", "version_id", "version_id")


def current_version(versions: DataFrame) -> DataFrame:
    """The version loaded last, as a row ``version_id``."""
    return (versions.groupBy()
            .agg(F.max_by("version_id", F.struct("loaded_at", "version_id")).alias("version_id"))
            .where(F.col("version_id").isNotNull()))


def trip_updates(snapshots: DataFrame) -> DataFrame:
    """One row per entity with a trip update and a trip id; ``entity_no`` is its place.

    A ``version_id`` of the snapshots is kept.
    """
    version = ["version_id"] if "version_id" in snapshots.columns else []
    return (snapshots
            .select(*version, F.timestamp_seconds("header.timestamp").alias("ts"),
                    F.posexplode("entity").alias("entity_no", "e"))
            .where(F.col("e.trip_update").isNotNull()
                   & (F.coalesce("e.trip_update.trip.trip_id", F.lit("")) != ""))
            .select(*version, "ts", "entity_no",
                    F.col("e.trip_update.trip.trip_id").alias("trip_id"),
                    F.coalesce(F.col("e.trip_update.trip.schedule_relationship")
                               == TRIP_CANCELED, F.lit(False)).alias("canceled"),
                    F.col("e.trip_update.stop_time_update").alias("stops")))


def flatten_stops(snapshots: DataFrame) -> DataFrame:
    """One row per stop update that has a sequence, of trips that are not canceled."""
    return stop_updates(trip_updates(snapshots))


def stop_updates(entities: DataFrame) -> DataFrame:
    """The same from the rows of ``trip_updates``."""
    version = ["version_id"] if "version_id" in entities.columns else []
    return (entities.where("NOT canceled")
            .select(*version, "ts", "entity_no", "trip_id",
                    F.posexplode("stops").alias("stop_no", "s"))
            .where(F.col("s.stop_sequence").isNotNull())
            .select(*version, "ts", "entity_no", "stop_no", "trip_id",
                    F.col("s.stop_sequence").alias("stop_sequence"),
                    F.coalesce(F.col("s.schedule_relationship") == STOP_SKIPPED,
                               F.lit(False)).alias("skipped"),
                    F.col("s.arrival").isNotNull().alias("has_arrival"),
                    F.col("s.arrival.delay").alias("delay_s")))


def unique_stops(lookup: DataFrame, version: int) -> DataFrame:
    """One lookup row per (trip, sequence) of a version: the one with the lowest stop id."""
    return _lowest_stops(lookup.where(F.col("version_id") == version))


def _lowest_stops(stops: DataFrame) -> DataFrame:
    rest = [c for c in _SCHEDULE_COLUMNS if c not in ("trip_id", "stop_sequence", "version_id")]
    # Grouping by the version too leaves the join its own exchange, which AQE can split.
    return (stops.groupBy("version_id", "trip_id", "stop_sequence")
            .agg(F.min(F.struct(*rest)).alias("r"))
            .select("version_id", "trip_id", "stop_sequence", "r.*"))


def match_schedule(updates: DataFrame, lookup: DataFrame, version: int) -> DataFrame:
    """Stop updates with their scheduled stop; updates the schedule does not know are dropped.

    The feed names no stop, so the match is on (trip, sequence).
    """
    stops = unique_stops(lookup, version).hint(_JOIN)
    matched = updates.join(stops, ["trip_id", "stop_sequence"])
    return matched.withColumn("service_date", service_date("ts", "day_offset"))


def expand_canceled(snapshots: DataFrame, lookup: DataFrame, version: int) -> DataFrame:
    """A CANCELED row for every scheduled stop of a canceled trip."""
    stops = lookup.where(F.col("version_id") == version).select(*_SCHEDULE_COLUMNS)
    return _canceled_stops(trip_updates(snapshots.drop("version_id")), stops, ["trip_id"])


def _canceled_stops(entities: DataFrame, stops: DataFrame, on: list[str]) -> DataFrame:
    trips = entities.where("canceled").select("ts", "entity_no", *on)
    return (trips.join(stops.hint(_JOIN), on)
            .withColumn("service_date", service_date("ts", "day_offset"))
            .withColumn("delay_s", F.lit(None).cast("int"))
            .withColumn("status", F.lit(CANCELED))
            .withColumn("stop_no", F.lit(0))
            .select(*FACT_COLUMNS, "entity_no", "stop_no"))


def skipped_stops(matched: DataFrame) -> DataFrame:
    return (matched.where("skipped")
            .withColumn("delay_s", F.lit(None).cast("int"))
            .withColumn("status", F.lit(SKIPPED))
            .select(*FACT_COLUMNS, "entity_no", "stop_no"))


def observed_delays(matched: DataFrame) -> DataFrame:
    """Matched updates with a reported delay that are not skipped."""
    return (matched.where(~F.col("skipped") & F.col("delay_s").isNotNull())
            .withColumn("status", F.lit(OBSERVED))
            .select(*FACT_COLUMNS, "entity_no", "stop_no"))


def _may_match(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose trip ``keys`` lack; none that they hold is left out.

    A row is looked up by the hash of its trip in a bitmap of the keys, where it lies. The bitmap is
    one row per word of 64 bits and of bounded size, so it can be broadcast at any number of keys.
    """
    bits = _LEAST_BITS
    wanted = keys.count() * _BITS_PER_KEY
    while bits < min(wanted, _MOST_BITS):
        bits *= 2

    def place(df):
        at = F.xxhash64(df["version_id"].cast("bigint"), df["trip_id"].cast("string")).bitwiseAND(F.lit(bits - 1))
        return F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(keys)
    words = (keys.select(word.alias("_word"), bit.alias("_bit"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    word, bit = place(rows)
    # As a semi-join, since the planner moves the join with the keys below any other.
    return rows.join(F.broadcast(words), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def stops_of_trips(lookup, entities: DataFrame) -> DataFrame:
    """The scheduled stops of the trips that ``entities`` name: a semi-join of the lookup.

    The trips come as distinct keys, combined map-side, so a trip that fills the feed is one key.
    Of a lookup that is a table only the rows that may match are shuffled, however many versions and
    trips it holds besides. ``lookup`` is such a table, or a ``StoredLookup`` whose buckets already
    lie by trip.
    """
    keys = entities.select("version_id", "trip_id").distinct()
    if not isinstance(lookup, DataFrame):
        return lookup.stops_of(keys).select(*_SCHEDULE_COLUMNS)
    keys = materialize(keys, "trips")
    return _may_match(lookup.select(*_SCHEDULE_COLUMNS), keys).join(
        keys.hint(_JOIN), ["version_id", "trip_id"], "left_semi")


def process_feed(snapshots: DataFrame, lookup, version: int | None = None) -> DataFrame:
    """All fact rows of the snapshots, with their place in the feed.

    ``version`` is that of all snapshots; without it they carry a ``version_id`` each. The feed is
    taken apart once and the lookup is reduced to the trips in it once; both are written, and all
    joins, orderings and sums after that see those rows only. ``lookup`` as in ``stops_of_trips``.
    """
    if version is not None:
        snapshots = snapshots.withColumn("version_id", F.lit(version).cast("int"))
    entities = materialize(trip_updates(snapshots), "entities")
    stops = materialize(stops_of_trips(lookup, entities), "stops")
    matched = (stop_updates(entities)
               .join(_lowest_stops(stops).hint(_JOIN), ["version_id", "trip_id", "stop_sequence"])
               .withColumn("service_date", service_date("ts", "day_offset")))
    skipped = F.col("skipped")
    reported = (matched.where(skipped | F.col("delay_s").isNotNull())
                .withColumn("delay_s", F.when(~skipped, F.col("delay_s")))
                .withColumn("status", F.when(skipped, F.lit(SKIPPED)).otherwise(OBSERVED))
                .select(*FACT_COLUMNS, "entity_no", "stop_no"))
    return reported.unionByName(_canceled_stops(entities, stops, ["version_id", "trip_id"]))


def first_per_key(rows: DataFrame) -> DataFrame:
    """One fact per primary key: the first in feed order where the rows have one."""
    rest = [c for c in FACT_COLUMNS if c not in FACT_KEY]
    place = [c for c in ("entity_no", "stop_no") if c in rows.columns]
    return (rows.groupBy(*FACT_KEY)
            .agg(F.min(F.struct(*place, *rest)).alias("r"))
            .select(*[F.col(c) if c in FACT_KEY else F.col(f"r.{c}") for c in FACT_COLUMNS]))


def insert_new_facts(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows to append: new primary keys only, each once."""
    return first_per_key(rows).join(target.select(*FACT_KEY), FACT_KEY, "left_anti")


def log_run(batches: DataFrame) -> DataFrame:
    """Run-log rows from per-iteration statistics.

    ``batches``: started_at, finished_at, snapshot_ts, fresh, n_observed, n_inserted, error.
    """
    failed = F.col("error").isNotNull()
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    done = ~failed & F.col("fresh")
    return batches.select(
        "started_at", "snapshot_ts",
        F.when(done, F.col("n_observed")).otherwise(0).cast("int").alias("n_observed"),
        F.when(done, F.col("n_inserted")).otherwise(0).cast("int").alias("n_inserted"),
        F.round(seconds, 3).cast(RUN_LOG["seconds"].dataType).alias("seconds"),
        F.when(failed, "ERROR").when(F.col("fresh"), "OK").otherwise("SKIPPED").alias("status"),
        F.substring("error", 1, ERROR_TEXT_LENGTH).alias("error"),
    ).select(*RUN_LOG.fieldNames())


def orphan_facts(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per dimension, the number of facts whose non-null key the dimension lacks.

    ``dims`` maps a fact column to (dimension, key column). Facts are counted by key first,
    so only distinct keys reach the anti joins.
    """
    result = None
    for column, (dim, key) in dims.items():
        counts = (fact.where(F.col(column).isNotNull())
                  .groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
        missing = (counts.join(dim.select(F.col(key).alias("_key")), "_key", "left_anti")
                   .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_facts"),
                        F.count(F.lit(1)).alias("n_keys"))
                   .select(F.lit(column).alias("key_column"), "n_facts", "n_keys"))
        result = missing if result is None else result.unionByName(missing)
    return result
