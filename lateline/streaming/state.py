"""Streams that remember: header times already seen, facts already stored, the last run.

All keep their memory in the state of the stream, which its checkpoint restores. None reads
what has been written before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lateline.constants import FACT_RETENTION_HOURS, GAP_MINUTES, SILENCE_MINUTES
from lateline.functions.clock import local_date
from lateline.schema import DELAY_FACT, FACT_KEY

_POLL = "source string, arrived_at timestamp, header_ts long"


def mark_new(polls: DataFrame, feed: str = "trip updates") -> DataFrame:
    """Add ``fresh`` to a stream of polls: its header time is above that of every earlier poll.

    The state is one number per feed, so it needs no time to live. A batch's polls are taken in
    order of (arrived_at, source, header_ts); only these columns reach the state, never a payload.
    A poll without a header time is not fresh.
    """
    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState):
        batch = pd.concat(list(frames), ignore_index=True)
        batch = batch.sort_values(["arrived_at", "source", "header_ts"], kind="stable")
        header = batch["header_ts"].astype("float64").fillna(-math.inf)
        mark = float(state.get[0]) if state.exists else -math.inf
        fresh = header > header.cummax().shift(fill_value=-math.inf).clip(lower=mark)
        if fresh.any():
            state.update((int(header.max()),))
        yield batch[["source", "arrived_at"]].assign(
            header_ts=batch["header_ts"].astype("Int64"), fresh=fresh)

    rows = polls.select(F.lit(feed).alias("_feed"), "source", "arrived_at",
                        F.col("header_ts").cast("long").alias("header_ts"))
    return rows.groupBy("_feed").applyInPandasWithState(
        follow, f"{_POLL}, fresh boolean", "header_ts long", "append", GroupStateTimeout.NoTimeout)


def watch_runs(runs: DataFrame, minutes: float = GAP_MINUTES,
               silence: float | None = SILENCE_MINUTES) -> DataFrame:
    """Breaks in a stream of runs (started_at), as they end or last: kind, gap_from, gap_to, gap_minutes.

    A "gap" is a pair of consecutive runs more than ``minutes`` apart. A "silence" comes once when no
    run has arrived for ``silence`` minutes of clock time, and has no end yet; the gap follows with
    the next run. The state is the last run's time. Runs of a batch are put in order; one that
    comes in later than a later run is no end of a gap.

    A watch for silence has work at all times: it needs a trigger by interval, and a pass over what
    is there (``availableNow``) would never end. Without ``silence`` it tells gaps only.
    """
    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.update((last,))       # no new timeout: one alarm per silence
            yield pd.DataFrame({"kind": ["silence"], "gap_from": [last], "gap_to": [None], "gap_minutes": [silence]})
            return
        micros = pd.concat([f["micros"] for f in frames]).dropna().astype("int64").sort_values().to_numpy()
        if state.exists:
            micros = np.concatenate([[state.get[0]], micros[micros > state.get[0]]])
        if len(micros):
            state.update((int(micros[-1]),))
            if silence is not None:
                state.setTimeoutDuration(int(silence * 60_000))
        wide = np.flatnonzero(np.diff(micros) > minutes * 60_000_000)
        ends = micros[wide + 1] if len(wide) else micros[:0]
        yield pd.DataFrame({"kind": "gap", "gap_from": micros[wide], "gap_to": pd.array(ends, "Int64"),
                            "gap_minutes": (ends - micros[wide]) / 60_000_000})

    rows = runs.select(F.lit("runs").alias("_log"), F.unix_micros("started_at").alias("micros"))
    found = rows.groupBy("_log").applyInPandasWithState(
        follow, "kind string, gap_from long, gap_to long, gap_minutes double", "last long", "append",
        GroupStateTimeout.NoTimeout if silence is None else GroupStateTimeout.ProcessingTimeTimeout)
    return found.select("kind", *[F.timestamp_micros(c).alias(c) for c in ("gap_from", "gap_to")], "gap_minutes")


def unseen_facts(facts: DataFrame, hours: int = FACT_RETENTION_HOURS) -> DataFrame:
    """A stream of facts without those whose primary key came before.

    Keys are forgotten ``hours`` behind the latest fact, as the fact table itself keeps no older
    ones; facts that are later than that are dropped. Of rows with one key in one batch any may
    stay: feed order has to be settled before (``first_per_key``).
    """
    return (facts.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(FACT_KEY))


def start_fact_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                      trigger: dict | None = None, hours: int = FACT_RETENTION_HOURS,
                      files_per_batch: int = 1000):
    """Append the new facts of the Parquet files arriving in ``source`` to ``target``, by local day."""
    facts = (spark.readStream.schema(DELAY_FACT).option("maxFilesPerTrigger", files_per_batch)
             .parquet(source))
    return (unseen_facts(facts, hours).withColumn("dt", local_date("ts"))
            .writeStream.format("parquet").option("path", target).partitionBy("dt")
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"processingTime": "20 seconds"})).start())
