"""Rollups as watermarked streaming aggregates (append mode).

A bucket is emitted once the watermark has passed its end; rows later than ``late`` are not
counted, as with the batch refresh window of the same length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateline.constants import LATE_LIMIT
from lateline.operators.rollups import KEYS, MEASURES, STOP_KEYS, measures, merged_measures


def _quarters(facts: DataFrame, keys: list[str], late: str) -> DataFrame:
    return (facts.withWatermark("ts", late)
            .groupBy(F.window("ts", "15 minutes").alias("w"), *keys).agg(*measures()))


def stream_rollup_15min(facts: DataFrame, late: str = LATE_LIMIT) -> DataFrame:
    return _quarters(facts, KEYS, late).select(F.col("w.start").alias("bucket"), *KEYS, *MEASURES)


def stream_rollup_15min_stop(facts: DataFrame, late: str = LATE_LIMIT) -> DataFrame:
    return _quarters(facts, STOP_KEYS, late).select(
        F.col("w.start").alias("bucket"), *STOP_KEYS, *MEASURES)


def stream_rollup_1h(facts: DataFrame, late: str = LATE_LIMIT) -> DataFrame:
    """Hours merged from the emitted quarters, in the same stream."""
    return (_quarters(facts, KEYS, late)
            .groupBy(F.window(F.window_time("w"), "1 hour").alias("w"), *KEYS)
            .agg(*merged_measures())
            .select(F.col("w.start").alias("hour"), *KEYS, *MEASURES))


def write_stream(rollup: DataFrame, path: str, checkpoint: str, trigger: dict):
    return (rollup.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start(path))
