"""Feature build: raw features -> split -> profile -> scaling -> sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateline.constants import (
    HEADWAY_WINDOW_MINUTES, SEQUENCE_LENGTH, TRAIN_SHARE, WINDOW_MINUTES, WORKDAY_PREFIX,
)
from lateline.operators import features as ops
from lateline.session import materialize


@dataclass
class FeatureTables:
    raw: DataFrame          # unscaled features with the split
    profile: DataFrame      # daily profile of the training part
    stats: DataFrame        # scaling statistics of the training part
    features: DataFrame     # standardized features
    sequences: DataFrame    # (client, split, window, x)


def feature_tables(fact: DataFrame, lookup: DataFrame, dim_date: DataFrame, mapping: DataFrame,
                   minutes: int = WINDOW_MINUTES, trailing: int = HEADWAY_WINDOW_MINUTES,
                   train_share: float = TRAIN_SHARE, length: int = SEQUENCE_LENGTH,
                   workday_prefix: str = WORKDAY_PREFIX) -> FeatureTables:
    """The facts are aggregated once; the (client, window) table they reduce to is written and
    every later step reads that. Profile and statistics see the training part only."""
    facts = ops.assign_window(ops.assign_client(fact, mapping), minutes)
    primary = materialize(ops.primary_quantities(facts), "primary")
    irregularity = ops.headway_irregularity(facts, lookup, minutes, trailing)
    base = ops.base_features(ops.time_grid(primary, minutes), primary, irregularity)
    dated = ops.calendar_features(base, dim_date, workday_prefix)
    base = materialize(ops.delay_change(dated, minutes), "features")

    raw = ops.time_split(base, train_share)
    train = F.col("split") == "train"
    # A few rows per client each; as written tables their size is known when joins are planned.
    profile = materialize(ops.daily_profile(raw.where(train)), "profile")
    deviated = ops.profile_deviation(raw, profile)
    stats = materialize(ops.scaling_stats(deviated.where(train)), "scaling")
    scaled = ops.standardize(deviated, stats)
    return FeatureTables(raw, profile, stats, scaled, ops.sequences(scaled, length, minutes))
