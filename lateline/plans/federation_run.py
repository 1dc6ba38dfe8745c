"""Federated training rounds and the comparison with purely local models."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateline.operators import federated as fed
from lateline.session import materialize


@dataclass
class Federation:
    weights: DataFrame      # final global model
    history: DataFrame      # round, client, loss, validation, mb_per_client
    seconds: list[float]    # wall-clock seconds per round


def federated_rounds(moments: DataFrame, strategy: str = "fedavg", rounds: int = 5,
                     epochs: int = 3, mu: float = 0.1, hidden: int = fed.HIDDEN,
                     seed: int = 0) -> Federation:
    """Rounds of local training, aggregation and validation.

    ``moments`` comes from ``client_moments`` and should be a stored table. Each round's weights
    are written to the shared folder: the lineage of a round never reaches back to earlier ones,
    and a lost executor costs one round's small work.
    """
    aggregate = fed.STRATEGIES[strategy]
    mu = mu if strategy == "fedprox" else 0.0
    train = moments.where(F.col("part") == "train")
    validation = moments.where(F.col("part") == "val")
    start = materialize(fed.initial_weights(train, hidden, seed), "weights")
    weights, history, seconds = None, None, []
    for number in range(1, rounds + 1):
        began = time.monotonic()
        updates = materialize(fed.local_update(train, start, epochs, mu), "updates")
        weights = materialize(aggregate(updates), "weights")
        start = fed.spread(weights, updates)
        losses = updates.groupBy("client").agg(F.max("loss").alias("loss"),
                                               (F.count(F.lit(1)) * 4 / 1_048_576)
                                               .alias("mb_per_client"))
        errors = fed.moment_loss(validation, start).select(
            "client", F.col("error").alias("validation"))
        entry = materialize(losses.join(errors, "client", "left").select(
            F.lit(number).alias("round"), "client", "loss", "validation", "mb_per_client"),
            "round")
        history = entry if history is None else history.unionByName(entry)
        seconds.append(time.monotonic() - began)
    return Federation(weights, history, seconds)


def local_baseline(moments: DataFrame, epochs: int, hidden: int = fed.HIDDEN,
                   seed: int = 0) -> DataFrame:
    """Updates of one model per client, trained alone for ``epochs`` from the same start."""
    train = moments.where(F.col("part") == "train")
    return fed.local_update(train, fed.initial_weights(train, hidden, seed), epochs)


def compare_with_local(moments: DataFrame, federation: Federation, rounds: int, epochs: int,
                       hidden: int = fed.HIDDEN, seed: int = 0) -> DataFrame:
    """Validation error of the global and of the local models, trained for as many epochs."""
    validation = moments.where(F.col("part") == "val")
    local = materialize(local_baseline(moments, rounds * epochs, hidden, seed), "local")
    return fed.comparison(fed.moment_loss(validation, fed.spread(federation.weights, local)),
                          fed.moment_loss(validation, local))
