"""Federated anomaly detection with a linear sequence autoencoder.

A sequence x (steps times features, flattened) is encoded by A and decoded by B. The mean
squared error of a client is tr((I - BA) G (I - BA)^T) / dim with the client's second-moment
matrix G, so one Spark aggregation over the sequences serves all epochs and rounds, and the
training itself works on matrices of fixed size.

Weights are tables (layer, idx, value): layer 0 is A (hidden x dim), layer 1 is B (dim x
hidden), both row by row. Updates add client, n_examples and loss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateline.constants import ALARM_PERCENTILE, MIN_SEQUENCES, VALIDATION_SHARE
from lateline.functions.ordered import preceding
from lateline.functions.selection import quantiles
from lateline.session import materialize

HIDDEN = 8
LEARNING_RATE = 0.5
# Partial moment matrices kept per task before they are sent on (62 KB each at dim 88).
_PARTIALS = 256

MOMENTS = "client string, part string, i int, n bigint, total double, cross array<double>"
UPDATES = "client string, layer int, idx int, value double, n_examples bigint, loss double"


def client_split(seqs: DataFrame, val_share: float = VALIDATION_SHARE,
                 min_sequences: int = MIN_SEQUENCES) -> DataFrame:
    """Add ``part``: each client's first sequences by time are train, the rest val.

    Clients with fewer than ``min_sequences`` are left out. The rank is a prefix count over
    time slices, so no client's sequences meet in one task.
    """
    columns = seqs.columns
    # One row per client: stored, the planner knows it is small and does not shuffle ``seqs``.
    sizes = materialize(seqs.groupBy("client").agg(F.count(F.lit(1)).alias("_n"))
                        .where(F.col("_n") >= min_sequences), "sizes")
    ranked = preceding(seqs.withColumn("_one", F.lit(1)), ["client"], ["window"], "_one", "sum",
                       "_before")
    boundary = F.floor(F.col("_n") * F.lit(1 - val_share))
    return (ranked.join(sizes, "client")
            .withColumn("part", F.when(F.col("_before") < boundary, "train").otherwise("val"))
            .select(*columns, "part"))


def client_moments(split: DataFrame) -> DataFrame:
    """``client, part, i, n, total, cross``: row i of X^T X and the sum of coordinate i.

    Tasks add up one matrix per client and part and send rows of it; the shuffle carries
    partial sums, never sequences.
    """
    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list] = {}

        def flush():
            for (client, part), (n, total, cross) in sums.items():
                dim = len(total)
                yield pa.RecordBatch.from_pydict({
                    "client": [client] * dim, "part": [part] * dim,
                    "i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
                    "total": pa.array(total), "cross": pa.array(list(cross), pa.list_(pa.float64())),
                })
            sums.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            clients = batch.column(0).to_pandas()
            parts = batch.column(1).to_pandas()
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1).astype("float64")
            for key, rows in clients.groupby([clients, parts]).indices.items():
                own = x[rows]
                n, total, cross = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(own), total + own.sum(axis=0), cross + own.T @ own)
            if len(sums) >= _PARTIALS:
                yield from flush()
        yield from flush()

    flat = split.select("client", "part", F.flatten("x").alias("x"))
    partial = flat.mapInArrow(partial_sums, MOMENTS)
    cells = partial.select("client", "part", "i", "n", "total",
                           F.posexplode("cross").alias("j", "value"))
    return (cells.groupBy("client", "part", "i", "j")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                 F.sum("value").alias("cross")))


def initial_weights(moments: DataFrame, hidden: int = HIDDEN, seed: int = 0) -> DataFrame:
    """Starting weights of every client: small reproducible values, the same for all."""
    size = moments.groupBy("client").agg((F.max("i") + 1).alias("dim"))
    cells = (size.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("dim") * hidden - 1))))
    idx, layer = F.col("idx").cast("bigint"), F.col("layer")
    mixed = idx * idx * (layer + 31) + idx * 104_729 + layer * 1_299_709 + F.lit(seed) * 7_919
    unit = F.pmod(mixed, F.lit(1_000_003)) / 1_000_003 - 0.5
    return cells.select("client", "layer", "idx", (unit / F.sqrt("dim")).alias("value"))


def _matrices(moments: pd.DataFrame) -> tuple[int, np.ndarray]:
    """(number of sequences, mean of x x^T) of one client."""
    dim = int(moments["i"].max()) + 1
    n = int(moments["n"].iloc[0])
    gram = np.zeros((dim, dim))
    gram[moments["i"].to_numpy(), moments["j"].to_numpy()] = moments["cross"].to_numpy()
    return n, gram / n


def _layers(weights: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ordered = weights.sort_values(["layer", "idx"])["value"].to_numpy()
    half = len(ordered) // 2
    return ordered[:half].reshape(-1, dim).copy(), ordered[half:].reshape(dim, -1).copy()


def _loss(a: np.ndarray, b: np.ndarray, gram: np.ndarray) -> float:
    rest = np.eye(len(gram)) - b @ a
    return float(np.trace(rest @ gram @ rest.T) / len(gram))


def _per_client(moments: DataFrame, weights: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` on each client's moment matrix and weights, both of fixed size."""
    # New column names, because the weights often derive from the same moments.
    own = weights.select(F.col("client").alias("owner"), F.col("layer").alias("layer"),
                         F.col("idx").alias("idx"), F.col("value").alias("value"))
    return (moments.select("client", "i", "j", "n", "cross").groupBy("client")
            .cogroup(own.groupBy("owner")).applyInPandas(work, schema))


def local_update(moments: DataFrame, weights: DataFrame, epochs: int, mu: float = 0.0,
                 learning_rate: float = LEARNING_RATE) -> DataFrame:
    """``epochs`` gradient steps per client from ``weights`` (client, layer, idx, value).

    ``mu`` > 0 adds (mu / 2) times the squared distance to those starting weights. A client's
    group is its moment matrix and its weights: a fixed size, whatever its number of sequences.
    """
    def train(key, mine: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or start.empty:
            return pd.DataFrame({"client": [], "layer": [], "idx": [], "value": [],
                                 "n_examples": [], "loss": []})
        n, gram = _matrices(mine)
        dim = len(gram)
        a0, b0 = _layers(start, dim)
        a, b = a0.copy(), b0.copy()
        # The curvature of the loss grows with the largest eigenvalue of G, which its
        # Frobenius norm bounds.
        step = learning_rate * dim / max(float(np.linalg.norm(gram)), 1e-12)
        for _ in range(epochs):
            rest_gram = (np.eye(dim) - b @ a) @ gram
            grad_a = -2 / dim * b.T @ rest_gram + mu * (a - a0)
            grad_b = -2 / dim * rest_gram @ a.T + mu * (b - b0)
            rate = step / (1 + step * mu)
            a, b = a - rate * grad_a, b - rate * grad_b
        flat = [a.ravel(), b.ravel()]
        return pd.DataFrame({
            "client": key[0], "layer": np.repeat([0, 1], [len(f) for f in flat]),
            "idx": np.concatenate([np.arange(len(f)) for f in flat]),
            "value": np.concatenate(flat), "n_examples": n, "loss": _loss(a, b, gram)})

    return _per_client(moments, weights, train, UPDATES)


def moment_loss(moments: DataFrame, weights: DataFrame) -> DataFrame:
    """``client, n_examples, error``: mean reconstruction error, from moments alone."""
    def score(key, mine: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or own.empty:
            return pd.DataFrame({"client": [], "n_examples": [], "error": []})
        n, gram = _matrices(mine)
        a, b = _layers(own, len(gram))
        return pd.DataFrame({"client": [key[0]], "n_examples": [n],
                             "error": [_loss(a, b, gram)]})

    return _per_client(moments, weights, score, "client string, n_examples bigint, error double")


# --- aggregation of client updates ---

def fedavg(updates: DataFrame) -> DataFrame:
    """Mean of every coordinate, weighted by the clients' numbers of examples."""
    return updates.groupBy("layer", "idx").agg(
        (F.sum(F.col("value") * F.col("n_examples")) / F.sum("n_examples")).alias("value"))


def fedmedian(updates: DataFrame) -> DataFrame:
    return updates.groupBy("layer", "idx").agg(F.median("value").alias("value"))


def fedtrimmed(updates: DataFrame, beta: float = 0.2) -> DataFrame:
    """Plain mean of every coordinate without its int(beta * clients) lowest and highest."""
    coordinate = Window.partitionBy("layer", "idx")
    cut = F.floor(F.lit(beta) * F.col("_n"))
    ranked = (updates
              .withColumn("_rank", F.row_number().over(coordinate.orderBy("value", "client")))
              .withColumn("_n", F.count(F.lit(1)).over(coordinate)))
    return (ranked.where((F.col("_rank") > cut) & (F.col("_rank") <= F.col("_n") - cut))
            .groupBy("layer", "idx").agg(F.avg("value").alias("value")))


STRATEGIES = {"fedavg": fedavg, "fedprox": fedavg, "fedmedian": fedmedian,
              "fedtrimmed": fedtrimmed}


def spread(weights: DataFrame, updates: DataFrame) -> DataFrame:
    """Global weights as every client's next starting point."""
    return (updates.select("client", "layer", "idx").join(weights, ["layer", "idx"])
            .select("client", "layer", "idx", "value"))


# --- scoring ---

def model_size(weights: DataFrame) -> DataFrame:
    """``n_parameters, mb``: the coordinates of a model and their size as 32-bit floats."""
    return weights.agg(F.count(F.lit(1)).alias("n_parameters")) \
        .withColumn("mb", F.col("n_parameters") * 4 / 1_048_576)


def reconstruction_error(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``error``: the mean squared difference between x and its reconstruction.

    The model has twice ``hidden`` times the sequence width parameters whatever the data, so it
    goes to the tasks as a broadcast variable.
    """
    local = weights.select("layer", "idx", "value").toPandas()
    shared = seqs.sparkSession.sparkContext.broadcast(local)
    columns = seqs.columns

    @F.pandas_udf("double")
    def error(flat: pd.Series) -> pd.Series:
        if flat.empty:
            return pd.Series([], dtype="float64")
        x = np.stack(flat.to_numpy()).astype("float64")
        a, b = _layers(shared.value, x.shape[1])
        return pd.Series((((x @ a.T) @ b.T - x) ** 2).mean(axis=1))

    return seqs.select(*columns, error(F.flatten("x")).alias("error"))


def alarm_threshold(errors: DataFrame, clients: DataFrame | None = None,
                    percentile: float = ALARM_PERCENTILE) -> DataFrame:
    """``client, threshold``: the linear percentile of the errors.

    Clients of ``clients`` without errors get infinity.
    """
    found = quantiles(errors, ["client"], "error", {"threshold": percentile / 100})
    if clients is None:
        return found
    return (clients.select("client").distinct().join(found, "client", "left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(math.inf))))


def alarms(errors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Sequences whose error is above their client's threshold (a stored table)."""
    return errors.join(thresholds, "client").where(F.col("error") > F.col("threshold"))


def comparison(federated: DataFrame, local: DataFrame) -> DataFrame:
    """Errors of both models per client and the gain of federation in percent."""
    return (federated.select("client", F.col("error").alias("federated"))
            .join(local.select("client", F.col("error").alias("local")), "client")
            .withColumn("gain_pct", 100 * (F.col("local") - F.col("federated"))
                        / F.nullif(F.col("local"), F.lit(0.0))))
