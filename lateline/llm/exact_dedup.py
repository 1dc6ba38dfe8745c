"""Exact dedup by a sharded minimal perfect hash over distinct digests.

Every distinct SHA-256 digest of the history gets one slot of a minimal perfect hash. Digests are
dealt to shards of about 256 keys; a shard of m keys has m slots and one small integer (the pilot)
per bucket of about two keys, chosen so that no two keys share a slot. A slot holds the full
digest and the locator of the row that stays. A row is looked up by computing its slot and
comparing all bytes of the digest; rows whose digest is not in the history group separately.

The number of shards follows the number of digests, so a shard, its pilots and the group that
builds it have the same size at any scale. Copies are pre-aggregated by digest before the index is
built; the lookups are equi joins that adaptive execution splits when one digest is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lateline.session import materialize

KEYS_PER_SHARD = 256
KEYS_PER_BUCKET = 2
PRIME = 2**31 - 1
MAX_PILOT = 2**15


def _same(text: Column) -> Column:
    return text


def digests(docs: DataFrame, normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """doc_id and the SHA-256 digest (binary) of each whole text; a null text counts as empty."""
    text = normalise(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"))


def _hashed(df: DataFrame, n_shards: int) -> DataFrame:
    """The shard of a digest and the words from which bucket and slot follow."""
    word = lambda k: F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(PRIME))
    return df.withColumns({
        "shard": F.pmod(F.xxhash64("digest", F.lit(0)), F.lit(n_shards)),
        "h0": word(1), "h1": word(2), "h2": word(3), "h3": word(4)})


def _slot(pilot: Column, m: Column) -> Column:
    return (F.col("h1") + pilot * F.col("h2") + pilot * pilot * F.col("h3")) % PRIME % m


def _build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    """Pilot and slot of every key of a shard; buckets are placed from the largest down."""
    m = len(keys)
    n_buckets = -(-m // KEYS_PER_BUCKET)
    bucket = keys["h0"].to_numpy() % n_buckets
    h1, h2, h3 = (keys[c].to_numpy() for c in ("h1", "h2", "h3"))
    pilots, slots, free = np.zeros(m, np.int64), np.zeros(m, np.int64), np.ones(m, bool)
    sizes = np.bincount(bucket, minlength=n_buckets)
    trial = np.arange(MAX_PILOT)[:, None]
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own = np.flatnonzero(bucket == b)
        for start in range(0, MAX_PILOT, 512):
            p = trial[start:start + 512]
            at = (h1[own] + p * h2[own] + p * p * h3[own]) % PRIME % m
            ordered = np.sort(at, axis=1)
            good = free[at].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                pilots[own], slots[own] = start + k, at[k]
                free[at[k]] = False
                break
        else:
            raise RuntimeError("no pilot separates the digests of a bucket")
    return pd.DataFrame({"shard": keys["shard"], "m": m, "bucket": bucket, "pilot": pilots,
                         "slot": slots, "digest": keys["digest"], "winner_id": keys["winner_id"],
                         "winner_row": keys["winner_row"], "n": keys["n"]})


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row with the largest doc_id (then the largest locator) and the group size."""
    return (rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count(F.lit(1)).alias("n"))
            .select("digest", F.col("w.doc_id").alias("winner_id"),
                    F.col("w.row").alias("winner_row"), "n"))


def build_index(distinct: DataFrame, n_shards: int) -> DataFrame:
    """One row per slot: shard, m, bucket, pilot, slot, digest, winner_id, winner_row, n."""
    id_type = distinct.schema["winner_id"].dataType.simpleString()
    return _hashed(distinct, n_shards).groupBy("shard").applyInPandas(
        _build_shard, f"shard long, m long, bucket long, pilot long, slot long, digest binary, "
                      f"winner_id {id_type}, winner_row long, n long")


def look_up(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """``rows`` with winner_id, winner_row and n of the slot whose digest has the same bytes."""
    heads = (index.groupBy("shard", "m")
             .agg(F.map_from_entries(F.collect_set(F.struct("bucket", "pilot"))).alias("pilots")))
    slots = index.select("shard", "slot", F.col("digest").alias("held"), "winner_id",
                         "winner_row", "n")
    n_buckets = F.ceil(F.col("m") / KEYS_PER_BUCKET)
    placed = (_hashed(rows, n_shards).join(heads, "shard", "left")
              .withColumn("pilot", F.try_element_at("pilots", F.col("h0") % n_buckets))
              .withColumn("slot", _slot(F.col("pilot"), F.col("m")))
              .select(*rows.columns, "shard", "slot"))
    hit = F.coalesce(F.col("held") == F.col("digest"), F.lit(False))
    return (placed.join(slots, ["shard", "slot"], "left")
            .select(*rows.columns, *[F.when(hit, F.col(c)).alias(c)
                                     for c in ("winner_id", "winner_row", "n")],
                    hit.alias("member")))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None,
                normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``.

    Without ``history`` the rows of ``docs`` are their own history: of equal texts the row with
    the largest doc_id stays. With a history (doc_id, text), rows equal to one of its texts are
    all repeats of its largest doc_id; other rows group among themselves.

    A null text equals an empty one; a null doc_id is smaller than any other; of rows that repeat
    the winning doc_id exactly one stays; an empty table gives an empty result; columns besides
    doc_id and text are ignored.
    """
    rows = materialize(digests(docs, normalise)
                       .withColumn("row", F.monotonically_increasing_id()), "digests")
    known = rows if history is None else (
        digests(history, normalise).withColumn("row", F.lit(None).cast("long")))
    distinct = materialize(winners(known), "distinct-digests")
    n_shards = max(1, math.ceil(distinct.count() / KEYS_PER_SHARD))
    index = materialize(build_index(distinct, n_shards), "digest-slots")
    found = look_up(rows, index, n_shards)
    if history is not None:
        found = materialize(found, "digest-lookups")
        fresh = found.filter(~F.col("member")).select("doc_id", "digest", "row")
        found = found.filter("member").unionByName(
            fresh.join(winners(fresh), "digest").withColumn("member", F.lit(False)))
    kept = (F.col("doc_id").eqNullSafe(F.col("winner_id"))
            & F.coalesce(F.col("row") == F.col("winner_row"), F.lit(False)))
    return found.select("doc_id", F.col("winner_id").alias("keep_id"),
                        F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def keep_first_of_equal(docs: DataFrame, normalise: Callable[[Column], Column] = _same,
                        history: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat doc_id and text of a kept row leave one row.
    """
    kept = (exact_dedup(docs, history, normalise).filter("kept")
            .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct())
    text = normalise(F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"_own": F.unhex(F.sha2(text, 256))})
    same = keyed["doc_id"].eqNullSafe(kept["_id"]) & (keyed["_own"] == kept["_digest"])
    once = Window.partitionBy("doc_id", "_own").orderBy("doc_id")
    return (keyed.join(kept, same, "left_semi")
            .withColumn("_nth", F.row_number().over(once))
            .filter("_nth = 1").select(*docs.columns))
