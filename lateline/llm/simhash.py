"""SimHash near-dedup with pigeonring filtering.

Fingerprints come from Arrow batches: every 3-word shingle is hashed (XXH64), and bit counts are
summed for a whole batch with numpy, so no step costs Python time per bit.

Linking works on distinct fingerprints, so a group of copies is one row. The 64 bits form a ring
of 16 segments of 4 bits. If two fingerprints differ in at most t bits, some start on the ring has
cumulative differences of at most l * t / 16 over its first l segments, for every l. While
that budget is below one, segments must be equal: these leading segments are the join key (28 bits
for t = 2); the remaining budgets are tested on candidates before the full Hamming distance.

A key shared by more than ``dense`` fingerprints (a cloud of near copies) is not paired out.
Fingerprints there go by midpoints instead: two values within 2 bits share a value at most one
bit from both. Each value names its 65 neighbours; a neighbour has at most 65 namers, all of
which are within 2 bits of each other, so a star of at most 64 edges joins them without loss.

Components follow from large-star / small-star rounds over the edges, which stay distributed; each
round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from lateline.session import materialize

SHINGLE = 3
SEED = 42
BITS = 64
SEGMENTS = 16
MAX_DISTANCE = 2
DENSE = 32
#: Byte value -> its 8 bits as 8 byte lanes, so that sums of up to 255 rows need no carry.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """Hashes of all word shingles, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text the bits set in over half of its hashes; ``counts`` hashes belong to each text."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    # Pieces of at most 255 hashes of one text.
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = starts[owner] + 255 * nth
    bytes_ = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(full), BITS), np.int64)
    first = np.cumsum(pieces) - pieces
    for k in range(8):
        sums = np.add.reduceat(LANES[bytes_[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k:8 * k + 8] = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    over = 2 * bits > counts[full][:, None]
    out[full] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        # One text's hashes at a time in memory, plus small texts together.
        held, counts, n = [], [], 0

        def flush():
            nonlocal held, counts, n
            if counts:
                all_hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
                prints.append(majority(all_hashes, np.array(counts)))
            held, counts, n = [], [], 0

        for text in batch.column("text"):
            hashes = np.array(shingle_hashes(text.as_py()), np.uint64)
            held.append(hashes)
            counts.append(len(hashes))
            n += len(hashes)
            if n > 200_000:
                flush()
        flush()
        values = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(values, pa.int64())], names=[*rest, "fp"])


def fingerprints(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, ``keep`` and the fingerprint (its 64 bits as a signed number) of each whole text."""
    rest = docs.select("doc_id", *keep)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema)
    return docs.select(*rest.columns, "text").mapInArrow(_fingerprint_batches, f"{columns}, fp long")


def _rotated(fp: Column, segment: int, width: int) -> Column:
    """The ring read from ``segment`` on, as 64 bits."""
    shift = segment * width
    if not shift:
        return fp
    return F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift))


def candidate_keys(prints: DataFrame, distance: int = MAX_DISTANCE,
                   segments: int = SEGMENTS) -> DataFrame:
    """fp, start and key: the leading segments that must be equal, for each start on the ring."""
    width = BITS // segments
    lead = next(n for n in range(1, segments + 1) if n * distance >= segments) - 1
    keys = [F.struct(F.lit(s).alias("start"), F.shiftrightunsigned(
        _rotated(F.col("fp"), s, width), BITS - lead * width).alias("key"))
        for s in range(segments)]
    return (prints.select("fp", F.explode(F.array(*keys)).alias("k"))
            .select("fp", "k.start", "k.key"))


def within_budgets(a: Column, b: Column, start: Column, distance: int = MAX_DISTANCE,
                   segments: int = SEGMENTS) -> Column:
    """Whether every prefix of the chain from ``start`` keeps to its share of the distance."""
    width = BITS // segments
    diff = a.bitwiseXOR(b)
    shift = (start * width).cast("int")
    ring = F.call_function("shiftleft", diff, shift).bitwiseOR(
        F.when(shift > 0, F.call_function("shiftrightunsigned", diff, F.lit(BITS) - shift))
        .otherwise(F.lit(0).cast("long")))
    ok = F.lit(True)
    for length in range(1, segments + 1):
        budget = length * distance // segments
        prefix = ring if length == segments else F.shiftrightunsigned(ring, BITS - length * width)
        if length == segments or (length + 1) * distance // segments != budget:
            ok = ok & (F.bit_count(prefix) <= budget)
    return ok


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b), a < b, that join all distinct fingerprints within 2 bits of each other."""
    keys = materialize(candidate_keys(prints), "ring-keys")
    sizes = keys.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keys.join(sizes, ["start", "key"]), "shared-keys")
    pairable = shared.filter(F.col("n") <= dense)
    left = pairable.select("start", "key", F.col("fp").alias("a"))
    right = pairable.select("start", "key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    pairs = (left.join(right, ["start", "key"]).filter(F.col("a") < F.col("b"))
             .filter(within_budgets(F.col("a"), F.col("b"), F.col("start")) & close)
             .select("a", "b"))
    crowded = shared.filter(F.col("n") > dense).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[
        F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(BITS)])
    named = crowded.select("fp", F.explode(F.transform(
        flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    stars = (named.groupBy("mid").agg(F.collect_list("fp").alias("fps"))  # at most 65
             .filter(F.size("fps") > 1)
             .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
             .filter("a < b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) for every node of ``edges`` (a, b)."""
    edges = materialize(edges, "edges")
    total = None
    while True:
        # Large star: every node's larger neighbours move to its smallest neighbour.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        # Small star: every node's smaller neighbours (and itself) move to the smallest of them.
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
                 .unionAll(down.select(F.col("m").alias("x"), F.col("b").alias("y")))
                 .filter("x <> y").distinct())
        edges = materialize(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "stars")
        # Equal sums of two hashes of the edges: the same edges, but for a chance of 2^-128.
        state = edges.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(38,0)"))
                                               for k in (1, 2)]).first()
        if state == total:
            break
        total = state
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return pairs.unionByName(pairs.select(F.col("label").alias("node"), "label").distinct())


def _components(docs: DataFrame, keep: list[str], dense: int = DENSE) -> DataFrame:
    """doc_id, fp, the component's number and smallest doc_id, and the columns ``keep``, of every row."""
    rows = materialize(fingerprints(docs, keep), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(distinct.select("fp"), dense))
    linked = (distinct.join(labels, distinct["fp"] == labels["node"])
              .select("fp", "label", "first_id"))
    roots = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    members = linked.join(roots, "label").select("fp", F.col("label").alias("component"), "component_id")
    alone = distinct.join(labels, distinct["fp"] == labels["node"], "left_anti").select(
        "fp", F.col("fp").alias("component"), F.col("first_id").alias("component_id"))
    return rows.join(members.unionByName(alone), "fp")


def near_dedup(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint zero, which links like any other.
    component_id is the smallest doc_id of the component; a null doc_id counts only where there is
    no other. Repeated rows give a row each; an empty table gives an empty result; texts have no
    length limit; columns besides doc_id and text are ignored.
    """
    return _components(docs, [], dense).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, with all columns: one of its smallest doc_id.

    Of rows that share this doc_id the one with the smallest fingerprint stays, of equal ones the
    one with the smallest hash of its text, of repeated rows one. A component whose ids are all
    null keeps one row too. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(_components(docs.select("doc_id", "text", F.xxhash64(text).alias("_hash")), ["_hash"]),
                       "components")
    first = rows.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", "_hash")).alias("m"))
    stay = first.select(F.col("m.doc_id").alias("_id"), F.col("m._hash").alias("_kept")).distinct()
    keyed = docs.withColumn("_hash", F.xxhash64(text))
    once = Window.partitionBy("doc_id", "_hash").orderBy("doc_id")
    return (keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed["_hash"] == stay["_kept"]),
                       "left_semi")
            .withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select(*docs.columns))
