"""Substring dedup: repeated-phrase automata over sharded passages.

A window is ``WINDOW`` consecutive words; a word goes if a window over it has the same words as one
that starts earlier (smaller doc_id, or same document and earlier start). Equal windows choose the
same anchor, the run of ``GRAM`` words with the lowest hash inside them. Only anchors are counted
over the corpus; anchors that recur give the passages (the words of all windows on one anchor, at
most 2 * WINDOW - GRAM) worth a closer look. Passages are dealt to shards by anchor. A shard confirms
the windows that recur, compiles them into an Aho-Corasick automaton, and runs all its passages
through it to locate every occurrence. Shards hold about ``SHARD`` passages at any scale.

An anchor of more than ``HOT`` passages never enters a shard: its distinct passages are aggregated
before the shuffle, their windows grouped by text, and joined back, with the same result.
Equal texts are searched once; all but the one of the smallest doc_id lose every window.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, functions as F

from lateline.session import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW, GRAM = 20, 8
SHARD, HOT = 8000, 2000
# A run of windows as one number: first window * SPAN + number of windows.
SPAN = 64
# Passages are written after this many words of texts.
CUT_WORDS = 500_000


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of windows on one anchor."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width = WINDOW - GRAM + 1
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return (grams[at[first]].view(np.int64), first.astype(np.int32),
            np.diff(first, append=n).astype(np.int32))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("th"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        found = [anchors(hashes(WORD.findall(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"),
             *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]],
            ["doc_id", "th", "a", "start", "n"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of texts: their words joined by one blank."""
    for batch in batches:
        spots = batch.column("spots")
        ends = np.cumsum(spots.value_lengths().to_numpy(zero_copy_only=False))
        a, start, n = (spots.flatten().field(c) for c in ("a", "start", "n"))
        begins, lengths = start.to_pylist(), n.to_pylist()
        texts, size, done = [], 0, 0
        for row, (text, end) in enumerate(zip(batch.column("text"), ends.tolist())):
            words = WORD.findall(text.as_py())
            for k in range(done, end):
                texts.append(" ".join(words[begins[k]:begins[k] + lengths[k] + WINDOW - 1]))
            size, done = size + len(words), end
            if size > CUT_WORDS or row == batch.num_rows - 1:
                first = done - len(texts)
                owner = pa.array(np.searchsorted(ends, np.arange(first, done), side="right"))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(owner) for c in ("doc_id", "tie", "rid")),
                     a.slice(first, len(texts)), start.slice(first, len(texts)),
                     pa.array(texts, pa.string())],
                    ["doc_id", "tie", "rid", "a", "start", "passage"])
                texts, size = [], 0


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """The anchors (a, start, n) of every distinct text, under the number ``rid`` of its first row.

    doc_id and tie, the leading bytes of the text's MD5, are the order of texts. What follows moves
    the number and not the key.
    """
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    marks = materialize(keyed.mapInArrow(
        _mark, f"doc_id {id_type}, th binary, a array<long>, start array<int>, n array<int>")
        .filter(F.size("a") > 0).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    first = marks.groupBy("th").agg(F.min(F.struct("doc_id", "rid")).alias("w")).select(F.col("w.rid").alias("rid"))
    once = materialize(first, "first-rows")
    # Bytes above 7f are larger, so the number is shifted to keep their order.
    tie = F.conv(F.hex(F.substring("th", 1, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-2**63))
    return marks.join(once, "rid", "left_semi").withColumn("tie", tie)


def passages(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, tie, rid, a, start, passage) of all passages whose anchor recurs, of distinct texts."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    spots = texts.select("rid", F.explode(F.arrays_zip("a", "start", "n")).alias("s")).select(
        "rid", F.col("s.a").alias("a"), (F.col("s.start") * F.lit(64).cast("long") + F.col("s.n")).alias("at"))
    again = (spots.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"))
    held = (spots.join(again, "a", "left_semi")
            .groupBy("rid").agg(F.collect_list(F.struct(
                "a", F.floor(F.col("at") / 64).cast("int").alias("start"),
                (F.col("at") % 64).cast("int").alias("n"))).alias("spots")))  # one text's own anchors
    held = held.join(texts.select("rid", "doc_id", "tie", "th"), "rid").select(
        "rid", "tie", F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spots")
    found = keyed.join(held, (keyed["th"] == held["_th"]) & keyed["doc_id"].eqNullSafe(held["_id"]))
    cut = found.select("doc_id", "tie", "rid", "text", "spots").mapInArrow(
        _cut, f"doc_id {id_type}, tie long, rid long, a long, start int, passage string")
    return materialize(cut, "passages")


def locate(shard: pa.Table) -> pa.Table:
    """The windows of a shard's passages whose words start earlier elsewhere.

    One row per passage that has any: ``spans`` holds, per run of such windows, the place of the
    first and their number (``span``). Words become numbers, so a window is a sequence of them to
    the automaton.
    """
    import ahocorasick

    ids = shard.column("doc_id").to_pylist()
    keys = [(i is not None, 0 if i is None else i, t) for i, t in zip(ids, shard.column("tie").to_pylist())]
    rank = {key: k << 32 for k, key in enumerate(sorted(set(keys)))}
    # The order of (document, start) as one number.
    order = [rank[key] + start for key, start in zip(keys, shard.column("start").to_pylist())]
    passages = shard.column("passage").to_pylist()
    earliest: dict[str, int] = {}
    repeated: set[str] = set()
    for passage, at in zip(passages, order):
        if passage in earliest:
            repeated.add(passage)
            earliest[passage] = min(earliest[passage], at)
        else:
            earliest[passage] = at
    numbers: dict[str, int] = {}
    parts: dict[str, tuple] = {}
    first: dict[tuple, int] = {}
    seen: set[tuple] = set()
    for passage, at in earliest.items():
        words = parts[passage] = tuple([numbers.setdefault(w, len(numbers)) for w in passage.split(" ")])
        again = passage in repeated
        for k in range(len(words) - WINDOW + 1):
            window = words[k:k + WINDOW]
            spot = first.get(window)
            if spot is None:
                first[window] = at + k
                if again:
                    seen.add(window)
            else:
                seen.add(window)
                if at + k < spot:
                    first[window] = at + k
    rows, spans = [], []
    if seen:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window in seen:
            automaton.add_word(window, first[window])
        automaton.make_automaton()
        found = {passage: [(end - WINDOW + 1, spot) for end, spot in automaton.iter(words)]
                 for passage, words in parts.items()}
        for row, (passage, at) in enumerate(zip(passages, order)):
            gone = [k for k, spot in found[passage] if spot < at + k]
            if gone:
                begin, low = at & 0xFFFFFFFF, gone[0]
                runs = []
                for k, after in zip(gone, [*gone[1:], None]):
                    if after != k + 1:
                        runs.append((begin + low) * SPAN + k - low + 1)
                        low = after
                rows.append(row)
                spans.append(runs)
    return pa.table({"rid": shard.column("rid").take(pa.array(rows, pa.int64())),
                     "spans": pa.array(spans, pa.list_(pa.int64()))})


def _hot_windows(hot: DataFrame) -> DataFrame:
    """``locate`` for passages on very frequent anchors, as grouping and joins."""
    spot = F.struct("doc_id", "tie", "start")
    distinct = hot.groupBy("a", "passage").agg(F.min(spot).alias("w"), F.count(F.lit(1)).alias("c"))
    words = F.split("passage", " ")
    windows = distinct.withColumn("_words", words).select(
        "a", "passage", "w", "c", F.explode(F.sequence(
            F.lit(0), F.size("_words") - WINDOW)).alias("k"), "_words").select(
        "a", F.md5("passage").alias("p"), "k", "c",
        F.array_join(F.slice("_words", F.col("k") + 1, WINDOW), " ").alias("window"),
        F.struct("w.doc_id", "w.tie", (F.col("w.start") + F.col("k")).alias("start")).alias("at"))
    windows = materialize(windows, "hot-windows")
    first = (windows.groupBy("window").agg(F.min("at").alias("first"), F.sum("c").alias("c"))
             .filter("c > 1").drop("c"))
    known = (windows.join(first, "window")
             .groupBy("a", "p").agg(F.collect_list(F.struct("k", "first")).alias("known")))

    def later(x):
        return x["first"] < F.struct("doc_id", "tie", (F.col("start") + x["k"]).alias("start"))

    def span(x):
        return (F.col("start") + x["k"]).cast("long") * SPAN + 1

    # A passage stays one row, with its few windows in an array.
    return (hot.withColumn("p", F.md5("passage")).join(known, ["a", "p"])
            .select("rid", F.transform(F.filter("known", later), span).alias("spans"))
            .filter(F.size("spans") > 0))


def repeated_windows(found: DataFrame, shard_size: int = SHARD, hot: int = HOT) -> DataFrame:
    """(rid, spans) of the passages of ``found`` with windows whose words start earlier."""
    many = (found.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > hot)
            .select("a"))
    many = materialize(many, "hot-anchors")
    shards = max(1, math.ceil(found.count() / shard_size))
    cold = (found.join(many, "a", "left_anti")
            .withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))))
    located = cold.groupBy("shard").applyInArrow(
        lambda table: locate(table), "rid long, spans array<long>")
    return located.unionByName(_hot_windows(found.join(many, "a", "left_semi")))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, digests, texts = [], [], [], []
        for text, spans, copy in zip(batch.column("text"), batch.column("spans"),
                                     batch.column("copy")):
            words = WORD.findall(text.as_py())
            n = len(words)
            kept = words
            if copy.as_py() and n >= WINDOW:
                kept = []
            elif spans.is_valid:
                at, windows = np.divmod(spans.values.to_numpy(), SPAN)
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + windows + WINDOW - 1, -1)
                left = np.cumsum(gone)[:n] == 0
                edges = np.flatnonzero(np.diff(left, prepend=False, append=False)).tolist()
                kept = []
                for low, high in zip(edges[::2], edges[1::2]):
                    kept += words[low:high]
            left = len(kept)
            kept = " ".join(kept)
            counts.append(n)
            removed.append(n - left)
            digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            texts.append(kept)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row.

    A null text has no words; texts of fewer words than a window lose none and have no length
    limit otherwise; a null doc_id is smaller than any other; rows that share a doc_id but differ
    in text are ordered by the MD5 of the text, rows that repeat both count as one document; an empty
    table gives an empty result; other columns are ignored.
    """
    keyed = _keyed(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = distinct_texts(keyed)
    gone = (repeated_windows(passages(keyed, texts))
            .groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")))  # one text's own windows
    gone = texts.select("rid", F.col("doc_id").alias("_id"), F.col("th").alias("_th")).join(gone, "rid").drop("rid")
    first = (keyed.groupBy(F.col("th").alias("_ft")).agg(F.min(F.struct("doc_id")).alias("w"))
             .select("_ft", F.col("w.doc_id").alias("_fid")))
    ids = materialize(keyed.select("doc_id", "th").distinct(), "texts")
    plan = (ids.join(first, ids["th"] == first["_ft"])
            .withColumn("copy", ~F.col("doc_id").eqNullSafe(F.col("_fid")))
            .select("doc_id", "th", "copy"))
    plan = (plan.join(gone, (plan["th"] == gone["_th"])
                      & plan["doc_id"].eqNullSafe(gone["_id"]), "left")
            .filter(F.col("copy") | F.col("spans").isNotNull())
            .select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "copy", "spans"))
    plan = materialize(plan, "removals")
    rows = keyed.join(plan, (keyed["th"] == plan["_th"])
                      & keyed["doc_id"].eqNullSafe(plan["_id"]), "left")
    return rows.select("doc_id", "text", "spans",
                       F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _keep, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")
