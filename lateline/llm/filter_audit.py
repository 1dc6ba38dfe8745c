"""Filter interaction audit: what every filter removes in every order of the filters.

One table-driven pass over the UTF-8 bytes of a text feeds all filters. ``TABLE`` maps (state, byte)
to output bits; the states are "between words" and "in a word", and as the next state depends on the
byte alone, numpy runs the transducer over whole blocks of documents at once. Its outputs count
code points, capitals and symbols and mark where words start and end. The spans of the words go into
an open-addressing hash table; a slot holds a span, and a span counts as seen only after its bytes
were compared with those of the slot, so equal hashes never merge different words.

The audit itself is Spark: documents are counted per distinct text, and the failures of a text are
five bits, so a part shrinks to at most 32 patterns before the 120 orders are laid out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
BLOCK = 1 << 20

START, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16


def transducer() -> np.ndarray:
    """Output bits by state (0 between words, 1 in a word) and byte; a word byte leads to state 1."""
    table = np.zeros((2, 256), np.uint8)
    byte = np.arange(256)
    blank = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    table[0, ~blank] |= START
    table[1, blank] |= END
    table[:, (byte & 0xC0) != 0x80] |= POINT
    table[:, ord("A"):ord("Z") + 1] |= CAPITAL
    table[:, list(SYMBOLS)] |= SYMBOL
    return table


TABLE = transducer()
IN_WORD = (TABLE[0] & START).astype(bool)

#: Odd multipliers of the span hash; any odd numbers do.
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


POWER, UNPOWER = _powers(BASE, BLOCK), _powers(INVERSE, BLOCK)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span: a polynomial of its bytes modulo 2^64, taken from prefix sums.

    Spans are grouped into runs of at most ``BLOCK`` bytes; a longer span is hashed by itself.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        upto = int(np.searchsorted(end, first + BLOCK, "right"))
        if upto <= at:
            out[at] = int.from_bytes(hashlib.blake2b(data[first:int(end[at])], digest_size=8).digest(),
                                     "little")
            at += 1
            continue
        last = int(end[upto - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * POWER[:last - first],
                  out=sums[1:])
        a, b = start[at:upto] - first, end[at:upto] - first
        h = (sums[b] - sums[a]) * UNPOWER[a]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[at:upto] = h ^ (h >> np.uint64(29))
        at = upto
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b`` hold the same ``length`` bytes (at least one)."""
    out = np.empty(len(a), bool)
    at, total = 0, np.cumsum(length)
    while at < len(a):
        done = int(total[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + BLOCK, "right")))
        if upto == at + 1:
            n = int(length[at])
            out[at] = np.array_equal(data[int(a[at]):int(a[at]) + n], data[int(b[at]):int(b[at]) + n])
        else:
            n = length[at:upto]
            first = np.cumsum(n) - n
            inner = np.arange(int(n.sum())) - np.repeat(first, n)
            equal = data[np.repeat(a[at:upto], n) + inner] == data[np.repeat(b[at:upto], n) + inner]
            out[at:upto] = np.logical_and.reduceat(equal, first)
        at = upto
    return out


class SpanTable:
    """Open-addressing hash table of byte spans; insertion tells which spans are new.

    A span belongs to an owner (a document): equal bytes of two owners are two entries. All spans
    of a call are inserted side by side: each round they claim their slots, losers compare their
    bytes with the winner's and either are repeats or probe the next slot.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.used = 0
        self._rows(np.full(1 << 10, -1, np.int64))
        self.spans = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)]

    def _rows(self, slots: np.ndarray) -> None:
        self.slots, self.mask = slots, np.uint64(len(slots) - 1)

    def insert(self, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """True for each span that is the first of its owner and bytes."""
        key = span_hashes(self.data, start, end) ^ (owner.astype(np.uint64) * np.uint64(BASE))
        base, n = self.used, len(start)
        new = [owner, start, end - start, key]
        self.spans = [np.concatenate([old[:base], x]) for old, x in zip(self.spans, new)]
        need = 2 * (base + n)
        if need > len(self.slots):
            self._rows(np.full(1 << int(need - 1).bit_length(), -1, np.int64))
            self._place(np.arange(base), fresh=True)
        first = self._place(np.arange(base, base + n), fresh=False)
        # Only distinct spans are kept, so the table grows with the distinct words.
        kept = np.flatnonzero(first)
        moved = np.full(base + n, -1, np.int64)
        moved[:base] = np.arange(base)
        moved[base + kept] = base + np.arange(len(kept))
        taken = self.slots >= 0
        self.slots[taken] = moved[self.slots[taken]]
        self.spans = [np.concatenate([x[:base], x[base + kept]]) for x in self.spans]
        self.used = base + len(kept)
        return first

    def _place(self, ids: np.ndarray, fresh: bool) -> np.ndarray:
        owner, start, length, key = self.spans
        first = np.zeros(len(ids), bool)
        open_, slot = np.arange(len(ids)), key[ids] & self.mask
        while len(open_):
            at, mine = slot.astype(np.int64), ids[open_]
            empty = self.slots[at] < 0
            # The smallest id claims an empty slot, so the first span of equal ones stays.
            claim, claimer = at[empty][::-1], mine[empty][::-1]
            self.slots[claim] = claimer
            held = self.slots[at]
            won = held == mine
            first[open_[won]] = True
            repeat = np.zeros(len(open_), bool)
            if not fresh:
                alike = np.flatnonzero(~won & (key[held] == key[mine]) & (owner[held] == owner[mine])
                                       & (length[held] == length[mine]))
                repeat[alike] = same_bytes(self.data, start[held[alike]], start[mine[alike]],
                                           length[mine[alike]])
            left = ~won & ~repeat
            open_, slot = open_[left], (slot[left] + np.uint64(1)) & self.mask
        return first


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end document, first byte, end byte) of blocks of about ``BLOCK`` bytes.

    Small documents are taken together; a larger one comes in several blocks cut between words, or
    after a whole word where a word is longer than a block.
    """
    doc, n = 0, len(offsets) - 1
    while doc < n:
        upto = int(np.searchsorted(offsets, offsets[doc] + BLOCK, "right")) - 1
        if upto > doc:
            yield doc, upto, int(offsets[doc]), int(offsets[upto])
            doc = upto
            continue
        at, stop = int(offsets[doc]), int(offsets[doc + 1])
        while at < stop:
            end = step = min(at + BLOCK, stop)
            if end < stop:
                blanks = np.flatnonzero(~IN_WORD[data[at:end]])
                end = at + int(blanks[-1]) + 1 if len(blanks) else 0
                while not end:
                    blanks = np.flatnonzero(~IN_WORD[data[step:min(step + BLOCK, stop)]])
                    end = step + int(blanks[0]) + 1 if len(blanks) else 0
                    step += BLOCK
                    if not end and step >= stop:
                        end = stop
            yield doc, doc + 1, at, end
            at = end
        doc += 1


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols (columns) of documents laid end to end."""
    n = len(offsets) - 1
    counts = np.zeros((n, 5), np.int64)
    table, held = None, -1
    for doc, upto, first, last in _cuts(data, offsets):
        if first == last:
            continue
        part = data[first:last]
        edges = offsets[doc:upto + 1].clip(first, last) - first
        word = IN_WORD[part]
        state = np.empty(len(part), np.uint8)
        state[0], state[1:] = 0, word[:-1]
        state[edges[:-1][edges[:-1] < len(part)]] = 0
        out = TABLE[state, part]
        begin = np.flatnonzero(out & START)
        # A word ends at a blank, or where its document ends.
        ends = np.zeros(len(part) + 1, bool)
        ends[:-1] = (out & END) != 0
        closing = edges[1:][edges[1:] > 0]
        ends[closing] |= word[closing - 1]
        end = np.flatnonzero(ends)
        owner = np.searchsorted(edges, begin, "right") - 1
        counts[doc:upto, 0] += np.bincount(owner, minlength=upto - doc)
        for k, bit in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
            seen = np.zeros(len(part) + 1, np.int64)
            np.cumsum((out & bit) != 0, out=seen[1:])
            counts[doc:upto, k] += seen[edges[1:]] - seen[edges[:-1]]
        if table is None or upto - doc > 1 or held != doc:
            table, held = SpanTable(data), doc
        new = table.insert(owner + doc, begin + first, end + first)
        counts[doc:upto, 1] += np.bincount(owner[new], minlength=upto - doc)
    return counts


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        counts = measure(data, offsets)
        view = memoryview(data)
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()),
             *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(5))],
            ["doc_id", "part", "digest", "words", "distinct_words", "capitals", "points", "symbols"])


def measures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, SHA-256 of the text, words, distinct_words, capitals, points, symbols of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(
        "doc_id", F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).mapInArrow(
        _measured, f"doc_id {id_type}, part string, digest binary, words long, distinct_words long, "
                   "capitals long, points long, symbols long")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures() -> Column:
    """The failures of filters A to D as bits; E (a copy) follows from the groups of equal texts."""
    fails = {"A": F.col("words") < 100,
             "B": 100 * F.col("distinct_words") < 80 * F.col("words"),
             "C": 100 * F.col("capitals") > 10 * F.col("points"),
             "D": F.col("symbols") > 0}
    return sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails (bits of A to E), n, n_good, n_toxic: documents by what they fail.

    Rows are counted per (doc_id, text) first, so neither a frequent text nor a frequent doc_id
    reaches a join or a window as many rows.
    """
    rows = (measures(docs, part).withColumn("fails", failures())
            .groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n")))
    marks = labels.groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Copies of a text differ in part and labels only; the rows of the smallest doc_id are no copies.
    known = F.col("doc_id").isNotNull()
    texts = marked.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"),
        F.coalesce(F.min_by("n", F.when(known, F.col("doc_id"))), F.lit(0)).alias("n_least"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_unknown"))
    first = F.min("least").over(Window.partitionBy("digest"))
    own = F.col("n_unknown") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("own", own).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("fails").alias("fails"), F.col("own").alias("n")),
            F.struct((F.col("fails") + _bit("E")).alias("fails"), (F.col("n") - F.col("own")).alias("n")),
        )).alias("p"))
    return split.groupBy("part", "p.fails").agg(
        F.sum("p.n").alias("n"), F.sum(F.col("good") * F.col("p.n")).alias("n_good"),
        F.sum(F.col("toxic") * F.col("p.n")).alias("n_toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    part, filter_order, step, filter, then kept (after the step), removed (at it), redundant (fail
    the step's filter, removed earlier), unique_fails (fail that filter alone), good_lost and
    toxic_lost (removed at it and labelled so), shapley (the filter's removed over all orders).

    A null text is an empty one (it fails A only), a null part is the empty string. A null doc_id
    has no labels, is no copy and makes no copies. Rows that repeat doc_id and text are documents
    of their own and no copies of each other. Of several labels of a doc_id any 1 counts. Texts of
    any length take memory for one block and their distinct words. Empty tables give no rows;
    further columns are ignored.
    """
    steps = [{"filter_order": o, "step": k + 1, "filter": o[k], "own": _bit(o[k]),
              "before": sum(map(_bit, o[:k]))}
             for o in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, "
                                                 "filter: string, own: int, before: int>>")
    grouped = patterns(docs, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("fails", "n", "n_good", "n_toxic")).alias("ps"))

    def total(test, value: str = "n") -> Column:
        return F.aggregate(F.filter("ps", test), F.lit(0).cast("long"), lambda s, p: s + p[value])

    own, before = F.col("own"), F.col("before")
    fails = lambda p: p["fails"].bitwiseAND(own) != 0
    gone = lambda p: p["fails"].bitwiseAND(before) != 0
    removed = lambda p: fails(p) & ~gone(p)
    # A filter meets a document that fails f filters first in 1/f of the orders.
    orders = len(steps) // len(FILTERS)
    share = lambda p: p["n"] * (F.lit(orders) / F.bit_count(p["fails"])).cast("long")
    return grouped.select("part", "ps", F.explode(plan).alias("s")).select("part", "ps", "s.*").select(
        "part", "filter_order", "step", "filter",
        total(lambda p: ~fails(p) & ~gone(p)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda p: fails(p) & gone(p)).alias("redundant"),
        total(lambda p: p["fails"] == own).alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
        F.aggregate(F.filter("ps", fails), F.lit(0).cast("long"), lambda s, p: s + share(p)).alias("shapley"))
