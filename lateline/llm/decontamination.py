"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``FEATURES`` features, weighted by the squared inverse document frequency over
all documents. A randomised SVD (range finder with power iterations, as sums over Spark tasks) of
the passages searched for gives a latent basis of ``RANK`` directions. A basis of document
passages would spend its directions on languages and topics: copied items then lie no closer than
chance. Every document is cut into overlapping passages of about twice an item's length, so that
one of them holds a copied item as a whole; passages and items meet by cosine in the latent space.
A candidate is then checked on its words: the longest common subsequence with the item, and with
the item's answer (its last sentence), so that paraphrases that keep the answer count at a lower
share.

An item copied into very many documents must not make its own words cheap: where a document repeats
``RUN`` words of an item in a row, those words are left out of the frequencies. The same runs are a
second way into the check besides the cosine, so a passage with a run of an item is always judged,
however frequent its words are. Items shorter than a run are found by cosine alone.

Nothing is sampled: the frequencies cover all documents, and the search all passages of all
documents against all items. A latent space holds about ``ITEMS`` items, four per direction, and one
pass over the documents searches ``SPACES`` of them.

Words never become Python objects on the way: a block of texts is one array of code points, words are
runs in it, and their numbers come from prefix sums. Only the words of candidates are cut out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lateline.session import materialize

FEATURES, RANK, EXTRA, ROUNDS = 1 << 16, 64, 16, 2
FIT_WORDS = 64
STEP = 8
COSINE = 0.6
SAME, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Items of a latent space, and spaces searched in one pass over the documents.
ITEMS, SPACES = 4 * RANK, 16
#: Characters of the blocks that texts are taken in, and multiply-adds of one product of matrices
#: (so few that the library does not start threads for it).
BLOCK, PRODUCT = 1 << 20, 1 << 18
#: Words of a run. The table of all items' runs has 16 to 32 bits per run, 2^20 to 2^30 in all.
RUN, RUN_BITS = 8, (20, 30)
#: The table travels in pieces of so many bytes.
PIECE = 1 << 13
SEED = 5

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")

#: Any odd numbers do.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@cache
def word_characters() -> np.ndarray:
    """Whether a code point belongs to a word, as ``WORD`` has it."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, bool)
    for run in WORD.finditer(every):
        table[ord(every[run.start()]):ord(every[run.end() - 1]) + 1] = True
    table[0xD800:0xE000] = False
    return table


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit number of every word of a lower-case text, a block of it at a time.

    A word's number is a polynomial of its code points modulo 2^64, as a difference of prefix sums.
    """
    table, parts, at = word_characters(), [], 0
    while at < len(text):
        # Blocks end before a character that belongs to no word.
        end = min(at + BLOCK, len(text))
        while end < len(text) and table[ord(text[end])]:
            end += 1
        points = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = table[points]
        edge = np.diff(inside)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = max(BLOCK, 1 << (len(points) - 1).bit_length())
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[:len(points)], out=sums[1:])
        number = _mixed((sums[stop] - sums[start]) * _powers(INVERSE, size)[start])
        parts.append((start + at, stop + at, number))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def feature(numbers: np.ndarray) -> np.ndarray:
    return (numbers & np.uint64(FEATURES - 1)).astype(np.int64)


def run_hashes(numbers: np.ndarray) -> np.ndarray:
    """A hash of every run of RUN words."""
    n = max(0, len(numbers) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for k in range(RUN):
        out = (out ^ out >> np.uint64(29)) * np.uint64(BASE) + numbers[k:k + n]
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Texts:
    """Some texts as one: lower-case and end to end, with the words' places, numbers and texts."""

    joined: str
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    #: First word of each text, and the number of words last.
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        lower = [(t or "").lower() for t in texts]
        joined = "\n".join(lower)
        start, end, number = hashed_words(joined)
        begins = np.cumsum([0, *(len(t) + 1 for t in lower)])
        return cls(joined, start, end, number, np.searchsorted(start, begins))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def words(self, a: int, b: int) -> list[str]:
        return [self.joined[i:j] for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run that lies in one text."""
        hashes, owner = run_hashes(self.number), self.owner()
        at = np.flatnonzero(owner[:len(hashes)] == owner[RUN - 1:]) if len(hashes) else np.empty(0, np.int64)
        return at, hashes[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows in blocks of about ``BLOCK`` characters, with their texts."""
    for batch in batches:
        column, texts, first, size = batch.column(batch.schema.get_field_index("text")), [], 0, 0
        for k, value in enumerate(column):
            texts.append(value.as_py())
            size += len(texts[-1] or "")
            if size >= BLOCK or k + 1 == len(column):
                yield batch.slice(first, len(texts)), Texts.of(texts)
                texts, first, size = [], k + 1, 0


def _run_bit(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each hash in a run table of 2^bits bits."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return at >> 3, (1 << (at & 7)).astype(np.uint8)


def run_table(items: DataFrame) -> np.ndarray:
    """The runs of all items as bits of one table, put together on the executors.

    It has 16 bits or more for each of up to 2^26 runs; pieces without a run do not travel.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(block.runs()[0]) for _, block in _blocks(batches))
        yield pa.RecordBatch.from_pydict({"n": [n]})

    total = items.select("text").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(max(RUN_BITS[0], (16 * total).bit_length()), RUN_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for _, block in _blocks(batches):
            at, bit = _run_bit(block.runs()[1], bits)
            for piece in np.unique(at // PIECE).tolist():
                own = at // PIECE == piece
                held = pieces.setdefault(piece, np.zeros(PIECE, np.uint8))
                np.bitwise_or.at(held, at[own] % PIECE, bit[own])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(pieces), pa.int64()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())],
            ["piece", "bits"])

    def merge(rows):
        out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        rows = rows.iloc[:1].copy()
        rows["bits"] = [out.tobytes()]
        return rows

    schema = "piece long, bits binary"
    table = np.zeros(1 << bits - 3, np.uint8)
    merged = items.select("text").mapInArrow(mark, schema).groupBy("piece").applyInPandas(merge, schema)
    for batch in merged.toArrow().to_batches():
        for piece, bits_ in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = np.frombuffer(bits_.as_buffer(), np.uint8)
            room = table[piece * PIECE:(piece + 1) * PIECE]
            room[:] = held[:len(room)]
    return table


def document_frequencies(docs: DataFrame, runs: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents per feature, without runs of ``runs``, and the number of documents.

    At most FEATURES + 1 rows come back.
    """
    held_runs = docs.sparkSession.sparkContext.broadcast(runs)  # at most 2^30 bits
    bits = len(runs).bit_length() + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for rows, block in _blocks(batches):
            at, hashes = block.runs()
            byte, bit = _run_bit(hashes, bits)
            copied = at[held_runs.value[byte] & bit != 0]
            edge = np.zeros(len(block.number) + 1, np.int64)
            np.add.at(edge, copied, 1)
            np.add.at(edge, copied + RUN, -1)
            own = np.cumsum(edge)[:-1] == 0
            seen = np.unique(block.owner()[own] * FEATURES + feature(block.number[own]))
            total += np.bincount(seen % FEATURES, minlength=FEATURES + 1)
            total[FEATURES] += rows.num_rows
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["f", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    found = docs.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    held_runs.destroy()  # its copies on disk
    out[found["f"].to_numpy()] = found["n"].to_numpy()
    return out[:FEATURES], int(out[FEATURES])


def used_features(texts: list[str | None]) -> np.ndarray:
    """The features of some texts, ascending; a basis of their passages is zero elsewhere."""
    return np.unique(feature(Texts.of(texts).number))


def _project(passages: DataFrame, weight: np.ndarray, used: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the unit TF-IDF rows A of ``passages``, summed over the tasks' parts.

    ``basis`` and the result have a row per feature of ``used``, which holds all of the passages'.
    """
    held = passages.sparkSession.sparkContext.broadcast((weight[used], basis))  # fixed size
    width = basis.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis = held.value
        total = np.zeros(basis.shape)
        for _, block in _blocks(batches):
            places = np.searchsorted(used, feature(block.number))
            for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
                for start in range(a, b, FIT_WORDS):
                    f, n = np.unique(places[start:min(start + FIT_WORDS, b)], return_counts=True)
                    row = n * weight[f]
                    norm = np.linalg.norm(row)
                    if norm > 0:
                        row = row / norm
                        total[f] += row[:, None] * (row @ basis[f])
        rows = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(rows), 2048):
            f = rows[at:at + 2048]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f), pa.FixedSizeListArray.from_arrays(pa.array(total[f].ravel()), width)
                 .cast(pa.list_(pa.float64()))], ["f", "v"])

    sums = [F.sum(F.col("v")[k]).alias(f"s{k}") for k in range(width)]
    found = passages.select("text").mapInArrow(part, "f long, v array<double>").groupBy("f").agg(*sums).toArrow()
    held.destroy()  # its copies on disk
    out = np.zeros(basis.shape)
    rows = found["f"].to_numpy()
    for k in range(width):
        out[rows, k] = found[f"s{k}"].to_numpy()
    return out


def latent_basis(passages: DataFrame, weight: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages, a row per feature of ``used``."""
    if not len(used):
        return np.zeros((0, 1))
    width = min(RANK + EXTRA, len(used))
    q = np.random.default_rng(SEED).standard_normal((len(used), width))
    for _ in range(ROUNDS):
        q = np.linalg.qr(_project(passages, weight, used, q))[0]
    small = q.T @ _project(passages, weight, used, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:RANK]]


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]
    counts: Counter


@dataclass
class Index:
    """Per passage length (in steps) the items and their unit vectors in one latent space.

    ``weighted`` has the weighted basis vectors of the features in use and a last row of zeros;
    ``place`` is the row of each feature. ``runs`` are the items' run hashes, sorted; ``owners``
    name steps, item and word of each.
    """

    place: np.ndarray
    weighted: np.ndarray
    classes: dict[int, tuple[list[Item], np.ndarray]]
    runs: np.ndarray
    owners: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("...i,...i->...", vectors, vectors))[..., None]
    return vectors / np.where(norm > 0, norm, 1)


def build_index(rows: list, weight: np.ndarray, basis: np.ndarray, used: np.ndarray | None = None) -> Index:
    """The index of items (item_id, text); ``basis`` has a row per feature of ``used``, or of all."""
    used = np.arange(FEATURES) if used is None else used
    place = np.full(FEATURES + 1, len(used), np.int32)
    place[used] = np.arange(len(used))
    weighted = np.zeros((len(used) + 1, basis.shape[1]), np.float32)
    weighted[:-1] = weight[used][:, None] * basis
    grouped: dict[int, list] = {}
    for item_id, text in rows:
        words = words_of(text)
        if words:
            answer = words_of(SENTENCE_END.split(text.strip())[-1])
            grouped.setdefault(-(-len(words) // STEP), []).append(
                (Item(item_id, words, answer, Counter(words)), Texts.of([text])))
    hashes, owners, classes = [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.int64)], {}
    for steps, items in grouped.items():
        for i, (_, block) in enumerate(items):
            at, own = block.runs()
            hashes.append(own)
            owners.append(np.column_stack([np.full(len(at), steps), np.full(len(at), i), at]))
        vectors = np.stack([weighted[place[feature(block.number)]].sum(0) for _, block in items])
        classes[steps] = ([item for item, _ in items], _unit(vectors))
    runs = np.concatenate(hashes)
    order = np.argsort(runs, kind="stable")
    return Index(place, weighted, classes, runs[order], np.concatenate(owners)[order])


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def judge(item: Item, passage: list[str]) -> float | None:
    """The share of the item's words the passage keeps in order, if that makes it a leak."""
    n = len(item.words)
    if sum(map(item.counts.__getitem__, item.counts.keys() & set(passage))) < PARAPHRASE * n:
        return None
    share = lcs(item.words, passage) / n
    if share >= SAME or (share >= PARAPHRASE and len(item.answer) < n
                         and lcs(item.answer, passage) >= ANSWER * len(item.answer)):
        return share
    return None


def _run_passages(index: Index, at: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First word, steps, item and the item's word of every run that an item holds too."""
    if not len(index.runs):
        return
    first, last = (np.searchsorted(index.runs, hashes, side) for side in ("left", "right"))
    for k in np.flatnonzero(last > first).tolist():
        for steps, i, word in index.owners[first[k]:last[k]].tolist():
            yield int(at[k]), steps, i, word


def search(indexes: list[Index], block: Texts) -> list[list[tuple]]:
    """For each text of the block (item_id, share, cosine) of the items that it leaks."""
    out: list[list[tuple]] = [[] for _ in range(len(block.first) - 1)]
    places, runs = feature(block.number), block.runs()
    counts, owner = block.counts, block.owner()
    # Every text is padded to whole steps with an empty feature of weight zero.
    steps_of = -(-counts // STEP)
    first = np.cumsum(steps_of) - steps_of
    ids = np.full(int(steps_of.sum()) * STEP, FEATURES, np.int64)
    ids[(first * STEP - block.first[:-1])[owner] + np.arange(len(owner))] = places
    for index in indexes:
        found = _search_one(index, block, ids, steps_of, first, owner, runs)
        for d, hits in found.items():
            out[d] += hits.values()
    return out


def _search_one(index: Index, block: Texts, ids: np.ndarray, counts: np.ndarray, first: np.ndarray,
                owner: np.ndarray, runs: tuple[np.ndarray, np.ndarray]) -> dict[int, dict]:
    found: dict[int, dict] = {}
    weighted, rows = index.weighted, index.place[ids]
    n_words = block.counts

    def keep(d: int, steps: int, i: int, start: int, end: int, cosine) -> None:
        """Judge the passage of words start to end (within text d); of one item the best stays."""
        items, vectors = index.classes[steps]
        begin = int(block.first[d])
        share = judge(items[i], block.words(begin + start, begin + min(end, int(n_words[d]))))
        held = found.get(d, {}).get((steps, i), (None, -1.0))
        if share is not None and share > held[1]:
            if cosine is None:
                at = int(first[d]) * STEP
                passage = rows[at + start:at + min(end, int(n_words[d]))]
                cosine = _unit(weighted[passage].sum(0, np.float64)) @ vectors[i]
            found.setdefault(d, {})[steps, i] = (items[i].item_id, share, float(cosine))

    tried = set()
    for at, steps, i, word in _run_passages(index, *runs):
        # The passage around the run, to whole steps.
        d = int(owner[at])
        start = max(0, (at - int(block.first[d]) - word) // STEP * STEP - steps * STEP // 2)
        if (d, steps, i, start) not in tried:
            tried.add((d, steps, i, start))
            keep(d, steps, i, start, start + 2 * steps * STEP, None)
    if not len(ids):
        return found
    sums = np.empty((len(ids) // STEP, weighted.shape[1]), np.float32)
    for at in range(0, len(sums), 8192):
        part = weighted[rows[at * STEP:(at + 8192) * STEP]]
        part.reshape(-1, STEP, part.shape[1]).sum(axis=1, out=sums[at:at + 8192])
    total = np.zeros((len(sums) + 1, sums.shape[1]))
    np.cumsum(sums, axis=0, out=total[1:])
    for steps, (items, vectors) in index.classes.items():
        # Passages of 2 * steps at every steps-th step, up to one that reaches the end.
        per = np.where(counts > 0, np.maximum(1, -(-counts // steps) - 1), 0)
        doc = np.repeat(np.arange(len(counts)), per)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * steps
        end = np.minimum(start + 2 * steps, counts[doc])
        rows_at_once = max(1, PRODUCT // vectors.size)
        for at in range(0, len(doc), rows_at_once):
            cut = slice(at, at + rows_at_once)
            base = first[doc[cut]]
            passages = (total[base + end[cut]] - total[base + start[cut]]).astype(np.float32)
            cosine = passages @ vectors.T
            norm = np.sqrt(np.einsum("ij,ij->i", passages, passages))[:, None]
            for p, i in zip(*np.nonzero((cosine >= COSINE * norm) & (norm > 0))):
                keep(int(doc[at + p]), steps, int(i), int(start[at + p]) * STEP, int(end[at + p]) * STEP,
                     cosine[p, i] / norm[p, 0])
    return found


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Index]]:
    """The indexes of one pass over the documents after another: up to ``SPACES`` of about ``ITEMS``
    items each, whatever the benchmark's size."""
    items = materialize(benchmark.filter(F.col("text").isNotNull())
                        .select("item_id", "text").distinct(), "items")
    df, n = document_frequencies(docs, run_table(items))
    weight = (np.log((n + 1) / (df + 1)) + 0.1) ** 2
    spaces = max(1, math.ceil(items.count() / ITEMS))
    held = []
    for k in range(spaces):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(spaces)) == k)
        rows = [tuple(r) for r in block.orderBy("item_id", "text").collect()]
        used = used_features([text for _, text in rows])
        held.append(build_index(rows, weight, latent_basis(block, weight, used), used))
        if len(held) == SPACES or k + 1 == spaces:
            yield held
            held = []


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share and cosine for every document and item that it leaks.

    Null and empty texts and items leak nothing; texts have no length limit; repeated rows and
    null ids give rows each, while items that repeat id and text count once; an empty table on
    either side gives an empty result; ids may have any atomic type; other columns are ignored.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {doc_type}, item_id {item_type.simpleString()}, share double, cosine double"
    arrow = to_arrow_type(item_type)
    out = None
    for group in indexes(docs, benchmark):
        held = docs.sparkSession.sparkContext.broadcast(group)  # at most about SPACES * ITEMS items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for rows, block in _blocks(batches):
                found = search(held.value, block)
                owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
                flat = [hit for x in found for hit in x]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(owner, pa.int64())),
                     pa.array([h[0] for h in flat], arrow), pa.array([h[1] for h in flat], pa.float64()),
                     pa.array([round(h[2], 6) for h in flat], pa.float64())],
                    ["doc_id", "item_id", "share", "cosine"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all columns.

    Rows with a null or empty text stay; each of repeated rows is judged alike; an empty table on
    either side drops nothing.
    """
    spark, schema = docs.sparkSession, docs.schema
    for group in indexes(docs, benchmark):
        held = spark.sparkContext.broadcast(group)  # at most about SPACES * ITEMS items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for rows, block in _blocks(batches):
                clean = [not x for x in search(held.value, block)]
                yield rows.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
