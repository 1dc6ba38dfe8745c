"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word of a text enters with a word input (how much more often toxic than clean documents hold
it, as a lower confidence bound, for both directions) and a character input (the same evidence of
its character sequences, maximum and mean, so that unseen forms of a word count too). A gated
recurrent unit reads every window of ``WINDOW`` words forwards and backwards; attention pools its
states; windows overlap and cover the whole text. A document's score is its highest window's
logit after a calibration to the share of toxic documents.

The network is trained in numpy, on a bounded sample of labelled documents: at most ``FIT_ROWS``
of each label, of at most ``FIT_CHARS`` characters, outside the held-out fold. Scoring reads all
rows and whole texts, in Arrow batches; input projections are computed once per distinct word of
a block of texts, so a step costs one small matrix product.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FIT_ROWS = 1500
FIT_CHARS = 20_000
FOLDS = 5
WINDOW, STRIDE = 32, 24
HIDDEN, INPUTS = 8, 6
WORD_BITS, GRAM_BITS = 17, 18
GRAMS = (3, 4, 5, 6)
EPOCHS, BATCH, SEED = 14, 256, 11
BLOCK_WORDS = 150_000
EDGES = ".,;:!?\"'()[]{}<>*#$%&-_|"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed lower bound of the log odds ratio of being held by toxic and clean documents."""
    a, b = toxic + 0.5, clean + 0.5
    odds = np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1))
    doubt = 1.64 * np.sqrt(1 / a + 1 / b)
    return (np.sign(odds) * np.maximum(np.abs(odds) - doubt, 0)).astype(np.float32)


class Vocabulary:
    """The distinct words of a block of texts, with hashes of words and character sequences."""

    def __init__(self):
        self.ids: dict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[""]  # padding

    def add(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word slots, sequence slots, the word each sequence belongs to, and word lengths."""
        words = [w.strip(EDGES) for w in self.ids]
        slots = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words),
                            np.int64, len(words)) & ((1 << WORD_BITS) - 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        # Code points, so that a sequence spans as many letters in every script.
        marked = "".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(marked, np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths + 2)
        grams, owners = [], []
        for n in GRAMS:
            if len(chars) < n:
                continue
            k = len(chars) - n + 1
            h = np.full(k, n, np.int64)
            for j in range(n):
                h = (h * 1_000_003 + chars[j:j + k]) & 0xFFFFFFFF
            inside = owner[:k] == owner[n - 1:]
            grams.append(((h ^ (h >> 15)) * 0x9E3779B1 >> 7)[inside] & ((1 << GRAM_BITS) - 1))
            owners.append(owner[:k][inside])
        return slots, np.concatenate(grams), np.concatenate(owners), lengths


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    wx: np.ndarray  # 2, INPUTS + 1, 3 * HIDDEN
    wh: np.ndarray  # 2, HIDDEN, 3 * HIDDEN
    att: np.ndarray  # 2, HIDDEN
    out: np.ndarray  # 2, HIDDEN
    bias: np.ndarray  # 1
    scale: float = 1.0
    shift: float = 0.0

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        """One row per distinct word; the padding word is all zero."""
        slots, grams, owners, lengths = vocabulary.hashes()
        n = len(slots)
        own = self.words[slots]
        held = self.grams[grams]
        most, total = np.zeros(n, np.float32), np.zeros(n, np.float32)
        np.maximum.at(most, owners, held)
        total = np.bincount(owners, held, n) / np.maximum(np.bincount(owners, minlength=n), 1)
        x = np.column_stack([np.maximum(own, 0), np.minimum(own, 0), most, total,
                             np.log1p(lengths) / 3, np.ones(n)]).astype(np.float32)
        x[0] = 0
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text as rows, the last one padded; one row at least."""
    n = max(1, -(-max(0, len(ids) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    padded[:len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def forward(model: Model, x: np.ndarray, windows: np.ndarray, keep: bool = False):
    """The logit of each window; with ``keep`` also what the backward pass needs."""
    n, h = len(windows), HIDDEN
    projected = [x @ model.wx[d, :INPUTS] + model.wx[d, INPUTS] for d in (0, 1)]
    states = np.zeros((2, WINDOW, n, h), np.float32)
    trace = []
    for d in (0, 1):
        state = np.zeros((n, h), np.float32)
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            p = projected[d][windows[:, t]]
            g = state @ model.wh[d]
            zr = _sigmoid(p[:, :2 * h] + g[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = 2 * _sigmoid(2 * (p[:, 2 * h:] + r * g[:, 2 * h:])) - 1
            if keep:
                trace.append((d, t, state, z, r, new, g[:, 2 * h:]))
            state = new + z * (state - new)
            states[d, t] = state
    scores = states[0] @ model.att[0] + states[1] @ model.att[1]
    weights = np.exp(np.clip(scores, -30, 30)) * (windows.T != 0)
    weights[0] += (windows[:, 0] == 0) * 1e-6  # a text without words
    weights /= weights.sum(0)
    values = states[0] @ model.out[0] + states[1] @ model.out[1]
    logits = (weights * values).sum(0) + model.bias[0]
    return (logits, states, weights, values, trace) if keep else logits


def gradients(model: Model, x: np.ndarray, windows: np.ndarray, target: np.ndarray,
              weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss and its gradients by back-propagation through time."""
    logits, states, weights, values, trace = forward(model, x, windows, keep=True)
    p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
    loss = -float(np.mean(weight * np.log(np.where(target > 0, p, 1 - p) + 1e-9)))
    d_logit = weight * (p - target) / len(target)
    pooled = logits - model.bias[0]
    d_value = weights * d_logit
    d_score = weights * (values - pooled) * d_logit
    grad = {k: np.zeros_like(getattr(model, k)) for k in ("wx", "wh", "att", "out", "bias")}
    grad["bias"][0] = d_logit.sum()
    d_states = np.empty_like(states)
    for d in (0, 1):
        grad["out"][d] = np.einsum("tn,tnh->h", d_value, states[d])
        grad["att"][d] = np.einsum("tn,tnh->h", d_score, states[d])
        d_states[d] = d_value[:, :, None] * model.out[d] + d_score[:, :, None] * model.att[d]
    flow, last = None, None
    for d, t, state, z, r, new, g in reversed(trace):
        flow = d_states[d, t] if d != last else flow + d_states[d, t]
        last = d
        d_new = flow * (1 - z) * (1 - new * new)
        d_z = flow * (state - new) * z * (1 - z)
        d_r = d_new * g * r * (1 - r)
        d_p = np.concatenate([d_z, d_r, d_new], axis=1)
        d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
        grad["wh"][d] += state.T @ d_g
        grad["wx"][d, :INPUTS] += x[windows[:, t]].T @ d_p
        grad["wx"][d, INPUTS] += d_p.sum(0)
        flow = flow * z + d_g @ model.wh[d].T
    return loss, grad


def _tables(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence per word slot and per character-sequence slot, from documents that hold them."""
    counts = [np.zeros((2, 1 << bits)) for bits in (WORD_BITS, GRAM_BITS)]
    for text, label in zip(texts, toxic):
        vocabulary = Vocabulary()
        vocabulary.add(text)
        slots, grams, *_ = vocabulary.hashes()
        counts[0][int(label), np.unique(slots[1:])] += 1
        counts[1][int(label), np.unique(grams)] += 1
    n = int(toxic.sum()), int(len(toxic) - toxic.sum())
    return tuple(_evidence(c[1], c[0], *n) for c in counts)


def _best_windows(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Index of each document's window with the highest logit."""
    order = np.lexsort((logits, owner))
    return order[np.searchsorted(owner[order], np.arange(n), side="right") - 1]


def train(texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """Fit the network; ``prior`` is the share of toxic documents among the labelled ones.

    Only a document's label is known, not which window earns it, so every epoch learns from each
    document's currently highest window, and from a random one of each clean document.
    """
    rng = np.random.default_rng(SEED)
    toxic = np.asarray(toxic, np.float32)
    shape = {"wx": (2, INPUTS + 1, 3 * HIDDEN), "wh": (2, HIDDEN, 3 * HIDDEN),
             "att": (2, HIDDEN), "out": (2, HIDDEN), "bias": (1,)}
    init = {k: (0.3 * rng.standard_normal(s)).astype(np.float32) for k, s in shape.items()}
    if not 0 < toxic.sum() < len(toxic):
        rate = min(max(prior, 1e-3), 1 - 1e-3)
        zero = {k: np.zeros(s, np.float32) for k, s in shape.items()}
        return Model(np.zeros(1 << WORD_BITS, np.float32), np.zeros(1 << GRAM_BITS, np.float32),
                     **zero, shift=float(np.log(rate / (1 - rate))))
    model = Model(*_tables(texts, toxic), **init)
    vocabulary = Vocabulary()
    rows = [windows_of(vocabulary.add(t)) for t in texts]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    windows = np.concatenate(rows)
    x = model.inputs(vocabulary)
    moment = {k: [np.zeros(s, np.float32), np.zeros(s, np.float32)] for k, s in shape.items()}
    step, clean = 0, np.flatnonzero(toxic[owner] == 0)
    for epoch in range(EPOCHS):
        if epoch < 2:  # before the network knows anything, take the strongest inputs
            logits = (x[:, 0] + x[:, 2])[windows].max(axis=1)
        else:
            logits = _logits(model, x, windows)
        chosen = np.concatenate([_best_windows(logits, owner, len(rows)),
                                 rng.choice(clean, len(rows) // 2)])
        rng.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            part = chosen[at:at + BATCH]
            target = toxic[owner[part]]
            _, grad = gradients(model, x, windows[part], target, np.ones(len(part), np.float32))
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value = getattr(model, k)
                value -= (0.02 * (m / (1 - 0.9**step))
                          / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                value *= 1 - 1e-4
    top = np.maximum.reduceat(_logits(model, x, windows),
                              np.searchsorted(owner, np.arange(len(rows))))
    _calibrate(model, top, toxic, prior)
    return model


def _calibrate(model: Model, top: np.ndarray, toxic: np.ndarray, prior: float) -> None:
    """Scale and shift of a document's highest logit, weighted to the share of toxic documents."""
    share = toxic.mean()
    weight = np.where(toxic > 0, prior / share, (1 - prior) / (1 - share))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        g = weight * (p - toxic)
        h = weight * p * (1 - p) + 1e-6
        lhs = np.array([[np.sum(h * top * top) + 1, np.sum(h * top)],
                        [np.sum(h * top), np.sum(h) + 1e-3]])
        move = np.linalg.solve(lhs, [np.sum(g * top) + (a - 1), np.sum(g)])
        a, b = a - move[0], b - move[1]
    model.scale, model.shift = float(max(a, 0.05)), float(b)


def _logits(model: Model, x: np.ndarray, windows: np.ndarray, size: int = 2048) -> np.ndarray:
    return np.concatenate([forward(model, x, windows[i:i + size])
                           for i in range(0, len(windows), size)])


def scores(model: Model, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """Scores of blocks of texts, each the highest over all windows; a text is never cut."""
    def flush(vocabulary, held):
        rows = [windows_of(ids) for ids in held]
        starts = np.cumsum([0, *[len(r) for r in rows[:-1]]])
        logits = _logits(model, model.inputs(vocabulary), np.concatenate(rows))
        top = model.scale * np.maximum.reduceat(logits, starts) + model.shift
        return 1 / (1 + np.exp(-np.clip(top, -30, 30).astype(np.float64)))

    vocabulary, held, n = Vocabulary(), [], 0
    for text in texts:
        held.append(vocabulary.add(text))
        n += len(held[-1])
        if n >= BLOCK_WORDS:
            yield flush(vocabulary, held)
            vocabulary, held, n = Vocabulary(), [], 0
    if held:
        yield flush(vocabulary, held)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Train on at most ``rows`` labelled documents of each label outside fold 0.

    Rows are chosen by a hash of their id among the labels alone, so their number is known before
    any text is read.
    """
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .filter(fold(F.col("doc_id")) != 0)
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    by_hash = F.xxhash64("doc_id", F.lit(SEED))
    parts = [known.filter(F.col("toxic") == y).orderBy(by_hash, "doc_id").limit(rows)
             for y in (0, 1)]
    chosen = [tuple(r) for part in parts for r in part.collect()]
    sample = docs.sparkSession.createDataFrame(
        chosen, known.schema).withColumnRenamed("toxic", "_toxic")
    read = (docs.select("doc_id", "text").filter(F.length("text") <= FIT_CHARS)
            .join(F.broadcast(sample), "doc_id")  # at most 2 * rows ids
            .select("doc_id", "_toxic", "text").collect())
    read = sorted(set(map(tuple, read)))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return train([t for _, _, t in read], np.array([y for _, y, _ in read]), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its text alone.

    Null, empty and blank texts get the score of a window without words; texts have no length
    limit; repeated rows and null ids give a row each; an empty table gives an empty result; other
    columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            found = list(scores(held.value, texts))
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; see ``score_documents``.

    Labels that are null or belong to no document are not used; of several labels of a document
    toxic wins; without labels of both kinds every text scores the share of toxic labels.
    """
    scored = score_documents(docs, fit(docs, labels, rows))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            found = list(scores(held.value, (t.as_py() for t in column)))
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < 0.5))

    return docs.mapInArrow(run, schema)
