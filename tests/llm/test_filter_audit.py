"""The filter audit against plain Python: every order applied document by document."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from lateline.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text),
            len(re.findall("[#$%&*|]", text))]


def measured(texts):
    array = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(texts) + 1)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return filter_audit.measure(data, offsets).tolist()


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = "aAbB é🙂#$\t\n\x0b\x0c\r\x1f\x85　 "
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40, 300])))
            for _ in range(n)]


@pytest.mark.parametrize("block", [3, 17, 1 << 20])
def test_transducer(monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    texts = ["", " ", "a", "a a", "", "aa", "aa aa b", "x" * 50, "x" * 50 + " y", " " * 40, ""]
    texts += random_texts(block, 300)
    assert measured(texts) == [plain_counts(t) for t in texts]


def test_long_text():
    text = "one Two three# " * 300_000 + "z" * 3_000_000 + " " + "".join(f"w{i} " for i in range(200_000))
    assert measured(["a b", text, "c"])[1] == plain_counts(text)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit, "span_hashes",
                        lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = random_texts(5, 60)
    assert measured(texts) == [plain_counts(t) for t in texts]


def plain_audit(docs, labels):
    fails, rows = [], [(i, t or "", p or "") for i, t, p in docs]
    for i, t, _ in rows:
        words, distinct, capitals, points, symbols = plain_counts(t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append({k for k, bad in zip("ABCDE", (
            words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, copy)) if bad})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, _, p in rows}:
            left = [k for k, r in enumerate(rows) if r[2] == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                earlier = [k for k in everyone if k not in left]
                left = [k for k in left if f not in fails[k]]
                out[part, order, step] = [
                    f, len(left), len(gone), sum(f in fails[k] for k in earlier),
                    sum(fails[k] == {f} for k in everyone), sum(rows[k][0] in good for k in gone),
                    sum(rows[k][0] in toxic for k in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {key: (*v, shapley[key[0], v[0]]) for key, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, p, 1, 2) for i, t, p in rows],
        "doc_id long, text string, lang string, words int, part int")


def results(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
        for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (4, long + " #", "en"),
            (5, "A B", "en"), (6, "", None), (7, None, ""), (8, "a " * 150, "de"), (9, "A a# " * 80, "de"),
            (None, long, "en"), (None, "A B", "en"), (10, "É é", "fr"), (0, "A B", "fr"), (5, "A B", "fr")]
    labels = [(2, 1, 0), (2, 0, 1), (3, 1, 1), (5, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (4, 1, 0)]
    got = results(filter_audit.audit(frame(spark, docs), spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(docs, labels)


def test_empty(spark):
    assert filter_audit.audit(frame(spark, []), spark.createDataFrame([], LABELS)).collect() == []
    one = results(filter_audit.audit(frame(spark, [(1, "a", "x")]), spark.createDataFrame([], LABELS)))
    assert one == plain_audit([(1, "a", "x")], [])
