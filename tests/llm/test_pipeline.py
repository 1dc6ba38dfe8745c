"""The corpus pipeline, stage by stage and as a whole, against plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from lateline.llm import toxicity
from tests.llm.test_contracts import brute_components, brute_print
from tests.llm.test_mixing import by_rounds
from tests.llm.test_new_operators import _flat, brute_leaks
from lateline.llm import decontamination

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _copies int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with planted equal, near-equal, leaked, empty and clean rows beside given ones."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in
            spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 150").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").collect()]
    long = max((t for _, t, _, _ in rows), key=len)
    rows += [(9_000 + k, long + f" tail{k}", "en", "near") for k in range(4)]
    rows += [(9_100 + k, rows[3][1], "en", None) for k in range(3)]
    rows += [(9_200 + k, f"{rows[k][1]} {items[k]} {rows[k + 1][1]}", "en", "leaks") for k in range(5)]
    rows += [(9_300, None, None, None), (9_301, "", "en", "x"), (9_302, " ", "en", "x"), (9_303, "One two", "en", "x")]
    frame = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def plain_stages(spark, folder):
    """The ids that stay after each stage but the last, and the texts by id."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    kept = [sorted(set(text) - toxic)]
    kept.append(sorted({text[i]: i for i in sorted(kept[-1])}.values()))
    prints = [(i, brute_print(text[i])) for i in kept[-1]]
    label = brute_components(prints)
    kept.append(sorted(i for i, fp in prints if label[fp] == i))
    items = {r.item_id: list(*zip(*[v[0] for v in decontamination.build_index(
        [(r.item_id, r.text)], *_flat()).classes.values()]))
        for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    leaks = {i for i, _ in brute_leaks([(i, text[i]) for i in kept[-1]], items)}
    kept.append(sorted(set(kept[-1]) - leaks))
    return kept, text


def test_stages_and_whole(spark, tables):
    kept, text = plain_stages(spark, tables)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept):
        docs = stage(spark, docs, tables)
        assert docs.columns == columns, name
        docs = corpus_pipeline.materialize(docs, name)
        assert ids(docs) == want, name
    assert not set(ids(docs)) & {9_200 + k for k in range(5)}
    assert len(set(ids(docs)) & {9_000 + k for k in range(4)}) <= 1 and 9_303 in ids(docs)

    mixed = corpus_pipeline.run(spark, tables).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i])) for i in source}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in source if source[i] == s) for s in names]
    targets = dict(zip(names, by_rounds(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(source) and max(times.values()) <= 3
    for s in names:
        own = [i for i in source if source[i] == s]
        assert abs(sum(size[i] * times[i] for i in own) - targets[s]) <= max(size[i] for i in own)
        assert max(times[i] for i in own) - min(times[i] for i in own) <= 1
    for i, n in times.items():
        assert sorted(r.repetition for r in mixed if r.doc_id == i) == list(range(1, n + 1))


def test_empty_table(spark, tables):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0
