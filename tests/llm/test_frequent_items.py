"""Decontamination where one benchmark item stands in very many documents."""

import random

from lateline.llm import decontamination

SF_DIR = "/root/testdata/sf0.001"


def test_copies_of_an_item_in_a_third_of_the_documents_are_found(spark):
    """An item whose words other items hold too, at random places of every third document."""
    rng = random.Random(1)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    item_id, text = items[3]
    cut = text.split()
    edited = " ".join(w for k, w in enumerate(cut) if k % 5 != 4)
    others = [w for i, t in items if i != item_id for w in t.split()]
    rows, verbatim, shorter = [], set(), set()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    for k in range(600):
        words = (docs[k % len(docs)].text or "").split()[:300]
        at = rng.randrange(len(words) + 1)
        if k % 3 == 0:
            near = rng.sample(others, min(8, len(others)))
            words[at:at] = [*near[:4], *cut, *near[4:]]
            verbatim.add(k)
        elif k % 100 == 1:
            words[at:at] = edited.split()
            shorter.add(k)
        rows.append((k, " ".join(words)))
    found = decontamination.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    hits = {r.doc_id: r for r in found if r.item_id == item_id}
    assert verbatim <= hits.keys() and all(hits[k].share == 1 for k in verbatim)
    assert shorter <= hits.keys()
