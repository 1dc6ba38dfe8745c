"""Targets of the mix against water-filling round by round."""

import pytest
from pyspark.sql import functions as F

from lateline.llm import mixing

CASES = [[100, 10, 1], [22029, 14275, 20517, 18565, 3, 900], [5], [0, 0], [1, 1, 1, 1000], [7, 0, 50]]


def by_rounds(sizes, weights, epochs):
    caps = [epochs * n for n in sizes]
    stopped = set()
    while True:
        left = sum(sizes) - sum(caps[k] for k in stopped)
        open_ = [k for k in range(len(sizes)) if k not in stopped]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > caps[k]}
        if not over:
            return [caps[k] if k in stopped else share[k] for k in range(len(sizes))]
        stopped |= over


@pytest.mark.parametrize("sizes", CASES)
def test_targets(spark, sizes):
    rows = [(f"s{k}", n) for k, n in enumerate(sizes)]
    sources = spark.createDataFrame(rows, "source string, source_size long")
    got = mixing.water_fill(mixing.ranked_weights(sources)).orderBy("source").collect()
    want = by_rounds(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 3)
    assert [r.target for r in got] == pytest.approx(want)


def test_taken_words_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix_sources(docs).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"),
        F.max("size").alias("largest"), F.max("copies").alias("copies"),
        F.min("copies").alias("fewest")).collect()
    assert rows and all(abs(r.taken - r.target) <= r.largest for r in rows)
    assert all(0 <= r.fewest and r.copies <= 3 for r in rows)
    assert mixing.mixture(docs).count() > 0
