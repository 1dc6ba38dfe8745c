"""Centroid clustering against plain Python with whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lateline.llm import centroids

DIMS = 64


def plain(rows, k=16, rounds=3, scale=64, dims=DIMS):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    kept_sorted = sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))
    means = [v for _, v in kept_sorted[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [[sum(xs) // len(groups[n]) for xs in zip(*groups[n])] if n in groups else c
                 for n, c in enumerate(means)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = {n: sum(d for _, c, d in found if c == n) for n in range(k)}
    return sorted(((i, n, d, own[n], sum(own.values()), sha(",".join(map(str, means[n])))) for i, n, d in found),
                  key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, cluster int, row string")


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def clouds(seed, n, width=0.02):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.2, (7, DIMS))
    return [(i, (middles[i % 7] + rng.normal(0, width, DIMS)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_in_steps_of_one(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    keys = [k.tobytes() for k in centroids.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.integers(-20, 20, DIMS) + rng.integers(-3, 4, (50, DIMS))
        c = rng.integers(-25, 25, (16, DIMS))
        c[3] = c[9]
        lo, hi = x.min(axis=0), x.max(axis=0)
        distance = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert set(distance.argmin(axis=1)) <= set(centroids.candidates(lo, hi, c).tolist())
        best, least = centroids.assign(x, lo, hi, c)
        assert best.tolist() == distance.argmin(axis=1).tolist()
        assert least.tolist() == distance.min(axis=1).tolist()


def test_boxes_rule_centroids_out(spark):
    rows = clouds(1, 700)
    stored = centroids.blocks(centroids.kept_vectors(frame(spark, rows), DIMS), DIMS, 64, block=20)
    means = np.array([[math.floor(64 * x) for x in v] for _, v in rows[:7]])
    left = [len(centroids.candidates(lo, hi, means)) for _, _, lo, hi in
            centroids._block_rows(iter(stored.toArrow().to_batches()), DIMS)]
    assert np.mean(left) < 3


def test_clusters(spark):
    rows = clouds(3, 400, 0.3) + [(1000 + i, rows_v) for i, (_, rows_v) in enumerate(clouds(4, 9) * 20)]
    bad = [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [0.5] * 63 + [None]),
           (2005, [0.5] * 63 + [float("nan")]), (2006, [float("inf")] + [0.5] * 63)]
    odd = [(None, [0.1] * DIMS), (None, [-0.1] * DIMS), (5, [0.25] * DIMS), (5, [0.25] * DIMS), (7, [-0.0] * DIMS)]
    rows = rows + bad + odd
    random.Random(3).shuffle(rows)
    assert found(centroids.cluster(frame(spark, rows).repartition(5))) == plain(rows)


def test_few_equal_and_no_vectors(spark):
    few = [(1, [0.5] * DIMS), (2, [0.4] * DIMS), (2, [0.4] * DIMS)]
    assert found(centroids.cluster(frame(spark, few))) == plain(few)
    same = [(i, [0.3, -0.3] * 32) for i in range(60)]
    assert found(centroids.cluster(frame(spark, same))) == plain(same)
    assert found(centroids.cluster(frame(spark, []))) == []
    assert found(centroids.cluster(frame(spark, [(1, None), (2, [1.0])]))) == []


def test_large_components(spark):
    rows = [(i, [float(3_000 * ((i * 7 + d) % 900)) for d in range(DIMS)]) for i in range(40)]
    assert found(centroids.cluster(frame(spark, rows))) == plain(rows)
    huge = [(1, [3e38] * DIMS), (2, [-3e38] * DIMS), (3, [0.0] * DIMS)]
    got = centroids.cluster(frame(spark, huge), k=1, rounds=0).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and all(0 <= r["distance"] < 2**63 for r in got)


def test_other_sizes(spark):
    rows = [(i, [float(np.float32(i * 0.01)), float(np.float32((i * i % 17) * 0.1))]) for i in range(90)]
    got = found(centroids.cluster(frame(spark, rows), k=5, rounds=4, dims=2, scale=1000, block=8))
    assert got == plain(rows, k=5, rounds=4, scale=1000, dims=2)
