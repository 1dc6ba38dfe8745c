"""Quantiles by selection against sorted lists."""

import math
import random

import numpy as np
import pytest

from lateline.functions import selection
from lateline.functions.selection import quantiles

SHARES = {"lowest": 0.0, "p01": 0.01, "median": 0.5, "p95": 0.95, "highest": 1.0}
SCHEMA = "a string, b int, x double, w long"


def plain(values, share, how):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    n = len(values)
    if how == "disc":
        return values[max(math.ceil(n * share) - 1, 0)]
    place = (n - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    if low == high or (math.isnan(low) and math.isnan(high)):
        return low
    return (math.ceil(place) - place) * low + (place - math.floor(place)) * high


def expected(rows, how="linear", weighted=False):
    groups = {}
    for a, b, x, w in rows:
        if x is not None:
            groups.setdefault((a, b), []).extend([x] * (w if weighted else 1))
    return {g: [plain(v, s, how) for s in SHARES.values()] for g, v in groups.items()}


def found(df):
    return {(r["a"], r["b"]): [r[s] for s in SHARES] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for g in want:
        assert np.array_equal(np.array(got[g]), np.array(want[g]), equal_nan=True), (g, got[g], want[g])


def odd_rows():
    rng = random.Random(6)
    special = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, 1.0, None]
    rows = [("odd", 1, rng.choice(special), 1) for _ in range(200)]
    rows += [("tied", None, 3.5, 1)] * 70 + [("one", 2, -2.25, 1), ("none", 2, None, 1), (None, None, 7.0, 1)]
    rows += [("wide", 3, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), 1) for _ in range(500)]
    rows += [("near", 4, 1.0 + k * 2.0**-52, 1) for k in rng.sample(range(3000), 800)]
    return rows


@pytest.mark.parametrize("small", [1, 7, 4096])
@pytest.mark.parametrize("how", ["linear", "disc"])
def test_quantiles(spark, monkeypatch, small, how):
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "CUTS", 16 if small == 7 else 4096)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    same(found(quantiles(df, ["a", "b"], "x", SHARES, how=how)), expected(rows, how))


def test_weights(spark):
    rng = random.Random(8)
    rows = [("g", 1, rng.gauss(0, 5), rng.choice([1, 2, 90])) for _ in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for how in ("linear", "disc"):
        same(found(quantiles(df, ["a", "b"], "x", SHARES, weight="w", how=how)), expected(rows, how, True))


def test_no_groups_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, float(k), 1) for k in range(11)], SCHEMA)
    assert tuple(quantiles(df, [], "x", SHARES).first()) == (0.0, 0.1, 5.0, 9.5, 10.0)
    empty = df.where("x > 100")
    assert tuple(quantiles(empty, [], "x", SHARES).first()) == (None,) * 5
    assert quantiles(empty, ["a"], "x", SHARES).collect() == []


def test_one_group_of_a_million_values(spark):
    df = spark.range(1_000_003).selectExpr("pmod(id * 7919, 1000003) / 1000.0D AS x")
    got = quantiles(df, [], "x", {"m": 0.5, "p": 0.999}).first()
    values = np.arange(1_000_003) / 1000.0
    assert got["m"] == values[500_001]
    assert got["p"] == plain(values.tolist(), 0.999, "linear")


def test_no_buffer_of_values_in_the_plan(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 1)], SCHEMA)
    plan = quantiles(df, ["a"], "x", {"m": 0.5})._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median(" not in plan
