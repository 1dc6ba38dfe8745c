"""Sliced prefix values equal plain windows, also for one hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lateline.functions.ordered import DAY, HOUR, overlapping_slices, preceding


@pytest.fixture(scope="module")
def rows(spark):
    # A third of all rows in one key, half of its rows within one hour, ties in time.
    return (spark.range(3000)
            .select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
                        F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(40)).cast("string")))
                    .alias("key"),
                    F.timestamp_seconds(F.when(F.col("id") % 2 == 0, F.col("id"))
                                        .otherwise(F.pmod(F.xxhash64("id"), F.lit(9_000_000))))
                    .alias("ts"),
                    "id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).alias("value"))
            .withColumn("value", F.when(F.col("value") % 7 != 0, F.col("value"))))


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("widths", [(HOUR,), (60, HOUR, DAY), ()])
@pytest.mark.parametrize("how", ["last", "max", "sum"])
def test_preceding(rows, keys, widths, how):
    window = Window.partitionBy(*keys).orderBy("ts", "id")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    plain = {"last": F.lag("value").over(window), "max": F.max("value").over(before),
             "sum": F.coalesce(F.sum("value").over(before), F.lit(0))}[how]
    want = {r.id: r.out for r in rows.withColumn("out", plain).collect()}
    got = {r.id: r.out or (0 if how == "sum" else r.out)
           for r in preceding(rows, keys, ["ts", "id"], "value", how, "out", widths).collect()}
    assert got == want


def test_rows_are_shuffled_once_and_summaries_combine_first(rows):
    df = preceding(rows, ["key"], ["ts", "id"], "ts", "last", "out").select("out")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(ts" in plan and "SortAggregate" not in plan


def test_overlapping_slices(spark):
    grid = spark.range(500).select(F.timestamp_seconds(F.col("id") * 900).alias("window"), "id")
    sliced = overlapping_slices(grid, "window", 7 * 900, width=DAY)
    frame = Window.partitionBy("slice").orderBy("window").rowsBetween(-7, 0)
    got = {r.id: r.s for r in sliced.withColumn("s", F.sum("id").over(frame)).where("own").collect()}
    assert got == {i: sum(range(max(0, i - 7), i + 1)) for i in range(500)}
