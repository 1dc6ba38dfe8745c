"""Exact quantiles of large groups by repeated selection.

An exact percentile aggregate keeps every distinct value of a group in one buffer. Here a group
is first counted in bins that follow the order of its values (sign and quarter of a binade), which
needs a fixed number of rows per group however many rows it has and combines map-side. Only the
bins that hold a wanted rank are looked at again: a large one is cut into finer bins between
its smallest and largest value, a small one is ordered as it is. Subtraction, division and
rounding keep the order of doubles, so no value ever lands in a bin of the wrong side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lateline.session import materialize

#: Rows of a bin that are ordered in one task, and the cuts of a larger bin.
SMALL, CUTS = 4_096, 4_096
_BINADE, _ENDS = 5_000, 20_000


def _bin(x: Column) -> Column:
    """Number of the value's bin, rising with the value; NaN is the largest."""
    size = F.abs(x)
    infinite = F.lit(float("inf"))
    quarter = F.floor(F.log2(F.when((size > 0) & (size < infinite), size)) * 4)
    bins = (F.when(F.isnan(x), F.lit(_ENDS + 1))
            .when(size == infinite, F.when(x > 0, _ENDS).otherwise(-_ENDS))
            .when(x == 0, F.lit(0)))
    return bins.when(x > 0, _BINADE + quarter).otherwise(-_BINADE - quarter).cast("bigint")


def _ranks(n: Column, share: float, how: str) -> tuple[Column, Column]:
    """Lower and upper rank (from 0) of a quantile among ``n`` values."""
    if how == "disc":
        rank = F.greatest(F.ceil(n * F.lit(float(share))) - 1, F.lit(0))
        return rank, rank
    place = (n - 1) * F.lit(float(share))
    return F.floor(place), F.ceil(place)


def _wanted(keyed: DataFrame, shares: list[float], how: str) -> DataFrame:
    """The bin of every wanted rank of a group: rank, total, the values below it and its extent."""
    per_bin = keyed.groupBy("_g", "_bin").agg(
        F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_rows"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    group = Window.partitionBy("_g")
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_bin.withColumns({
        "_total": F.sum("_n").over(group), "_below": F.coalesce(F.sum("_n").over(upto), F.lit(0))})
    ranks = F.array_distinct(F.flatten(F.array(
        *[F.array(*_ranks(F.col("_total"), s, how)) for s in shares])))
    inside = F.filter(ranks, lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_n")))
    return counted.select("*", F.explode(inside).alias("_rank"))


def _refined(keyed: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the large bins in finer bins, and the finer bin of every rank."""
    at = ["_g", "_from", "_bin"]
    cuts = large.select(*at, "_lo", "_hi").distinct()
    step = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS)
    rows = materialize(keyed.join(cuts, at).select(
        "_g", "_x", "_w", F.col("_lo").alias("_from"), step.cast("bigint").alias("_bin")), "selection")
    part = Window.partitionBy("_g", "_from")
    upto = part.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = (rows.groupBy("_g", "_from", "_bin")
               .agg(F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_rows"),
                    F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))))
    old = large.select("_g", F.col("_lo").alias("_from"), "_rank", "_total",
                       F.col("_below").alias("_outside"))
    below = F.col("_outside") + F.col("_before")
    found = (counted.join(old, ["_g", "_from"])
             .where((F.col("_rank") >= below) & (F.col("_rank") < below + F.col("_n")))
             .withColumn("_below", below))
    return rows, materialize(found.select(
        "_g", "_from", "_bin", "_n", "_rows", "_lo", "_hi", "_total", "_below", "_rank"), "ranks")


def _ordered(keyed: DataFrame, small: DataFrame) -> DataFrame:
    """The values at the wanted ranks of bins of at most ``SMALL`` rows."""
    rows = keyed.join(small.select("_g", "_from", "_bin", "_total", "_below", "_rank"),
                      ["_g", "_from", "_bin"])
    upto = (Window.partitionBy("_g", "_rank").orderBy("_x")
            .rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("_below") + F.coalesce(F.sum("_w").over(upto), F.lit(0))
    return (rows.withColumn("_first", first)
            .where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_w")))
            .select("_g", "_total", "_rank", F.col("_x").alias("_value")))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float],
              weight: str | None = None, how: str = "linear") -> DataFrame:
    """``by`` columns and one double column per entry of ``shares`` (name to share).

    ``how`` is "linear" (between the two nearest ranks) or "disc" (the first value whose rank
    reaches the share). ``weight`` counts a row several times (positive whole numbers). Null values
    do not count; a group without values is left out, but without ``by`` there is always one row.
    NaN is the largest value, and null is a group of its own.

    The values are written once; every pass reads only the bins left over from the pass before.
    """
    if how not in ("linear", "disc"):
        raise ValueError(how)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    x = F.col(value).cast("double")
    keyed = materialize(df.where(F.col(value).isNotNull()).select(
        group.alias("_g"), x.alias("_x"),
        (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("_w"),
        F.lit(0.0).alias("_from"), _bin(x).alias("_bin")), "selection")
    wanted = materialize(_wanted(keyed, list(shares.values()), how)
                         .withColumn("_from", F.lit(0.0)), "ranks")
    found = None
    while True:
        alike = F.col("_lo") == F.col("_hi")
        known = wanted.where(alike).select("_g", "_total", "_rank", F.col("_lo").alias("_value"))
        known = known.unionByName(_ordered(keyed, wanted.where(~alike & (F.col("_rows") <= SMALL))))
        found = known if found is None else found.unionByName(known)
        large = wanted.where(~alike & (F.col("_rows") > SMALL))
        if large.isEmpty():
            break
        keyed, wanted = _refined(keyed, large)

    at = found.groupBy(*(["_g"] if by else [])).agg(
        F.max("_total").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def result(share: float) -> Column:
        low, high = _ranks(F.col("_total"), share, how)
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        if how == "disc":
            return a
        place = (F.col("_total") - 1) * F.lit(float(share))
        return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)

    return at.select(*[F.col("_g")[c].alias(c) for c in by],
                     *[result(share).alias(name) for name, share in shares.items()])
