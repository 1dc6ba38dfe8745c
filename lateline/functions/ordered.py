"""Order-dependent values over long or skewed groups.

A plain window puts a whole group in one task. Here a group is cut into time slices; each
slice is one task's work, and only one row per (group, slice) is carried on to stitch the
slices together. The carried rows are stitched the same way with the next, wider slice.
The rows themselves are shuffled once; their summary combines map-side. Both read the input,
so it should be a stored table where it is costly to compute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR
# One row per hour and group is carried on: at most 8,784 a year.
SLICES = (HOUR,)


def _preceding(df, keys, order, seconds, value, how, name, widths):
    if not widths:
        before = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, _over(value, how, before))

    width, *wider = widths
    depth = len(widths)
    slice_col, carry, nth = f"_slice{depth}", f"_carry{depth}", f"_nth{depth}"
    parts = [*keys, slice_col]
    rows = df.withColumn(slice_col, F.floor(seconds / width).cast("bigint"))
    summary = rows.groupBy(*parts).agg(_total(value, how, order).alias(f"_total{depth}"))
    carried = _preceding(summary, keys, [slice_col], F.col(slice_col) * width,
                         f"_total{depth}", how, carry, wider).select(*parts, carry)

    inside = Window.partitionBy(*parts).orderBy(*order)
    local = F.col(f"_local{depth}")
    out = (rows.select("*", _over(value, how, inside).alias(f"_local{depth}"),
                       F.row_number().over(inside).alias(nth))
           .join(carried, parts, "left"))
    if how == "last":
        joined = F.when(F.col(nth) == 1, F.col(carry)).otherwise(local)
    elif how == "max":
        joined = F.greatest(F.col(carry), local)
    else:
        joined = F.coalesce(F.col(carry), F.lit(0)) + F.coalesce(local, F.lit(0))
    return out.select(*df.columns, joined.alias(name))


def _over(value, how, ordered):
    if how == "last":
        return F.lag(value).over(ordered)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (F.max(value) if how == "max" else F.sum(value)).over(before)


def _total(value, how, order):
    if how == "last" and value != order[0]:
        return F.max_by(value, order[0] if len(order) == 1 else F.struct(*order))
    # The last of the leading order column is its maximum, which needs no sorting aggregate.
    return F.sum(value) if how == "sum" else F.max(value)


def preceding(df: DataFrame, keys: list[str], order: list[str], value: str, how: str,
              name: str, widths=SLICES) -> DataFrame:
    """Add ``name``: the last / max / sum of ``value`` over all earlier rows of the group.

    ``order`` starts with a timestamp column and must be a total order; ``keys`` hold no
    nulls. ``how`` is "last", "max" or "sum"; without earlier rows last and max give null.
    """
    if how not in ("last", "max", "sum"):
        raise ValueError(how)
    seconds = F.unix_seconds(F.col(order[0]))
    return _preceding(df, list(keys), list(order), seconds, value, how, name, tuple(widths))


def as_of(df: DataFrame, at: str, changes: DataFrame, since: str, value: str, name: str,
          widths=SLICES) -> DataFrame:
    """Add ``name``: the ``value`` in force at the row's time ``at``.

    A change holds from its time ``since`` on until the next one (of changes at one time the
    largest value); rows before the first change get the first change's value, and without changes
    all get null. The changes travel with the rows through the same time slices, so neither side
    is collected and no window spans all rows; ``df`` should hold no more than keys.
    """
    mark = F.struct(F.col(since).alias("since"), F.col(value).alias("value"))
    first = changes.agg(F.min(mark).alias("m")).first().m
    marks = changes.select(F.col(since).alias("_at"), F.lit(0).alias("_side"), mark.alias("_change"))
    rows = df.withColumns({"_at": F.col(at), "_side": F.lit(1)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    held = preceding(both, [], ["_at", "_side"], "_change", "max", "_held", widths)
    kind = changes.schema[value].dataType
    return held.where("_side = 1").select(*df.columns, F.coalesce(
        F.col("_held.value"), F.lit(first and first["value"]).cast(kind)).alias(name))


def overlapping_slices(df: DataFrame, time: str, back_seconds: int,
                       width: int = 7 * DAY) -> DataFrame:
    """Copy the last ``back_seconds`` of every slice into the next one.

    Adds ``slice`` and ``own``. A window over (key, slice) that looks back no further than
    ``back_seconds`` sees all it needs; keep the rows with ``own`` afterwards. Widths far
    above the look-back keep the copies few.
    """
    second = F.unix_seconds(F.col(time))
    first = F.floor(second / width).cast("bigint")
    last = F.floor((second + back_seconds) / width).cast("bigint")
    return (df.withColumn("_first", first)
            .withColumn("slice", F.explode(F.sequence(F.col("_first"), last)))
            .withColumn("own", F.col("slice") == F.col("_first"))
            .drop("_first"))
