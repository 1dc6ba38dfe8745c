"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap (its size times the largest number of epochs). Sources that
their share would push above the cap stop there; what is left is shared by weight among the
others until none is above. Sorted by cap / weight, the stopped sources are a prefix, so running
sums over the table of sources give the result in one pass: from the first source that its level
does not fill, levels only fall, so the shared level is the highest of those.

A document is taken as often as whole epochs fit, and once more if it lies before the point where
the fraction of its source is used up, in the order of a seeded hash. That point is found from
sizes summed per hash bucket; only the bucket it falls into is ordered by document. A source that
holds most rows is thus never gathered in one task, and the taken size misses the target by at
most half a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lateline.session import materialize

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (one row per source) with weights repeating by code point, null last."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", values[nth % len(weights)])


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with target: shares of the summed size, capped."""
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (sources
            .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumns({
                "left": F.sum("source_size").over(whole)
                - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                "open": F.sum("weight").over(whole)
                - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
            .withColumn("level", F.col("left") / F.col("open"))
            .withColumn("shared", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                                               F.col("level"))).over(whole))
            .withColumn("target", F.when(F.col("ratio") <= F.col("shared"), F.col("cap"))
                        .otherwise(F.least("cap", F.coalesce("shared", F.col("ratio"))
                                           * F.col("weight"))))
            .select("source", "source_size", "weight", "target"))


def _cut_points(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole epochs, and how far into which hash bucket the fraction reaches."""
    ordered = Window.partitionBy("source").orderBy("bucket")
    filled = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("filled"))
              .withColumn("before", F.sum("filled").over(ordered) - F.col("filled")))
    epochs = F.floor(F.try_divide("target", "source_size"))
    plan = (targets.withColumn("whole", F.coalesce(epochs, F.lit(0)).cast("long"))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumnRenamed("source", "s"))
    reached = F.struct("bucket", "before")
    cut = (filled.join(plan, F.col("source").eqNullSafe(F.col("s")))
           .groupBy("s", "source_size", "target", "whole", "rest")
           .agg(F.max(F.when(F.col("before") <= F.col("rest"), reached)).alias("cut")))
    return cut.select("s", "source_size", "target", "whole", "rest",
                      F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("cut_before"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                max_epochs: int = MAX_EPOCHS, seed: int = SEED,
                targets: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often the mix takes the row).

    ``targets`` (source, weight) replaces the repeating weights. A null text has size 0, a null
    source is a source of its own, a null doc_id is ordered as empty text; rows that repeat a
    doc_id are rows of their own; documents of size 0 are taken with their source's epochs; an
    empty table gives an empty result; other columns are ignored.
    """
    sized = materialize(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), order_key(seed).alias("key"))
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if targets is None:
        weighted = ranked_weights(sources, weights)
    else:
        named = targets.select(F.col("source").alias("s"), F.col("weight").cast("double"))
        weighted = (sources.join(named, F.col("source").eqNullSafe(F.col("s")))
                    .select("source", "source_size", "weight"))
    cuts = materialize(_cut_points(sized, water_fill(weighted, max_epochs)), "mix-cuts")
    joined = sized.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    last = joined.filter(F.col("bucket") == F.col("cut_bucket"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size")
                              .rowsBetween(Window.unboundedPreceding, 0))
    # Middle of the document on the line of its source's words; the fraction ends at "rest".
    middle = F.col("cut_before") + upto - F.col("size") / 2
    inside = last.withColumn("extra", (middle < F.col("rest")).cast("long"))
    outside = (joined.filter(F.coalesce(F.col("bucket") != F.col("cut_bucket"), F.lit(True)))
               .withColumn("extra", F.coalesce((F.col("bucket") < F.col("cut_bucket")),
                                               F.lit(False)).cast("long")))
    return (inside.unionByName(outside)
            .withColumn("extra", F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("whole") + F.col("extra")).alias("copies")))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with the repetition's number.

    The number is in a last column ``repetition``, from 1; a column of that name in ``docs`` is
    replaced. doc_id must tell rows apart here; rows that repeat a doc_id (or have none) are taken
    as often as the most taken of them. Null texts and sources as in `mix_sources`; an empty table
    gives an empty result.
    """
    taken = (mix_sources(docs, **options).filter("copies > 0")
             .groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")))
    # Both sides under names of their own, whatever the documents' columns are called.
    rows = docs.select(F.col("doc_id").alias("key"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns if c != "repetition"]).alias("row"))
    times = taken.select(F.col("doc_id").alias("taken_key"), "copies")
    return (rows.join(times, F.col("key").eqNullSafe(F.col("taken_key")))
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("repetition"))
            .select("row.*", "repetition"))
