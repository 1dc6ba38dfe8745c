"""Row-order-independent digests of table content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampType

_WORDS = 8


def _encoded(df: DataFrame, name: str) -> Column:
    """Text of a value, "-" for null; strings carry their length, so that none looks like
    another value, a null or two columns."""
    kind = df.schema[name].dataType
    value = F.unix_micros(name) if isinstance(kind, TimestampType) else F.col(name)
    text = value.cast("string")
    if isinstance(kind, StringType):
        text = F.concat(F.length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(text, F.lit("-"))


def content_digest(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """``by`` columns, ``n_rows`` and ``digest`` (SHA-256 hex) of the rows' content.

    Every row's SHA-256 is cut into 32-bit words that are summed exactly, so equal multisets
    of rows give equal sums in any order. Sums combine map-side: the shuffle carries small rows
    per task and group, and no group is ever collected. The first sums run per leading hash
    byte as plain integers (room for 2^31 rows each), the second ones as decimals.
    """
    row_hash = F.sha2(F.concat_ws("|", *[_encoded(df, c) for c in columns]), 256)
    sums = [f"_s{i}" for i in range(_WORDS)]
    words = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")
             for i in range(_WORDS)]
    partial = (df.select(*by, row_hash.alias("_h"))
               .groupBy(*by, F.substring("_h", 1, 2).alias("_byte"))
               .agg(F.count(F.lit(1)).alias("_n"),
                    *[F.sum(w).alias(s) for w, s in zip(words, sums)]))
    total = partial.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.sum(F.col(s).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(s)
          for s in sums])
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *sums)
    return total.select(*by, "n_rows", F.sha2(text, 256).alias("digest"))


# --- a tree of digests ---

_SUMS = [f"s{i}" for i in range(_WORDS)]
_DIGITS = 2


def key_range(key: Column | str, digits: int = _DIGITS) -> Column:
    """The range of a key: the leading hex digits of its MD5, so that all ranges are alike in size."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)


def digest_leaves(df: DataFrame, columns: list[str], by: list[str], key: str,
                  digits: int = _DIGITS) -> DataFrame:
    """``by``, ``range``, ``n_rows`` and the sums of the rows' hash words: the leaves of the tree.

    The sums add up, so leaves of new rows can be added to stored ones, and parents are sums of
    their children. A leaf that holds a third of all rows is combined map-side like any other.
    """
    row_hash = F.sha2(F.concat_ws("|", *[_encoded(df, c) for c in columns]), 256)
    words = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(_WORDS)]
    return (df.select(*by, key_range(key, digits).alias("range"), row_hash.alias("_h"))
            .groupBy(*by, "range", F.substring("_h", 1, 2).alias("_byte"))
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(w).alias(s) for w, s in zip(words, _SUMS)])
            .groupBy(*by, "range").agg(*_added()))


def _added() -> list[Column]:
    return [F.sum("n_rows").alias("n_rows"),
            *[F.sum(F.col(s).cast("decimal(20,0)")).cast("decimal(30,0)").alias(s) for s in _SUMS]]


def digest_parents(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The nodes one level up: sums over everything but ``by``; all of it without ``by``."""
    return nodes.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", *_SUMS)])


def differing(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """``by``, n_left, n_right of the nodes that are not equal; a node one side lacks has 0 rows."""
    a = left.select(*by, F.col("n_rows").alias("n_left"), F.struct("n_rows", *_SUMS).alias("_a"))
    b = right.select(*by, F.col("n_rows").alias("n_right"), F.struct("n_rows", *_SUMS).alias("_b"))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return a.join(b, by, "full").where(~same).select(
        *by, F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
