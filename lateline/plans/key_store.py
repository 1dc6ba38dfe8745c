"""Exact distinct counts of fact keys from bitmaps that are stored per day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, LongType, StringType, StructField, StructType

from lateline.functions.clock import local_date
from lateline.operators.audits import key_bitmaps, key_dictionary, keys_used
from lateline.session import materialize
from lateline.sources.tables import read_or_empty

_DICTIONARY = StructType([StructField("column", StringType()), StructField("key", StringType()),
                          StructField("number", LongType())])
_BITMAPS = StructType([StructField("column", StringType()), StructField("bucket", LongType()),
                       StructField("keys", BinaryType()), StructField("day", DateType())])
COLUMNS = ("line_id", "operator_id", "stop_id", "service_date")


@dataclass(frozen=True)
class KeyStore:
    """A dictionary of all keys ever used and, per local day, the bitmaps of the day's keys."""
    spark: SparkSession
    root: str
    columns: tuple[str, ...] = COLUMNS

    def add(self, fact: DataFrame) -> None:
        """Take in the facts of some whole days; a day taken in before is replaced.

        Only these facts are read. The dictionary grows first: a number without a bitmap is unused.
        """
        columns = list(self.columns)
        path = f"{self.root}/dictionary"
        facts = materialize(fact.select(local_date("ts").alias("day"), *columns).distinct(), "keys")
        key_dictionary(read_or_empty(self.spark, path, _DICTIONARY), facts, columns) \
            .write.mode("append").parquet(path)
        known = read_or_empty(self.spark, path, _DICTIONARY)
        (key_bitmaps(facts, known, columns, ["day"])
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(f"{self.root}/bitmaps"))

    def bitmaps(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/bitmaps", _BITMAPS)

    def used(self, first=None, last=None) -> DataFrame:
        """The number of distinct keys per column, in all days or in first..last."""
        found = self.bitmaps()
        if first is not None:
            found = found.where(F.col("day") >= F.lit(first))
        if last is not None:
            found = found.where(F.col("day") <= F.lit(last))
        return keys_used(found, list(self.columns))
