"""The schedule lookup as a stored table whose files lie by trip.

One partition per version, and in each the rows of a trip in one bucket, in order. A batch of the
feed asks for its trips only: their distinct keys are shuffled to the buckets, the lookup is read
where it lies, without an exchange, an aggregate or a sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateline.schema import SCHEDULE_LOOKUP

#: Buckets of a version. Some 10^6 stops are a few tens of MB; raise it with the network's size.
BUCKETS = 16


@dataclass(frozen=True)
class StoredLookup:
    spark: SparkSession
    table: str
    path: str
    buckets: int = BUCKETS

    def open(self) -> DataFrame:
        """The table; registers the files of ``path`` where this session does not know them yet."""
        if not self.spark.catalog.tableExists(self.table):
            context = self.spark.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(folder)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEDULE_LOOKUP)
            self.spark.sql(f"""CREATE TABLE {self.table} ({columns}) USING parquet
                PARTITIONED BY (version_id) CLUSTERED BY (trip_id) SORTED BY (trip_id, stop_sequence)
                INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")
        self.spark.catalog.recoverPartitions(self.table)
        return self.spark.table(self.table)

    def write(self, lookup: DataFrame, version: int) -> None:
        """Store a version, in place of what the table holds of it."""
        self.open()
        names = [f.name for f in SCHEDULE_LOOKUP if f.name != "version_id"]
        rows = lookup.select(*[F.col(f.name).cast(f.dataType) for f in SCHEDULE_LOOKUP
                               if f.name != "version_id"], F.lit(version).cast("int").alias("version_id"))
        # Dealt as the buckets are, so that each bucket is one file.
        (rows.select(*names, "version_id").repartition(self.buckets, "trip_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.table))
        self.spark.catalog.recoverPartitions(self.table)
        self.spark.catalog.refreshTable(self.table)

    def stops_of(self, keys: DataFrame) -> DataFrame:
        """The stops of the trips in ``keys`` (version_id, trip_id, distinct).

        A join per version, since a version is a partition and not a bucket column; a batch spans
        one or two.
        """
        table = self.open()
        versions = sorted(r.version_id for r in keys.select("version_id").distinct().collect()
                          if r.version_id is not None)
        parts = [table.where(F.col("version_id") == v).join(
            keys.where(F.col("version_id") == v).select("trip_id").hint("merge"), "trip_id", "left_semi")
            for v in versions]
        return reduce(DataFrame.unionByName, parts) if parts else table.limit(0)
