"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where the next operator then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_session(app: str = "lateline", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a local session gets a fresh temporary folder (tests); a cluster
    session is refused, because a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir", None)
              or context.getCheckpointDir())
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its URI names, as Spark itself reaches it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


_SCOPES = threading.local()


@contextmanager
def temporary_tables(spark: SparkSession):
    """What ``materialize`` writes inside is deleted at the end, also after an error.

    For work whose results are all written elsewhere by then, such as a batch of a stream or a
    nightly run; a frame over such a table must not leave the block. Blocks nest, and each owns
    what is written in it.
    """
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            delete_folder(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that several readers do not recompute it, and survives the loss of
    executors. Columnar files keep pruning and give later joins real size statistics.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if getattr(_SCOPES, "stack", None):
        _SCOPES.stack[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_values(df: DataFrame, limit: int = 10_000) -> list | None:
    """The values of a one-column frame if there are at most ``limit``, else None.

    Lets a filter use a literal list, which prunes partitions and needs no join, only where the
    list is known to be short.
    """
    rows = df.distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r[0] for r in rows]
