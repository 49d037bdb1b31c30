"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Shuffle files of a finished write are of no further use; without this they stay until the driver
# happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that go to Python together. Both sides hold several copies of a batch for every task, and
# ten thousand documents are tens of MB.
_BATCH, _BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def build_session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; `master` only for local runs."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every expression costs more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, which every executor can reach.

    Where that setting is missing the folder lies in the warehouse, which is shared as well. It is
    deleted when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    files = path.getFileSystem(hadoop)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand fewer documents to Python at once, if fewer are not set already."""
    rows = int(spark.conf.get(_BATCH, "10000"))
    with _setting(spark, _BATCH, str(min(rows, _BATCH_ROWS) if rows > 0 else _BATCH_ROWS)):
        yield


def stored(df: DataFrame) -> DataFrame:
    """`df` written to a new shared folder and read back, which cuts its lineage.

    What is read survives the loss of any executor. The shuffle files of the write are removed.
    Python gets few documents at once meanwhile.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    with _setting(spark, _CLEANUP, "true"), small_batches(spark):
        df.write.parquet(f"{folder}/rows")
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
