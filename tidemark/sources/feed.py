"""The change feed: what each run added, removed and changed against the completed run before it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import CHANGES
from tidemark.sources.tables import (
    PARTITION,
    VERSION,
    RunLog,
    chosen_versions,
    file_names,
    file_path,
    lookup,
)


class ChangeFeed:
    """Parquet table of `schema.CHANGES`, partitioned by run and version of the run's changes.

    Loads write the changes of a run once, and anew when the run before it is loaded later or again.
    The event that publishes a run names the version of its changes too, so the feed always agrees
    with the rows and the log. It grows with what changes, not with the catalogue.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location

    def stage(self, changes: DataFrame, versions: Mapping[int, int]) -> DataFrame:
        """Write the changes of some runs, each as its version, and return them.

        Changes of one run are spread over tasks by size, as one run can hold almost all of them.
        A version that a failed load has left is replaced.
        """
        rows = changes.select(*CHANGES.fieldNames()).withColumn(
            VERSION, lookup(versions, F.col(PARTITION))
        )
        (
            rows.hint("rebalance", PARTITION)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PARTITION, VERSION)
            .parquet(self.location)
        )
        return self._versions(versions)

    def vacuum(self, keep: Mapping[int, int]) -> None:
        """Remove all versions of the changes of the given runs but the ones to keep."""
        for run, version in keep.items():
            folder = f"{self.location}/{PARTITION}={run}"
            for name in file_names(self.spark, folder):
                if name != f"{VERSION}={version}":
                    files, path = file_path(self.spark, f"{folder}/{name}")
                    files.delete(path, True)

    def _versions(self, versions: Mapping[int, int]) -> DataFrame:
        stored = self.spark.read.schema(f"{_DDL}, {VERSION} int").parquet(self.location)
        return stored.where(chosen_versions(versions)).select(*CHANGES.fieldNames())

    def frame(self, log: RunLog) -> DataFrame:
        """The changes of all completed runs as of this call; only their partitions are read."""
        versions = log.feed_versions()
        if not versions:
            return self.spark.createDataFrame([], CHANGES)
        return self._versions(versions)


_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHANGES)
