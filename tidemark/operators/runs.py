"""Run selection. Every selection stays a plan over the run log, so nothing runs while a query is
built and partition pruning sees the chosen runs when the query does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completed(runs: DataFrame) -> DataFrame:
    """Completed runs as (scrape_run_id, started_at)."""
    return runs.where(F.col("status") == "completed").select(
        F.col("id").alias("scrape_run_id"), "started_at"
    )


def last_runs(runs: DataFrame, k: int) -> DataFrame:
    """The newest k completed runs with `run_rank`, 1 for the newest (by id, not by time)."""
    newest = completed(runs).orderBy(F.desc("scrape_run_id")).limit(k)
    return newest.withColumn(
        "run_rank", F.row_number().over(Window.orderBy(F.desc("scrape_run_id")))
    )


def momentum_buckets(runs: DataFrame) -> DataFrame:
    """The newest six completed runs: 1-3 are 'recent', 4-6 'prior'."""
    return last_runs(runs, 6).withColumn(
        "bucket", F.when(F.col("run_rank") <= 3, "recent").otherwise("prior")
    )


def latest_pair(runs: DataFrame) -> DataFrame:
    """Ids and starts of the two newest completed runs in one row; empty if fewer than two."""
    return (
        completed(runs)
        .orderBy(F.desc("scrape_run_id"))
        .limit(2)
        .agg(
            F.max("scrape_run_id").alias("current_run_id"),
            F.min("scrape_run_id").alias("previous_run_id"),
            F.max_by("started_at", "scrape_run_id").alias("current_started_at"),
            F.min_by("started_at", "scrape_run_id").alias("previous_started_at"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") == 2)
        .drop("n")
    )


def rows_of(snapshots: DataFrame, run: int | Column) -> DataFrame:
    """Snapshots of one run, given by id or one-value subquery; both prune partitions."""
    return snapshots.where(F.col("scrape_run_id") == run)


def current(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the newest completed run."""
    return rows_of(snapshots, latest_completed(runs).scalar())


def previous(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the second newest completed run; empty if there is none."""
    return rows_of(snapshots, latest_pair(runs).select("previous_run_id").scalar())


def latest_pair_rows(snapshots: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current and previous rows; both empty unless two runs are completed."""
    pair = latest_pair(runs)
    return (
        rows_of(snapshots, pair.select("current_run_id").scalar()),
        rows_of(snapshots, pair.select("previous_run_id").scalar()),
    )


def rows_of_completed(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots of all completed runs.

    Joins with the run log carry no hint: Spark broadcasts the log, and prunes partitions by it,
    while it is below `spark.sql.autoBroadcastJoinThreshold`.
    """
    return snapshots.join(completed(runs).select("scrape_run_id"), "scrape_run_id", "left_semi")


def latest_completed(runs: DataFrame) -> DataFrame:
    """One row: id of the newest completed run, NULL if there is none."""
    return completed(runs).agg(F.max("scrape_run_id").alias("latest_run_id"))


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    """The run log row of one run; no row if unknown."""
    return runs.where(F.col("id") == run_id)


def snapshot_counts(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows per known run, whatever its status; 0 for a run without rows."""
    counts = snapshots.groupBy("scrape_run_id").agg(F.count(F.lit(1)).alias("rows"))
    return (
        runs.select(F.col("id").alias("scrape_run_id"), "status")
        .join(counts, "scrape_run_id", "left")
        .select(
            "scrape_run_id",
            "status",
            F.coalesce(F.col("rows"), F.lit(0)).alias("snapshot_count"),
        )
    )
