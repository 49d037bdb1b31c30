"""Velocity, acceleration and trend of entities over the newest runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import small, sorted_few, top_k
from tidemark.functions.scalars import calendar_days, ratio, round_half_up, trend
from tidemark.operators.runs import current, last_runs, momentum_buckets
from tidemark.schema import ACCEL_MIN_DOWNLOADS, CHART_RUNS, LEADERBOARD_LIMIT

_SHOWN = ("slug", "display_name", "owner_handle", "stat_stars", "created_at")


def _mean_step(bucket: str) -> Column:
    """Mean of consecutive download steps within a bucket; NULL with fewer than two rows.

    The steps telescope, so first, last and row count are enough and no ordering is needed.
    """
    run = F.when(F.col("bucket") == bucket, F.col("scrape_run_id"))
    steps = F.count(run) - 1
    first = F.min_by("stat_downloads", run)
    last = F.max_by("stat_downloads", run)
    return F.when(steps > 0, (last - first) / steps)


def _velocities() -> tuple[Column, Column]:
    return (
        _mean_step("recent").alias("velocity_recent"),
        _mean_step("prior").alias("velocity_prior"),
    )


def acceleration(recent: Column, prior: Column) -> Column:
    """Change of velocity in percent, one decimal; NULL unless prior is positive."""
    return round_half_up(ratio(recent - prior, prior) * 100.0, 1)


def _recent_history(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    return snapshots.select("scrape_run_id", "skill_id", "stat_downloads").join(
        momentum_buckets(runs), "scrape_run_id"
    )


def velocity(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Velocity of every entity seen in the newest six completed runs, one aggregation for all.

    Columns: skill_id, velocity_recent, velocity_prior, acceleration_pct, trend.
    """
    recent, prior = F.col("velocity_recent"), F.col("velocity_prior")
    return (
        _recent_history(snapshots, runs)
        .groupBy("skill_id")
        .agg(*_velocities())
        .select(
            "*",
            acceleration(recent, prior).alias("acceleration_pct"),
            trend(recent, prior).alias("trend"),
        )
    )


def fastest_growing(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = LEADERBOARD_LIMIT,
    min_downloads: int = ACCEL_MIN_DOWNLOADS,
) -> DataFrame:
    """Current entities by acceleration, ties by downloads."""
    newest = F.when(F.col("run_rank") == 1, F.col("stat_downloads"))
    recent, prior = F.col("velocity_recent"), F.col("velocity_prior")
    candidates = (
        _recent_history(snapshots, runs)
        .groupBy("skill_id")
        .agg(*_velocities(), F.max(newest).alias("stat_downloads"))
        .where(F.col("stat_downloads") >= min_downloads)
        .withColumn("acceleration_pct", acceleration(recent, prior))
        .where(F.col("acceleration_pct").isNotNull())
    )
    top = top_k(
        candidates,
        limit,
        F.desc("acceleration_pct"),
        F.desc("stat_downloads"),
        "skill_id",
    )
    # Text columns are fetched for the listed entities only.
    shown = current(snapshots, runs).select("skill_id", *_SHOWN)
    listed = (
        shown.join(small(top, limit), "skill_id")
        .select(
            "rank",
            "skill_id",
            "slug",
            "display_name",
            "owner_handle",
            "stat_downloads",
            F.coalesce("stat_stars", F.lit(0)).alias("stat_stars"),
            "created_at",
            calendar_days(F.col("created_at"), now).alias("days_old"),
            F.when(recent != 0, round_half_up(recent, 1)).alias("velocity"),
            "acceleration_pct",
            trend(recent, prior).alias("trend"),
        )
    )
    return sorted_few(listed, "rank")


def leaderboard_all_time(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, limit: int = LEADERBOARD_LIMIT
) -> DataFrame:
    """Current entities by downloads, with recent velocity and trend."""
    top = top_k(
        current(snapshots, runs).select("skill_id", "stat_downloads", *_SHOWN),
        limit,
        F.desc("stat_downloads"),
        "skill_id",
    )
    # Every listed entity is in the newest run, so the inner join keeps all of them.
    listed = ["rank", "skill_id", "top_downloads", *_SHOWN]
    history = _recent_history(snapshots, runs).join(
        small(top.withColumnRenamed("stat_downloads", "top_downloads"), limit), "skill_id"
    )
    recent, prior = F.col("velocity_recent"), F.col("velocity_prior")
    board = (
        history.groupBy(*listed)
        .agg(*_velocities())
        .select(
            "rank",
            "skill_id",
            "slug",
            "display_name",
            "owner_handle",
            F.col("top_downloads").alias("stat_downloads"),
            F.coalesce("stat_stars", F.lit(0)).alias("stat_stars"),
            "created_at",
            calendar_days(F.col("created_at"), now).alias("days_old"),
            round_half_up(recent, 1).alias("velocity"),
            trend(recent, prior).alias("trend"),
        )
    )
    return sorted_few(board, "rank")


def chart_rows(snapshots: DataFrame, runs: DataFrame, last: int = CHART_RUNS) -> DataFrame:
    """Downloads per entity and run over the newest completed runs, long form."""
    return snapshots.join(
        last_runs(runs, last).select("scrape_run_id"), "scrape_run_id", "left_semi"
    ).select("skill_id", "scrape_run_id", "stat_downloads")


def in_run_order(column: str) -> Column:
    """Aggregate: `column` as an array in run order, at most one element per run."""
    points = F.array_sort(F.collect_list(F.struct("scrape_run_id", F.col(column).alias("value"))))
    return F.transform(points, lambda p: p.value)


def velocity_chart(snapshots: DataFrame, runs: DataFrame, last: int = CHART_RUNS) -> DataFrame:
    """One row per entity: skill_id, velocity_chart (downloads over the newest runs, in order)."""
    return (
        chart_rows(snapshots, runs, last)
        .groupBy("skill_id")
        .agg(in_run_order("stat_downloads").alias("velocity_chart"))
    )
