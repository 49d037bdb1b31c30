"""Ranked lists over the current run and over the two newest runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import small, sorted_few, top_k
from tidemark.functions.scalars import (
    calendar_days,
    daily_rate,
    instant,
    round_half_up,
    seconds_between,
)
from tidemark.operators.momentum import chart_rows, in_run_order
from tidemark.operators.runs import current, latest_pair, latest_pair_rows
from tidemark.schema import (
    CHART_RUNS,
    DETAIL_ENTITY_LIMIT,
    DETAIL_RATE_LIMIT,
    HOT_NEW_DAYS,
    MIN_INTERVAL,
    REPORT_LIMIT,
    RISING_LIMIT,
    RISING_RECENT_DAYS,
    RISING_RECENT_LIMIT,
    STAR_RATE_MIN_DOWNLOADS,
    TOP_LIMIT,
)

_TIE = "skill_id"


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def top_by_downloads(snapshots: DataFrame, runs: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    top = top_k(current(snapshots, runs), limit, F.desc("stat_downloads"), _TIE)
    return top.select(
        "rank",
        "skill_id",
        "slug",
        "display_name",
        "owner_handle",
        "stat_downloads",
        "stat_stars",
        "stat_installs_all_time",
        "stat_versions",
    )


def top_by_stars(snapshots: DataFrame, runs: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    top = top_k(current(snapshots, runs), limit, F.desc("stat_stars"), _TIE)
    return top.select(
        "rank", "skill_id", "slug", "display_name", "owner_handle", "stat_stars", "stat_downloads"
    )


def most_versions(snapshots: DataFrame, runs: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    top = top_k(current(snapshots, runs), limit, F.desc("stat_versions"), _TIE)
    return top.select(
        "rank", "skill_id", "display_name", "owner_handle", "stat_versions", "stat_downloads"
    )


def star_rate(
    snapshots: DataFrame,
    runs: DataFrame,
    limit: int = REPORT_LIMIT,
    min_downloads: int = STAR_RATE_MIN_DOWNLOADS,
) -> DataFrame:
    """Stars per hundred downloads, ordered by the unrounded ratio."""
    # A positive floor also keeps the division defined.
    enough = F.col("stat_downloads") >= max(min_downloads, 1)
    rated = current(snapshots, runs).where(enough)
    exact = F.col("stat_stars") / F.col("stat_downloads")
    top = top_k(rated, limit, exact.desc(), _TIE)
    return top.select(
        "rank",
        "skill_id",
        "display_name",
        "owner_handle",
        "stat_downloads",
        "stat_stars",
        round_half_up(F.col("stat_stars") * 100.0 / F.col("stat_downloads"), 2).alias("rate"),
    )


def hot_new(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = REPORT_LIMIT,
    days: int = HOT_NEW_DAYS,
) -> DataFrame:
    """Entities created in the last `days` days, by downloads."""
    recent = current(snapshots, runs).where(F.col("created_at") >= instant(now) - _days(days))
    top = top_k(recent, limit, F.desc("stat_downloads"), _TIE)
    return top.select(
        "rank",
        "skill_id",
        "display_name",
        "owner_handle",
        "stat_downloads",
        "stat_stars",
        "stat_installs_all_time",
        "created_at",
    )


def download_growth(snapshots: DataFrame, runs: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """Entities of both newest runs that gained downloads, by gain."""
    now, before = latest_pair_rows(snapshots, runs)
    before = before.select("skill_id", F.col("stat_downloads").alias("prev_downloads"))
    grown = (
        now.select("skill_id", "slug", "display_name", "owner_handle", "stat_downloads")
        .join(before.hint("merge"), "skill_id")
        .withColumnRenamed("stat_downloads", "curr_downloads")
        .withColumn("growth", F.col("curr_downloads") - F.col("prev_downloads"))
        .where(F.col("growth") > 0)
    )
    return top_k(grown, limit, F.desc("growth"), _TIE).select(
        "rank",
        "skill_id",
        "slug",
        "display_name",
        "owner_handle",
        "prev_downloads",
        "curr_downloads",
        "growth",
    )


def _with_delta(snapshots: DataFrame, runs: DataFrame, kept: Column | None = None) -> DataFrame:
    """Current rows with `prev_downloads` (NULL if not in the previous run) and `delta`.

    `kept` filters the current rows before the join.
    """
    now, before = latest_pair_rows(snapshots, runs)
    if kept is not None:
        now = now.where(kept)
    before = before.select("skill_id", F.col("stat_downloads").alias("prev_downloads"))
    delta = F.col("stat_downloads") - F.coalesce(F.col("prev_downloads"), F.lit(0))
    return now.join(before.hint("merge"), "skill_id", "left").withColumn("delta", delta)


def _with_chart(
    top: DataFrame, limit: int, snapshots: DataFrame, runs: DataFrame, chart_runs: int
) -> DataFrame:
    """Add `velocity_chart` to a list of at most `limit` entities of the current run.

    The list goes to the history scan as the small side, so only listed entities are shuffled; all
    of them are in the newest run, so the inner join loses none.
    """
    history = chart_rows(snapshots, runs, chart_runs).withColumnRenamed(
        "stat_downloads", "chart_downloads"
    )
    charted = (
        history.join(small(top, limit), "skill_id")
        .groupBy(*top.columns)
        .agg(in_run_order("chart_downloads").alias("velocity_chart"))
    )
    return sorted_few(charted, "rank")


def _rising(snapshots: DataFrame, runs: DataFrame, now: datetime, limit: int) -> DataFrame:
    gained = _with_delta(snapshots, runs).where(F.col("delta") > 0)
    created, prev = F.col("created_at"), F.col("prev_downloads")
    pct = F.when(prev > 0, round_half_up(F.col("delta") * 100.0 / prev, 1))
    return top_k(gained, limit, F.desc("delta"), _TIE).select(
        "rank",
        "skill_id",
        "slug",
        "display_name",
        "owner_handle",
        "summary",
        "created_at",
        calendar_days(created, now).alias("days_old"),
        "stat_downloads",
        "delta",
        pct.alias("delta_pct"),
        round_half_up(daily_rate(F.col("stat_downloads"), created, now), 1).alias("dl_per_day"),
    )


def rising(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = RISING_LIMIT,
    chart_runs: int = CHART_RUNS,
) -> DataFrame:
    """Current entities by download gain since the previous run; empty with fewer than two runs."""
    top = _rising(snapshots, runs, now, limit)
    return _with_chart(top, limit, snapshots, runs, chart_runs)


def rising_by_pct(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, limit: int = RISING_LIMIT
) -> DataFrame:
    """The rising list re-ranked by relative gain, unknown as 0, ties in list order."""
    order = (F.coalesce(F.col("delta_pct"), F.lit(0.0)).desc(), F.asc("delta_rank"))
    listed = _rising(snapshots, runs, now, limit).withColumnRenamed("rank", "delta_rank")
    return top_k(listed, limit, *order).select(
        "rank", "delta_rank", "skill_id", "slug", "stat_downloads", "delta", "delta_pct"
    )


def rising_recent(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    limit: int = RISING_RECENT_LIMIT,
    max_age_days: int = RISING_RECENT_DAYS,
) -> DataFrame:
    """Entities created in the days before the current run, by gain; gains may be 0 or negative.

    Empty with fewer than two runs, or if no listed entity changed.
    """
    pair = latest_pair(runs)
    cutoff = pair.select("current_started_at").scalar() - _days(max_age_days)
    top = top_k(
        _with_delta(snapshots, runs, F.col("created_at") >= cutoff), limit, F.desc("delta"), _TIE
    )
    moved = F.max(F.abs("delta")).over(Window.partitionBy(F.lit(1)))  # over the listed rows
    hours = pair.select(
        F.greatest(
            seconds_between(F.col("previous_started_at"), F.col("current_started_at")) / 3600.0,
            F.lit(MIN_INTERVAL),
        )
    ).scalar()
    return (
        top.withColumn("moved", moved)
        .where(F.col("moved") > 0)
        .select(
            "rank",
            "skill_id",
            "display_name",
            "owner_handle",
            F.col("stat_downloads").alias("curr_downloads"),
            F.coalesce("prev_downloads", F.lit(0)).alias("prev_downloads"),
            "delta",
            "stat_stars",
            "created_at",
            round_half_up(hours, 1).alias("hours"),
        )
    )


def rising_by_rate(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = RISING_LIMIT,
    max_age_days: int = HOT_NEW_DAYS,
    chart_runs: int = CHART_RUNS,
) -> DataFrame:
    """Recently created entities by downloads per day; empty with fewer than two runs."""
    young = F.col("created_at") >= instant(now) - _days(max_age_days)
    created = F.col("created_at")
    rated = _with_delta(snapshots, runs, young).withColumn(
        "exact_rate", daily_rate(F.col("stat_downloads"), created, now)
    )
    top = top_k(rated, limit, F.desc("exact_rate"), _TIE).select(
        "rank",
        "skill_id",
        "slug",
        "display_name",
        "owner_handle",
        "summary",
        "created_at",
        calendar_days(created, now).alias("days_old"),
        "stat_downloads",
        "delta",
        round_half_up(F.col("exact_rate"), 1).alias("dl_per_day"),
    )
    return _with_chart(top, limit, snapshots, runs, chart_runs)


def detail_keys(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = DETAIL_ENTITY_LIMIT,
    rate_limit: int = DETAIL_RATE_LIMIT,
) -> DataFrame:
    """Slugs that get a detail document: the most downloaded and the fastest per day."""
    named = current(snapshots, runs).where(F.col("slug").isNotNull())
    by_downloads = named.orderBy(F.desc("stat_downloads"), _TIE).limit(limit).select("slug")
    rate = daily_rate(F.col("stat_downloads"), F.col("created_at"), now)
    by_rate = (
        named.where(F.col("created_at").isNotNull())
        .orderBy(rate.desc(), _TIE)
        .limit(rate_limit)
        .select("slug")
    )
    return by_downloads.union(by_rate).distinct()
