"""Totals, concentration, weekly growth and run-to-run growth of the whole catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.order_stats import percentiles, top_fraction_sums
from tidemark.functions.ranking import sorted_few
from tidemark.functions.scalars import (
    calendar_days,
    instant,
    ratio,
    round_half_even,
    round_half_up,
    seconds_between,
    week_start,
)
from tidemark.operators.runs import completed, current, rows_of_completed
from tidemark.schema import GROWTH_WEEKS, MIN_INTERVAL, WOW_RUNS_BACK


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def platform_totals(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """One row over the current run; zeros when there is none. NULL owners are not counted."""
    return current(snapshots, runs).agg(
        F.count(F.lit(1)).alias("total_skills"),
        _total("stat_downloads").alias("total_downloads"),
        _total("stat_stars").alias("total_stars"),
        _total("stat_comments").alias("total_comments"),
        _total("stat_installs_all_time").alias("total_installs"),
        F.count_distinct("owner_handle").alias("unique_owners"),
    )


def top_share(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of downloads held by the first of 100 and the first of 10 equal tiles by downloads.

    One row; no row when the current run is empty.
    """
    sums = top_fraction_sums(current(snapshots, runs), "stat_downloads", (100, 10))

    def share(part: str) -> Column:
        pct = ratio(F.col(part), F.col("total")) * 100.0
        return F.coalesce(round_half_up(pct, 2), F.lit(0.0))

    return sums.select(
        F.col("n").alias("total_skills"),
        F.col("total").alias("total_downloads"),
        F.col("top_100").alias("top1_downloads"),
        F.col("top_10").alias("top10_downloads"),
        share("top_100").alias("top1_pct"),
        share("top_10").alias("top10_pct"),
    )


def rollup(snapshots: DataFrame) -> DataFrame:
    """Totals of each run that has rows, with the columns of `schema.TOTALS`. Reads all runs.

    The loads keep the same rows with the run log (`RunLog.totals`). Operators over run totals take
    them as `totals`, and then read no history.
    """
    return snapshots.groupBy("scrape_run_id").agg(
        F.count(F.lit(1)).alias("total_skills"),
        F.sum("stat_downloads").alias("total_downloads"),
        F.sum("stat_stars").alias("total_stars"),
    )


def _run_totals(snapshots: DataFrame, runs: DataFrame, totals: DataFrame | None) -> DataFrame:
    """One row per completed run that has rows."""
    known = rollup(snapshots) if totals is None else totals
    return known.join(completed(runs), "scrape_run_id").select(
        "scrape_run_id", "started_at", "total_skills", "total_downloads", "total_stars"
    )


def run_totals(
    snapshots: DataFrame, runs: DataFrame, *, totals: DataFrame | None = None
) -> DataFrame:
    """Size and totals of every completed run that has rows, in run order."""
    return sorted_few(_run_totals(snapshots, runs, totals), "scrape_run_id")


def run_percentiles(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Interpolated percentiles of downloads per completed run, in whole downloads."""
    wanted = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    rows = rows_of_completed(snapshots, runs)
    result = percentiles(rows, ["scrape_run_id"], "stat_downloads", wanted)
    dated = result.join(completed(runs), "scrape_run_id").select(
        "scrape_run_id",
        F.date_format("started_at", "yyyy-MM-dd").alias("run_date"),
        F.col("n").alias("skill_count"),
        *[round_half_even(F.col(p)).alias(p) for p in wanted],
    )
    return sorted_few(dated, "scrape_run_id")


def weekly_new(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Entities per creation week (Monday start); weeks without any are absent."""
    return (
        current(snapshots, runs)
        .where(F.col("created_at").isNotNull())
        .groupBy(week_start(F.col("created_at")).alias("week_start"))
        .agg(F.count(F.lit(1)).alias("new_count"))
    )


def _in_order(column: str) -> WindowSpec:
    """Without partition: only ever over one row per week or per run, never over entities."""
    return Window.orderBy(column)


def _so_far(column: str) -> WindowSpec:
    return _in_order(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def growth_timeline(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """All weeks with running total and change to the previous listed week, in whole percent."""
    before = F.lag("new_count").over(_in_order("week_start"))
    weeks = weekly_new(snapshots, runs).withColumn("before", before)
    change = ratio(F.col("new_count") - F.col("before"), F.col("before")) * 100.0
    return weeks.select(
        "week_start",
        "new_count",
        F.sum("new_count").over(_so_far("week_start")).alias("cumulative"),
        round_half_even(change).alias("wow_pct"),
    ).orderBy("week_start")


def weekly_growth(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, weeks: int | None = GROWTH_WEEKS
) -> DataFrame:
    """Last `weeks` weeks with running total, week-over-week change and a forecast.

    The current, incomplete week is scaled up to seven days; that forecast is what the change is
    computed from. Totals and changes are computed over all weeks before the list is cut.
    """
    this_week = week_start(instant(now))
    elapsed = calendar_days(F.col("week_start"), now) + 1
    incomplete = (F.col("week_start") >= this_week) & elapsed.between(1, 6)
    forecast = round_half_even(F.col("new_count") / elapsed * 7).cast("bigint")
    effective = F.when(incomplete, forecast).otherwise(F.col("new_count"))
    listed = weekly_new(snapshots, runs).select(
        "*", incomplete.alias("is_forecast"), effective.alias("effective")
    )
    before = F.lag("effective").over(_in_order("week_start"))
    growth = listed.select(
        "week_start",
        "new_count",
        F.sum("new_count").over(_so_far("week_start")).alias("cumulative"),
        round_half_up(ratio(F.col("effective") - before, before) * 100.0, 1).alias("wow_pct"),
        "is_forecast",
        F.when(F.col("is_forecast"), F.col("effective")).alias("forecast_count"),
    )
    if weeks is not None:
        growth = growth.orderBy(F.desc("week_start")).limit(weeks)
    return sorted_few(growth, "week_start")


def avg_wow(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """Mean week-over-week change of the listed complete weeks; NULL if there is none."""
    return weekly_growth(snapshots, runs, now=now).agg(
        round_half_up(F.avg(F.when(~F.col("is_forecast"), F.col("wow_pct"))), 1).alias(
            "avg_wow_pct"
        )
    )


def download_wow(
    snapshots: DataFrame, runs: DataFrame, *, totals: DataFrame | None = None
) -> DataFrame:
    """Change of total downloads against seven runs back, or the earliest run if there are fewer.

    One row; NULL with a single run or a reference without downloads; no row without runs.
    """
    newest = _run_totals(snapshots, runs, totals).orderBy(F.desc("scrape_run_id"))
    ends = newest.limit(WOW_RUNS_BACK + 1).agg(
        F.max_by("total_downloads", "scrape_run_id").alias("latest_downloads"),
        F.min_by("total_downloads", "scrape_run_id").alias("reference_downloads"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") > 0)
    change = ratio(
        F.col("latest_downloads") - F.col("reference_downloads"), F.col("reference_downloads")
    )
    return ends.select(
        "latest_downloads",
        "reference_downloads",
        F.when(F.col("n") >= 2, round_half_up(change * 100.0, 1)).alias("download_wow_pct"),
    )


def _days(start: Column, end: Column) -> Column:
    return F.greatest(seconds_between(start, end) / 86400.0, F.lit(MIN_INTERVAL))


def platform_velocity(
    snapshots: DataFrame, runs: DataFrame, *, totals: DataFrame | None = None
) -> DataFrame:
    """Totals per completed run and change to the run before; empty with fewer than two runs."""
    known = _run_totals(snapshots, runs, totals).withColumn(
        "n_runs", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    )
    delta = F.col("total_downloads") - F.lag("total_downloads").over(_in_order("scrape_run_id"))
    days = _days(F.lag("started_at").over(_in_order("scrape_run_id")), F.col("started_at"))
    return (
        known.select(
            "*",
            delta.alias("download_delta"),
            F.when(delta.isNotNull(), round_half_up(delta / days, 2)).alias("downloads_per_day"),
        )
        .where(F.col("n_runs") >= 2)
        .drop("n_runs")
        .orderBy("scrape_run_id")
    )


def avg_platform_velocity(
    snapshots: DataFrame, runs: DataFrame, *, totals: DataFrame | None = None
) -> DataFrame:
    """Mean daily download growth from the first to the last run; empty with fewer than three."""
    ends = _run_totals(snapshots, runs, totals).agg(
        F.min_by("total_downloads", "scrape_run_id").alias("first_downloads"),
        F.max_by("total_downloads", "scrape_run_id").alias("last_downloads"),
        F.min_by("started_at", "scrape_run_id").alias("first_at"),
        F.max_by("started_at", "scrape_run_id").alias("last_at"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    days = _days(F.col("first_at"), F.col("last_at"))
    growth = F.col("last_downloads") - F.col("first_downloads")
    return ends.where(F.col("n_runs") >= 3).select(
        "n_runs",
        round_half_up(days, 1).alias("total_days"),
        round_half_up(growth / days, 2).alias("avg_downloads_per_day"),
    )
