"""Creation-month cohorts and rates of recently created entities."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order_stats import percentiles
from tidemark.functions.ranking import sorted_few
from tidemark.functions.scalars import daily_rate, instant, month_start, ratio, round_half_up
from tidemark.operators.runs import current


def _dated(snapshots: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """Current entities of known age with `cohort_month` and `rate` (downloads per day)."""
    return (
        current(snapshots, runs)
        .where(F.col("created_at").isNotNull())
        .select(
            month_start(F.col("created_at")).alias("cohort_month"),
            "created_at",
            "stat_downloads",
            "stat_stars",
            "stat_installs_all_time",
            daily_rate(F.col("stat_downloads"), F.col("created_at"), now).alias("rate"),
        )
    )


def cohort_quality(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """Size, mean downloads and stars, install share and mean daily rate per creation month."""
    installs = ratio(F.sum("stat_installs_all_time") * 100.0, F.sum("stat_downloads"))
    cohorts = (
        _dated(snapshots, runs, now)
        .groupBy("cohort_month")
        .agg(
            F.count(F.lit(1)).alias("skill_count"),
            round_half_up(F.avg("stat_downloads")).alias("avg_downloads"),
            round_half_up(F.avg("stat_stars"), 1).alias("avg_stars"),
            F.coalesce(round_half_up(installs, 1), F.lit(0.0)).alias("install_pct"),
            round_half_up(F.avg("rate"), 1).alias("avg_dl_per_day"),
        )
    )
    return sorted_few(cohorts, "cohort_month")


def cohort_percentiles(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """Percentiles and mean of the daily rate and stars per download, per creation month."""
    wanted = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}
    dated = _dated(snapshots, runs, now)
    shape = percentiles(dated, ["cohort_month"], "rate", wanted)
    stars = ratio(F.sum("stat_stars"), F.sum("stat_downloads"))
    means = dated.groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("skill_count"),
        round_half_up(F.avg("rate"), 1).alias("avg_dl_per_day"),
        F.coalesce(round_half_up(stars, 4), F.lit(0.0)).alias("star_dl_ratio"),
    )
    # Both sides have one row per month.
    cohorts = means.join(shape.drop("n"), "cohort_month").select(
        "cohort_month",
        "skill_count",
        *[round_half_up(F.col(p), 1).alias(p) for p in wanted],
        "avg_dl_per_day",
        "star_dl_ratio",
    )
    return sorted_few(cohorts, "cohort_month")


def median_rate_windows(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, days: int = 30
) -> DataFrame:
    """Median daily rate of entities created in the last `days` days and in the `days` before.

    One row; NULL where a window has no entity, change NULL unless the earlier median is positive.
    """
    created = F.col("created_at")

    def ago(n: int):
        return instant(now) - F.make_dt_interval(F.lit(n))

    window = F.when(created >= ago(days), "recent").when(created >= ago(2 * days), "prior")
    rated = _dated(snapshots, runs, now).where(created >= ago(2 * days)).withColumn("age", window)
    medians = percentiles(rated, ["age"], "rate", {"median": 0.5})

    def of(side: str):
        return F.max(F.when(F.col("age") == side, round_half_up(F.col("median"), 1)))

    recent, prior = F.col("median_rate"), F.col("median_rate_prior")
    return medians.agg(
        of("recent").alias("median_rate"), of("prior").alias("median_rate_prior")
    ).withColumn("median_mom_pct", round_half_up(ratio(recent - prior, prior) * 100.0, 1))
