"""Roll-ups per owner. Hot owners are combined map-side; no owner's rows meet in one task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import top_k
from tidemark.functions.scalars import (
    calendar_days,
    daily_rate,
    owner_key,
    ratio,
    round_half_up,
)
from tidemark.operators.runs import completed, current
from tidemark.schema import (
    DETAIL_OWNER_LIMIT,
    OWNER_LIST_LIMIT,
    SPAM_MAX_MEAN_DOWNLOADS,
    SPAM_MIN_ENTITIES,
    TOP_LIMIT,
)

_TIE = "owner_handle"


def _owned(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    return current(snapshots, runs).where(F.col("owner_handle").isNotNull())


def _totals(owned: DataFrame) -> DataFrame:
    return owned.groupBy("owner_handle").agg(
        F.count(F.lit(1)).alias("skill_count"),
        F.sum("stat_downloads").alias("total_downloads"),
        F.sum("stat_stars").alias("total_stars"),
    )


def owner_leaderboard(snapshots: DataFrame, runs: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """Owners of the current run by total downloads."""
    return top_k(_totals(_owned(snapshots, runs)), limit, F.desc("total_downloads"), _TIE).select(
        "rank", "owner_handle", "skill_count", "total_downloads", "total_stars"
    )


def owner_spam(
    snapshots: DataFrame,
    runs: DataFrame,
    min_entities: int = SPAM_MIN_ENTITIES,
    max_mean_downloads: float = SPAM_MAX_MEAN_DOWNLOADS,
) -> DataFrame:
    """Owners with more than `min_entities` entities and a mean below `max_mean_downloads`."""
    return (
        _owned(snapshots, runs)
        .groupBy("owner_handle")
        .agg(F.count(F.lit(1)).alias("skill_count"), F.avg("stat_downloads").alias("mean"))
        .where((F.col("skill_count") > min_entities) & (F.col("mean") < max_mean_downloads))
        .select("owner_handle", "skill_count", round_half_up(F.col("mean")).alias("avg_downloads"))
        .orderBy(F.desc("skill_count"), _TIE)
    )


def owner_stats(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """Every owner with an entity of known age: totals, shares, mean daily rate, first creation.

    Shares are of the sum over these owners.
    """
    dated = _owned(snapshots, runs).where(F.col("created_at").isNotNull())
    rate = daily_rate(F.col("stat_downloads"), F.col("created_at"), now)
    owners = dated.groupBy("owner_handle").agg(
        F.count(F.lit(1)).alias("skill_count"),
        F.coalesce(F.sum("stat_downloads"), F.lit(0)).alias("total_downloads"),
        F.coalesce(F.sum("stat_stars"), F.lit(0)).alias("total_stars"),
        F.coalesce(round_half_up(F.avg(rate), 1), F.lit(0.0)).alias("avg_dl_per_day"),
        F.min("created_at").alias("first_skill_at"),
    )

    def share(part: str, column: str) -> Column:
        whole = dated.agg(F.sum(column)).scalar()
        return F.coalesce(round_half_up(ratio(F.col(part), whole) * 100.0, 2), F.lit(0.0))

    return owners.select(
        "owner_handle",
        "skill_count",
        "total_downloads",
        "total_stars",
        share("total_downloads", "stat_downloads").alias("dl_pct"),
        share("total_stars", "stat_stars").alias("star_pct"),
        "avg_dl_per_day",
        "first_skill_at",
    )


def owners_by(
    snapshots: DataFrame,
    runs: DataFrame,
    key: str,
    *,
    now: datetime,
    limit: int = OWNER_LIST_LIMIT,
) -> DataFrame:
    """`owner_stats` by 'total_downloads', 'total_stars' or 'skill_count', ties by downloads."""
    stats = owner_stats(snapshots, runs, now=now)
    return top_k(stats, limit, F.desc(key), F.desc("total_downloads"), _TIE).select(
        "rank", *stats.columns
    )


def owner_portfolio(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """One row per owner of the current run, summed over its entities of known age."""
    dated = F.col("created_at").isNotNull()

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(dated, F.col(column))), F.lit(0))

    rate = F.when(dated, daily_rate(F.col("stat_downloads"), F.col("created_at"), now))
    return (
        _owned(snapshots, runs)
        .groupBy("owner_handle")
        .agg(
            total("stat_downloads").alias("total_downloads"),
            total("stat_stars").alias("total_stars"),
            total("stat_installs_all_time").alias("total_installs"),
            F.count_if(dated).alias("skill_count"),
            F.coalesce(round_half_up(F.avg(rate), 1), F.lit(0.0)).alias("avg_dl_per_day"),
        )
    )


def owner_entities(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    """Entities per owner, by downloads within the owner.

    A global sort rather than a window per owner, so a large owner spreads over many tasks.
    """
    return (
        _owned(snapshots, runs)
        .select(
            "owner_handle",
            "skill_id",
            "slug",
            "display_name",
            "stat_downloads",
            "stat_stars",
            "created_at",
            calendar_days(F.col("created_at"), now).alias("days_old"),
        )
        .orderBy("owner_handle", F.desc("stat_downloads"), "skill_id")
    )


def owner_trajectory(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Downloads and stars per owner and completed run."""
    return (
        snapshots.where(F.col("owner_handle").isNotNull())
        .join(completed(runs), "scrape_run_id")
        .groupBy("owner_handle", "scrape_run_id", "started_at")
        .agg(F.sum("stat_downloads").alias("downloads"), F.sum("stat_stars").alias("stars"))
        .withColumnRenamed("started_at", "run_date")
    )


def owner_count_mom(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct owners of the newest run and the change to the newest run 30 days older.

    One row; the reference columns are NULL if no run is that old. No row without runs.
    """
    done = completed(runs)
    newest = done.orderBy(F.desc("scrape_run_id")).limit(1)
    cutoff = newest.select("started_at").scalar() - F.make_dt_interval(F.lit(30))
    reference = (
        done.where(F.col("started_at") <= cutoff).orderBy(F.desc("scrape_run_id")).limit(1)
    )
    chosen = newest.select("scrape_run_id", F.lit("newest").alias("side")).union(
        reference.select("scrape_run_id", F.lit("reference"))
    )
    counts = (
        snapshots.select("scrape_run_id", "owner_handle")
        .join(chosen, "scrape_run_id")
        .groupBy("scrape_run_id", "side")
        .agg(F.count_distinct("owner_handle").alias("owners"))
    )

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    change = ratio(F.col("total_owners") - F.col("reference_owners"), F.col("reference_owners"))
    return (
        counts.agg(
            of("newest", "scrape_run_id").alias("scrape_run_id"),
            of("newest", "owners").alias("total_owners"),
            of("reference", "scrape_run_id").alias("reference_run_id"),
            of("reference", "owners").alias("reference_owners"),
        )
        .where(F.col("scrape_run_id").isNotNull())
        .withColumn("owners_mom_pct", round_half_up(change * 100.0, 1))
    )


def detail_owners(
    snapshots: DataFrame, runs: DataFrame, limit: int = DETAIL_OWNER_LIMIT
) -> DataFrame:
    """Owners that get a detail document, by total downloads."""
    totals = _owned(snapshots, runs).groupBy("owner_handle").agg(
        F.sum("stat_downloads").alias("total_downloads")
    )
    return top_k(totals, limit, F.desc("total_downloads"), _TIE).select(
        "rank", "owner_handle", owner_key(F.col("owner_handle")).alias("owner_key")
    )


def owner_keys(handles: DataFrame) -> DataFrame:
    """Distinct handles of a frame with `owner_handle`, with their key."""
    distinct = handles.where(F.col("owner_handle").isNotNull()).select("owner_handle").distinct()
    return distinct.withColumn("owner_key", owner_key(F.col("owner_handle")))


def owner_key_collisions(handles: DataFrame) -> DataFrame:
    """Handles that share their key with another handle; lists of handles are never collected."""
    keyed = owner_keys(handles)
    shared = keyed.groupBy("owner_key").count().where("count > 1").select("owner_key")
    return keyed.join(shared, "owner_key", "left_semi").select("owner_key", "owner_handle")
