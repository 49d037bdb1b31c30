"""Published documents: one-row page documents, and one document per entity or owner."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranking import small
from tidemark.functions.scalars import instant, owner_key
from tidemark.operators import growth, history, momentum, owners, rankings
from tidemark.schema import DETAIL_ENTITY_LIMIT, DETAIL_OWNER_LIMIT, DETAIL_RATE_LIMIT


def _array(df: DataFrame, order: str = "rank", only: str | None = None) -> Column:
    """A short list (top-k, weeks or runs) as an array in `order`, as a one-value subquery.

    Elements are structs of all columns but run id and rank, or the column `only`.
    """
    fields = [c for c in df.columns if c not in ("rank", "scrape_run_id")]
    entry = F.col(only) if only else F.struct(*fields)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), entry.alias("entry"))))
    return df.agg(F.transform(ordered, lambda e: e.entry)).scalar()


def _document(spark: SparkSession, now: datetime, **parts: Column) -> DataFrame:
    """One row put together from one-value subqueries."""
    return spark.range(1, numPartitions=1).select(
        *[column.alias(name) for name, column in parts.items()],
        instant(now).alias("generated_at"),
    )


def dashboard(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    totals = growth.platform_totals(snapshots, runs)
    per_run = growth.run_totals(snapshots, runs)
    shape = growth.run_percentiles(snapshots, runs)

    def total(name: str) -> Column:
        return totals.select(name).scalar()

    return _document(
        snapshots.sparkSession,
        now,
        total_skills=total("total_skills"),
        total_downloads=total("total_downloads"),
        total_stars=total("total_stars"),
        total_owners=total("unique_owners"),
        weekly_growth=_array(growth.weekly_growth(snapshots, runs, now=now), "week_start"),
        download_sparkline=_array(per_run, "scrape_run_id", only="total_downloads"),
        download_percentiles=_array(shape, "scrape_run_id"),
        download_wow_pct=growth.download_wow(snapshots, runs).select("download_wow_pct").scalar(),
        avg_wow_pct=growth.avg_wow(snapshots, runs, now=now).scalar(),
    )


def rising(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    listed = rankings.rising(snapshots, runs, now=now)
    return _document(snapshots.sparkSession, now, skills=_array(listed))


def leaderboard(snapshots: DataFrame, runs: DataFrame, *, now: datetime, **accel) -> DataFrame:
    """`accel` goes to `momentum.fastest_growing`."""
    return _document(
        snapshots.sparkSession,
        now,
        all_time=_array(momentum.leaderboard_all_time(snapshots, runs, now=now)),
        fastest_growing=_array(momentum.fastest_growing(snapshots, runs, now=now, **accel)),
    )


def owners_page(snapshots: DataFrame, runs: DataFrame, *, now: datetime) -> DataFrame:
    def by(key: str) -> Column:
        listed = owners.owners_by(snapshots, runs, key, now=now)
        return _array(listed.withColumnRenamed("owner_handle", "handle"))

    return _document(
        snapshots.sparkSession,
        now,
        by_downloads=by("total_downloads"),
        by_stars=by("total_stars"),
        by_skill_count=by("skill_count"),
    )


def _in_run_order(fields: tuple[str, ...], when: Column | None = None) -> Column:
    """Aggregate: structs of `fields` in run order, at most one per run."""
    point = F.struct("scrape_run_id", F.struct(*fields).alias("entry"))
    points = F.collect_list(point if when is None else F.when(when, point))
    return F.transform(F.array_sort(points), lambda p: p.entry)


def entity_documents(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    limit: int = DETAIL_ENTITY_LIMIT,
    rate_limit: int = DETAIL_RATE_LIMIT,
) -> DataFrame:
    """One row per qualifying entity: detail, history and releases. One plan for all of them."""
    keys = rankings.detail_keys(snapshots, runs, now=now, limit=limit, rate_limit=rate_limit)
    keys = small(keys, limit + rate_limit)
    detail = history.entity_detail(snapshots, runs, now=now, slugs=keys)
    chosen = small(detail.select("skill_id"), limit + rate_limit)
    past = (
        history.timeline(snapshots, runs, chosen)
        .groupBy("skill_id")
        .agg(
            _in_run_order(history.HISTORY_FIELDS).alias("history"),
            _in_run_order(history.RELEASE_FIELDS, F.col("is_release")).alias("version_releases"),
        )
    )
    return detail.join(past, "skill_id")


def owner_documents(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, limit: int = DETAIL_OWNER_LIMIT
) -> DataFrame:
    """One row per qualifying owner: portfolio and trajectory.

    The owner's entities are `owner_document_entities`: their number has no bound, so they are rows
    and not an array in the document.
    """
    listed = small(owners.detail_owners(snapshots, runs, limit).select("owner_handle"), limit)
    owned = snapshots.join(listed, "owner_handle", "left_semi")
    path = (
        owners.owner_trajectory(owned, runs)
        .groupBy("owner_handle")
        .agg(_in_run_order(("run_date", "downloads", "stars")).alias("trajectory"))
    )
    return (
        owners.owner_portfolio(owned, runs, now=now)
        .join(path, "owner_handle")
        .select(
            owner_key(F.col("owner_handle")).alias("owner_key"),
            F.col("owner_handle").alias("handle"),
            "total_downloads",
            "total_stars",
            "total_installs",
            "skill_count",
            "avg_dl_per_day",
            "trajectory",
            F.transform("trajectory", lambda t: t.downloads).alias("download_trajectory"),
        )
    )


def owner_document_entities(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, limit: int = DETAIL_OWNER_LIMIT
) -> DataFrame:
    """Entities of the qualifying owners, by owner and downloads."""
    listed = small(owners.detail_owners(snapshots, runs, limit).select("owner_handle"), limit)
    owned = snapshots.join(listed, "owner_handle", "left_semi")
    return owners.owner_entities(owned, runs, now=now).withColumn(
        "owner_key", owner_key(F.col("owner_handle"))
    )
