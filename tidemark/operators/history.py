"""Per-entity histories and details, for all requested entities in one plan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import elapsed_days, json_keys, round_half_up
from tidemark.operators.momentum import velocity
from tidemark.operators.runs import completed, current


def _requested(snapshots: DataFrame, entities: DataFrame | None) -> DataFrame:
    if entities is None:
        return snapshots
    return snapshots.join(entities.select("skill_id"), "skill_id", "left_semi")


def timeline(
    snapshots: DataFrame, runs: DataFrame, entities: DataFrame | None = None
) -> DataFrame:
    """Counters and version of each entity in each completed run, with `is_release`.

    A release is a version that differs from the entity's row before. A missing version is no
    release, and neither is the first version after it. `entities` (skill_id) restricts the set.
    """
    w = Window.partitionBy("skill_id").orderBy("scrape_run_id")  # one row per run at most
    version = F.col("version_number")
    changed = (version != "") & (version != F.lag("version_number").over(w))
    return (
        _requested(snapshots, entities)
        .join(completed(runs), "scrape_run_id")
        .select(
            "skill_id",
            "scrape_run_id",
            F.col("started_at").alias("run_date"),
            F.col("stat_downloads").alias("downloads"),
            F.col("stat_stars").alias("stars"),
            F.col("stat_installs_all_time").alias("installs_all_time"),
            F.col("stat_installs_current").alias("installs_current"),
            "version_number",
            F.col("version_changelog").alias("changelog"),
            F.coalesce(changed, F.lit(False)).alias("is_release"),
        )
    )


HISTORY_FIELDS = ("run_date", "downloads", "stars", "installs_all_time", "installs_current")
RELEASE_FIELDS = ("version_number", "run_date", "changelog")


def entity_history(
    snapshots: DataFrame, runs: DataFrame, entities: DataFrame | None = None
) -> DataFrame:
    """Counters of each entity in each completed run, long form."""
    return timeline(snapshots, runs, entities).select(
        "skill_id", "scrape_run_id", *HISTORY_FIELDS
    )


def version_releases(
    snapshots: DataFrame, runs: DataFrame, entities: DataFrame | None = None
) -> DataFrame:
    """Runs in which an entity shows another version than in its row before."""
    return (
        timeline(snapshots, runs, entities)
        .where("is_release")
        .select("skill_id", "scrape_run_id", *RELEASE_FIELDS)
    )


def slug_owners(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """(slug, skill_id) of the current run; a slug used twice goes to the least skill_id."""
    return (
        current(snapshots, runs)
        .where(F.col("slug").isNotNull())
        .groupBy("slug")
        .agg(F.min("skill_id").alias("skill_id"))
    )


def entity_detail(
    snapshots: DataFrame, runs: DataFrame, *, now: datetime, slugs: DataFrame | None = None
) -> DataFrame:
    """Current state of one entity per slug; `slugs` (slug) restricts the set.

    `tags` is the array of tag names. `velocity` is lifetime downloads per elapsed day.
    """
    chosen = slug_owners(snapshots, runs)
    if slugs is not None:
        chosen = chosen.join(slugs.select("slug"), "slug", "left_semi")
    chosen = chosen.select("skill_id")
    pace = velocity(_requested(snapshots, chosen) if slugs is not None else snapshots, runs)
    age = elapsed_days(F.col("created_at"), now)
    return (
        current(snapshots, runs)
        .join(chosen, "skill_id", "left_semi")
        .join(pace.select("skill_id", "acceleration_pct"), "skill_id", "left")
        .select(
            "skill_id",
            "slug",
            "display_name",
            "summary",
            "owner_handle",
            "created_at",
            age.alias("days_old"),
            "stat_downloads",
            "stat_stars",
            json_keys(F.col("tags")).alias("tags"),
            "badges",
            F.coalesce("stat_installs_all_time", F.lit(0)).alias("stat_installs"),
            F.coalesce("stat_comments", F.lit(0)).alias("stat_comments"),
            F.col("version_number").alias("current_version"),
            round_half_up(F.col("stat_downloads") / age, 1).alias("velocity"),
            "acceleration_pct",
        )
    )
