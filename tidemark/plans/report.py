"""The report: named tables in a fixed order."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cohorts, diff, growth, owners, rankings
from tidemark.schema import (
    REPORT_LIMIT,
    SPAM_MAX_MEAN_DOWNLOADS,
    SPAM_MIN_ENTITIES,
    STAR_RATE_MIN_DOWNLOADS,
)

# Tables left out of a report when they have no rows.
OPTIONAL = frozenset({
    "owner_spam",
    "platform_velocity",
    "avg_platform_velocity",
    "rising_recent",
    "diff_counts",
    "diff_summary",
})


def report(
    snapshots: DataFrame,
    runs: DataFrame,
    *,
    now: datetime,
    star_rate_min_downloads: int = STAR_RATE_MIN_DOWNLOADS,
    spam_min_entities: int = SPAM_MIN_ENTITIES,
    spam_max_mean_downloads: float = SPAM_MAX_MEAN_DOWNLOADS,
) -> dict[str, DataFrame]:
    """All report tables by name, in report order; nothing runs until a table is used."""
    h = (snapshots, runs)
    return {
        "platform_totals": growth.platform_totals(*h),
        "top_share": growth.top_share(*h),
        "growth_timeline": growth.growth_timeline(*h),
        "cohort_quality": cohorts.cohort_quality(*h, now=now),
        "hot_new": rankings.hot_new(*h, now=now),
        "top_by_downloads": rankings.top_by_downloads(*h, limit=REPORT_LIMIT),
        "star_rate": rankings.star_rate(*h, min_downloads=star_rate_min_downloads),
        "most_versions": rankings.most_versions(*h),
        "owner_leaderboard": owners.owner_leaderboard(*h, limit=REPORT_LIMIT),
        "owner_spam": owners.owner_spam(*h, spam_min_entities, spam_max_mean_downloads),
        "platform_velocity": growth.platform_velocity(*h),
        "avg_platform_velocity": growth.avg_platform_velocity(*h),
        "rising_recent": rankings.rising_recent(*h),
        "diff_counts": diff.diff_counts(*h),
        "diff_summary": diff.diff_summary(*h),
    }


def report_contents(tables: dict[str, DataFrame]) -> DataFrame:
    """(position, section, rows) of the tables a report shows: optional empty ones are left out."""
    counted = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(position).alias("position"), F.lit(name).alias("section"), "rows"
        )
        for position, (name, table) in enumerate(tables.items(), 1)
    ]
    shown = (F.col("rows") > 0) | ~F.col("section").isin(*sorted(OPTIONAL))
    return reduce(DataFrame.unionByName, counted).where(shown)
