"""Table schemas and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# Run log: one row per run.
RUNS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("started_at", T.TimestampNTZType(), False),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("total_skills", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("duration_secs", T.DoubleType()),
    T.StructField("new_skills", T.IntegerType()),
    T.StructField("removed_skills", T.IntegerType()),
    T.StructField("changed_skills", T.IntegerType()),
])

# Rollup: totals of each completed run that has rows, kept by the loads.
TOTALS = T.StructType([
    T.StructField("scrape_run_id", T.IntegerType()),
    T.StructField("total_skills", T.LongType()),
    T.StructField("total_downloads", T.LongType()),
    T.StructField("total_stars", T.LongType()),
])

# History: one row per run and entity. The partition column comes last, as in the stored table.
# The columns of the two stored tables.
SNAPSHOTS = T.StructType([
    T.StructField("skill_id", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("badges", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("stat_downloads", T.LongType()),
    T.StructField("stat_stars", T.LongType()),
    T.StructField("stat_comments", T.LongType()),
    T.StructField("stat_installs_all_time", T.LongType()),
    T.StructField("stat_installs_current", T.LongType()),
    T.StructField("stat_versions", T.LongType()),
    T.StructField("owner_user_id", T.StringType()),
    T.StructField("owner_handle", T.StringType()),
    T.StructField("owner_display_name", T.StringType()),
    T.StructField("owner_name", T.StringType()),
    T.StructField("owner_image", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("version_number", T.StringType()),
    T.StructField("version_changelog", T.StringType()),
    T.StructField("version_changelog_source", T.StringType()),
    T.StructField("version_created_at", T.TimestampNTZType()),
    T.StructField("owner_handle_top", T.StringType()),
    T.StructField("scrape_run_id", T.IntegerType()),
])


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _number(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _nested(name: str, *fields: T.StructField) -> T.StructField:
    return T.StructField(name, T.StructType(list(fields)))


# One catalogue item as it arrives; numbers arrive as JSON floats. Badges and tags are
# objects whose values can be of any type.
ITEM = T.StructType([
    *_text("ownerHandle"),
    _nested(
        "skill",
        *_text("_id", "slug", "displayName", "summary"),
        *_number("createdAt", "updatedAt"),
        T.StructField("badges", T.VariantType()),
        T.StructField("tags", T.VariantType()),
        _nested(
            "stats",
            *_number(
                "downloads", "stars", "comments", "installsAllTime", "installsCurrent", "versions"
            ),
        ),
    ),
    _nested("owner", *_text("_id", "handle", "displayName", "name", "image")),
    _nested(
        "latestVersion",
        *_text("_id", "version", "changelog", "changelogSource"),
        *_number("createdAt"),
    ),
])

# One landed response page. `cursor` names the request it answers and is null for the first one;
# the rest are fixed values of the response.
PAGE = T.StructType([
    *_text("cursor", "status"),
    _nested(
        "value",
        *_text("nextCursor"),
        T.StructField("hasMore", T.BooleanType()),
        T.StructField("page", T.ArrayType(ITEM)),
    ),
])

# What is kept of pages that are not loaded: `reason` is 'status' for a page with an error, 'damaged'
# for a line that is no page or a page with a value of another type; `record` is its text.
QUARANTINED = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("cursor", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("record", T.StringType()),
    T.StructField("run", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()),
])

# The fields a diff compares.
TRACKED_FIELDS = (
    "stat_downloads",
    "stat_stars",
    "stat_comments",
    "stat_installs_all_time",
    "stat_installs_current",
    "stat_versions",
    "display_name",
    "summary",
    "owner_handle",
    "version_number",
    "version_id",
)

# Change feed: `kind` is new, removed or changed; the values are those of the run, or of the run before
# for what was removed; `changes` is null unless the kind is changed.
CHANGES = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("skill_id", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("owner_handle", T.StringType()),
    T.StructField("stat_downloads", T.LongType()),
    T.StructField(
        "changes",
        T.ArrayType(T.StructType([
            T.StructField("field", T.StringType()),
            T.StructField("from_value", T.StringType()),
            T.StructField("to_value", T.StringType()),
        ])),
    ),
    T.StructField("previous_run_id", T.IntegerType()),
    T.StructField("scrape_run_id", T.IntegerType()),
])

# List lengths, windows and thresholds.
TOP_LIMIT = 20
REPORT_LIMIT = 10
RISING_LIMIT = 50
RISING_RECENT_LIMIT = 15
LEADERBOARD_LIMIT = 100
OWNER_LIST_LIMIT = 50
DETAIL_ENTITY_LIMIT = 200
DETAIL_RATE_LIMIT = 50
DETAIL_OWNER_LIMIT = 50
CHART_RUNS = 10
GROWTH_WEEKS = 12
WOW_RUNS_BACK = 7
HOT_NEW_DAYS = 30
RISING_RECENT_DAYS = 14
TREND_THRESHOLD_PCT = 5.0
ACCEL_MIN_DOWNLOADS = 50
STAR_RATE_MIN_DOWNLOADS = 100
SPAM_MIN_ENTITIES = 50
SPAM_MAX_MEAN_DOWNLOADS = 50
MIN_INTERVAL = 0.01
ITEMS_PER_PAGE = 180
