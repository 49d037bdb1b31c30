"""Every query by name, over the history derived from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import cohorts, diff, growth, history, momentum, owners, rankings, runs
from tidemark.plans import documents, landed
from tidemark.plans.report import report, report_contents
from tidemark.plans.star_history import FAILED_RUN, NOW, RUNS, star_history, star_totals
from tidemark.schema import PAGE
from tidemark.session import shared_folder
from tidemark.sources import pages as page_source
from tidemark.sources import publish as publisher
from tidemark.sources.feed import ChangeFeed
from tidemark.sources.tables import HistoryTable, RunLog
from tidemark.streaming.landing import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds at the scale of the derived history.
SPAM_ENTITIES, SPAM_MEAN = 30, 2600
MIN_DOWNLOADS = 1000

_queries: dict[str, Query] = {}


def _plain(name: str, operator: Callable[..., DataFrame], **params) -> None:
    """Register an operator over (snapshots, runs)."""
    _queries[name] = lambda spark, sf_dir: operator(*star_history(spark, sf_dir), **params)


def _from_totals(name: str, operator: Callable[..., DataFrame]) -> None:
    """Register an operator over the totals of each run, which reads no snapshots."""
    _queries[name] = lambda spark, sf_dir: operator(
        *star_history(spark, sf_dir), totals=star_totals(spark, sf_dir)
    )


def _query(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a function of (spark, sf_dir) under its own name."""
    _queries[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_queries)


# Runs
_SHOWN = ("skill_id", "slug", "display_name", "owner_handle", "stat_downloads", "created_at")
_plain("snapshot_count", runs.snapshot_counts)
_queries["current_entities"] = lambda s, d: runs.current(*star_history(s, d)).select(*_SHOWN)
_queries["previous_entities"] = lambda s, d: runs.previous(*star_history(s, d)).select(*_SHOWN)

# Lists
_plain("top_by_downloads", rankings.top_by_downloads)
_plain("top_by_stars", rankings.top_by_stars)
_plain("most_versions", rankings.most_versions)
_plain("star_rate", rankings.star_rate, min_downloads=MIN_DOWNLOADS)
_plain("hot_new", rankings.hot_new, now=NOW)
_plain("download_growth", rankings.download_growth)
_plain("rising_by_pct", rankings.rising_by_pct, now=NOW)
_plain("rising_recent", rankings.rising_recent)
_plain("detail_keys", rankings.detail_keys, now=NOW)

# Differences
_plain("diff_new", diff.diff_new)
_plain("diff_removed", diff.diff_removed)
_plain("diff_changed", diff.diff_changed)
_plain("diff_changes_long", diff.diff_changes_long)
_plain("diff_counts", diff.diff_counts)
_plain("diff_all_runs", diff.diff_all_runs)
_queries["diff_pair"] = lambda s, d: diff.pair_counts(star_history(s, d).snapshots, 7, FAILED_RUN)

# The whole catalogue
_plain("platform_totals", growth.platform_totals)
_plain("top_share", growth.top_share)
_from_totals("run_totals", growth.run_totals)
_plain("run_percentiles", growth.run_percentiles)
_plain("weekly_new", growth.weekly_new)
_plain("weekly_growth", growth.weekly_growth, now=NOW)
_plain("avg_wow", growth.avg_wow, now=NOW)
_plain("growth_timeline", growth.growth_timeline)
_from_totals("download_wow", growth.download_wow)
_from_totals("platform_velocity", growth.platform_velocity)
_from_totals("avg_platform_velocity", growth.avg_platform_velocity)
_plain("cohort_quality", cohorts.cohort_quality, now=NOW)
_plain("cohort_percentiles", cohorts.cohort_percentiles, now=NOW)
_plain("median_rate_windows", cohorts.median_rate_windows, now=NOW)

# Momentum
_plain("velocity", momentum.velocity)
_plain("fastest_growing", momentum.fastest_growing, now=NOW, min_downloads=MIN_DOWNLOADS)
_plain("leaderboard_all_time", momentum.leaderboard_all_time, now=NOW)

# Owners
_plain("owner_leaderboard", owners.owner_leaderboard)
_plain("owner_spam", owners.owner_spam, min_entities=SPAM_ENTITIES, max_mean_downloads=SPAM_MEAN)
_plain("owner_stats", owners.owner_stats, now=NOW)
_plain("owners_by_downloads", owners.owners_by, key="total_downloads", now=NOW)
_plain("owners_by_stars", owners.owners_by, key="total_stars", now=NOW)
_plain("owners_by_count", owners.owners_by, key="skill_count", now=NOW)
_plain("owner_portfolio", owners.owner_portfolio, now=NOW)
_plain("owner_entities", owners.owner_entities, now=NOW)
_plain("owner_trajectory", owners.owner_trajectory)
_plain("owner_count_mom", owners.owner_count_mom)
_plain("detail_owners", owners.detail_owners)

# Histories
_plain("entity_history", history.entity_history)
_plain("version_releases", history.version_releases)


def _joined(numbers: str) -> Column:
    """An array as text, so that results compare as plain values."""
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")


@_query
def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = rankings.rising(*star_history(spark, sf_dir), now=NOW)
    return listed.withColumn("velocity_chart", _joined("velocity_chart"))


@_query
def rising_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = rankings.rising_by_rate(*star_history(spark, sf_dir), now=NOW)
    return listed.withColumn("velocity_chart", _joined("velocity_chart"))


@_query
def velocity_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = momentum.velocity_chart(*star_history(spark, sf_dir))
    return charts.withColumn("velocity_chart", _joined("velocity_chart"))


@_query
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = history.entity_detail(*star_history(spark, sf_dir), now=NOW)
    return detail.withColumn("tags", F.array_join("tags", ","))


@_query
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = diff.diff_summary(*star_history(spark, sf_dir))
    return listed.withColumn("n_changes", F.array_size("changes")).drop("changes")


@_query
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = report(
        *star_history(spark, sf_dir),
        now=NOW,
        star_rate_min_downloads=MIN_DOWNLOADS,
        spam_min_entities=SPAM_ENTITIES,
        spam_max_mean_downloads=SPAM_MEAN,
    )
    return report_contents(tables)


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and slugs of customers used as handles, so that each key occurs twice."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    names = customers.select(F.col("c_name").alias("owner_handle"))
    slugs = customers.select(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    return names.union(slugs)


_queries["owner_key"] = lambda s, d: owners.owner_keys(_handles(s, d))
_queries["owner_key_collisions"] = lambda s, d: owners.owner_key_collisions(_handles(s, d))


# Ingest
@_query
def epoch_ms_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # Millisecond values with a fraction, as the service sends floats.
    ms = scalars.ts_to_epoch_ms(F.col("o_orderdate")) + F.col("o_orderkey") * 0.25
    return orders.select("o_orderkey", scalars.epoch_ms_to_ts(ms).alias("created_at"))


@_query
def flatten_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs as page documents in JSON text, parsed and flattened again."""
    pages = landed.pages(star_history(spark, sf_dir).snapshots)
    parsed = pages.select(
        "run", F.from_json(F.to_json(F.struct("cursor", "status", "value")), PAGE).alias("page")
    )
    items = parsed.select("run", F.explode("page.value.page").alias("item"))
    return page_source.flatten_items(items, F.col("run")).select(
        "scrape_run_id",
        "skill_id",
        "slug",
        "display_name",
        "summary",
        "created_at",
        "updated_at",
        "badges",
        "tags",
        "stat_downloads",
        "stat_stars",
        "stat_comments",
        "stat_installs_all_time",
        "stat_installs_current",
        "stat_versions",
        "owner_handle",
        "owner_handle_top",
        "version_number",
        "version_changelog",
    )


@_query
def dumped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the newest run dumped as JSON and read back."""
    folder = shared_folder(spark)
    items = landed.raw_items(runs.current(*star_history(spark, sf_dir))).select("item")
    page_source.dump_items(items, folder)
    stats = "struct<downloads:double,stars:double>"
    owner, version = "struct<handle:string>", "struct<version:string>"
    return spark.read.schema(
        f"skill_id string, display_name string, created_at double, stats {stats}, "
        f"owner {owner}, latest_version {version}, owner_handle string"
    ).json(folder).select(
        "skill_id",
        "display_name",
        F.col("created_at").cast("bigint").alias("created_ms"),
        "stats.downloads",
        "stats.stars",
        "owner.handle",
        "latest_version.version",
        "owner_handle",
    )


@_query
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the history taken as one run: entities of several runs repeat."""
    rows = star_history(spark, sf_dir).snapshots.withColumn("scrape_run_id", F.lit(1))
    return page_source.key_violations(rows)


# Ids of runs that land besides those of the history.
EMPTY_RUN = RUNS + 1



class Loaded(NamedTuple):
    table: HistoryTable
    log: RunLog
    feed: ChangeFeed


_loaded: dict[tuple[str, str], Loaded] = {}


def _load(spark: SparkSession, sf_dir: str) -> Loaded:
    """Land all runs as page files and load them with the streaming job, once per application.

    One run has a page with an error, and one has no items. The job's clock goes on by 90 seconds
    whenever it is asked.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        folder = shared_folder(spark)
        landed.land(star_history(spark, sf_dir).snapshots, f"{folder}/landing", FAILED_RUN, EMPTY_RUN)
        name = "loaded_" + folder.rsplit("-", 1)[1]
        table = HistoryTable(
            spark, name, f"{folder}/snapshots", spark.sparkContext.defaultParallelism
        )
        log, feed = RunLog(spark, f"{folder}/runs"), ChangeFeed(spark, f"{folder}/changes")
        ticks = count()
        query = ingest_stream(
            spark,
            f"{folder}/landing",
            table,
            log,
            f"{folder}/checkpoint",
            clock=lambda: NOW + next(ticks) * timedelta(seconds=90),
            feed=feed,
        )
        query.awaitTermination()
        _loaded[key] = Loaded(table, log, feed)
    return _loaded[key]


@_query
def latest_completed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the run log that the load job wrote, like the next queries."""
    return runs.latest_completed(_load(spark, sf_dir).log.frame())


@_query
def run_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.get_run(_load(spark, sf_dir).log.frame(), 7)


@_query
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.momentum_buckets(_load(spark, sf_dir).log.frame())


@_query
def ingest_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir).log.frame()


@_query
def ingest_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup that the load job keeps."""
    return _load(spark, sf_dir).log.totals()


@_query
def ingest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _load(spark, sf_dir)
    return loaded.table.frame(loaded.log).select(
        "scrape_run_id", "skill_id", "created_at", "stat_downloads", "owner_handle", "tags"
    )


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _load(spark, sf_dir)
    return loaded.feed.frame(loaded.log)


@_query
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed that the load job wrote; fields of changed entities are counted."""
    return _feed(spark, sf_dir).withColumn("changes", F.array_size("changes"))


@_query
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.feed_counts(_feed(spark, sf_dir))


@_query
def feed_changes_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.feed_changes_long(_feed(spark, sf_dir))


# Published documents
_published: dict[tuple[str, str], str] = {}


def _publish(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _published:
        folder = shared_folder(spark)
        publisher.publish(
            *star_history(spark, sf_dir), folder, now=NOW, min_downloads=MIN_DOWNLOADS
        )
        _published[key] = folder
    return _published[key]


@_query
def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the four page documents in long form, read back from the files."""
    folder = _publish(spark, sf_dir)

    def entries(page: str, section: str, key: str | None, value: str) -> DataFrame:
        kind = f"struct<{key}:string,{value}:bigint>" if key else "bigint"
        document = spark.read.schema(f"{section} array<{kind}>").json(f"{folder}/{page}")
        return document.select(F.posexplode(section).alias("at", "entry")).select(
            F.lit(page).alias("page"),
            F.lit(section).alias("section"),
            (F.col("at") + 1).alias("position"),
            (F.col(f"entry.{key}") if key else F.lit(None).cast("string")).alias("key"),
            F.col(f"entry.{value}" if key else "entry").alias("value"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            entries("dashboard", "weekly_growth", "week_start", "cumulative"),
            entries("dashboard", "download_sparkline", None, "total_downloads"),
            entries("dashboard", "download_percentiles", "run_date", "skill_count"),
            entries("rising", "skills", "skill_id", "delta"),
            entries("leaderboard", "all_time", "skill_id", "stat_downloads"),
            entries("leaderboard", "fastest_growing", "skill_id", "stat_downloads"),
            entries("owners", "by_downloads", "handle", "total_downloads"),
            entries("owners", "by_stars", "handle", "total_stars"),
            entries("owners", "by_skill_count", "handle", "skill_count"),
        ],
    )


@_query
def published_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History points and releases of the published entity documents, in long form."""
    point = "struct<run_date:timestamp_ntz,downloads:bigint,stars:bigint>"
    release = "struct<version_number:string,run_date:timestamp_ntz,changelog:string>"
    written = spark.read.schema(
        f"slug string, history array<{point}>, version_releases array<{release}>"
    ).json(f"{_publish(spark, sf_dir)}/entity_details")
    points = written.select("slug", F.explode("history").alias("p"), F.lit("point").alias("kind"))
    releases = written.select(
        "slug", F.explode("version_releases").alias("r"), F.lit("release").alias("kind")
    )
    return points.select(
        "slug", "kind", "p.run_date", "p.downloads", F.lit(None).cast("string").alias("version")
    ).unionByName(
        releases.select(
            "slug",
            "kind",
            "r.run_date",
            F.lit(None).cast("bigint").alias("downloads"),
            F.col("r.version_number").alias("version"),
        )
    )


@_query
def detail_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every slug that customers have or could have, by key."""
    keys = _handles(spark, sf_dir).select("owner_handle")
    found = publisher.find_details(
        spark, _publish(spark, sf_dir), "entities", keys, "stat_downloads bigint, display_name string"
    )
    return found.select("slug", "found", "display_name", "stat_downloads")


@_query
def published_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory of the published owner documents, in long form."""
    step = "struct<run_date:timestamp_ntz,downloads:bigint,stars:bigint>"
    written = spark.read.schema(
        f"owner_key string, skill_count bigint, trajectory array<{step}>"
    ).json(f"{_publish(spark, sf_dir)}/owner_details")
    return written.select("owner_key", "skill_count", F.inline("trajectory"))


@_query
def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = publisher.published_index(spark, _publish(spark, sf_dir))
    return index.withColumn("available", F.array_join("available", ","))


@_query
def owner_document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.owner_document_entities(*star_history(spark, sf_dir), now=NOW)
