"""Landed response pages: reading, flattening to snapshot rows, key checks, JSON dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import epoch_ms_to_ts, json_text
from tidemark.schema import PAGE, QUARANTINED, SNAPSHOTS

# The text of a line that is no page, or of a page in which a value has another type than declared.
DAMAGED = "_damaged"


def page_schema(page: T.StructType = PAGE, *more: T.StructField) -> T.StructType:
    return T.StructType([*page.fields, *more, T.StructField(DAMAGED, T.StringType())])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one JSON document per line, with the declared schema (no inference pass).

    Beside the columns of a page there are `file` and `_damaged`, the text of a damaged line. Spark
    reads what it can of such a line and leaves the rest null, so its values must not be used.
    """
    pages = spark.read.schema(page_schema()).option("columnNameOfCorruptRecord", DAMAGED).json(path)
    return pages.select("*", F.col("_metadata.file_path").alias("file"))


def is_good(pages: DataFrame) -> Column:
    """Whether a page can be loaded: a success, and nothing of it is damaged."""
    good = F.col("status").eqNullSafe("success")
    return good & F.col(DAMAGED).isNull() if DAMAGED in pages.columns else good


def quarantined(pages: DataFrame) -> DataFrame:
    """Pages that cannot be loaded, with the columns of `schema.QUARANTINED` but the attempt.

    The text of a damaged line is the line; that of a page with an error is written anew.
    """
    damaged = F.col(DAMAGED).isNotNull()
    return pages.where(~is_good(pages)).select(
        "file",
        "cursor",
        "status",
        F.when(damaged, "damaged").otherwise("status").alias("reason"),
        F.coalesce(DAMAGED, F.to_json(F.struct("cursor", "status", "value"))).alias("record"),
        F.col("run").cast("int").alias("run"),
    )


def write_quarantine(records: DataFrame, folder: str) -> None:
    """Write rows of `schema.QUARANTINED`; the records of the same run and attempt are replaced."""
    (
        records.select(*QUARANTINED.names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "attempt")
        .parquet(folder)
    )


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(QUARANTINED).parquet(folder)


def page_items(pages: DataFrame, on_bad_page: str = "fail", *keep: str) -> DataFrame:
    """One row per catalogue item: the columns of the page to `keep`, and `item`.

    A page whose status is not 'success', or that is damaged, fails the query; `on_bad_page="keep"`
    keeps the good pages.
    """
    good = is_good(pages)
    if on_bad_page == "keep":
        items = pages.where(good).select(*keep, F.explode("value.page").alias("item"))
    elif on_bad_page == "fail":
        problem = F.concat(
            F.lit("damaged page or page with status "),
            F.coalesce(F.col("status"), F.lit("(missing)")),
        )
        page = F.when(good, F.col("value.page")).otherwise(F.raise_error(problem))
        items = pages.select(*keep, F.explode(page).alias("item"))
    else:
        raise ValueError(f"on_bad_page must be 'fail' or 'keep', not {on_bad_page!r}")
    return items


def _counter(value: Column) -> Column:
    """Counters arrive as floats; the fraction is dropped and a missing counter is 0."""
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def flatten_items(items: DataFrame, run_id: int | Column) -> DataFrame:
    """Items to snapshot rows. Absent or null sub-objects give NULL columns."""
    skill, stats = "item.skill.", "item.skill.stats."
    owner, version = "item.owner.", "item.latestVersion."
    run = F.lit(run_id) if isinstance(run_id, int) else run_id
    columns = {
        "skill_id": F.col(skill + "_id"),
        "slug": F.col(skill + "slug"),
        "display_name": F.col(skill + "displayName"),
        "summary": F.col(skill + "summary"),
        "created_at": epoch_ms_to_ts(F.col(skill + "createdAt")),
        "updated_at": epoch_ms_to_ts(F.col(skill + "updatedAt")),
        "badges": json_text(F.col(skill + "badges")),
        "tags": json_text(F.col(skill + "tags")),
        "stat_downloads": _counter(F.col(stats + "downloads")),
        "stat_stars": _counter(F.col(stats + "stars")),
        "stat_comments": _counter(F.col(stats + "comments")),
        "stat_installs_all_time": _counter(F.col(stats + "installsAllTime")),
        "stat_installs_current": _counter(F.col(stats + "installsCurrent")),
        "stat_versions": _counter(F.col(stats + "versions")),
        "owner_user_id": F.col(owner + "_id"),
        "owner_handle": F.col(owner + "handle"),
        "owner_display_name": F.col(owner + "displayName"),
        "owner_name": F.col(owner + "name"),
        "owner_image": F.col(owner + "image"),
        "version_id": F.col(version + "_id"),
        "version_number": F.col(version + "version"),
        "version_changelog": F.col(version + "changelog"),
        "version_changelog_source": F.col(version + "changelogSource"),
        "version_created_at": epoch_ms_to_ts(F.col(version + "createdAt")),
        "owner_handle_top": F.col("item.ownerHandle"),
        "scrape_run_id": run.cast("int"),
    }
    return items.select(*[columns[name].alias(name) for name in SNAPSHOTS.fieldNames()])


def _per_key(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("scrape_run_id", "skill_id").agg(F.count(F.lit(1)).alias("rows"))


def _violated() -> Column:
    return F.col("skill_id").isNull() | (F.col("rows") > 1)


def check_runs(snapshots: DataFrame) -> DataFrame:
    """One row per run that has rows: scrape_run_id, rows, totals of the counters that the rollup
    holds, number of violated keys and one of them."""
    per_key = snapshots.groupBy("scrape_run_id", "skill_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("stat_downloads").alias("downloads"),
        F.sum("stat_stars").alias("stars"),
    )
    return per_key.groupBy("scrape_run_id").agg(
        F.sum("rows").alias("rows"),
        F.sum("downloads").alias("total_downloads"),
        F.sum("stars").alias("total_stars"),
        F.count_if(_violated()).alias("bad_keys"),
        F.min(F.when(_violated(), F.col("skill_id"))).alias("example"),
    )


def key_violations(snapshots: DataFrame) -> DataFrame:
    """Keys (scrape_run_id, skill_id) that are missing or occur more than once, with their count."""
    return _per_key(snapshots).where(_violated())


def dump_items(items: DataFrame, path: str) -> None:
    """Write the catalogue as JSON, one item per line: snake_case names, nested one level."""
    skill, stats = F.col("item.skill"), F.col("item.skill.stats")
    owner, version = F.col("item.owner"), F.col("item.latestVersion")

    def count(name: str) -> Column:
        return F.coalesce(stats[name], F.lit(0.0))

    nested = items.select(
        skill["_id"].alias("skill_id"),
        skill["slug"].alias("slug"),
        skill["displayName"].alias("display_name"),
        skill["summary"].alias("summary"),
        skill["createdAt"].alias("created_at"),
        skill["updatedAt"].alias("updated_at"),
        skill["badges"].alias("badges"),
        skill["tags"].alias("tags"),
        F.struct(
            count("downloads").alias("downloads"),
            count("stars").alias("stars"),
            count("comments").alias("comments"),
            count("installsAllTime").alias("installs_all_time"),
            count("installsCurrent").alias("installs_current"),
            count("versions").alias("versions"),
        ).alias("stats"),
        F.struct(
            owner["_id"].alias("user_id"),
            owner["handle"].alias("handle"),
            owner["displayName"].alias("display_name"),
            owner["name"].alias("name"),
            owner["image"].alias("image"),
        ).alias("owner"),
        F.struct(
            version["_id"].alias("version_id"),
            version["version"].alias("version"),
            version["changelog"].alias("changelog"),
            version["changelogSource"].alias("changelog_source"),
            version["createdAt"].alias("created_at"),
        ).alias("latest_version"),
        F.col("item.ownerHandle").alias("owner_handle"),
    )
    nested.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
