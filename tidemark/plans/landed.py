"""Response pages made from the star history, as input for the load jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ts_to_epoch_ms
from tidemark.schema import ITEM, ITEMS_PER_PAGE, PAGE


def raw_items(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows in the nested shape of the response: (scrape_run_id, skill_id, item)."""
    number = {
        "downloads": "stat_downloads",
        "stars": "stat_stars",
        "comments": "stat_comments",
        "installsAllTime": "stat_installs_all_time",
        "installsCurrent": "stat_installs_current",
        "versions": "stat_versions",
    }
    stats = F.struct(*[(F.col(c) + 0.75).alias(n) for n, c in number.items()])
    nothing = F.parse_json(F.lit("{}"))
    skill = F.struct(
        F.col("skill_id").alias("_id"),
        "slug",
        F.col("display_name").alias("displayName"),
        "summary",
        ts_to_epoch_ms(F.col("created_at")).alias("createdAt"),
        ts_to_epoch_ms(F.col("updated_at")).alias("updatedAt"),
        nothing.alias("badges"),
        F.parse_json(F.to_json(F.create_map(F.lit("segment"), F.col("summary")))).alias("tags"),
        stats.alias("stats"),
    )
    owner = F.struct(
        F.lit(None).alias("_id"),
        F.col("owner_handle").alias("handle"),
        F.col("owner_display_name").alias("displayName"),
        F.col("owner_name").alias("name"),
        F.col("owner_image").alias("image"),
    )
    version = F.struct(
        F.col("version_id").alias("_id"),
        F.col("version_number").alias("version"),
        F.col("version_changelog").alias("changelog"),
        F.col("version_changelog_source").alias("changelogSource"),
        ts_to_epoch_ms(F.col("version_created_at")).alias("createdAt"),
    )
    item = F.struct(
        F.col("owner_handle").alias("ownerHandle"),
        skill.alias("skill"),
        # An unowned item has no owner object at all.
        F.when(F.col("owner_handle").isNotNull(), owner).alias("owner"),
        version.alias("latestVersion"),
    )
    return snapshots.select("scrape_run_id", "skill_id", item.cast(ITEM).alias("item"))


def pages(snapshots: DataFrame) -> DataFrame:
    """Pages of at most `ITEMS_PER_PAGE` items per run: (run, cursor, status, value)."""
    number = F.expr(f"bigint(substring(skill_id, 2)) div {ITEMS_PER_PAGE}")
    grouped = (
        raw_items(snapshots)
        .groupBy(F.col("scrape_run_id").alias("run"), number.alias("number"))
        .agg(F.collect_list("item").alias("page"))
    )
    # Numbers of pages may have gaps; each page names the next one there is.
    in_order = Window.partitionBy("run").orderBy("number")
    chain = grouped.select("run", "number").select(
        "*",
        F.lead("number").over(in_order).alias("following"),
        (F.row_number().over(in_order) > 1).alias("continues"),
    )
    more = F.col("following").isNotNull()
    value = F.struct(
        F.when(more, F.concat(F.lit("page-"), F.col("following"))).alias("nextCursor"),
        more.alias("hasMore"),
        "page",
    )
    cursor = F.when(F.col("continues"), F.concat(F.lit("page-"), F.col("number")))
    return grouped.join(chain, ["run", "number"]).select(
        "run",
        cursor.alias("cursor"),
        F.lit("success").alias("status"),
        value.cast(PAGE["value"].dataType).alias("value"),
    )


def land(
    snapshots: DataFrame, folder: str, bad_run: int | None = None, empty_run: int | None = None
) -> None:
    """Write pages as `<folder>/run=<id>/*.json`.

    `bad_run` gets a page with an error status, `empty_run` is a run whose only page has no items.
    Pages are written by the tasks that group them; as text they take ten times the room of the
    compressed files.
    """
    landed = pages(snapshots)

    def more(run: int, cursor: str | None, status: str, value: str) -> DataFrame:
        return landed.sparkSession.range(1, numPartitions=1).select(
            F.lit(run).cast("int").alias("run"),
            F.lit(cursor).cast("string").alias("cursor"),
            F.lit(status).alias("status"),
            F.from_json(F.lit(value), PAGE["value"].dataType).alias("value"),
        )

    if bad_run is not None:
        landed = landed.unionByName(more(bad_run, "page-error", "error", "null"))
    if empty_run is not None:
        nothing = '{"page": [], "hasMore": false}'
        landed = landed.unionByName(more(empty_run, None, "success", nothing))
    landed.write.partitionBy("run").option("compression", "gzip").json(folder)
