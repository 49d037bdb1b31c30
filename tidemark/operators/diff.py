"""Differences between runs. A run is an id or a one-row frame, see `runs.rows_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranking import top_k
from tidemark.functions.scalars import label
from tidemark.operators.runs import completed, latest_pair, latest_pair_rows, rows_of
from tidemark.schema import REPORT_LIMIT, TRACKED_FIELDS

_LISTED = ("skill_id", "slug", "display_name", "owner_handle", "stat_downloads")


def _by_downloads(column: str = "stat_downloads") -> tuple:
    return F.desc(column), "skill_id"


def _any_changed() -> Column:
    """Whether a tracked field differs from its `prev_` column."""
    return F.expr(" OR ".join(f"NOT ({f} <=> prev_{f})" for f in TRACKED_FIELDS))


def _as_previous(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("skill_id", *[f"{f} AS prev_{f}" for f in TRACKED_FIELDS])


def _only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*_LISTED).join(right.select("skill_id"), "skill_id", "left_anti")


def new_entities(snapshots: DataFrame, current: int, previous: int) -> DataFrame:
    """Entities of the current run missing from the previous one, by downloads."""
    listed = _only_in(rows_of(snapshots, current), rows_of(snapshots, previous))
    return listed.orderBy(*_by_downloads())


def removed_entities(snapshots: DataFrame, current: int, previous: int) -> DataFrame:
    """Entities of the previous run missing from the current one, with their previous values."""
    return new_entities(snapshots, previous, current)


def _changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    values = [e for f in TRACKED_FIELDS for e in (f"prev_{f}", f"{f} AS curr_{f}")]
    return (
        current.select("skill_id", "slug", *TRACKED_FIELDS)
        .join(_as_previous(previous), "skill_id")
        .where(_any_changed())
        .selectExpr("skill_id", "slug", "display_name", *values)
    )


def changed_entities(snapshots: DataFrame, current: int, previous: int) -> DataFrame:
    """Entities of both runs where a tracked field differs, with `prev_` and `curr_` columns."""
    changed = _changed(rows_of(snapshots, current), rows_of(snapshots, previous))
    return changed.orderBy(*_by_downloads("curr_stat_downloads"))


def _changed_fields() -> Column:
    """Array of (field, from_value, to_value) for the fields that differ, values as text."""
    entries = ", ".join(
        f"struct('{f}' AS field, string(prev_{f}) AS from_value, string(curr_{f}) AS to_value)"
        for f in TRACKED_FIELDS
    )
    return F.expr(f"filter(array({entries}), e -> NOT (e.from_value <=> e.to_value))")


def changes_long(changed: DataFrame) -> DataFrame:
    """One row per changed field of `changed_entities`: skill_id, field, from_value, to_value."""
    return changed.select("skill_id", F.explode(_changed_fields()).alias("change")).select(
        "skill_id", "change.*"
    )


def _counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One full outer join gives all three counts."""
    now = current.select("skill_id", *TRACKED_FIELDS).withColumn("is_now", F.lit(True))
    before = _as_previous(previous).withColumn("was_before", F.lit(True))
    joined = now.join(before, "skill_id", "full_outer")
    in_both = F.col("is_now").isNotNull() & F.col("was_before").isNotNull()
    return joined.agg(
        F.count_if(F.col("was_before").isNull()).alias("new_skills"),
        F.count_if(F.col("is_now").isNull()).alias("removed_skills"),
        F.count_if(in_both & _any_changed()).alias("changed_skills"),
    )


def pair_counts(snapshots: DataFrame, current: int, previous: int) -> DataFrame:
    """One row: new, removed and changed entities between two runs."""
    return _counts(rows_of(snapshots, current), rows_of(snapshots, previous))


def diff_new(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """`new_entities` of the two newest completed runs."""
    now, before = latest_pair_rows(snapshots, runs)
    return _only_in(now, before).orderBy(*_by_downloads())


def diff_removed(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    now, before = latest_pair_rows(snapshots, runs)
    return _only_in(before, now).orderBy(*_by_downloads())


def diff_changed(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    now, before = latest_pair_rows(snapshots, runs)
    return _changed(now, before).orderBy(*_by_downloads("curr_stat_downloads"))


def diff_changes_long(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    now, before = latest_pair_rows(snapshots, runs)
    return changes_long(_changed(now, before))


def diff_counts(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts for the two newest completed runs, with both run ids and their sizes.

    The sizes follow from the join as well, so each run is read once.
    """
    current = latest_pair(runs).select("current_run_id").scalar()
    counts = diff_all_runs(snapshots, runs, last=2)
    return counts.where(F.col("scrape_run_id") == current).select(
        F.col("scrape_run_id").alias("current_run_id"),
        "previous_run_id",
        "previous_skills",
        "total_skills",
        "new_skills",
        "removed_skills",
        "changed_skills",
    )


def diff_all_runs(snapshots: DataFrame, runs: DataFrame, last: int | None = None) -> DataFrame:
    """Size and diff counts of every completed run against the completed run before it.

    One pass over each entity's own rows in run order: a row whose predecessor is not of the run
    before is new, a row whose successor is not of the run after was removed there. An entity has
    at most one row per run, so the window's groups are small. `last` restricts to the newest runs.
    """
    order = Window.orderBy("scrape_run_id")  # over the run log only
    done = completed(runs).select("scrape_run_id")
    if last is not None:
        done = done.orderBy(F.desc("scrape_run_id")).limit(last)
    steps = done.select(
        "scrape_run_id",
        F.lag("scrape_run_id").over(order).alias("run_before"),
        F.lead("scrape_run_id").over(order).alias("run_after"),
    )
    w = Window.partitionBy("skill_id").orderBy("scrape_run_id")
    tracked = F.struct(*TRACKED_FIELDS)
    rows = snapshots.join(steps, "scrape_run_id").select(
        "scrape_run_id",
        "run_before",
        "run_after",
        F.lag("scrape_run_id").over(w).eqNullSafe(F.col("run_before")).alias("known"),
        F.lead("scrape_run_id").over(w).eqNullSafe(F.col("run_after")).alias("stays"),
        (~tracked.eqNullSafe(F.lag(tracked).over(w))).alias("differs"),
    )
    has_before = F.col("run_before").isNotNull()
    per_run = rows.groupBy("scrape_run_id", "run_before", "run_after").agg(
        F.count(F.lit(1)).alias("total_skills"),
        F.count_if(has_before & ~F.col("known")).alias("new_skills"),
        F.count_if(has_before & F.col("known") & F.col("differs")).alias("changed_skills"),
        F.count_if(F.col("run_after").isNotNull() & ~F.col("stays")).alias("leaving"),
    )
    # One row per run from here on.
    sizes = steps.select("scrape_run_id", "run_before").join(
        per_run.drop("run_before", "run_after"), "scrape_run_id", "left"
    )
    return sizes.select(
        "scrape_run_id",
        F.col("run_before").alias("previous_run_id"),
        F.coalesce(F.lag("total_skills").over(order), F.lit(0)).alias("previous_skills"),
        F.coalesce(F.col("total_skills"), F.lit(0)).alias("total_skills"),
        F.coalesce(F.col("new_skills"), F.lit(0)).alias("new_skills"),
        F.coalesce(F.lag("leaving").over(order), F.lit(0)).alias("removed_skills"),
        F.coalesce(F.col("changed_skills"), F.lit(0)).alias("changed_skills"),
    )


def change_rows(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """What every completed run added, removed and changed, with the columns of `schema.CHANGES`.

    One pass over each entity's own rows in run order, as in `diff_all_runs`: each row says whether
    it is new or changed in its run, and whether it is gone in the run after. Runs without a run
    before them have no changes. The loads store these rows as the change feed.
    """
    order = Window.orderBy("scrape_run_id")  # over the run log only
    steps = completed(runs).select(
        "scrape_run_id",
        F.lag("scrape_run_id").over(order).alias("run_before"),
        F.lead("scrape_run_id").over(order).alias("run_after"),
    )
    w = Window.partitionBy("skill_id").orderBy("scrape_run_id")
    earlier = [F.lag(f).over(w).alias(f"prev_{f}") for f in TRACKED_FIELDS]
    rows = snapshots.join(steps, "scrape_run_id").select(
        "scrape_run_id",
        "run_before",
        "run_after",
        F.lag("scrape_run_id").over(w).eqNullSafe(F.col("run_before")).alias("known"),
        F.lead("scrape_run_id").over(w).eqNullSafe(F.col("run_after")).alias("stays"),
        "skill_id",
        "slug",
        *TRACKED_FIELDS,
        *earlier,
    )
    here = F.when(~F.col("known"), "new").when(_any_changed(), "changed")
    came = F.when(F.col("run_before").isNotNull() & here.isNotNull(), F.struct(
        here.alias("kind"),
        F.col("run_before").alias("previous_run_id"),
        F.col("scrape_run_id").alias("run"),
    ))
    went = F.when(F.col("run_after").isNotNull() & ~F.col("stays"), F.struct(
        F.lit("removed").alias("kind"),
        F.col("scrape_run_id").alias("previous_run_id"),
        F.col("run_after").alias("run"),
    ))
    entries = ", ".join(
        f"if({f} <=> prev_{f}, NULL, struct('{f}' AS field, string(prev_{f}) AS from_value,"
        f" string({f}) AS to_value))"
        for f in TRACKED_FIELDS
    )
    changes = F.expr(f"filter(array({entries}), e -> e IS NOT NULL)")
    return (
        rows.withColumn("event", F.explode(F.array_compact(F.array(came, went))))
        .select(
            "event.kind",
            "skill_id",
            "slug",
            "display_name",
            "owner_handle",
            "stat_downloads",
            F.when(F.col("event.kind") == "changed", changes).alias("changes"),
            "event.previous_run_id",
            F.col("event.run").alias("scrape_run_id"),
        )
    )


def feed_counts(feed: DataFrame) -> DataFrame:
    """Diff counts of each run that has changes, from the change feed: no snapshot is read."""
    return feed.groupBy("scrape_run_id", "previous_run_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_skills") for k in ("new", "removed", "changed")]
    )


def feed_changes_long(feed: DataFrame) -> DataFrame:
    """One row per changed field of the feed: scrape_run_id, skill_id, field, from_value, to_value."""
    return feed.select("scrape_run_id", "skill_id", F.inline("changes"))


def diff_summary(snapshots: DataFrame, runs: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """First rows of the diff lists: section, rank, skill_id, label, owner_handle, changes.

    `changes` is the array of changed fields, NULL for the new and removed sections. Totals and
    counts of the same pair are `diff_counts`.
    """
    now, before = latest_pair_rows(snapshots, runs)
    change = "array<struct<field:string,from_value:string,to_value:string>>"

    def listed(section: str, rows: DataFrame) -> DataFrame:
        return top_k(rows, limit, *_by_downloads()).select(
            F.lit(section).alias("section"),
            "rank",
            "skill_id",
            label(F.col("display_name"), F.col("slug")).alias("label"),
            "owner_handle",
            F.lit(None).cast(change).alias("changes"),
        )

    top_changed = top_k(_changed(now, before), limit, *_by_downloads("curr_stat_downloads"))
    changed = top_changed.select(
        F.lit("changed").alias("section"),
        "rank",
        "skill_id",
        label(F.col("display_name"), F.col("slug")).alias("label"),
        F.col("curr_owner_handle").alias("owner_handle"),
        _changed_fields().alias("changes"),
    )
    return (
        listed("new", _only_in(now, before))
        .unionByName(listed("removed", _only_in(before, now)))
        .unionByName(changed)
    )
