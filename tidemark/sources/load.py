"""The load job: landed pages of one or more runs into the history and the run log."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.diff import change_rows, diff_all_runs, feed_counts
from tidemark.sources.feed import ChangeFeed
from tidemark.sources.pages import (
    check_runs,
    flatten_items,
    is_good,
    page_items,
    quarantined,
    write_quarantine,
)
from tidemark.sources.tables import (
    Event,
    HistoryTable,
    RunLog,
    lookup,
    next_event,
    small_frame,
)

log = logging.getLogger(__name__)

# What a diff needs of a run log.
_COMPLETED = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
])
_DIFFERENCES = ("new_skills", "removed_skills", "changed_skills")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class DuplicateKeys(ValueError):
    """A run holds an entity twice or an entity without id."""


class BadPage(ValueError):
    """A landed page has a status other than 'success', or a line of a file is damaged."""


def load_run(
    pages: DataFrame,
    history: HistoryTable,
    run_log: RunLog,
    *,
    run_id: int | None = None,
    **options,
) -> int:
    """Load the pages of one run, the next free one unless given, and return its id.

    As `load_runs`, but the fault of the run, if there is one, is raised.
    """
    run_id = run_id or max(run_log.states(), default=0) + 1
    numbered = pages.withColumn("run", F.lit(run_id))
    fault = load_runs(numbered, [run_id], history, run_log, **options).get(run_id)
    if fault:
        raise fault
    return run_id


def load_runs(
    pages: DataFrame | None,
    run_ids: Iterable[int],
    history: HistoryTable,
    run_log: RunLog,
    *,
    clock: Callable[[], datetime] = utc_now,
    on_bad_page: str = "fail",
    on_duplicate: str = "fail",
    broken: Mapping[int, Exception] | None = None,
    feed: ChangeFeed | None = None,
    quarantine: str | None = None,
) -> dict[int, Exception]:
    """Load the runs `run_ids` from `pages`, which has a column `run`; returns faults in the data.

    Each run becomes 'completed' with its size, its totals and its diff counts against the completed
    run before it; the counts of the completed run after it, if there is one, are taken anew. Rows
    are first staged as a new version of the run, checked and counted. Then one append to the log
    publishes the rows of all runs with their figures and those of their successors: whatever fails
    before leaves everything as it was, nothing can fail in between.

    A bad or damaged page, or a repeated or missing key, makes its run 'failed', unless it was
    completed before, and so does an empty catalogue, which is no fault to report. `broken` runs fail
    without being read. Any other error fails all the runs and is raised. `on_bad_page="keep"` loads
    the good pages. `on_duplicate="drop"` keeps of each repeated key the row updated last, and drops
    rows without a key; how many rows went is logged.

    With a `feed` the changes of the loaded runs and of the runs after them are stored as well, and
    published by the same append. Pages that are not loaded go to the folder `quarantine`, if given,
    with their files and texts; good pages are read once, and no value of a bad one is used.
    """
    if on_bad_page not in ("fail", "keep"):
        raise ValueError(f"on_bad_page must be 'fail' or 'keep', not {on_bad_page!r}")
    faults = dict(broken or {})
    wanted = sorted({*run_ids} - faults.keys())
    if not wanted and not faults:
        return {}
    opened = run_log.start(clock(), *sorted({*wanted, *faults}))
    try:
        latest = run_log.latest()
        published = run_log.versions()
        history.vacuum(published, opened)
        checks = {}
        if wanted:
            versions = {run: opened[run].attempt for run in wanted}
            # Bad pages are noted while the good ones are loaded.
            seen = Observation()
            bad = F.when(~is_good(pages), F.col("run"))
            watched = pages.observe(seen, F.collect_set(bad).alias("runs"))
            rows = flatten_items(page_items(watched, "keep", "run"), F.col("run"))
            if on_duplicate == "drop":
                rows = _one_per_key(rows)
            # The staged rows are bucketed by entity, so neither the check nor the counts shuffle
            # entities, and the pages are parsed once.
            staged = history.stage(rows, versions)
            checks = {r.scrape_run_id: r for r in check_runs(staged).collect()}
            # Spark drops what it observes with the rest of a plan that gives no row at all.
            missed = pages.where(bad.isNotNull()).select("run").distinct()
            damaged = sorted(seen.get["runs"] if checks else [r.run for r in missed.collect()])
            if damaged and quarantine:
                of_run = {run: versions[run] for run in damaged}
                found = quarantined(pages.where(F.col("run").isin(damaged)))
                attempt = lookup(of_run, F.col("run")).alias("attempt")
                write_quarantine(found.select("*", attempt), quarantine)
            if on_bad_page == "fail":
                faults |= {run: BadPage(f"run {run} has bad or damaged pages") for run in damaged}
        for run, found in checks.items():
            if found.bad_keys and run not in faults:
                faults[run] = DuplicateKeys(
                    f"run {run}: {found.bad_keys} repeated or missing keys, such as {found.example!r}"
                )
        sound = [run for run in checks if run not in faults]
        counts = _counts(
            history, published | {run: versions[run] for run in sound}, sound, latest, feed
        )
        now = clock()
        events = [
            next_event(
                opened[run],
                "completed",
                now,
                total_skills=checks[run].rows,
                total_downloads=checks[run].total_downloads,
                total_stars=checks[run].total_stars,
                **counts.get(run, {}),
            )
            for run in sound
        ]
        events += [next_event(e, "failed", now) for run, e in opened.items() if run not in sound]
        events += [
            next_event(latest[run], "completed", latest[run].finished_at, **figures)
            for run, figures in counts.items()
            if run not in sound
        ]
        run_log.append(events)
        return faults
    except Exception:
        try:
            run_log.append([next_event(e, "failed", clock()) for e in opened.values()])
        except Exception:
            # The attempts stay 'running', which no reader takes for more than that.
            log.exception("the failure of runs %s could not be logged", sorted(opened))
        raise


def _counts(
    history: HistoryTable,
    versions: Mapping[int, int],
    loaded: list[int],
    latest: Mapping[int, Event],
    feed: ChangeFeed | None,
) -> dict[int, dict[str, int]]:
    """Diff counts of the loaded runs and of the runs that follow one, in one pass.

    `versions` are those of all runs that will be completed. Of them only the counted runs and
    their predecessors are read; a run without predecessor has no counts. With a feed the changes are
    written first, and counted there.
    """
    order = sorted(versions)
    before = dict(zip(order[1:], order))
    counted = [run for run in before if run in loaded or before[run] in loaded]
    scope = {run: versions[run] for run in {*counted, *[before[run] for run in counted]}}
    if not scope:
        return {}
    known = small_frame(history.spark, [(run, None, "completed") for run in scope], _COMPLETED)
    if feed is None:
        found = diff_all_runs(history.at(scope), known).where(F.col("scrape_run_id").isin(counted))
        return {r.scrape_run_id: {name: r[name] for name in _DIFFERENCES} for r in found.collect()}
    published = {run: latest[run].feed if run in latest else 0 for run in counted}
    feed.vacuum(published)
    stored = {run: version + 1 for run, version in published.items()}
    changes = change_rows(history.at(scope), known).where(F.col("scrape_run_id").isin(counted))
    found = {r.scrape_run_id: r for r in feed_counts(feed.stage(changes, stored)).collect()}
    return {
        run: {name: found[run][name] if run in found else 0 for name in _DIFFERENCES}
        | {"feed": version if run in found else 0}
        for run, version in stored.items()
    }


def _one_per_key(rows: DataFrame) -> DataFrame:
    """The row updated last of each run and key, ties by all columns; counts what goes."""
    columns = rows.columns
    order = F.struct("updated_at", *[c for c in columns if c != "updated_at"])
    best = (
        rows.where("skill_id IS NOT NULL")
        .groupBy("scrape_run_id", "skill_id")
        .agg(F.max_by(F.struct(*columns), order).alias("row"), F.count(F.lit(1)).alias("n"))
    )
    dropped = rows.agg(
        F.count_if(F.col("skill_id").isNull())
        + F.count("skill_id")
        - F.count_distinct("scrape_run_id", "skill_id")
    ).first()[0]
    if dropped:
        log.warning("%s rows with a repeated or missing key are left out", dropped)
    return best.select("row.*")
