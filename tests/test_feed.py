"""The change feed against the joins of two runs, and the rollup against the history."""

import pytest

from tests.conftest import day
from tests.test_ingest import Clock, item, land, page
from tidemark.operators import diff, growth
from tidemark.schema import CHANGES
from tidemark.sources.feed import ChangeFeed
from tidemark.sources.load import load_run, load_runs
from tidemark.sources.pages import read_pages
from tidemark.sources.tables import HistoryTable, RunLog

CATALOGUES = {
    1: {"a": 1, "b": 2, "c": 3},
    2: {"b": 2, "c": 4, "d": 1},
    3: {"b": 5, "d": 1, "e": 1},
    4: {"b": 5, "d": 1, "e": 1},
}


@pytest.fixture
def store(spark, tmp_path):
    name = "f_" + tmp_path.name.replace("-", "_")
    history = HistoryTable(spark, name, str(tmp_path / "snapshots"), buckets=2)
    return history, RunLog(spark, str(tmp_path / "runs")), ChangeFeed(spark, str(tmp_path / "feed"))


def load(spark, folder, store, run_id, entities, **options):
    history, log, feed = store
    items = [item(k, v, displayName=None if v == 4 else f"The {k}") for k, v in entities.items()]
    pages = read_pages(spark, land(folder / f"{run_id}-{len(log.events())}", page(*items)))
    return load_run(pages, history, log, run_id=run_id, clock=Clock(), feed=feed, **options)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def agrees(store):
    """The feed says of every pair of consecutive runs what the joins of their rows say."""
    history, log, feed = store
    snapshots, changes = history.frame(log), feed.frame(log)
    done = sorted(log.versions())
    listed = ("skill_id", "slug", "display_name", "owner_handle", "stat_downloads")
    for before, run in zip(done, done[1:]):
        mine = changes.where(f"scrape_run_id = {run} AND previous_run_id = {before}")
        assert mine.count() == changes.where(f"scrape_run_id = {run}").count()
        for kind, joined in (("new", diff.new_entities), ("removed", diff.removed_entities)):
            expected = joined(snapshots, run, before).select(*listed)
            assert rows(mine.where(f"kind = '{kind}'").select(*listed)) == rows(expected)
        changed = diff.changed_entities(snapshots, run, before)
        long = diff.feed_changes_long(mine).drop("scrape_run_id")
        assert rows(long) == rows(diff.changes_long(changed))
    first = done[0]
    assert changes.where(f"scrape_run_id = {first}").count() == 0
    counts = rows(
        diff.diff_all_runs(snapshots, log.frame())
        .where(f"scrape_run_id > {first} AND new_skills + removed_skills + changed_skills > 0")
        .select("scrape_run_id", "previous_run_id", "new_skills", "removed_skills", "changed_skills")
    )
    assert rows(diff.feed_counts(changes)) == counts
    logged = log.frame().selectExpr("id", "new_skills", "removed_skills", "changed_skills")
    assert [r for r in rows(logged) if any(r[1:])] == [(r[0], *r[2:]) for r in counts]


@pytest.mark.parametrize("order", [(1, 2, 3, 4), (4, 1, 3, 2), (2, 4, 3, 1)])
def test_feed_equals_the_joins_whatever_the_order_of_loads(spark, tmp_path, store, order):
    for run_id in order:
        load(spark, tmp_path, store, run_id, CATALOGUES[run_id])
    agrees(store)
    assert store[2].frame(store[1]).schema == CHANGES


def test_a_reload_rewrites_the_feed_of_the_run_and_of_its_successor(spark, tmp_path, store):
    for run_id, entities in CATALOGUES.items():
        load(spark, tmp_path, store, run_id, entities)
    began = store[2].frame(store[1])
    before = rows(began)
    load(spark, tmp_path, store, 2, {"x": 1, "b": 9})
    agrees(store)
    assert store[1].feed_versions() == {2: 2, 3: 2}
    # A reader that began before the reload has what it began with.
    assert rows(began) == before
    # No changes at all: the run has no feed, and has one again later.
    load(spark, tmp_path, store, 3, {"x": 1, "b": 9})
    assert 3 not in store[1].feed_versions()
    agrees(store)
    load(spark, tmp_path, store, 3, {"x": 2})
    agrees(store)


def test_a_failed_load_leaves_the_feed_as_it_was(spark, tmp_path, store, monkeypatch):
    for run_id, entities in CATALOGUES.items():
        load(spark, tmp_path, store, run_id, entities)
    before = rows(store[2].frame(store[1]))
    append, calls = RunLog.append, []

    def fails(self, events):
        calls.append(events)
        if len(calls) > 1:
            raise OSError("disk full")
        append(self, events)

    with monkeypatch.context() as patch:
        patch.setattr(RunLog, "append", fails)
        with pytest.raises(OSError):
            load(spark, tmp_path, store, 2, {"z": 1})
    assert rows(store[2].frame(store[1])) == before
    load(spark, tmp_path, store, 2, {"y": 1})
    agrees(store)


def test_one_run_of_the_feed_is_read_alone(spark, tmp_path, store):
    for run_id, entities in CATALOGUES.items():
        load(spark, tmp_path, store, run_id, entities)
    one = store[2].frame(store[1]).where("scrape_run_id = 3")
    files = one.select("_metadata.file_path").distinct().collect()
    assert files and all("feed/scrape_run_id=3/version=1/" in f.file_path for f in files)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "snapshots" not in plan


def test_feed_of_runs_without_changes(spark, tmp_path, store):
    assert store[2].frame(store[1]).collect() == []
    load(spark, tmp_path, store, 1, {"a": 1})
    load(spark, tmp_path, store, 2, {"a": 1})
    assert store[2].frame(store[1]).collect() == [] == diff.feed_counts(store[2].frame(store[1])).collect()
    agrees(store)


TOTALS_OPERATORS = [
    growth.run_totals, growth.download_wow, growth.platform_velocity, growth.avg_platform_velocity,
]


@pytest.mark.parametrize("operator", TOTALS_OPERATORS)
def test_totals_of_runs_are_read_from_the_rollup_alone(spark, tmp_path, store, operator):
    for run_id in (1, 3, 4, 2):
        load(spark, tmp_path, store, run_id, CATALOGUES[run_id])
    load(spark, tmp_path, store, 2, {"x": 7, "b": 9})
    history, log, _ = store
    assert load_runs(None, [], history, log, clock=Clock()) == {}
    h = history.frame(log), log.frame()
    quick, full = operator(*h, totals=log.totals()), operator(*h)
    assert rows(quick) == rows(full) and quick.count() > 0
    assert "FileScan" in full._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in quick._jdf.queryExecution().executedPlan().toString()


def test_rollup_holds_completed_runs_with_rows_only(spark, tmp_path, store):
    history, log, _ = store
    load(spark, tmp_path, store, 1, {"a": 3, "b": 4})
    load(spark, tmp_path, store, 2, {})
    assert log.states() == {1: "completed", 2: "failed"}
    assert rows(log.totals()) == [(1, 2, 7, 4)] == rows(
        growth.rollup(history.frame(log)).select("scrape_run_id", "total_skills", "total_downloads", "total_stars")
    )
    assert rows(growth.run_totals(history.frame(log), log.frame(), totals=log.totals()))[0][0] == 1
    assert day(2026, 1, 1) < log.frame().first().started_at
