"""What the physical plans must look like on the stored, partitioned and bucketed history."""

import re

import pytest

from tests.conftest import day
from tidemark.operators import diff, growth, history, momentum, owners, rankings, runs
from tidemark.sources.tables import HistoryTable

NOW = day(2026, 3, 16)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from tests.conftest import Catalogue

    catalogue = Catalogue(spark)
    for i in range(7):
        entities = {f"e{n}": n * 10 + i for n in range(20 + i)}
        catalogue.run(day(2026, 3, 1 + i), **entities)
    snapshots, log = catalogue.frames()
    folder = tmp_path_factory.mktemp("plans")
    table = HistoryTable(spark, "planned", str(folder / "snapshots"), buckets=2)
    table.add_runs(snapshots)
    log.coalesce(1).write.parquet(str(folder / "runs"))
    return table.frame(), spark.read.parquet(str(folder / "runs"))


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffles(text: str) -> int:
    """Shuffles of rows by hash; the others bring a handful of rows together."""
    return len(re.findall(r"Arguments: hashpartitioning", text))


def test_current_reads_one_partition(stored):
    text = plan(runs.current(*stored))
    assert re.search(r"PartitionFilters: \[[^\n]*Subquery", text)
    files = runs.current(*stored).select("_metadata.file_path").distinct().collect()
    assert files and all("scrape_run_id=7" in f.file_path for f in files)


def test_only_used_columns_are_read(stored):
    text = plan(owners.owner_leaderboard(*stored))
    assert "ReadSchema: struct<stat_downloads:bigint,stat_stars:bigint,owner_handle:string>" in text


def test_rows_of_a_run_are_not_sent_to_the_driver(stored):
    for df in (rankings.download_growth(*stored), rankings.rising_recent(*stored)):
        assert "SortMergeJoin" in plan(df)
    shape = growth.run_percentiles(*stored)
    text = shape._sc._jvm.PythonSQLUtils.explainString(shape._jdf.queryExecution(), "simple")
    by_bucket = r"BroadcastHashJoin \[scrape_run_id#\w+, bucket#\w+\], \[[^]]*\], Inner, (\w+)"
    assert "BuildRight" in re.findall(by_bucket, text)


def test_joins_across_runs_do_not_shuffle(stored):
    for df in (
        diff.new_entities(stored[0], 7, 6),
        rankings.download_growth(*stored),
        diff.pair_counts(stored[0], 7, 6),
        diff.diff_changes_long(*stored),
        momentum.velocity(*stored),
        history.version_releases(*stored),
        momentum.velocity_chart(*stored),
    ):
        assert shuffles(plan(df)) == 0


def test_anti_join_is_used(stored):
    assert "LeftAnti" in plan(diff.diff_new(*stored))


def test_top_k_never_sorts_everything(stored):
    for df in (
        rankings.top_by_downloads(*stored),
        rankings.rising(*stored, now=NOW),
        momentum.fastest_growing(*stored, now=NOW),
        owners.owners_by(*stored, "total_stars", now=NOW),
    ):
        text = plan(df)
        assert "TakeOrderedAndProject" in text
        # Only the ranked rows themselves are sorted by range, after the limit.
        assert text.count("rangepartitioning") <= 2


def test_no_window_over_entities_in_one_task(stored):
    # Values are only ordered within their bucket; bucket counts, of fixed number, in one task.
    text = plan(growth.top_share(*stored))
    windows = re.findall(r"\) Window\nInput[^\n]*\nArguments: \[(.*)\], \[(.*)\], \[", text)
    assert windows
    for expressions, partition in windows:
        assert partition.startswith("bucket") or "rows#" in expressions


def test_there_is_no_cross_join_or_python(stored):
    for df in (
        owners.owner_stats(*stored, now=NOW),
        rankings.rising_recent(*stored),
        growth.run_percentiles(*stored),
        diff.diff_all_runs(*stored),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "Python" not in text
