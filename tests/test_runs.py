from tests.conftest import column, day
from tidemark.operators import runs


def test_newest_completed_run_is_by_id_and_failed_runs_are_ignored(catalogue):
    catalogue.run(day(2026, 3, 5), a=1).run(day(2026, 3, 1), a=2, b=2)
    catalogue.run(day(2026, 3, 9), status="failed", c=3).run(day(2026, 3, 10), status="running")
    snapshots, log = catalogue.frames()
    assert runs.latest_completed(log).first()[0] == 2
    assert sorted(column(runs.current(snapshots, log), "skill_id")) == ["a", "b"]
    assert column(runs.previous(snapshots, log), "skill_id") == ["a"]


def test_previous_is_empty_with_one_run_and_all_is_empty_without(catalogue):
    snapshots, log = catalogue.frames()
    assert runs.latest_completed(log).first()[0] is None
    assert runs.current(snapshots, log).isEmpty()
    snapshots, log = catalogue.run(day(2026, 3, 1), a=1).frames()
    assert runs.previous(snapshots, log).isEmpty()
    now, before = runs.latest_pair_rows(snapshots, log)
    assert now.isEmpty() and before.isEmpty()


def test_momentum_buckets_take_six_runs_newest_first(catalogue):
    for d in range(1, 9):
        catalogue.run(day(2026, 3, d), status="failed" if d == 4 else "completed", a=d)
    _, log = catalogue.frames()
    got = [(r.scrape_run_id, r.bucket) for r in runs.momentum_buckets(log).collect()]
    assert got == [
        (8, "recent"), (7, "recent"), (6, "recent"), (5, "prior"), (3, "prior"), (2, "prior"),
    ]


def test_run_by_id_and_row_counts(catalogue):
    snapshots, log = catalogue.run(day(2026, 3, 1), a=1, b=1).run(day(2026, 3, 2)).frames()
    assert runs.get_run(log, 1).first().status == "completed"
    assert runs.get_run(log, 99).isEmpty()
    counts = runs.snapshot_counts(snapshots, log).collect()
    assert {r.scrape_run_id: r.snapshot_count for r in counts} == {1: 2, 2: 0}
