from tests.conftest import column, day
from tidemark.operators import diff


def two_runs(catalogue, first, second):
    return catalogue.run(day(2026, 3, 1), **first).run(day(2026, 3, 2), **second).frames()


def test_new_removed_and_changed_together(catalogue):
    snapshots, log = two_runs(
        catalogue,
        {"kept": 100, "removed": 100, "changed": {"stat_stars": 5}},
        {"kept": 100, "added": 100, "changed": {"stat_stars": 50}},
    )
    assert column(diff.diff_new(snapshots, log), "skill_id") == ["added"]
    assert column(diff.diff_removed(snapshots, log), "skill_id") == ["removed"]
    changed = diff.diff_changed(snapshots, log).collect()
    assert [(r.skill_id, r.prev_stat_stars, r.curr_stat_stars) for r in changed] == [
        ("changed", 5, 50)
    ]
    long = diff.diff_changes_long(snapshots, log).collect()
    assert [tuple(r) for r in long] == [("changed", "stat_stars", "5", "50")]
    counts = diff.diff_counts(snapshots, log).first().asDict()
    assert counts == {
        "current_run_id": 2, "previous_run_id": 1, "previous_skills": 3, "total_skills": 3,
        "new_skills": 1, "removed_skills": 1, "changed_skills": 1,
    }
    assert tuple(diff.pair_counts(snapshots, 2, 1).first()) == (1, 1, 1)


def test_equal_runs_have_no_difference(catalogue):
    snapshots, log = two_runs(catalogue, {"a": 1, "b": 2}, {"a": 1, "b": 2})
    assert diff.diff_new(snapshots, log).isEmpty()
    assert diff.diff_removed(snapshots, log).isEmpty()
    assert diff.diff_changed(snapshots, log).isEmpty()
    assert tuple(diff.pair_counts(snapshots, 2, 1).first()) == (0, 0, 0)


def test_null_and_value_differ_but_null_and_null_do_not(catalogue):
    snapshots, log = two_runs(
        catalogue,
        {"a": {"summary": None}, "b": {"summary": None}, "c": {"summary": "x"}},
        {"a": {"summary": "now"}, "b": {"summary": None}, "c": {"summary": None}},
    )
    long = {tuple(r) for r in diff.diff_changes_long(snapshots, log).collect()}
    assert long == {("a", "summary", None, "now"), ("c", "summary", "x", None)}


def test_untracked_fields_do_not_count(catalogue):
    snapshots, log = two_runs(catalogue, {"a": {"badges": "x"}}, {"a": {"badges": "y"}})
    assert diff.diff_changed(snapshots, log).isEmpty()


def test_any_two_run_ids_whatever_their_status(catalogue):
    catalogue.run(day(2026, 3, 1), a=1).run(day(2026, 3, 2), status="failed", a=1, b=1)
    snapshots, _ = catalogue.frames()
    assert column(diff.new_entities(snapshots, 2, 1), "skill_id") == ["b"]
    assert column(diff.removed_entities(snapshots, 1, 2), "skill_id") == ["b"]
    assert diff.changed_entities(snapshots, 2, 1).isEmpty()


def test_lists_are_ordered_by_downloads(catalogue):
    snapshots, log = two_runs(catalogue, {"x": 1}, {"x": 1, "a": 5, "b": 50, "c": 500})
    assert column(diff.diff_new(snapshots, log), "skill_id") == ["c", "b", "a"]


def test_all_runs_bridges_failed_runs_and_starts_with_zeros(catalogue):
    catalogue.run(day(2026, 3, 1), a=1, b=1).run(day(2026, 3, 2), status="failed", z=1)
    catalogue.run(day(2026, 3, 3), a=2, c=1).run(day(2026, 3, 4)).run(day(2026, 3, 5), a=2)
    got = [
        (r.scrape_run_id, r.previous_run_id, r.previous_skills, r.total_skills, r.new_skills,
         r.removed_skills, r.changed_skills)
        for r in diff.diff_all_runs(*catalogue.frames()).orderBy("scrape_run_id").collect()
    ]
    assert got == [
        (1, None, 0, 2, 0, 0, 0),
        (3, 1, 2, 2, 1, 1, 1),
        (4, 3, 2, 0, 0, 2, 0),
        (5, 4, 0, 1, 1, 0, 0),
    ]


def test_summary_labels_fall_back_to_the_slug(catalogue):
    snapshots, log = two_runs(
        catalogue,
        {"a": 1, "gone": {"display_name": ""}},
        {"a": 9, "new": {"display_name": None}},
    )
    rows = {r.section: r for r in diff.diff_summary(snapshots, log).collect()}
    assert rows["new"].label == "new-page"
    assert rows["removed"].label == "gone-page"
    assert [tuple(c) for c in rows["changed"].changes] == [("stat_downloads", "1", "9")]


def test_single_run_gives_nothing(catalogue):
    snapshots, log = catalogue.run(day(2026, 3, 1), a=1).frames()
    assert diff.diff_new(snapshots, log).isEmpty()
    assert diff.diff_counts(snapshots, log).isEmpty()
    assert diff.diff_summary(snapshots, log).isEmpty()
