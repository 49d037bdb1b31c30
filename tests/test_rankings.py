from tests.conftest import column, day
from tidemark.operators import rankings

NOW = day(2026, 3, 16)


def test_top_lists_are_ranked_with_a_stable_tie_break(catalogue):
    catalogue.run(day(2026, 3, 1), b=5, a=5, c={"stat_downloads": 9, "stat_stars": 0})
    h = catalogue.frames()
    top = rankings.top_by_downloads(*h).collect()
    assert [(r["rank"], r.skill_id) for r in top] == [(1, "c"), (2, "a"), (3, "b")]
    assert column(rankings.top_by_stars(*h, limit=2), "skill_id") == ["a", "b"]
    assert column(rankings.most_versions(*h, limit=1), "skill_id") == ["a"]


def test_only_the_newest_completed_run_is_listed(catalogue):
    catalogue.run(day(2026, 3, 1), a=5).run(day(2026, 3, 2), status="failed", b=5)
    assert column(rankings.top_by_downloads(*catalogue.frames()), "skill_id") == ["a"]


def test_star_rate_floor_and_order(catalogue):
    catalogue.run(
        day(2026, 3, 1),
        few={"stat_downloads": 99, "stat_stars": 99},
        third={"stat_downloads": 300, "stat_stars": 100},
        half={"stat_downloads": 100, "stat_stars": 50},
        zero={"stat_downloads": 0, "stat_stars": 5},
    )
    rows = rankings.star_rate(*catalogue.frames()).collect()
    assert [(r.skill_id, r.rate) for r in rows] == [("half", 50.0), ("third", 33.33)]
    unfloored = rankings.star_rate(*catalogue.frames(), min_downloads=0)
    assert "zero" not in column(unfloored, "skill_id")


def test_hot_new_is_thirty_days(catalogue):
    catalogue.run(
        NOW,
        edge={"created_at": day(2026, 2, 14)},
        old={"created_at": day(2026, 2, 13)},
        unknown={"created_at": None},
    )
    assert column(rankings.hot_new(*catalogue.frames(), now=NOW), "skill_id") == ["edge"]


def test_download_growth_needs_both_runs_and_a_gain(catalogue):
    catalogue.run(day(2026, 3, 1), up=1, same=5, down=9)
    catalogue.run(day(2026, 3, 2), up=4, same=5, down=8, new=99)
    rows = rankings.download_growth(*catalogue.frames()).collect()
    assert [(r.skill_id, r.prev_downloads, r.curr_downloads, r.growth) for r in rows] == [
        ("up", 1, 4, 3)
    ]


def test_rising_has_gain_rate_age_and_chart(catalogue):
    created = {"created_at": day(2026, 3, 10)}
    catalogue.run(day(2026, 3, 14), a=created | {"stat_downloads": 100})
    catalogue.run(day(2026, 3, 15), a=created | {"stat_downloads": 200})
    catalogue.run(
        day(2026, 3, 16), a=created | {"stat_downloads": 300}, new=40, lost={"stat_downloads": 0}
    )
    a, new = rankings.rising(*catalogue.frames(), now=NOW).collect()
    assert (a.skill_id, a.delta, a.delta_pct, a.days_old, a.dl_per_day) == ("a", 100, 50.0, 6, 50.0)
    assert a.velocity_chart == [100, 200, 300]
    assert (new.delta, new.delta_pct, new.days_old, new.dl_per_day) == (40, None, None, 40.0)


def test_rising_does_not_exclude_old_entities_and_needs_two_runs(catalogue):
    old = {"created_at": day(2020, 1, 1)}
    catalogue.run(day(2026, 3, 14), a=old | {"stat_downloads": 100})
    assert rankings.rising(*catalogue.frames(), now=NOW).isEmpty()
    catalogue.run(day(2026, 3, 15), a=old | {"stat_downloads": 500})
    assert column(rankings.rising(*catalogue.frames(), now=NOW), "delta") == [400]
    assert rankings.rising_by_rate(*catalogue.frames(), now=NOW).isEmpty()


def test_rising_chart_covers_ten_runs(catalogue):
    for i in range(12):
        catalogue.run(day(2026, 3, 1 + i), a=10 * (i + 1))
    row = rankings.rising(*catalogue.frames(), now=NOW).first()
    assert row.velocity_chart == [10 * (i + 1) for i in range(2, 12)]


def test_rising_by_percent_puts_unknown_as_zero(catalogue):
    catalogue.run(day(2026, 3, 14), big=1000, small=10).run(
        day(2026, 3, 15), big=1500, small=20, new=100
    )
    rows = rankings.rising_by_pct(*catalogue.frames(), now=NOW).collect()
    assert [(r["rank"], r.skill_id, r.delta_pct) for r in rows] == [
        (1, "small", 100.0), (2, "big", 50.0), (3, "new", None),
    ]


def test_rising_recent_is_relative_to_the_run(catalogue):
    young, old = {"created_at": day(2026, 3, 10)}, {"created_at": day(2026, 1, 1)}
    catalogue.run(
        day(2026, 3, 14), a=young | {"stat_downloads": 100}, o=old | {"stat_downloads": 1}
    )
    catalogue.run(
        day(2026, 3, 15),
        a=young | {"stat_downloads": 500},
        n=young | {"stat_downloads": 300},
        z=young | {"stat_downloads": 0},
        o=old | {"stat_downloads": 9000},
    )
    rows = rankings.rising_recent(*catalogue.frames()).collect()
    assert [(r.skill_id, r.delta, r.hours) for r in rows] == [
        ("a", 400, 24.0), ("n", 300, 24.0), ("z", 0, 24.0),
    ]


def test_rising_recent_is_empty_when_nothing_moved(catalogue):
    young = {"created_at": day(2026, 3, 10)}
    catalogue.run(day(2026, 3, 14), a=young).run(day(2026, 3, 15), a=young)
    assert rankings.rising_recent(*catalogue.frames()).isEmpty()


def test_rising_by_rate_window(catalogue):
    catalogue.run(day(2026, 3, 14), fast=1)
    catalogue.run(
        day(2026, 3, 15),
        fast={"created_at": day(2026, 3, 10), "stat_downloads": 600},
        slow={"created_at": day(2026, 3, 1), "stat_downloads": 600},
        old={"created_at": day(2026, 1, 1), "stat_downloads": 9999},
    )
    h = catalogue.frames()
    assert column(rankings.rising_by_rate(*h, now=NOW), "slug") == ["fast-page", "slow-page"]
    assert column(rankings.rising_by_rate(*h, now=NOW, max_age_days=7), "slug") == ["fast-page"]


def test_detail_keys_join_both_lists_without_null_slugs(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        hidden={"slug": None, "stat_downloads": 9999},
        big={"stat_downloads": 5000},
        quick={"created_at": day(2026, 3, 15), "stat_downloads": 400},
        rest={"created_at": day(2026, 1, 1), "stat_downloads": 500},
    )
    h = catalogue.frames()
    keys = rankings.detail_keys(*h, now=NOW, limit=1, rate_limit=1)
    assert sorted(column(keys, "slug")) == ["big-page", "quick-page"]
