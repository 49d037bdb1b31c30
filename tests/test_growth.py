import pytest

from tests.conftest import column, day
from tidemark.operators import growth


def created(*dates):
    """Entities created on the given dates, several per date as (date, count)."""
    rows = {}
    for date, count in dates:
        rows |= {f"e{len(rows) + i}": {"created_at": date} for i in range(count)}
    return rows


def test_totals(catalogue):
    catalogue.run(
        day(2026, 3, 1),
        a={"stat_downloads": 5000, "stat_stars": 50, "owner_handle": "alice"},
        b={"stat_downloads": 3000, "stat_stars": 30, "owner_handle": "bob"},
        c={"stat_downloads": 200, "stat_stars": 5, "owner_handle": "alice"},
        d={"stat_downloads": 0, "stat_stars": 0, "owner_handle": None},
    )
    row = growth.platform_totals(*catalogue.frames()).first()
    assert (row.total_skills, row.total_downloads, row.total_stars) == (4, 8200, 85)
    assert (row.total_installs, row.unique_owners) == (140, 2)


def test_totals_are_zero_without_runs(catalogue):
    assert tuple(growth.platform_totals(*catalogue.frames()).first()) == (0, 0, 0, 0, 0, 0)


def test_run_totals_skip_failed_runs(catalogue):
    catalogue.run(day(2026, 3, 1), a=100).run(day(2026, 3, 2), status="failed", a=7)
    catalogue.run(day(2026, 3, 3), a=300)
    assert column(growth.run_totals(*catalogue.frames()), "total_downloads") == [100, 300]


def test_run_percentiles_interpolate(catalogue):
    catalogue.run(day(2026, 3, 1), a=10, b=100, c=1000, d=10000)
    row = growth.run_percentiles(*catalogue.frames()).first()
    assert (row.p50, row.p90, row.p95, row.p99) == (550.0, 7300.0, 8650.0, 9730.0)
    assert (row.run_date, row.skill_count) == ("2026-03-01", 4)


def test_download_wow(catalogue):
    catalogue.run(day(2026, 3, 1), a=1000).run(day(2026, 3, 8), a=1100)
    assert growth.download_wow(*catalogue.frames()).first().download_wow_pct == 10.0


def test_download_wow_looks_seven_runs_back(catalogue):
    for i in range(10):
        catalogue.run(day(2026, 3, 1 + i), a=100 * (i + 1))
    row = growth.download_wow(*catalogue.frames()).first()
    assert (row.latest_downloads, row.reference_downloads) == (1000, 300)


def test_download_wow_needs_two_runs(catalogue):
    assert growth.download_wow(*catalogue.frames()).isEmpty()
    catalogue.run(day(2026, 3, 1), a=1000)
    assert growth.download_wow(*catalogue.frames()).first().download_wow_pct is None


def test_current_week_is_forecast(catalogue):
    catalogue.run(day(2026, 3, 16), **created((day(2026, 3, 9), 10), (day(2026, 3, 16), 3)))
    weeks = growth.weekly_growth(*catalogue.frames(), now=day(2026, 3, 16)).collect()
    assert [(w.is_forecast, w.forecast_count, w.wow_pct) for w in weeks] == [
        (False, None, None),
        (True, 21, 110.0),
    ]
    assert [w.cumulative for w in weeks] == [10, 13]


def test_sunday_and_past_weeks_are_no_forecast(catalogue):
    catalogue.run(day(2026, 3, 22), **created((day(2026, 3, 2), 1), (day(2026, 3, 16), 3)))
    for now in (day(2026, 3, 22), day(2026, 3, 23)):
        weeks = growth.weekly_growth(*catalogue.frames(), now=now).collect()
        assert not any(w.is_forecast for w in weeks)


def test_forecast_ties_round_to_even(catalogue):
    # 3 in two days: 10.5 a week.
    catalogue.run(day(2026, 3, 17), **created((day(2026, 3, 16), 3)))
    week = growth.weekly_growth(*catalogue.frames(), now=day(2026, 3, 17)).first()
    assert week.forecast_count == 10


def test_average_wow_excludes_the_forecast(catalogue):
    rows = created((day(2026, 3, 2), 10), (day(2026, 3, 9), 20), (day(2026, 3, 16), 5))
    catalogue.run(day(2026, 3, 16), **rows)
    assert growth.avg_wow(*catalogue.frames(), now=day(2026, 3, 16)).first()[0] == 100.0
    assert growth.avg_wow(*catalogue.frames(), now=day(2025, 1, 1)).first()[0] is not None


def test_only_twelve_weeks_but_totals_over_all(catalogue):
    weeks = [(day(2026, 1, 5 + 7 * i), i + 1) for i in range(3)]
    weeks += [(day(2026, 2, 2 + 7 * i), 1) for i in range(4)]
    weeks += [(day(2026, 3, 2 + 7 * i), 1) for i in range(5)]
    weeks += [(day(2026, 4, 6 + 7 * i), 1) for i in range(3)]
    catalogue.run(day(2026, 6, 1), **created(*weeks))
    listed = growth.weekly_growth(*catalogue.frames(), now=day(2026, 6, 1)).collect()
    assert len(listed) == 12
    assert listed[0].cumulative == 7 and listed[0].wow_pct == -66.7
    assert len(growth.growth_timeline(*catalogue.frames()).collect()) == 15


@pytest.mark.parametrize("size", [1, 9, 10, 100, 101, 250])
def test_top_share_equals_tiles(catalogue, size):
    values = [(i * i) % 97 for i in range(size)]
    catalogue.run(day(2026, 3, 1), **{f"e{i}": v for i, v in enumerate(values)})
    row = growth.top_share(*catalogue.frames()).first()
    ordered = sorted(values, reverse=True)
    for tiles, got in ((100, row.top1_downloads), (10, row.top10_downloads)):
        first = size // tiles + (size % tiles > 0)
        assert got == sum(ordered[:first])
    assert row.total_downloads == sum(values)


def test_top_share_of_nothing_downloaded_is_zero(catalogue):
    row = growth.top_share(*catalogue.run(day(2026, 3, 1), a=0, b=0).frames()).first()
    assert (row.top1_pct, row.top10_pct) == (0.0, 0.0)


def test_platform_velocity(catalogue):
    catalogue.run(day(2026, 3, 1), a=100).run(day(2026, 3, 3), a=350)
    rows = growth.platform_velocity(*catalogue.frames()).collect()
    assert [r.download_delta for r in rows] == [None, 250]
    assert rows[1].downloads_per_day == 125.0
    assert growth.avg_platform_velocity(*catalogue.frames()).isEmpty()
    catalogue.run(day(2026, 3, 5), a=500)
    mean = growth.avg_platform_velocity(*catalogue.frames()).first()
    assert (mean.total_days, mean.avg_downloads_per_day) == (4.0, 100.0)


def test_platform_velocity_needs_two_runs_and_bounds_the_interval(catalogue):
    catalogue.run(day(2026, 3, 1), a=100)
    assert growth.platform_velocity(*catalogue.frames()).isEmpty()
    catalogue.run(day(2026, 3, 1), a=101)
    assert growth.platform_velocity(*catalogue.frames()).collect()[1].downloads_per_day == 100.0
