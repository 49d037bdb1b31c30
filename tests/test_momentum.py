from tests.conftest import day
from tidemark.operators import momentum

NOW = day(2026, 3, 16)


def runs_of(catalogue, **series):
    """One run per position; None leaves the entity out of that run."""
    for i in range(max(map(len, series.values()))):
        present = {k: v[i] for k, v in series.items() if i < len(v) and v[i] is not None}
        catalogue.run(day(2026, 3, 1 + i), **present)
    return catalogue.frames()


def by_id(df):
    return {r.skill_id: r for r in df.collect()}


def test_velocity_is_the_mean_step_and_gaps_are_bridged(catalogue):
    h = runs_of(
        catalogue,
        even=[0, 10, 20, 30, 50, 70],
        gap=[0, None, 20, 30, None, 90],
        late=[None, None, None, None, None, 5],
        fell=[60, 50, 40, 40, 40, 40],
    )
    rows = by_id(momentum.velocity(*h))
    assert (rows["even"].velocity_prior, rows["even"].velocity_recent) == (10.0, 20.0)
    assert (rows["even"].acceleration_pct, rows["even"].trend) == (100.0, "up")
    assert (rows["gap"].velocity_prior, rows["gap"].velocity_recent) == (20.0, 60.0)
    assert (rows["late"].velocity_recent, rows["late"].trend) == (None, "flat")
    # A falling prior velocity has a trend but no acceleration.
    assert (rows["fell"].acceleration_pct, rows["fell"].trend) == (None, "up")


def test_trend_thresholds_are_strict(catalogue):
    h = runs_of(
        catalogue,
        same=[0, 100, 200, 300, 405, 510],
        less=[0, 100, 200, 300, 395, 490],
        down=[0, 100, 200, 300, 394, 488],
    )
    rows = by_id(momentum.velocity(*h))
    assert [rows[k].trend for k in ("same", "less", "down")] == ["flat", "flat", "down"]


def test_fastest_growing_order_floor_and_zero_velocity(catalogue):
    h = runs_of(
        catalogue,
        quick=[100, 110, 120, 200, 240, 280],
        stalled=[100, 110, 120, 200, 200, 200],
        small=[0, 1, 2, 3, 8, 13],
        gone=[100, 110, 120, 200, 240, None],
    )
    rows = momentum.fastest_growing(*h, now=NOW).collect()
    assert [(r["rank"], r.skill_id, r.acceleration_pct, r.velocity) for r in rows] == [
        (1, "quick", 300.0, 40.0),
        (2, "stalled", -100.0, None),
    ]


def test_four_runs_have_no_prior_velocity(catalogue):
    h = runs_of(catalogue, a=[200, 400, 600, 800], b=[100, 110, 120, 130])
    assert momentum.fastest_growing(*h, now=NOW).isEmpty()


def test_leaderboard_keeps_zero_velocity_and_single_run(catalogue):
    h = runs_of(catalogue, low=[10, 10], high=[9999, 9999], mid=[None, 500])
    rows = momentum.leaderboard_all_time(*h, now=NOW).collect()
    assert [(r.skill_id, r.velocity, r.trend) for r in rows] == [
        ("high", 0.0, "flat"), ("mid", None, "flat"), ("low", 0.0, "flat"),
    ]


def test_chart_is_in_run_order(catalogue):
    h = runs_of(catalogue, a=[3, None, 1, 2])
    assert by_id(momentum.velocity_chart(*h))["a"].velocity_chart == [3, 1, 2]
