import pytest

from tests.conftest import column, day
from tidemark.operators import cohorts, history

NOW = day(2026, 3, 16)


def test_cohort_means(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        a={"created_at": day(2026, 1, 5), "stat_downloads": 5000},
        b={"created_at": day(2026, 1, 25), "stat_downloads": 3000},
        c={"created_at": day(2026, 2, 5), "stat_downloads": 0},
        d={"created_at": None},
    )
    jan, feb = cohorts.cohort_quality(*catalogue.frames(), now=NOW).collect()
    assert (jan.cohort_month, jan.skill_count, jan.avg_downloads) == (day(2026, 1, 1), 2, 4000.0)
    assert jan.install_pct == 0.9  # 70 installs of 8000 downloads
    assert (feb.install_pct, feb.avg_dl_per_day) == (0.0, 0.0)


def test_rates_are_normalised_for_age(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        old={"created_at": day(2026, 1, 15), "stat_downloads": 600},
        new={"created_at": day(2026, 3, 1), "stat_downloads": 150},
    )
    assert column(cohorts.cohort_quality(*catalogue.frames(), now=NOW), "avg_dl_per_day") == [
        10.0, 10.0,
    ]


def test_cohort_percentiles_and_star_ratio(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        a={"created_at": day(2026, 1, 15), "stat_downloads": 1000, "stat_stars": 100},
        b={"created_at": day(2026, 1, 15), "stat_downloads": 1000, "stat_stars": 50},
    )
    row = cohorts.cohort_percentiles(*catalogue.frames(), now=NOW).first()
    assert row.star_dl_ratio == 0.075
    assert (row.p10, row.p50, row.p99, row.avg_dl_per_day) == (16.7, 16.7, 16.7, 16.7)


def test_median_rate_windows(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        a={"created_at": day(2026, 2, 14), "stat_downloads": 300},
        b={"created_at": day(2026, 3, 1), "stat_downloads": 300},
    )
    row = cohorts.median_rate_windows(*catalogue.frames(), now=NOW).first()
    assert tuple(row) == (15.0, None, None)
    empty = cohorts.median_rate_windows(*catalogue.frames(), now=day(2030, 1, 1)).first()
    assert tuple(empty) == (None, None, None)


@pytest.mark.parametrize(
    ("versions", "events"),
    [
        (["1.0.0", "1.1.0"], [(2, "1.1.0")]),
        (["1.0.0", None, "1.1.0"], []),
        (["1.0.0", "", "1.1.0"], [(3, "1.1.0")]),
        (["1", "2", "2", "1"], [(2, "2"), (4, "1")]),
    ],
)
def test_version_releases(catalogue, versions, events):
    for i, version in enumerate(versions):
        catalogue.run(day(2026, 3, 1 + i), a={"version_number": version})
    rows = history.version_releases(*catalogue.frames()).collect()
    assert [(r.scrape_run_id, r.version_number) for r in rows] == events


def test_release_carries_the_changelog(catalogue):
    catalogue.run(day(2026, 3, 1), a=1)
    catalogue.run(day(2026, 3, 2), status="failed", a={"version_number": "9"})
    catalogue.run(
        day(2026, 3, 3), a={"version_number": "1.1.0", "version_changelog": "Bug fix"}
    )
    row = history.version_releases(*catalogue.frames()).first()
    assert (row.version_number, row.changelog, row.run_date) == (
        "1.1.0", "Bug fix", day(2026, 3, 3),
    )


def test_history_is_restricted_to_requested_entities(spark, catalogue):
    catalogue.run(day(2026, 3, 1), a=1, b=2).run(day(2026, 3, 2), a=3)
    wanted = spark.createDataFrame([("a",)], "skill_id string")
    rows = history.entity_history(*catalogue.frames(), wanted).orderBy("scrape_run_id")
    assert column(rows, "downloads") == [1, 3]


def test_detail(spark, catalogue):
    for i, downloads in enumerate([0, 10, 20, 30, 50, 70]):
        catalogue.run(
            day(2026, 3, 1 + i),
            a={
                "stat_downloads": downloads,
                "created_at": day(2026, 3, 13, 12),
                "tags": '{"latest": "1", "beta": "2"}',
            },
            bad={"tags": "not json", "created_at": None},
            twin={"slug": "a-page"},
        )
    h = catalogue.frames()
    rows = {r.slug: r for r in history.entity_detail(*h, now=NOW).collect()}
    assert set(rows) == {"a-page", "bad-page"}
    a = rows["a-page"]
    assert (a.skill_id, a.days_old, a.velocity, a.acceleration_pct) == ("a", 2, 35.0, 100.0)
    assert sorted(a.tags) == ["beta", "latest"]
    assert (rows["bad-page"].tags, rows["bad-page"].velocity) == ([], None)
    wanted = spark.createDataFrame([("bad-page",), ("none-page",)], "slug string")
    detail = history.entity_detail(*h, now=NOW, slugs=wanted)
    assert column(detail, "slug") == ["bad-page"]
