import pytest

from tests.conftest import column, day
from tidemark.operators import owners

NOW = day(2026, 3, 16)


def owned(owner, downloads, **extra):
    return {
        "owner_handle": owner, "stat_downloads": downloads, "created_at": day(2026, 3, 6),
    } | extra


@pytest.fixture
def two_owners(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        a=owned("alice", 5000, stat_stars=1),
        b=owned("alice", 3000, stat_stars=1),
        c=owned("bob", 1000, stat_stars=8),
        d=owned(None, 7000),
        e=owned("bob", 500, created_at=None),
    )
    return catalogue.frames()


def test_leaderboard(two_owners):
    rows = owners.owner_leaderboard(*two_owners).collect()
    assert [(r["rank"], r.owner_handle, r.skill_count, r.total_downloads) for r in rows] == [
        (1, "alice", 2, 8000), (2, "bob", 2, 1500),
    ]
    assert column(owners.detail_owners(*two_owners, limit=1), "owner_handle") == ["alice"]


def test_stats_share_only_among_listed_owners(two_owners):
    rows = {r.owner_handle: r for r in owners.owner_stats(*two_owners, now=NOW).collect()}
    assert (rows["alice"].dl_pct, rows["alice"].star_pct) == (88.89, 20.0)
    assert (rows["bob"].skill_count, rows["bob"].avg_dl_per_day) == (1, 100.0)
    assert rows["alice"].first_skill_at == day(2026, 3, 6)


def test_stats_without_downloads_have_zero_shares(catalogue):
    catalogue.run(day(2026, 3, 15), a=owned("alice", 0, stat_stars=0))
    row = owners.owner_stats(*catalogue.frames(), now=NOW).first()
    assert (row.dl_pct, row.star_pct, row.avg_dl_per_day) == (0.0, 0.0, 0.0)


def test_orderings_fall_back_to_downloads(catalogue):
    catalogue.run(
        day(2026, 3, 15),
        a=owned("few", 10, stat_stars=5),
        b=owned("many", 90, stat_stars=5),
        c=owned("stars", 1, stat_stars=9),
    )
    h = catalogue.frames()
    by = {k: column(owners.owners_by(*h, k, now=NOW), "owner_handle") for k in
          ("total_downloads", "total_stars", "skill_count")}
    assert by["total_downloads"] == ["many", "few", "stars"]
    assert by["total_stars"] == ["stars", "many", "few"]
    assert by["skill_count"] == ["many", "few", "stars"]


def test_spam_bounds_are_strict(catalogue):
    rows = {f"s{i}": owned("spam", 10) for i in range(55)}
    rows |= {f"f{i}": owned("fifty", 10) for i in range(50)}
    rows |= {f"g{i}": owned("good", 50) for i in range(51)}
    catalogue.run(day(2026, 3, 15), **rows, x=owned("big", 5000))
    got = owners.owner_spam(*catalogue.frames()).collect()
    assert [tuple(r) for r in got] == [("spam", 55, 10.0)]


def test_portfolio_counts_entities_of_known_age(two_owners):
    rows = {r.owner_handle: r for r in owners.owner_portfolio(*two_owners, now=NOW).collect()}
    assert (rows["bob"].skill_count, rows["bob"].total_downloads) == (1, 1000)
    listed = owners.owner_entities(*two_owners, now=NOW).collect()
    assert [(r.owner_handle, r.skill_id, r.days_old) for r in listed] == [
        ("alice", "a", 10), ("alice", "b", 10), ("bob", "c", 10), ("bob", "e", None),
    ]


def test_portfolio_of_an_owner_without_known_ages_is_zero(catalogue):
    catalogue.run(day(2026, 3, 15), a=owned("alice", 9, created_at=None))
    row = owners.owner_portfolio(*catalogue.frames(), now=NOW).first()
    assert tuple(row) == ("alice", 0, 0, 0, 0, 0.0)


def test_trajectory(catalogue):
    for i, downloads in enumerate([100, 200, 300]):
        catalogue.run(day(2026, 3, 1 + i), a=owned("alice", downloads))
    rows = owners.owner_trajectory(*catalogue.frames()).orderBy("scrape_run_id")
    assert column(rows, "downloads") == [100, 200, 300]


def test_owner_count_against_a_month_before(catalogue):
    catalogue.run(day(2026, 1, 1), a=owned("x", 1)).run(
        day(2026, 2, 1), a=owned("x", 1), b=owned("y", 1)
    )
    assert owners.owner_count_mom(*catalogue.frames()).first().owners_mom_pct == 100.0
    catalogue.run(day(2026, 2, 20), a=owned("x", 1), b=owned("y", 1), c=owned("z", 1))
    row = owners.owner_count_mom(*catalogue.frames()).first()
    assert (row.total_owners, row.reference_run_id, row.owners_mom_pct) == (3, 1, 200.0)


def test_owner_count_without_reference(catalogue):
    assert owners.owner_count_mom(*catalogue.frames()).isEmpty()
    catalogue.run(day(2026, 1, 1), a=owned("x", 1))
    row = owners.owner_count_mom(*catalogue.frames()).first()
    assert (row.total_owners, row.reference_owners, row.owners_mom_pct) == (1, None, None)


def test_keys_and_collisions(spark):
    handles = spark.createDataFrame(
        [("Jane Doe",), ("jane-doe",), ("JANE.DOE",), ("ok_name-1",), ("ok_name-1",), (None,)],
        "owner_handle string",
    )
    keys = {r.owner_handle: r.owner_key for r in owners.owner_keys(handles).collect()}
    assert keys["Jane Doe"] == keys["JANE.DOE"] == "jane-doe"
    assert keys["ok_name-1"] == "ok_name-1"
    collisions = column(owners.owner_key_collisions(handles), "owner_handle")
    assert sorted(collisions) == ["JANE.DOE", "Jane Doe", "jane-doe"]
