import json
import re
from datetime import timedelta

import pytest

from pyspark.errors import PySparkException, StreamingQueryException
from tests.conftest import column, day
from tests.test_plans import plan
from tidemark.operators import diff, momentum, runs
from tidemark.plans import documents
from tidemark.plans.report import report, report_contents
from tidemark.sources import load as load_job
from tidemark.sources import pages as page_source
from tidemark.sources import publish as publisher
from tidemark.sources.load import BadPage, DuplicateKeys, load_run
from tidemark.sources.pages import (
    dump_items,
    flatten_items,
    key_violations,
    page_items,
    read_pages,
)
from tidemark.sources.tables import HistoryTable, RunLog, next_event
from tidemark.streaming import landing as landing_job
from tidemark.streaming.landing import ingest_stream

NOW = day(2026, 3, 16)


def item(skill_id, downloads=1.0, **skill):
    return {
        "ownerHandle": "top",
        "skill": {
            "_id": skill_id,
            "slug": f"{skill_id}-page",
            "displayName": f"The {skill_id}",
            "createdAt": 1700000000000.0,
            "badges": {},
            "tags": {"latest": "v1"},
            "stats": {"downloads": downloads, "stars": 2},
        }
        | skill,
        "owner": {"_id": "u1", "handle": "alice"},
        "latestVersion": {"_id": "v1", "version": "1.0.0"},
    }


def page(*items, status="success", cursor=None, following=None):
    """The answer to the request `cursor`, the first one by default."""
    value = {"page": items, "hasMore": following is not None, "nextCursor": following}
    if status != "success":
        return {"cursor": cursor, "status": status, "value": None}
    return {"cursor": cursor, "status": status, "value": value}


def land(folder, *pages, name="pages"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(p) for p in pages))
    return str(folder)


@pytest.fixture
def store(spark, tmp_path):
    name = "t_" + tmp_path.name.replace("-", "_")
    return (
        HistoryTable(spark, name, str(tmp_path / "snapshots"), buckets=2),
        RunLog(spark, str(tmp_path / "runs")),
    )


class Clock:
    def __init__(self):
        self.at = NOW

    def __call__(self):
        self.at += timedelta(seconds=90)
        return self.at


def test_flatten_maps_every_field(spark, tmp_path):
    pages = read_pages(spark, land(tmp_path / "in", page(item("a", 41.9), following="p2")))
    row = flatten_items(page_items(pages), 7).first()
    assert (row.skill_id, row.scrape_run_id, row.stat_downloads, row.stat_stars) == ("a", 7, 41, 2)
    assert (row.stat_versions, row.tags, row.badges) == (0, '{"latest":"v1"}', None)
    assert (row.owner_handle, row.owner_handle_top, row.version_number) == ("alice", "top", "1.0.0")
    assert row.created_at == day(2023, 11, 14, 22).replace(minute=13, second=20)
    assert row.version_created_at is None


def test_flatten_of_empty_and_null_objects(spark, tmp_path):
    empty = {"skill": {"_id": "b"}, "owner": None, "latestVersion": None}
    pages = read_pages(spark, land(tmp_path / "in", page({}, empty)))
    rows = flatten_items(page_items(pages), 1).collect()
    assert sorted((r.skill_id or "", r.stat_downloads, r.owner_handle) for r in rows) == [
        ("", 0, None), ("b", 0, None),
    ]


def test_timestamps_do_not_depend_on_the_session_zone(spark, tmp_path):
    pages = read_pages(spark, land(tmp_path / "in", page(item("a", createdAt=0))))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = flatten_items(page_items(pages), 1).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.created_at == day(1970, 1, 1)


def test_bad_page_fails_or_is_left_out(spark, tmp_path):
    folder = land(tmp_path / "in", page(item("a"), following="p2"), page(status="error", cursor="p2"))
    pages = read_pages(spark, folder)
    with pytest.raises(PySparkException, match="status error"):
        flatten_items(page_items(pages), 1).collect()
    kept = flatten_items(page_items(pages, on_bad_page="keep"), 1)
    assert column(kept, "skill_id") == ["a"]


def test_key_violations(spark, tmp_path):
    pages = read_pages(spark, land(tmp_path / "in", page(item("a"), item("a"), item("b"), {})))
    rows = key_violations(flatten_items(page_items(pages), 1)).collect()
    assert sorted((r.skill_id or "", r["rows"]) for r in rows) == [("", 1), ("a", 2)]


def test_dump_keeps_one_level_of_nesting(spark, tmp_path):
    pages = read_pages(spark, land(tmp_path / "in", page(item("a", 5.5))))
    dump_items(page_items(pages), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.json")
    written = json.loads(part.read_text())
    assert written["stats"]["downloads"] == 5.5 and written["stats"]["versions"] == 0.0
    assert written["owner"]["handle"] == "alice" and written["owner_handle"] == "top"


def test_load_writes_rows_counts_and_log(spark, tmp_path, store):
    history, log = store
    clock = Clock()
    first = land(tmp_path / "1", page(item("a"), item("b"), following="p2"), page(item("c"), cursor="p2"))
    second = land(tmp_path / "2", page(item("a", 9), item("b"), item("d")))
    assert load_run(read_pages(spark, first), history, log, clock=clock) == 1
    assert load_run(read_pages(spark, second), history, log, clock=clock) == 2
    rows = {r.id: r for r in log.frame().collect()}
    assert (rows[1].status, rows[1].total_skills, rows[1].new_skills) == ("completed", 3, 0)
    assert (rows[2].new_skills, rows[2].removed_skills, rows[2].changed_skills) == (1, 1, 1)
    assert rows[2].duration_secs == 90.0 and rows[2].started_at < rows[2].finished_at
    h = (history.frame(log), log.frame())
    assert column(diff.diff_new(*h), "skill_id") == ["d"]
    # A later session finds the same rows at the same place.
    again = HistoryTable(spark, history.name + "_again", history.location)
    assert again.buckets == 2 and momentum.velocity(again.frame(log), log.frame()).count() == 4
    with pytest.raises(ValueError, match="2 buckets, not 8"):
        HistoryTable(spark, history.name + "_other", history.location, buckets=8)
    wider = again.rebucketed(history.name + "_wider", str(tmp_path / "wider"), 5, log)
    assert momentum.velocity(wider.frame(log), log.frame()).count() == 4
    with pytest.raises(ValueError, match="is needed"):
        HistoryTable(spark, history.name + "_new", str(tmp_path / "new"))


def test_failed_loads_stay_invisible(spark, tmp_path, store):
    history, log = store
    clock = Clock()
    load_run(read_pages(spark, land(tmp_path / "1", page(item("a")))), history, log, clock=clock)
    twice = read_pages(spark, land(tmp_path / "2", page(item("b"), item("b"))))
    with pytest.raises(DuplicateKeys, match="'b'"):
        load_run(twice, history, log, clock=clock)
    bad = read_pages(spark, land(tmp_path / "3", page(status="error")))
    with pytest.raises(BadPage):
        load_run(bad, history, log, clock=clock)
    nothing = read_pages(spark, land(tmp_path / "4", page()))
    assert load_run(nothing, history, log, clock=clock) == 4
    assert log.states() == {1: "completed", 2: "failed", 3: "failed", 4: "failed"}
    assert column(runs.current(history.frame(log), log.frame()), "skill_id") == ["a"]
    # Loading the run again, now dropping repeats, replaces its rows.
    load_run(twice, history, log, run_id=2, clock=clock, on_duplicate="drop")
    assert column(runs.current(history.frame(log), log.frame()), "skill_id") == ["b"]


def test_failed_reloads_leave_a_completed_run_as_it_was(spark, tmp_path, store):
    history, log = store
    clock = Clock()
    good = read_pages(spark, land(tmp_path / "1", page(item("a"), item("b"))))
    load_run(good, history, log, clock=clock)
    before = log.frame().collect()
    reloads = [
        ([page()], None),
        ([page(item("b"), item("b"))], DuplicateKeys),
        ([page(item("c"), following="p2"), page(status="error", cursor="p2")], BadPage),
    ]
    for k, (pages, error) in enumerate(reloads):
        again = read_pages(spark, land(tmp_path / f"again{k}", *pages))
        if error:
            with pytest.raises(error):
                load_run(again, history, log, run_id=1, clock=clock)
        else:
            load_run(again, history, log, run_id=1, clock=clock)
        assert log.frame().collect() == before
        assert sorted(column(history.frame(log), "skill_id")) == ["a", "b"]
    load_run(
        read_pages(spark, land(tmp_path / "new", page(item("z")))), history, log, run_id=1, clock=clock
    )
    assert column(history.frame(log), "skill_id") == ["z"]


def test_dropping_repeats_keeps_the_row_updated_last(spark, tmp_path, store):
    history, log = store
    pages = page(item("a", 1, updatedAt=5e12), item("a", 2, updatedAt=1e12), item(None), item("b", 3))
    load_run(
        read_pages(spark, land(tmp_path / "1", pages)), history, log, clock=Clock(), on_duplicate="drop"
    )
    assert sorted(map(tuple, history.frame(log).select("skill_id", "stat_downloads").collect())) == [
        ("a", 1), ("b", 3),
    ]


def test_runs_are_compared_with_the_one_before_whatever_the_order_of_loads(spark, tmp_path, store):
    history, log = store
    clock = Clock()
    catalogues = {1: "ab", 2: "bcd", 4: "cdefg", 3: "defgh"}
    for run_id, names in catalogues.items():
        pages = land(tmp_path / str(run_id), page(*[item(n, run_id) for n in names]))
        load_run(read_pages(spark, pages), history, log, run_id=run_id, clock=clock)
    columns = ["scrape_run_id", "new_skills", "removed_skills", "changed_skills"]
    logged = log.frame().withColumnRenamed("id", "scrape_run_id").where("scrape_run_id > 1")
    counted = diff.diff_all_runs(history.frame(log), log.frame()).where("scrape_run_id > 1")
    assert sorted(map(tuple, logged.select(*columns).collect())) == sorted(
        map(tuple, counted.select(*columns).collect())
    )
    assert {r.id: r.total_skills for r in log.frame().collect()} == {1: 2, 2: 3, 3: 5, 4: 5}


def test_events_at_one_instant_are_ordered(store):
    _, log = store
    for status in ("failed", "completed"):
        started = log.start(NOW, 1)[1]
        log.append([next_event(started, status, NOW, total_skills=4)])
    log.start(NOW, 1)
    (row,) = log.frame().collect()
    assert (row.status, row.total_skills, row.started_at) == ("completed", 4, NOW)


@pytest.fixture
def stream(spark, tmp_path, store):
    history, log = store

    def load(**options):
        query = ingest_stream(
            spark, str(tmp_path / "landing"), history, log, str(tmp_path / "checkpoint"),
            clock=Clock(), **options,
        )
        query.awaitTermination()
        return log.states(), sorted(
            (r.scrape_run_id, r.skill_id)
            for r in runs.rows_of_completed(history.frame(log), log.frame()).collect()
        )

    return tmp_path / "landing", load


def test_stream_loads_each_complete_run_once(spark, stream, store):
    (landing, load), log = stream, store[1]
    land(landing / "run=1", page(item("a")))
    land(landing / "run=2", page(item("a"), following="p2"))
    assert load() == ({1: "completed"}, [(1, "a")])
    # The rest of run 2 arrives, and a bad run does not keep run 4 out.
    land(landing / "run=2", page(item("b"), cursor="p2"), name="rest")
    land(landing / "run=3", page(status="error"))
    land(landing / "run=4", page(item("a")))
    states, rows = load()
    assert states == {1: "completed", 2: "completed", 3: "failed", 4: "completed"}
    assert rows == [(1, "a"), (2, "a"), (2, "b"), (4, "a")]
    events = len(log.events())
    assert load() == (states, rows)
    assert events == len(log.events())


def test_a_page_missing_in_the_middle_is_waited_for(stream):
    landing, load = stream
    land(landing / "run=1", page(item("a"), following="p2"))
    land(landing / "run=1", page(item("c"), cursor="p3"), name="third")
    assert load() == ({}, [])
    land(landing / "run=1", page(item("b"), cursor="p2", following="p3"), name="second")
    assert load() == ({1: "completed"}, [(1, "a"), (1, "b"), (1, "c")])


def test_pages_that_arrive_later_load_a_completed_run_again(stream):
    landing, load = stream
    land(landing / "run=1", page(item("a")))
    assert load() == ({1: "completed"}, [(1, "a")])
    land(landing / "run=1", page(item("b"), cursor="p9"), name="late")
    assert load() == ({1: "completed"}, [(1, "a")])
    land(landing / "run=1", page(item("c"), cursor="p8", following="p9"), name="more")
    # The new first page takes the place of the old one.
    land(landing / "run=1", page(item("d"), following="p8"), name="named")
    assert load() == ({1: "completed"}, [(1, "b"), (1, "c"), (1, "d")])


def test_a_kept_page_with_an_error_does_not_end_a_run(stream):
    landing, load = stream
    land(landing / "run=1", page(item("a"), following="p2"), page(status="error", cursor="p2"))
    assert load(on_bad_page="keep") == ({}, [])
    land(landing / "run=1", page(item("c"), cursor="p3"), name="third")
    assert load(on_bad_page="keep") == ({1: "completed"}, [(1, "a"), (1, "c")])


def test_storage_errors_are_raised_and_retried(stream, monkeypatch):
    landing, load = stream
    land(landing / "run=1", page(item("a")))
    stage, broken = HistoryTable.stage, [True]

    def fails_once(self, *args):
        if broken:
            broken.clear()
            raise OSError("disk full")
        return stage(self, *args)

    monkeypatch.setattr(HistoryTable, "stage", fails_once)
    with pytest.raises(StreamingQueryException):
        load()
    assert load() == ({1: "completed"}, [(1, "a")])


def test_a_good_page_supersedes_an_error_and_completes_the_run(stream):
    landing, load = stream
    land(landing / "run=1", page(item("a"), following="p2"))
    land(landing / "run=1", page(status="error", cursor="p2"), name="error")
    assert load() == ({1: "failed"}, [])
    land(landing / "run=1", page(item("b"), cursor="p2"), name="again")
    assert load() == ({1: "completed"}, [(1, "a"), (1, "b")])
    # An error that lands later does no harm to the good page.
    land(landing / "run=1", page(status="error", cursor="p2"), name="late")
    assert load() == ({1: "completed"}, [(1, "a"), (1, "b")])
    # A later good page takes its place.
    land(landing / "run=1", page(item("c"), cursor="p2"), name="a_third")
    assert load() == ({1: "completed"}, [(1, "a"), (1, "c")])


def test_later_is_the_trigger_then_the_time_then_the_name(spark):
    def header(file, batch, at, good=True):
        return ("p2", good, None, None, file, NOW + timedelta(seconds=at), 1, batch)

    cases = [
        ([header("b", 1, 0), header("a", 2, -5)], ["a"]),
        ([header("b", 1, 0), header("a", 1, 5)], ["a"]),
        ([header("b", 1, 0), header("a", 1, 0)], ["b"]),
        ([header("b", 1, 0), header("a", 2, 9, good=False)], ["b"]),
        ([header("b", 1, 0, good=False), header("a", 2, 9, good=False)], ["a"]),
        ([header("b", 1, 0), header("b", 1, 0)], ["b", "b"]),
    ]
    for headers, expected in cases:
        found = landing_job.answers(spark.createDataFrame(headers, landing_job.HEADERS))
        assert column(found, "file") == expected


def test_pages_are_read_once_when_their_run_is_loaded(stream, monkeypatch):
    landing, load = stream
    read, ready_pages = [], landing_job.ready_pages

    def noted(spark, folder, runs, answered):
        read.append(runs)
        return ready_pages(spark, folder, runs, answered)

    monkeypatch.setattr(landing_job, "ready_pages", noted)
    land(landing / "run=1", page(item("a"), following="p2"))
    land(landing / "run=2", page(item("a")))
    assert load()[0] == {2: "completed"}
    land(landing / "run=1", page(item("b"), cursor="p2", following="p3"), name="second")
    load()
    land(landing / "run=1", page(item("c"), cursor="p3"), name="third")
    land(landing / "run=3", page(item("a"), following="p2"))
    assert load() == (
        {1: "completed", 2: "completed"}, [(1, "a"), (1, "b"), (1, "c"), (2, "a")],
    )
    assert read == [[2], [1]]


def test_headers_do_not_parse_the_items():
    value = landing_job._LANDED_HEADER["value"].dataType
    assert value.names == ["nextCursor", "hasMore"]


def test_damaged_input_ends_in_a_defined_place(spark, stream, store, tmp_path):
    (landing, load), (history, log) = stream, store
    nested = {"a": {"b": [1, "x"]}, "n": 1.5, "t": "v1"}
    land(landing / "run=1", page(item("a", tags=nested, badges=["top"])))
    land(landing / "run=2", page(item("b"), item("c", downloads="many")))
    land(landing / "run=3", page(item("a"), following="p2"))
    (landing / "run=3" / "torn.json").write_text('{"cursor": "p2", "status": "succ\n')
    states, rows = load()
    assert states == {1: "completed", 2: "failed", 3: "failed"} and rows == [(1, "a")]
    row = history.frame(log).first()
    assert json.loads(row.tags) == nested and json.loads(row.badges) == ["top"]
    kept = page_source.read_quarantine(spark, str(tmp_path / "checkpoint" / "quarantine"))
    found = sorted((r.run, r.reason, r.file.rsplit("/", 1)[1], r.record[:16]) for r in kept.collect())
    assert found == [
        (2, "damaged", "pages.json", '{"cursor": null,'), (3, "damaged", "torn.json", '{"cursor": "p2",'),
    ]
    assert '"many"' in kept.where("run = 2").first().record
    # Whole pages for the same cursors complete both runs; what was damaged is still on record.
    land(landing / "run=2", page(item("b"), item("c", downloads=7)), name="sound")
    land(landing / "run=3", page(item("b"), cursor="p2"), name="whole")
    states, rows = load()
    assert set(states.values()) == {"completed"}
    assert rows == [(1, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b")]
    kept = page_source.read_quarantine(spark, str(tmp_path / "checkpoint" / "quarantine"))
    assert sorted(column(kept, "run")) == [2, 3]


def test_good_pages_of_a_damaged_run_can_be_kept(spark, tmp_path, store):
    history, log = store
    folder = land(tmp_path / "in", page(item("a")), page(item("b", downloads="x"), cursor="p2"))
    pages = read_pages(spark, folder)
    with pytest.raises(BadPage):
        load_run(pages, history, log, clock=Clock(), quarantine=str(tmp_path / "q"))
    kept = str(tmp_path / "kept")
    assert load_run(pages, history, log, clock=Clock(), on_bad_page="keep", quarantine=kept) == 2
    assert column(history.frame(log), "skill_id") == ["a"]
    for place, run in ((str(tmp_path / "q"), 1), (kept, 2)):
        (record,) = page_source.read_quarantine(spark, place).collect()
        assert (record.run, record.attempt, record.cursor, record.reason) == (run, 1, "p2", "damaged")


def test_runs_of_a_trigger_are_loaded_together(stream, store, monkeypatch):
    (landing, load), (history, log) = stream, store
    writes, append = [], RunLog.append
    monkeypatch.setattr(RunLog, "append", lambda self, events: (writes.append(len(events)), append(self, events))[1])
    land(landing / "run=1", page(item("a"), item("b")))
    land(landing / "run=2", page(item("b", 5), item("c")))
    land(landing / "run=3", page())
    land(landing / "run=4", page(item("d"), item("d")))
    land(landing / "run=5", page(item("c"), item("d"), item("e")))
    states, _ = load()
    assert states == {1: "completed", 2: "completed", 3: "failed", 4: "failed", 5: "completed"}
    assert writes == [5, 5]
    rows = {r.id: (r.total_skills, r.new_skills, r.removed_skills, r.changed_skills) for r in log.frame().collect()}
    assert rows == {1: (2, 0, 0, 0), 2: (2, 1, 1, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (3, 2, 1, 0)}
    # A run between two others changes the counts of the one after it in the same append.
    land(landing / "run=3", page(item("c")), name="found")
    load()
    assert writes == [5, 5, 1, 2]
    rows = {r.id: (r.new_skills, r.removed_skills) for r in log.frame().collect()}
    assert rows[3] == (0, 1) and rows[5] == (2, 0)


class Broken(Exception):
    pass


# Steps of a load as (object, function, which call fails, whether it fails after its work).
STEPS = [
    (RunLog, "append", 1, False),
    (HistoryTable, "vacuum", 1, False),
    (HistoryTable, "stage", 1, False),
    (HistoryTable, "_insert", 1, True),
    (load_job, "check_runs", 1, False),
    (load_job, "diff_all_runs", 1, False),
    (RunLog, "_write", 2, False),
    (RunLog, "append", 2, False),
    (RunLog, "append", 2, True),
]


@pytest.mark.parametrize("owner, name, call, after", STEPS)
@pytest.mark.parametrize("dies", [False, True])
def test_rows_and_log_agree_wherever_a_load_fails(
    spark, tmp_path, store, monkeypatch, owner, name, call, after, dies
):
    """`dies` leaves the job no chance to log its failure either."""
    history, log = store
    clock = Clock()

    def pages(k, *names):
        return read_pages(spark, land(tmp_path / str(k), page(*[item(n, k) for n in names])))

    for run_id, names in ((1, "abc"), (2, "bcd"), (3, "cde")):
        load_run(pages(run_id, *names), history, log, run_id=run_id, clock=clock)

    def seen():
        # As another session would see it.
        now = RunLog(spark, log.location)
        rows = HistoryTable(spark, history.name, history.location).frame(now)
        state = [
            (r.id, r.status, r.total_skills, r.new_skills, r.removed_skills, r.changed_skills)
            for r in now.frame().collect()
        ]
        totals = sorted(map(tuple, now.totals().collect()))
        return state, totals, sorted(map(tuple, rows.select("scrape_run_id", "skill_id").collect()))

    before = seen()
    step, calls = getattr(owner, name), []

    def failing(*args, **kwargs):
        calls.append(name)
        if len(calls) == call or (dies and len(calls) > call):
            if after:
                step(*args, **kwargs)
            raise Broken
        return step(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(owner, name, failing)
        if dies and name != "append":
            patch.setattr(RunLog, "append", _until_broken(RunLog.append, calls, call))
        with pytest.raises(Broken):
            load_run(pages(9, "x", "y"), history, log, run_id=2, clock=clock)
    published = (name, after) == ("append", True)
    expected = before if not published else (
        [(1, "completed", 3, 0, 0, 0), (2, "completed", 2, 2, 3, 0), (3, "completed", 3, 3, 2, 0)],
        [(1, 3, 3, 6), (2, 2, 18, 4), (3, 3, 9, 6)],
        [(1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, "y"), (3, "c"), (3, "d"), (3, "e")],
    )
    assert seen() == expected
    # The next load finds nothing in its way.
    load_run(pages(10, "z"), history, log, run_id=2, clock=clock)
    state, _, rows = seen()
    assert state[1] == (2, "completed", 1, 1, 3, 0) and (2, "z") in rows and (2, "x") not in rows


def _until_broken(append, calls, call):
    def guarded(self, events):
        if len(calls) >= call:
            raise Broken
        append(self, events)

    return guarded


def test_readers_keep_what_they_began_with(spark, tmp_path, store):
    history, log = store
    first = read_pages(spark, land(tmp_path / "1", page(item("a"), item("b"))))
    load_run(first, history, log, clock=Clock())
    rows, state = history.frame(log), log.frame()
    again = read_pages(spark, land(tmp_path / "2", page(item("c"))))
    load_run(again, history, log, run_id=1, clock=Clock())
    assert sorted(column(rows, "skill_id")) == ["a", "b"]
    assert column(state, "total_skills") == [2]
    assert column(history.frame(log), "skill_id") == ["c"]


def test_versions_that_no_event_names_are_removed_by_the_next_load(spark, tmp_path, store):
    history, log = store
    for k in range(4):
        pages = read_pages(spark, land(tmp_path / str(k), page(item(f"a{k}"))))
        load_run(pages, history, log, run_id=1, clock=Clock())
    # The one in use and the one before it, for readers that have begun.
    folders = sorted(p.name for p in (tmp_path / "snapshots" / "scrape_run_id=1").iterdir())
    assert folders == ["version=3", "version=4"]


def test_a_thousand_loads_leave_few_files(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"), compact_after=6)
    # Each append stands for a load of many runs, so that the test is short.
    for k in range(25):
        runs_of = range(40 * k + 1, 40 * k + 41)
        opened = log.start(NOW, *runs_of)
        log.append([
            next_event(e, "failed" if run % 50 == 0 else "completed", NOW, total_skills=run, total_downloads=run)
            for run, e in opened.items()
        ])
    files = [p for p in (tmp_path / "runs").rglob("*.parquet") if p.is_file()]
    assert len(files) <= 2 * (6 + 2)
    again = RunLog(spark, str(tmp_path / "runs"))
    assert again.latest() == log.latest() and len(again.latest()) == 1000
    assert again.totals().count() == 980
    assert again.frame().where("id = 77").first().total_skills == 77
    # Attempts are numbered on after a snapshot.
    again.start(NOW, 50)
    assert again.start(NOW, 50)[50].attempt == 3 and again.states()[50] == "running"
    again.append([next_event(again.start(NOW, 7)[7], "failed", NOW)])
    again.compact()
    assert again.states()[7] == "completed" and again.start(NOW, 7)[7].attempt == 3


def test_an_unfinished_snapshot_of_the_log_is_not_used(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    log.append([next_event(log.start(NOW, 1)[1], "completed", NOW, total_skills=3)])
    log.compact()
    before = log.latest()
    log._write([next_event(before[1], "failed", NOW)], str(tmp_path / "runs" / "snapshot=2"), "overwrite")
    (tmp_path / "runs" / "snapshot=2" / "_SUCCESS").unlink()
    assert RunLog(spark, log.location).latest() == before
    log.compact()
    assert RunLog(spark, log.location).latest() == before


def test_the_log_is_a_local_relation(store):
    _, log = store
    log.append([next_event(log.start(NOW, 1)[1], "completed", NOW, total_skills=3)])
    plan = runs.get_run(log.frame(), 1)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "Scan parquet" not in plan
    empty = RunLog(log.spark, log.location + "_new")
    assert empty.frame().collect() == [] and empty.totals().collect() == []
    assert empty.frame().dtypes == log.frame().dtypes


def test_documents_and_index(spark, catalogue, tmp_path):
    for i, version in enumerate(["1", "1", "2"]):
        catalogue.run(
            day(2026, 3, 1 + i),
            a={"stat_downloads": 100 * (i + 1), "version_number": version},
            b={"stat_downloads": 50, "owner_handle": "Other Owner"},
            c={"stat_downloads": 9000, "slug": None},
        )
    h = catalogue.frames()
    assert publisher.publish(*h, str(tmp_path), now=NOW)

    def read(name):
        lines = [p.read_text() for p in sorted((tmp_path / name).rglob("part-*.json"))]
        return [json.loads(line) for text in lines for line in text.splitlines()]

    (dashboard,) = read("dashboard")
    assert dashboard["download_sparkline"] == [9150, 9250, 9350]
    assert dashboard["total_skills"] == 3 and dashboard["weekly_growth"] == []
    (rising,) = read("rising")
    charts = [(s["skill_id"], s["velocity_chart"]) for s in rising["skills"]]
    assert charts == [("a", [100, 200, 300])]
    (leaders,) = read("leaderboard")
    assert [s["skill_id"] for s in leaders["all_time"]] == ["c", "a", "b"]
    details = {d["slug"]: d for d in read("entity_details")}
    assert set(details) == {"a-page", "b-page"}
    assert [p["downloads"] for p in details["a-page"]["history"]] == [100, 200, 300]
    assert [r["version_number"] for r in details["a-page"]["version_releases"]] == ["2"]
    owners = {d["handle"]: d for d in read("owner_details")}
    assert owners["Other Owner"]["owner_key"] == "other-owner"
    assert owners["maker"]["download_trajectory"] == [9100, 9200, 9300]
    (index,) = read("index")
    assert {d["kind"]: d["available"] for d in index["documents"]} == {
        "entities": ["a-page", "b-page"], "owners": ["maker", "other-owner"],
    }


    # One document is found in one folder.
    found = publisher.find_detail(spark, str(tmp_path), "entities", "a-page", "stat_downloads bigint")
    assert found.collect() == [("a-page", 300)]
    (filters,) = re.findall(r"PartitionFilters: \[[^\]]*\]", plan(found))
    assert re.search(r"bucket#\d+ = \d+", filters)
    folders = found.select("_metadata.file_path").collect()
    assert len(folders) == 1 and "/entity_details/bucket=" in folders[0].file_path
    assert publisher.find_detail(spark, str(tmp_path), "entities", "z-page", "history string").collect() == []
    owner = publisher.find_detail(spark, str(tmp_path), "owners", "other-owner", "handle string")
    assert owner.collect() == [("other-owner", "Other Owner")]
    keys = spark.createDataFrame([("b-page",), ("z-page",), ("b-page",)], "k string")
    many = publisher.find_details(spark, str(tmp_path), "entities", keys, "stat_downloads bigint")
    assert sorted(map(tuple, many.collect())) == [("b-page", 50, True), ("z-page", None, False)]


def test_nothing_is_published_without_a_completed_run(catalogue, tmp_path):
    catalogue.run(day(2026, 3, 1), status="failed", a=1)
    assert not publisher.publish(*catalogue.frames(), str(tmp_path / "out"), now=NOW)
    assert not (tmp_path / "out").exists()


def test_page_documents_of_an_empty_history(catalogue):
    h = catalogue.frames()
    dashboard = documents.dashboard(*h, now=NOW).first()
    assert (dashboard.total_skills, dashboard.weekly_growth, dashboard.avg_wow_pct) == (0, [], None)
    assert documents.rising(*h, now=NOW).first().skills == []
    assert documents.leaderboard(*h, now=NOW).first().all_time == []
    assert documents.owners_page(*h, now=NOW).first().by_stars == []


def test_report_leaves_out_empty_optional_sections(catalogue):
    catalogue.run(day(2026, 3, 1), a=1)
    names = column(report_contents(report(*catalogue.frames(), now=NOW)), "section")
    assert names == [
        "platform_totals", "top_share", "growth_timeline", "cohort_quality", "hot_new",
        "top_by_downloads", "star_rate", "most_versions", "owner_leaderboard",
    ]
