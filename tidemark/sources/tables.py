"""The two stored tables: snapshot history and run log.

A load writes the rows of a run as a new version, which no reader sees. The event in the log that
completes the run names the version, so that one append makes rows, state, counts and totals change
together. Nothing that readers use is ever moved or written over.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import RUNS, SNAPSHOTS, TOTALS

_logger = logging.getLogger(__name__)

PARTITION, KEY, VERSION = "scrape_run_id", "skill_id", "version"

# After so many events the log is written anew as one file.
COMPACT_AFTER = 32


def file_path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    files, path = file_path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


class HistoryTable:
    """Parquet table partitioned by run and version, bucketed by entity.

    Partitioning lets a query read only the runs it needs. Bucketing makes joins and aggregations by
    entity across runs free of shuffles. Entities are unique per run, so buckets are even; choose
    `buckets` so that one run's bucket is about one file of convenient size. The number is stored
    with the table: opening it with another one is refused, leaving it out takes the stored one, and
    `rebucketed` copies the table to another number.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int | None = None):
        self.spark, self.name, self.location = spark, name, location
        self.buckets = buckets = self._layout(buckets)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SNAPSHOTS)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {VERSION} int) USING parquet "
            f"PARTITIONED BY ({PARTITION}, {VERSION}) CLUSTERED BY ({KEY}) INTO {buckets} BUCKETS "
            f"LOCATION '{location}'"
        )
        self.known: set[tuple[int, int]] = set()
        self._recover()  # written by earlier sessions

    def _recover(self) -> None:
        if any(n.startswith(f"{PARTITION}=") for n in file_names(self.spark, self.location)):
            self.spark.catalog.recoverPartitions(self.name)
        self.known = self._stored_versions()

    def _stored_versions(self) -> set[tuple[int, int]]:
        """(run, version) of every partition in the catalog."""
        listed = self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()
        return {tuple(map(int, re.findall(r"=(\d+)", r.partition))) for r in listed}

    def _layout(self, buckets: int | None) -> int:
        """The stored number of buckets, stored now if the table is new."""
        folder = f"{self.location}/_layout"
        names = file_names(self.spark, self.location)
        layout = self.spark.read.schema("buckets int")
        stored = layout.json(folder).first() if "_layout" in names else None
        if stored is None:
            if buckets is None:
                raise ValueError(f"no table at {self.location}: its number of buckets is needed")
            if any(n.startswith(f"{PARTITION}=") for n in names):
                raise ValueError(f"the rows at {self.location} have no stored number of buckets")
            self.spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets")).write.mode(
                "overwrite"
            ).json(folder)
            return buckets
        if buckets not in (None, stored.buckets):
            raise ValueError(
                f"the table at {self.location} has {stored.buckets} buckets, not {buckets}"
            )
        return stored.buckets

    def rebucketed(
        self, name: str, location: str, buckets: int, log: RunLog | None = None
    ) -> HistoryTable:
        """A copy of the table at another place with another number of buckets.

        With the log only the rows that it names are copied, under the same versions, so the log
        serves the copy as well.
        """
        copy = HistoryTable(self.spark, name, location, buckets)
        copy._insert(self._versions(log.versions()) if log else self.spark.table(self.name))
        return copy

    def frame(self, log: RunLog | None = None) -> DataFrame:
        """The rows of the completed runs of `log` as of this call; without a log all rows there are.

        Loads that end later change neither these rows nor a log frame taken at the same time.
        """
        if log is None:
            return self.spark.table(self.name).drop(VERSION)
        return self.at(log.versions())

    def at(self, versions: Mapping[int, int]) -> DataFrame:
        """The rows of the given versions, by run. Other partitions are not listed."""
        return self._versions(versions).drop(VERSION)

    def _versions(self, versions: Mapping[int, int]) -> DataFrame:
        if not versions.items() <= self.known:
            self._recover()  # loaded by another session
        return self.spark.table(self.name).where(chosen_versions(versions))

    def _insert(self, rows: DataFrame) -> None:
        """One task per bucket, so each version of a run gets one file per bucket."""
        laid_out = rows.select(*SNAPSHOTS.fieldNames(), VERSION).repartition(self.buckets, KEY)
        laid_out.write.insertInto(self.name)
        self.known = self._stored_versions()

    def stage(self, snapshots: DataFrame, versions: Mapping[int, int]) -> DataFrame:
        """Write rows of one or more runs, each as its version, and return them.

        A version no log event names is invisible to `frame`. Versions are written once.
        """
        wrong = [run for run in versions if run < 1]
        if wrong:
            raise ValueError(f"run ids begin at 1, not {wrong[0]}")
        self._insert(snapshots.withColumn(VERSION, lookup(versions, F.col(PARTITION))))
        return self.at({run: v for run, v in versions.items() if (run, v) in self.known})

    def add_runs(self, snapshots: DataFrame) -> None:
        """Append rows of several runs at once, without a log."""
        self._insert(snapshots.withColumn(VERSION, F.lit(0)))

    def vacuum(self, keep: Mapping[int, int], runs: Iterable[int]) -> None:
        """Remove all versions of `runs` but the one that `keep` names, rows of failed loads too."""
        among = set(runs)
        old = sorted((r, v) for r, v in self.known if r in among and keep.get(r) != v)
        for run, version in old:
            self.spark.sql(
                f"ALTER TABLE {self.name} DROP IF EXISTS "
                f"PARTITION ({PARTITION} = {run}, {VERSION} = {version})"
            )
            files, path = file_path(
                self.spark, f"{self.location}/{PARTITION}={run}/{VERSION}={version}"
            )
            files.delete(path, True)
        if old:
            self.known -= set(old)
            self.spark.catalog.refreshTable(self.name)


def chosen_versions(versions: Mapping[int, int]) -> Column:
    """A condition on the partition columns that leaves one version of each run."""
    runs_of: dict[int, list[int]] = {}
    for run, version in versions.items():
        runs_of.setdefault(version, []).append(run)
    chosen = F.lit(False)
    for version, runs in sorted(runs_of.items()):
        chosen |= (F.col(VERSION) == version) & F.col(PARTITION).isin(sorted(runs))
    return chosen


def lookup(values: Mapping[int, int], key: Column) -> Column:
    """The value of a small mapping at a column's key."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


COUNTS = ("total_skills", "new_skills", "removed_skills", "changed_skills")

_EVENT = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    *[T.StructField(name, T.IntegerType()) for name in COUNTS],
    T.StructField("total_downloads", T.LongType()),
    T.StructField("total_stars", T.LongType()),
    T.StructField("feed", T.IntegerType()),
])


class Event(NamedTuple):
    """What an attempt to load a run came to, as far as it is known.

    The number of a completed attempt is the version of the run's rows in the history table; `feed` is
    the version of its changes in the change feed, 0 if it has none.
    """

    id: int
    attempt: int
    seq: int
    status: str
    started_at: datetime
    finished_at: datetime | None = None
    total_skills: int = 0
    new_skills: int = 0
    removed_skills: int = 0
    changed_skills: int = 0
    total_downloads: int = 0
    total_stars: int = 0
    feed: int = 0

    def rank(self) -> tuple:
        return self.status == "completed", self.attempt, self.seq


def _order(event: Event) -> tuple:
    return event.id, event.attempt, event.seq


_ARROW = {
    T.IntegerType(): pa.int32(),
    T.LongType(): pa.int64(),
    T.DoubleType(): pa.float64(),
    T.StringType(): pa.string(),
    T.TimestampNTZType(): pa.timestamp("us"),
}


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A frame of a few rows as a local relation, whose size the optimizer knows."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(c, _ARROW[f.dataType]) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, schema.names), schema=schema)


class RunLog:
    """Run log as appended status events, with a snapshot of the log from time to time.

    A run's state is the last event of its last completed attempt, or of its last attempt if none is
    completed: a reload that fails, or is still going on, leaves a completed run as it was. Each
    append is one file with all the events that must hold together.

    Files lie in generations. `snapshot=<n>` holds what decides each run, `events=<n>` what was
    appended after it, and the highest finished snapshot is the pointer to the log in use. The
    generation before stays for readers that have begun, older ones go, so the number of files has a
    bound whatever the number of loads. One job writes to a log at a time; readers need no care.

    The log has a few small rows per run, which pass through the driver.
    """

    def __init__(self, spark: SparkSession, location: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.location, self.compact_after = spark, location, compact_after
        self._read_files: tuple | None = None
        self._read_events: list[Event] = []
        files, path = file_path(spark, location)
        files.mkdirs(path)

    def _generation(self) -> int:
        """The newest generation whose snapshot is finished; the first one has none."""
        numbers = [int(n[9:]) for n in file_names(self.spark, self.location) if n.startswith("snapshot=")]
        for n in sorted(numbers, reverse=True):
            if "_SUCCESS" in file_names(self.spark, f"{self.location}/snapshot={n}"):
                return n
        return 0

    def _files(self) -> list[str]:
        """The data files of the generation in use."""
        n = self._generation()
        return [
            f"{self.location}/{folder}/{name}"
            for folder in (f"snapshot={n}", f"events={n}")
            for name in file_names(self.spark, f"{self.location}/{folder}")
            if name.endswith(".parquet")
        ]

    def events(self) -> list[Event]:
        """All events in use. Files are never changed, so they are read again only if there are others."""
        for attempt in range(3):
            files = self._files()
            if self._read_files == tuple(files):
                break
            try:
                rows = self.spark.read.schema(_EVENT).parquet(*files).collect() if files else []
            except Exception:
                # The generation was replaced and removed since it was listed.
                if attempt == 2 or self._files() == files:
                    raise
                continue
            self._read_events = sorted((Event(*r) for r in rows), key=_order)
            self._read_files = tuple(files)
        return self._read_events

    def latest(self) -> dict[int, Event]:
        """The deciding event of each run."""
        latest: dict[int, Event] = {}
        for event in self.events():
            known = latest.get(event.id)
            if known is None or known.rank() < event.rank():
                latest[event.id] = event
        return latest

    def _newest(self) -> dict[int, Event]:
        """The last event of the last attempt of each run."""
        return {event.id: event for event in self.events()}

    def versions(self) -> dict[int, int]:
        """The version of the rows of each completed run."""
        return {e.id: e.attempt for e in self.latest().values() if e.status == "completed"}

    def feed_versions(self) -> dict[int, int]:
        """The version of the changes of each completed run that has any recorded."""
        latest = self.latest().values()
        return {e.id: e.feed for e in latest if e.status == "completed" and e.feed}

    def states(self) -> dict[int, str]:
        """Status by run id."""
        return {run: e.status for run, e in self.latest().items()}

    def frame(self) -> DataFrame:
        """One row per run with the columns of `schema.RUNS`, as of this call."""
        rows = []
        for _, e in sorted(self.latest().items()):
            took = (e.finished_at - e.started_at).total_seconds() if e.finished_at else None
            counts = (e.new_skills, e.removed_skills, e.changed_skills)
            rows.append((e.id, e.started_at, e.finished_at, e.total_skills, e.status, took, *counts))
        return small_frame(self.spark, rows, RUNS)

    def totals(self) -> DataFrame:
        """Totals of every completed run that has rows, with the columns of `schema.TOTALS`.

        Loads write them with the event that completes a run, so no history file is read for them.
        """
        rows = [
            (e.id, e.total_skills, e.total_downloads, e.total_stars)
            for _, e in sorted(self.latest().items())
            if e.status == "completed" and e.total_skills
        ]
        return small_frame(self.spark, rows, TOTALS)

    def append(self, events: list[Event]) -> None:
        """Add events in one file: readers see all of them or none."""
        self._write(events, f"{self.location}/events={self._generation()}", "append")
        if len(self._files()) > self.compact_after:
            try:
                self.compact()
            except Exception:
                # The events stand; the next append tries again.
                _logger.exception("the run log at %s could not be compacted", self.location)

    def _write(self, events: list[Event], folder: str, mode: str) -> None:
        rows = small_frame(self.spark, [tuple(e) for e in events], _EVENT)
        rows.coalesce(1).write.mode(mode).parquet(folder)

    def compact(self) -> None:
        """Begin a new generation with the events that decide each run or number its next attempt."""
        n = self._generation()
        kept = sorted({*self.latest().values(), *self._newest().values()}, key=_order)
        self._write(kept, f"{self.location}/snapshot={n + 1}", "overwrite")
        for folder in (f"snapshot={n - 1}", f"events={n - 1}"):
            files, path = file_path(self.spark, f"{self.location}/{folder}")
            files.delete(path, True)

    def start(self, at: datetime, *run_ids: int) -> dict[int, Event]:
        """Open an attempt to load each of some runs: the next free run unless ids are given."""
        last = self._newest()
        opened = {
            run: Event(run, last[run].attempt + 1 if run in last else 1, 1, "running", at)
            for run in run_ids or [max(last, default=0) + 1]
        }
        self.append(list(opened.values()))
        return opened


def next_event(event: Event, status: str, at: datetime, **figures: int) -> Event:
    """What follows `event` in its attempt."""
    return event._replace(seq=event.seq + 1, status=status, finished_at=at, **figures)

