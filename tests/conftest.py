from __future__ import annotations

from datetime import datetime

import pytest

from tidemark.schema import RUNS, SNAPSHOTS
from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="2",
        # Tiny inputs: compiling stages would take most of the time. The comparison with SQL runs
        # with code generation.
        spark__sql__codegen__wholeStage="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(year: int, month: int, date: int, hour: int = 0) -> datetime:
    return datetime(year, month, date, hour)


class Catalogue:
    """Builds a history from a few rows: `run(start, entity=downloads or dict of columns, ...)`."""

    defaults = {
        "owner_handle": "maker",
        "stat_downloads": 100,
        "stat_stars": 4,
        "stat_comments": 7,
        "stat_installs_all_time": 35,
        "stat_installs_current": 12,
        "stat_versions": 2,
        "version_number": "0.3",
    }

    def __init__(self, spark):
        self.spark, self.runs, self.rows = spark, [], []

    def run(self, started_at, status="completed", **entities):
        run_id = len(self.runs) + 1
        self.runs.append({"id": run_id, "started_at": started_at, "status": status})
        for skill_id, values in entities.items():
            if not isinstance(values, dict):
                values = {"stat_downloads": values}
            named = {"slug": f"{skill_id}-page", "display_name": f"The {skill_id}"}
            self.rows.append(
                self.defaults
                | named
                | {"skill_id": skill_id, "scrape_run_id": run_id, "stat_downloads": 100}
                | values
            )
        return self

    def _frame(self, rows, schema):
        names = schema.fieldNames()
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def frames(self):
        return self._frame(self.rows, SNAPSHOTS), self._frame(self.runs, RUNS)


@pytest.fixture
def catalogue(spark):
    return Catalogue(spark)


def column(df, name):
    return [r[name] for r in df.collect()]
