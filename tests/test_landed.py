"""Pages made from a history: what is written, and how little moves for it."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from tests.conftest import Catalogue, day
from tidemark.plans import landed, star_history
from tidemark.sources.pages import read_pages


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_landed_pages_are_compressed_and_whole(spark, tmp_path):
    catalogue = Catalogue(spark)
    for k in range(3):
        catalogue.run(day(2026, 3, 1 + k), **{f"C{n}": n for n in range(0, 900, 7)})
    snapshots, _ = catalogue.frames()
    landed.land(snapshots, f"{tmp_path}/landing", bad_run=2, empty_run=9)
    files = [p for p in Path(tmp_path, "landing").rglob("*.json*") if not p.name.startswith(".")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    pages = read_pages(spark, f"{tmp_path}/landing")
    items = pages.select("run", F.explode("value.page").alias("item"))
    assert {r.run: r["count"] for r in items.groupBy("run").count().collect()} == {
        k: 129 for k in (1, 2, 3)
    }
    assert pages.where("status = 'error'").select("run").collect()[0].run == 2


def test_rows_of_the_runs_are_made_behind_the_last_shuffle(spark):
    text = plan(star_history._customer_runs(spark, "/root/testdata/sf0.001"))
    shuffled = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", text)
    assert shuffled and not any("scrape_run_id" in keys for keys in shuffled)
