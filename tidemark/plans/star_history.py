"""A run history derived from the star-schema tables (orders, customer, nation).

Customers are the entities, nations the owners, and the counters are order figures up to each of
twelve monthly runs. An entity is in a run if it was created before and ordered in the 180 days
before the run.
"""

from __future__ import annotations

from datetime import datetime
from threading import Lock
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.growth import rollup
from tidemark.schema import SNAPSHOTS, TOTALS
from tidemark.session import shared_folder
from tidemark.sources.tables import HistoryTable, small_frame

# Fixed values of the mapping.
NOW = datetime(2001, 8, 1, 6)
RUNS = 12
FIRST_START = "timestamp_ntz'2000-09-01 00:00:00'"
FAILED_RUN = 6
ACTIVE = "interval 180 days"
FIRST_CREATED = "timestamp_ntz'2000-01-03 00:00:00'"

# Of the table of customers; about 250,000 of them.
ENTITY_BYTES_PER_FILE = 5 << 20


class History(NamedTuple):
    snapshots: DataFrame
    runs: DataFrame


def star_runs(spark: SparkSession) -> DataFrame:
    """The run log: twelve monthly runs, one failed."""
    return spark.range(1, RUNS + 1, numPartitions=1).selectExpr(
        "int(id) AS id",
        f"{_started('int(id)')} AS started_at",
        f"if(id = {FAILED_RUN}, 'failed', 'completed') AS status",
    )


def _started(run: str) -> str:
    return f"{FIRST_START} + make_ym_interval(0, {run} - 1)"


def _runs_reached(at: str, shift: str) -> str:
    """Number of runs whose start, moved back by `shift`, is not after `at`."""
    return " + ".join(
        f"int({at} >= {_started(str(run))} - {shift})" for run in range(1, RUNS + 1)
    )


def _customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order figures per customer and run.

    An order counts from the first run after it; it is recent for the runs up to 180 days later.
    Orders are first combined per customer and such pair of runs, map-side, so neither the number of
    runs nor a customer with very many orders multiplies what is shuffled. Rows of the runs are made
    where all pairs of a customer are, so only pairs, at most 78 of them, are shuffled.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    combined = (
        orders.where(f"o_orderdate < {_started(str(RUNS))}")
        .selectExpr(
            "*",
            f"1 + {_runs_reached('o_orderdate', 'interval 0 days')} AS first_run",
            f"{_runs_reached('o_orderdate', ACTIVE)} AS last_recent",
        )
        .groupBy("o_custkey", "first_run", "last_recent")
        .agg(
            F.expr("count(*) AS orders"),
            F.expr("sum(bigint(floor(o_totalprice / 1000))) AS thousands"),
            F.expr("sum(bigint(floor(o_totalprice / 5000))) AS installs"),
            F.expr("count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent"),
            F.expr("count_if(o_orderstatus = 'P') AS pending"),
            F.expr("max(struct(o_orderdate, o_orderkey, o_orderpriority)) AS newest"),
        )
    )
    return (
        combined.repartition("o_custkey")
        .selectExpr("*", f"explode(sequence(first_run, {RUNS})) AS scrape_run_id")
        .groupBy("o_custkey", "scrape_run_id")
        .agg(
            F.expr("sum(orders) AS stat_versions"),
            F.expr("sum(thousands) AS stat_downloads"),
            F.expr("sum(installs) AS stat_installs_all_time"),
            F.expr("sum(if(scrape_run_id <= last_recent, installs, 0)) AS stat_installs_current"),
            F.expr("sum(urgent) AS stat_stars"),
            F.expr("sum(pending) AS stat_comments"),
            F.expr("max(newest) AS newest"),
            F.expr("bool_or(scrape_run_id <= last_recent) AS active"),
        )
        .where("active")
    )


def star_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot history as a plan over the star-schema tables."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "*",
        f"{FIRST_CREATED} + make_dt_interval(int(c_custkey * 7 % 577), int(c_custkey % 24))"
        " AS created",
    )
    rows = (
        _customer_runs(spark, sf_dir)
        # The rows of a customer are side by side already; the customers need not pass the driver.
        .join(customers.hint("merge"), F.expr("o_custkey = c_custkey"))
        .where(f"created < {_started('scrape_run_id')}")
        .join(nations, F.expr("c_nationkey = n_nationkey"), "left")
    )
    columns = {
        "skill_id": "concat('C', c_custkey)",
        "slug": "if(c_custkey % 97 <> 0, lower(replace(c_name, '#', '-')), NULL)",
        "display_name": "c_name",
        "summary": "c_mktsegment",
        "created_at": "if(c_custkey % 89 <> 0, created, NULL)",
        "updated_at": "newest.o_orderdate",
        "owner_handle": "if(c_custkey % 101 <> 0, n_name, NULL)",
        "version_number": "newest.o_orderpriority",
        "version_changelog": "concat('order ', newest.o_orderkey)",
    }
    known = set(rows.columns)
    return rows.selectExpr(*[
        f"CAST({columns.get(f.name, f.name if f.name in known else 'NULL')}"
        f" AS {f.dataType.simpleString()}) AS {f.name}"
        for f in SNAPSHOTS
    ])


class Stored(NamedTuple):
    table: HistoryTable
    totals: list[tuple]


_stored: dict[tuple[str, str], Stored] = {}
_storing = Lock()


def star_history(spark: SparkSession, sf_dir: str) -> History:
    """The history of `sf_dir`, written once per application as a partitioned, bucketed table.

    The table lies in the cluster's shared folder, so a lost executor costs no recomputation.
    """
    return History(_star_table(spark, sf_dir).table.frame(), star_runs(spark))


def star_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of the history, made when it is written: one row per run."""
    return small_frame(spark, _star_table(spark, sf_dir).totals, TOTALS)


def _star_table(spark: SparkSession, sf_dir: str) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _storing:
        if key not in _stored:
            _stored[key] = _store(spark, sf_dir, shared_folder(spark))
    return _stored[key]


def _store(spark: SparkSession, sf_dir: str, folder: str) -> Stored:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/customer.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = files.getContentSummary(path).getLength()
    # Bounded file sizes for many entities, no more files than cores for few.
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // ENTITY_BYTES_PER_FILE))
    name = "history_" + folder.rsplit("-", 1)[1]
    table = HistoryTable(spark, name, f"{folder}/snapshots", buckets)
    table.add_runs(star_snapshots(spark, sf_dir))
    totals = rollup(table.frame()).select(*TOTALS.names).orderBy("scrape_run_id").collect()
    return Stored(table, [tuple(r) for r in totals])
