"""Incremental load of landed pages with Structured Streaming.

Pages land as `<landing>/run=<id>/*.json`. Of each new page only its header is read at first: which
request it answers, whether it is good, and which page it names as the next one. The headers of a
run are kept between triggers; once its pages form a whole chain, the run is loaded from them.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import PAGE
from tidemark.sources.feed import ChangeFeed
from tidemark.sources.load import BadPage, load_runs, utc_now
from tidemark.sources.pages import DAMAGED, is_good, page_schema, write_quarantine
from tidemark.sources.tables import HistoryTable, RunLog

log = logging.getLogger(__name__)

_RUN = T.StructField("run", T.IntegerType())
LANDED = page_schema(PAGE, _RUN)

# The items of a page are not parsed for its header.
_LANDED_HEADER = page_schema(
    T.StructType([
        *[f for f in PAGE if f.name != "value"],
        T.StructField(
            "value", T.StructType([f for f in PAGE["value"].dataType if f.name != "page"])
        ),
    ]),
    _RUN,
)

# `next_cursor` is null for the last page and for one with an error; `damaged` is the text of a line
# that is no page.
HEADERS = (
    "cursor string, good boolean, next_cursor string, damaged string, file string,"
    " landed_at timestamp, run int, batch long"
)


def page_headers(landed: DataFrame) -> DataFrame:
    """Columns of `HEADERS` but the batch, of pages read from files."""
    good = is_good(landed)
    more = good & F.coalesce(F.col("value.hasMore"), F.lit(False))
    return landed.select(
        "cursor",
        good.alias("good"),
        F.when(more, F.col("value.nextCursor")).alias("next_cursor"),
        F.col(DAMAGED).alias("damaged"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        "run",
    )


def answers(headers: DataFrame) -> DataFrame:
    """The headers that count: of each run and cursor the good page that landed last.

    A later page supersedes an earlier answer to the same cursor, but one with an error supersedes no
    good one; an error counts while its cursor has no good page. Later is the later trigger, then the
    time and the name of the file. Pages of one file that answer the same cursor count together. A
    damaged line answers nothing.
    """
    newest = Window.partitionBy("run", "cursor").orderBy(
        F.desc("good"), F.desc("batch"), F.desc("landed_at"), F.desc("file")
    )
    pages = headers.where("damaged IS NULL")
    return pages.withColumn("place", F.rank().over(newest)).where("place = 1").drop("place")


def chains(answered: DataFrame) -> DataFrame:
    """What is there of each run's chain of pages, from the headers that count: run, errors, whole.

    A chain is whole if the first page, the last one, and every page that another names have landed,
    and every page is named by another. A page with an error names no successor and is never the last
    one, so the page behind each may be one that no other names.
    """

    def mark(condition: Column | bool) -> Column:
        return condition if isinstance(condition, Column) else F.lit(condition)

    def links(cursor: str, rows: DataFrame, **marks: Column | bool) -> DataFrame:
        kinds = ("landed", "named", "last", "error")
        return rows.select(
            "run", F.col(cursor).alias("cursor"), *[mark(marks.get(k, False)).alias(k) for k in kinds]
        )

    good, following = F.col("good"), F.col("next_cursor")
    landed = links("cursor", answered, landed=True, last=good & following.isNull(), error=~good)
    named = links("next_cursor", answered.where(following.isNotNull()), named=True)
    cursors = landed.unionByName(named).groupBy("run", "cursor").agg(
        *[F.bool_or(k).alias(k) for k in ("landed", "named", "last", "error")]
    )
    first = F.col("cursor").isNull()
    return cursors.groupBy("run").agg(
        F.count_if("error").alias("errors"),
        (
            (F.count_if(first & F.col("landed")) > 0)
            & (F.count_if("last") > 0)
            & (F.count_if(~F.col("landed")) == 0)
            & (F.count_if(~first & ~F.col("named")) <= F.count_if("error"))
        ).alias("whole"),
    )


def ready_pages(spark: SparkSession, landing: str, runs: list[int], answered: DataFrame) -> DataFrame:
    """The good pages that count, of runs whose chains are whole. Only their folders are read."""
    landed = (
        spark.read.schema(LANDED)
        .option("columnNameOfCorruptRecord", DAMAGED)
        .option("basePath", landing)
        .json([f"{landing}/run={run}" for run in runs])
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    chosen = answered.where("good").select("run", "file", "cursor").distinct().alias("chosen")
    same = (
        (F.col("landed.run") == F.col("chosen.run"))
        & (F.col("landed.file") == F.col("chosen.file"))
        & F.col("landed.cursor").eqNullSafe(F.col("chosen.cursor"))
    )
    pages = landed.where(F.col("status").eqNullSafe("success"))
    return pages.alias("landed").join(chosen, same, "left_semi")


def _load_arrived(
    batch: DataFrame,
    batch_id: int,
    landing: str,
    state: str,
    history: HistoryTable,
    run_log: RunLog,
    clock: Callable[[], datetime],
    on_bad_page: str,
    on_duplicate: str,
    feed: ChangeFeed | None,
    quarantine: str,
) -> None:
    # The headers of a batch are a partition of their own, so replaying the batch writes the same.
    spark = history.spark
    (
        batch.withColumn("batch", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch")
        .parquet(state)
    )
    kept = spark.read.schema(HEADERS).parquet(state)
    touched = [r.run for r in kept.where(F.col("batch") == batch_id).select("run").distinct().collect()]
    mine = kept.where(F.col("run").isin(touched))
    lines = mine.where("damaged IS NOT NULL")
    torn = [r.run for r in lines.select("run").distinct().collect()]
    if torn:
        # No attempt to load sees these lines: they are put down under attempt 0.
        write_quarantine(
            lines.select(
                "file",
                "cursor",
                F.lit(None).cast("string").alias("status"),
                F.lit("damaged").alias("reason"),
                F.col("damaged").alias("record"),
                "run",
                F.lit(0).alias("attempt"),
            ),
            quarantine,
        )
    answered = answers(mine)
    found = chains(answered).collect()
    keep = on_bad_page == "keep"
    ready = sorted(r.run for r in found if r.whole and (keep or not r.errors))
    # A page with an error fails its run until a good one for its cursor lands.
    broken = {
        r.run: BadPage(f"run {r.run}: {r.errors} pages with an error")
        for r in found
        if r.errors and not keep
    }
    # So does a damaged line while the chain is not whole without it.
    broken |= {
        run: BadPage(f"run {run}: damaged lines") for run in torn if run not in ready and not keep
    }
    if not ready and not broken:
        return
    pages = ready_pages(spark, landing, ready, answered) if ready else None
    faults = load_runs(
        pages,
        ready,
        history,
        run_log,
        clock=clock,
        on_bad_page=on_bad_page,
        on_duplicate=on_duplicate,
        broken=broken,
        feed=feed,
        quarantine=quarantine,
    )
    # The data are at fault and the run log says 'failed'. Other runs are loaded all the same; new
    # pages for these load them again. Any other error is raised, and the batch is run again.
    for run, fault in sorted(faults.items()):
        log.error("run %s failed: %s", run, fault)


def ingest_stream(
    spark: SparkSession,
    landing: str,
    history: HistoryTable,
    run_log: RunLog,
    checkpoint: str,
    *,
    clock: Callable[[], datetime] = utc_now,
    on_bad_page: str = "fail",
    on_duplicate: str = "fail",
    feed: ChangeFeed | None = None,
) -> StreamingQuery:
    """Load what has landed since the last call, then stop. Returns the running query.

    All runs that a trigger makes whole are loaded together, in one write and one log append. Damaged
    lines, and pages with a value of another type than declared, are kept in
    `<checkpoint>/quarantine`, see `pages.read_quarantine`.
    """
    state, quarantine = f"{checkpoint}/page_headers", f"{checkpoint}/quarantine"

    def load(batch: DataFrame, batch_id: int) -> None:
        _load_arrived(
            batch,
            batch_id,
            landing,
            state,
            history,
            run_log,
            clock,
            on_bad_page,
            on_duplicate,
            feed,
            quarantine,
        )

    return (
        page_headers(
            spark.readStream.schema(_LANDED_HEADER)
            .option("columnNameOfCorruptRecord", DAMAGED)
            .json(landing)
        )
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
