"""Writes the documents as JSON and lists what was written."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import instant
from tidemark.plans import documents
from tidemark.schema import DETAIL_ENTITY_LIMIT, DETAIL_OWNER_LIMIT, DETAIL_RATE_LIMIT

PAGES = ("dashboard", "rising", "leaderboard", "owners")

# Detail documents lie in folders by a hash of their key, so that one is found in one of them.
DETAIL_BUCKETS = 16
# Folder and key of each kind of detail document.
DETAILS = {"entities": ("entity_details", "slug"), "owners": ("owner_details", "owner_key")}


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DETAIL_BUCKETS)).cast("int")


def _write(df: DataFrame, path: str, *folders: str) -> None:
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    writer.partitionBy(*folders).json(path)


def _write_all(path: str, plans: dict[str, Callable[[], DataFrame]], *folders: str) -> None:
    """Build and write independent documents side by side, so that small ones share the cluster."""
    with ThreadPoolExecutor(len(plans)) as pool:
        written = [
            pool.submit(lambda n=name, p=plan: _write(p(), f"{path}/{n}", *folders))
            for name, plan in plans.items()
        ]
        for result in written:
            result.result()


def publish_pages(
    snapshots: DataFrame, runs: DataFrame, path: str, *, now: datetime, **accel
) -> None:
    """The four page documents, one JSON document each, below `path`."""
    h = snapshots, runs
    _write_all(path, {
        "dashboard": lambda: documents.dashboard(*h, now=now),
        "rising": lambda: documents.rising(*h, now=now),
        "leaderboard": lambda: documents.leaderboard(*h, now=now, **accel),
        "owners": lambda: documents.owners_page(*h, now=now),
    })


def publish_details(
    snapshots: DataFrame,
    runs: DataFrame,
    path: str,
    *,
    now: datetime,
    entity_limit: int = DETAIL_ENTITY_LIMIT,
    rate_limit: int = DETAIL_RATE_LIMIT,
    owner_limit: int = DETAIL_OWNER_LIMIT,
) -> None:
    """Documents of the qualifying entities and owners, one JSON document per line.

    Three jobs in all, however many documents there are. Documents of a bucket are side by side in one
    file, so there are no more files than buckets.
    """
    h = snapshots, runs

    def dealt(documents_: DataFrame, key: str) -> DataFrame:
        return documents_.withColumn("bucket", key_bucket(F.col(key))).repartition("bucket")

    _write_all(path, {
        "entity_details": lambda: dealt(
            documents.entity_documents(*h, now=now, limit=entity_limit, rate_limit=rate_limit), "slug"
        ),
        "owner_details": lambda: dealt(
            documents.owner_documents(*h, now=now, limit=owner_limit), "owner_key"
        ),
        "owner_entities": lambda: dealt(
            documents.owner_document_entities(*h, now=now, limit=owner_limit), "owner_key"
        ),
    }, "bucket")


def _details(spark: SparkSession, path: str, kind: str, columns: str) -> tuple[DataFrame, str]:
    folder, key = DETAILS[kind]
    schema = f"{key} string, {columns}, bucket int"
    return spark.read.schema(schema).json(f"{path}/{folder}"), key


def find_detail(spark: SparkSession, path: str, kind: str, key: str, columns: str) -> DataFrame:
    """The detail document of one key: `columns` (in DDL) of it; no row if there is none.

    `kind` is 'entities' or 'owners'. Only the folder of the key's bucket is listed and read. Owners
    whose handles share a key have a document each.
    """
    stored, name = _details(spark, path, kind, columns)
    wanted = (F.col("bucket") == key_bucket(F.lit(key))) & (F.col(name) == key)
    return stored.where(wanted).drop("bucket")


def find_details(spark: SparkSession, path: str, kind: str, keys: DataFrame, columns: str) -> DataFrame:
    """The detail documents of the keys in the only column of `keys`, with `found`; every key has a row.

    Both sides are joined by bucket and key, so only folders that hold a wanted key are read where
    the keys are few.
    """
    stored, name = _details(spark, path, kind, columns)
    wanted = keys.toDF(name).distinct().withColumn("bucket", key_bucket(F.col(name)))
    held = stored.withColumn("found", F.lit(True))
    joined = wanted.join(held, ["bucket", name], "left").drop("bucket")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def published_index(spark: SparkSession, path: str) -> DataFrame:
    """What `publish_details` wrote: (kind, count, available keys in order).

    The key lists are as long as the detail limits.
    """

    def keys(folder: str, column: str, kind: str) -> DataFrame:
        written = spark.read.schema(f"{column} string").json(f"{path}/{folder}")
        return written.agg(
            F.lit(kind).alias("kind"),
            F.count(column).alias("count"),
            F.array_sort(F.collect_list(column)).alias("available"),
        )

    return keys("entity_details", "slug", "entities").unionByName(
        keys("owner_details", "owner_key", "owners")
    )


def publish(
    snapshots: DataFrame, runs: DataFrame, path: str, *, now: datetime, **accel
) -> bool:
    """All documents and the index; nothing and False when no run is completed."""
    if runs.where(F.col("status") == "completed").isEmpty():
        return False
    publish_pages(snapshots, runs, path, now=now, **accel)
    publish_details(snapshots, runs, path, now=now)
    index = published_index(snapshots.sparkSession, path)
    endpoints = F.array(*[F.lit(p) for p in PAGES])
    _write(
        index.agg(
            instant(now).alias("generated_at"),
            endpoints.alias("endpoints"),
            F.collect_list(F.struct("kind", "count", "available")).alias("documents"),
        ),
        f"{path}/index",
    )
    return True
