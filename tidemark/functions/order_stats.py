"""Exact order statistics without bringing a whole group to one task.

Rows are first counted per bucket of a monotone logarithmic scale. The number of buckets per group
is fixed, so these counts are combined map-side to a small frame whatever the data size, and their
running sum tells which buckets hold the wanted ranks. A second pass counts the distinct values in
those few buckets only, again combined map-side, so a value shared by a third of all rows is one
row. A bucket that holds many distinct values is cut into equal slices between its least and its
greatest value; slices are summed first and each is ordered on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per doubling of the value: 64 doublings of a bigint give at most 65,536 buckets per sign.
_BUCKETS_PER_OCTAVE = 1024


# Slices of a wanted bucket.
_SLICES = 4096


def _bucketed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Columns: keys, value, bucket. The bucket never decreases as the value grows."""
    bucket = f"int(floor(signum(value) * log2(1 + abs(double(value))) * {_BUCKETS_PER_OCTAVE}))"
    return (
        df.select(*keys, F.col(value).alias("value"))
        .where("value IS NOT NULL")
        .withColumn("bucket", F.expr(bucket))
    )


def _ahead(column: str, partition: Sequence[str], order: Column | str) -> Column:
    """Sum of `column` over the rows before the current one."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def _ordered(counts: DataFrame, group: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds `ahead` to (group, value, n): the sum of n over the values ahead in the same group."""
    sliced = counts.join(
        counts.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high")),
        list(group),
    ).withColumn(
        "slice",
        F.expr(
            "CASE WHEN high > low THEN int(floor((double(value) - double(low))"
            f" / (double(high) - double(low)) * {_SLICES})) ELSE 0 END"
        ),
    ).drop("low", "high")
    slices = sliced.groupBy(*group, "slice").agg(F.sum("n").alias("rows_in_slice"))
    towards = F.desc if descending else F.asc
    slices = slices.select(
        *group, "slice", _ahead("rows_in_slice", group, towards("slice")).alias("slices_ahead")
    )
    return (
        sliced.join(slices, [*group, "slice"])
        .withColumn(
            "ahead",
            F.col("slices_ahead") + _ahead("n", [*group, "slice"], towards("value")),
        )
        .drop("slice", "slices_ahead")
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Interpolated percentiles of column `value` per group.

    Result: keys, `n` (rows with a value) and one double column per entry of `quantiles`.
    """
    keys = list(keys)
    rows = _bucketed(df, keys, value)
    buckets = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    buckets = buckets.select(
        "*",
        F.sum("rows").over(Window.partitionBy(*keys)).alias("total"),
        _ahead("rows", keys, "bucket").alias("before"),
    )
    # Zero-based rank below and above each percentile's position.
    position = {name: f"({q}D * (total - 1))" for name, q in quantiles.items()}
    ranks = [f"{f}({p})" for p in position.values() for f in ("floor", "ceil")]
    wanted = " OR ".join(f"(before <= {r} AND {r} < before + rows)" for r in ranks)
    # At most two buckets per quantile and group. Without the hint the rows, whose two columns look
    # small to the planner, are sent to all executors instead.
    wanted_buckets = F.broadcast(buckets.where(wanted).drop("rows"))

    counts = (
        rows.join(wanted_buckets, keys + ["bucket"])
        .groupBy(*keys, "bucket", "value", "total", "before")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    inside = _ordered(counts, keys + ["bucket"]).withColumn("start", F.col("before") + F.col("ahead"))
    found = [
        F.expr(f"max(if(start <= {f}({p}) AND {f}({p}) < start + n, double(value), NULL))").alias(
            f"{name}_{f}"
        )
        for name, p in position.items()
        for f in ("floor", "ceil")
    ]
    picked = inside.groupBy(*keys).agg(F.max("total").alias("total"), *found)
    return picked.selectExpr(
        *keys,
        "total AS n",
        *[
            f"{n}_floor + ({n}_ceil - {n}_floor) * ({p} - floor({p})) AS {n}"
            for n, p in position.items()
        ],
    )


def top_fraction_sums(df: DataFrame, value: str, tiles: Sequence[int]) -> DataFrame:
    """Rows, total, and for each t in `tiles` the sum of the first of t equal tiles by value.

    The first tile of n rows holds n div t rows, one more if there is a remainder, and the sum of
    the k greatest values does not depend on how ties are broken. One row, columns `n`, `total` and
    `top_<t>`.
    """
    rows = _bucketed(df, [], value)
    # Windows without partition run over the bucket counts, whose number is fixed.
    whole = Window.partitionBy()
    buckets = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("amount"))
        .select(
            "*",
            F.sum("rows").over(whole).alias("total_rows"),
            F.sum("amount").over(whole).alias("total"),
            _ahead("rows", [], F.desc("bucket")).alias("before"),
        )
    )
    tile = {t: f"(total_rows div {t} + int(total_rows % {t} > 0))" for t in tiles}
    cut = {t: f"(before < {size} AND {size} < before + rows)" for t, size in tile.items()}
    # A bucket before the cut contributes all of its values ...
    wholes = buckets.agg(
        F.max("total_rows").alias("n"),
        F.max("total").alias("total"),
        *[
            F.expr(f"sum(if(before + rows <= {tile[t]}, amount, 0))").alias(f"top_{t}")
            for t in tiles
        ],
    )
    # ... and the bucket at the cut its greatest ones. One bucket per tile count at most.
    cut_buckets = F.broadcast(buckets.where(" OR ".join(cut.values())).drop("amount", "total"))
    counts = (
        rows.join(cut_buckets, "bucket")
        .groupBy("bucket", "value", "rows", "before", "total_rows")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    partials = (
        _ordered(counts, ["bucket"], descending=True)
        .agg(*[
            F.expr(
                f"sum(if({cut[t]}, least(n, greatest({tile[t]} - before - ahead, 0)) * value, 0))"
            ).alias(f"top_{t}")
            for t in tiles
        ])
    )
    return (
        wholes.unionByName(partials, allowMissingColumns=True)
        .agg(F.max("n").alias("n"), F.max("total").alias("total"), *[
            F.sum(f"top_{t}").alias(f"top_{t}") for t in tiles
        ])
        .where("n IS NOT NULL")
    )
