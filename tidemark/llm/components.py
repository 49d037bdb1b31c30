"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns: node, root. `root` is the smallest node of the component; roots map to themselves.

    Every round hooks the larger neighbours of each node to the smallest one, then the smaller ones.
    The number of rounds grows with the logarithm of the largest component. Minima are combined
    map-side and each round is written to the shared folder, so a hub costs no more than its links.
    Nodes without a link are not in the result. Null nodes and self links are ignored.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
        .distinct()
    )
    mark = None
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("node", "near")
        least = both.groupBy("node").agg(F.min("near").alias("least"))
        large = (
            both.where("near > node")
            .join(least, "node")
            .select(F.col("near").alias("hi"), F.least("node", "least").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        floor = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(floor, "hi")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")),
                        F.struct("hi", F.col("least").alias("lo")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .where("hi <> lo")
            .distinct()
        )
        edges = stored(small)
        now = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.countDistinct("hi")
        ).first()
        # A forest of stars: every node has one edge, and another round changes nothing.
        if now == mark or now[0] == 0:
            break
        mark = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
