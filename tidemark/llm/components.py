"""Connected components of a graph given as pairs, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``pairs`` has long columns a, b. Returns (node, root) for each node, root
    being the least node of its component.

    Alternates two steps until nothing changes: every node's larger neighbours
    are linked to its least neighbour, then every node and its smaller
    neighbours to the least of these. Rounds grow with the logarithm of the
    diameter. Each step is an aggregation with partial sums and a join whose
    large groups Spark may split, and is written, so that lineage stays short.
    """
    edges = written(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # v's least neighbour or itself; each larger neighbour u of v moves to it
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = (
            both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        )
        large = written(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .where("v <> u")
            .distinct()
        )
        edges = written(small, "small")
        after = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h"),
        ).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
