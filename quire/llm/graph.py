"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise


def _fold(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node bigint, root bigint) for every node of ``edges`` (u, v bigint);
    ``root`` is the smallest node of the component.

    Each round is two aggregations joined back to the edge list; the minimum
    of a node's neighbours is pre-aggregated, and the join back is an ordinary
    equality join, whose hot nodes adaptive execution splits. The edge list is
    written each round, so a lost executor costs one round. It runs until
    nothing changes: the edges are then stars around the smallest node."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    state = _fold(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialise(small, "edges")
        now = _fold(e)
        if now == state:
            break
        state = now
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root") \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
