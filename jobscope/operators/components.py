"""Connected components of an edge table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.store import written

#: Edges up to which a round's steps are worked out again instead of written.
SMALL = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node in reach) of each node of ``a``-``b`` edges.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest node it
    sees, until nothing changes; a round is written to the shared folder, so that lineage stays short
    and a lost executor repeats one round at most. All that the driver sees is a sum of hashes. Edges
    of a node to itself and repeated edges change nothing; edges with a null end are ignored.
    """
    edges = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while before[0]:
        # written where there are many, so that both sides of the joins are dealt out for them and a node with many neighbours can be split
        keep = written if before[0] > SMALL else lambda df, _: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = keep(large, "large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
