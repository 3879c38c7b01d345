"""Connected components of a graph given by its edges, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the edges (a, b, both long): the least node that it is connected to.

    Large-star and small-star rounds in turn: each node's larger neighbours, then its smaller
    ones, are linked to its least one, until nothing changes. Edges are written each round; the rounds grow
    with the logarithm of the longest path. No edges give an empty result.
    """
    now = Cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = Cut(large, "edges")
        least = large.df.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.df.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        old, now = now, Cut(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        old.drop()
        large.drop()
    roots = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots if before is None else roots.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
