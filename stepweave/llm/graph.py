"""Connected components of an edge list too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Rounds of large-star and small-star: each keeps the components, moves every edge towards the smallest node it can
    see and is one shuffle, so chains shorten geometrically. The edges of each round are written to the shared folder.
    Loops and nulls are ignored, repeated edges count once; no edges give no rows."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = written(edges), None
    near = Window.partitionBy("a")
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
        seen = state
        both = edges.union(edges.select("b", "a"))
        large = both.withColumn("m", F.least("a", F.min("b").over(near))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.withColumn("m", F.min("b").over(near))
        small = low.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = written(small.where("a <> b").distinct())
