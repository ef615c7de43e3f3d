"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swingtrace.llm.common import discard, stored


def _star(edges: DataFrame, small: bool, made: list[DataFrame]) -> DataFrame:
    """Edges (a, b), a > b: each node's neighbours are tied to the least of them and the node. Stored tables go to `made`."""
    if small:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    made.append(least)
    tied = near.join(least, "u")
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u"), F.col("m")))
    else:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node reachable.

    Each round stores its edges; a round's cost is the number of edges, and a hub is split by the
    skew join, for its least neighbour is aggregated before the join.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges"
    )
    check = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was = check(now)
    while was[0]:
        made = [now]
        now = stored(_star(_star(now, small=False, made=made), small=True, made=made), "edges")
        discard(*made)
        seen = check(now)
        if seen == was:
            break
        was = seen
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return ends.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
