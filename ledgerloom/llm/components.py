"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_MOST_ROUNDS = 60
_SALTS = 16


def _follow(edges: DataFrame, moves: DataFrame, on: str) -> DataFrame:
    """edges (u, v) with m, where moves (node, m) has their `on`; else null.

    A node's edges are dealt over _SALTS keys, and only nodes that move are repeated for each of them.
    """
    salt: Column = F.pmod(F.xxhash64("u", "v"), F.lit(_SALTS)).cast("int")
    spread = moves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumnRenamed("node", on)
    return edges.withColumn("salt", salt).join(spread, [on, "salt"], "left").select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one parent at most, and parents have none: then a parent is its component's smallest node."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    sides = sides.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = sides.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    # one job whatever the number of partitions, where isEmpty looks at more and more of them in several
    return not nodes.agg(F.max(F.expr("child > 1 or (child = 1 and parent = 1)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), any direction, repeats allowed -> (node, comp): the smallest node of each component.

    Edges lead from the larger node u to the smaller v.  The large-star step hangs a node's larger neighbours on its
    smallest one, the small-star step its smaller ones; rounds grow with the logarithm of the longest chain.  Nodes that
    don't move take no part in the joins, and none of them gathers a node's neighbours in one task.
    Only nodes with links appear.  Every round is written to the shared folder, which cuts the lineage.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    for _ in range(_MOST_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        inner = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("m < node and most > node")
        large = _follow(edges, inner.select("node", "m"), "v").select("u", F.coalesce("m", "v").alias("v"))
        several = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.max("v").alias("most")).filter("m < most")
        small = _follow(large, several.select("node", "m"), "u")
        small = small.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.coalesce("m", "v").alias("v"))
        edges = materialize(small.distinct(), "cc")
    else:
        raise RuntimeError(f"components did not settle in {_MOST_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
