"""Connected components of an edge table by alternating large and small stars.

Each round connects every node's larger neighbours to its smallest one, then its smaller ones; the
graph ends as stars around each component's smallest node. A round is a few shuffles of the edges,
written to the shared folder; nothing but a count reaches the driver. A hub's edges
are joined with the hub's smallest neighbour, a join that Spark splits when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.session import materialise


#: Edges for each partition of a round's tables; a table of few edges is read by few tasks.
EDGES = 200_000


def _least(edges: DataFrame, parts: int) -> DataFrame:
    return materialise(edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts), "stars-least")


def _large(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, parts).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, parts)
    rest = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b <> m")
    return rest.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _stored(edges: DataFrame, parts: int, name: str) -> DataFrame:
    return materialise(edges.coalesce(parts).distinct().coalesce(parts), name)


def _are_stars(edges: DataFrame) -> bool:
    """No node has two centres, and no centre has one: nothing is left to join."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node of an edge; ``root`` is the smallest node of its component.
    Loops and repeated edges are fine; an empty edge table gives no rows."""
    edges = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "stars-in")
    parts = 1 + edges.count() // EDGES
    while True:
        # large stars are written before they are read by the two branches of the small ones
        edges = _stored(_small(_stored(_large(edges, parts), parts, "stars-large"), parts), parts, "stars-small")
        if _are_stars(edges):
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
