"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it; links may come out repeated."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end")
    least = edges.select(ends).select("end.*").groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a link's ``a`` is its larger node
    return larger.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return edges.join(least, "a").select(both.alias("end")).select("end.*").where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is linked to one smaller node at most, and to none if a larger one is linked to it."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    nodes = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node with a link; the component is its smallest node.

    Two alternating steps shrink the links to stars (rounds grow with the logarithm of the component
    size). A node with very many links is one row per link, so no group is held in memory; each round
    is stored, and only a count goes to the driver. Links to itself, repeated links and
    nulls are ignored.
    """
    plain = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    settled = edges.isEmpty()
    while not settled:
        edges = cut(_smaller_to_smallest(_larger_to_smallest(edges)))
        settled = _are_stars(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
