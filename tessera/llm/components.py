"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import Stored, materialise


def _stars_of(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over ``edges`` (a > b): the same components, nearer to stars."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # each larger neighbour is linked to the least node around
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # then each node and its smaller neighbours are linked to the least of these
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def contract(edges: DataFrame, steps: int) -> Stored:
    """Edges (a > b) with the components of ``edges`` (a, b: any ordered type), after ``steps`` star steps.

    Null ends and loops are left out.
    """
    at = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(steps):
        new = materialise(_stars_of(at.df), "edges")
        at.drop()
        at = new
    return at


def components(edges: DataFrame, rounds: int = 60) -> Stored:
    """``node, root`` of every node that ``edges`` (a, b: any ordered type) names; the root is its component's least node.

    Large-star and small-star steps: every node tells its neighbours of the
    least node that it knows, until each component is a star around its least
    node.  A round is two joins on grouped minima; nothing is gathered by node,
    so a node with very many links is no burden.  Null ends and loops are
    ignored; no edges give an empty table; more than ``rounds`` are an error.
    """
    at = contract(edges, 0)
    for _ in range(rounds):
        if _stars(at.df):
            break
        new = materialise(_stars_of(at.df), "edges")
        at.drop()
        at = new
    else:
        if not _stars(at.df):
            raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = at.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = materialise(roots.unionAll(at.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    at.drop()
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node, which has none: then these are the roots."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()
