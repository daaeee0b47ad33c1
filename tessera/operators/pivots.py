"""Exact threshold search on unit vectors by pivots and the triangle inequality.

Every vector lies in the cell of its nearest pivot, in a ring by its distance from it,
and in one of a few slots, so that an article with very many vectors is many blocks.
A small table holds the least and largest distance of each block.  A vector within
r of a query differs from it by at most r in its distance from any pivot, and its
own pivot is at most 2 r further from the query than the query's nearest one: blocks
for which neither holds can't have a match, and only the others meet the query.
Vectors that are spread evenly in many dimensions are all about equally far from
everything; then few blocks go, and what remains is the even split of hot articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import unit
from tessera.sources.files import stored

PIVOTS, RINGS, SLOTS = 16, 16, 4
_SLACK = 1e-7  # of distances, for the rounding of sums


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _distance(a: Column, b: Column) -> Column:
    """Between unit vectors."""
    return F.sqrt(F.greatest(2 - 2 * _dot(a, b), F.lit(0.0)))


def pivots_of(vectors: DataFrame, key: str, vector: str, n: int = PIVOTS) -> DataFrame:
    """``pivots``: one row with the unit vectors of the ``n`` keys of least hash."""
    few = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("h"), key, unit(F.col(vector)).alias("v")).orderBy("h", key).limit(n)
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda x: x["v"]).alias("pivots"))


def _seen_from(rows: DataFrame, vector: str, pivots: DataFrame) -> DataFrame:
    """The rows with ``unit`` and ``far``, their distances from all pivots."""
    own = rows.withColumn("unit", unit(F.col(vector))).join(F.broadcast(pivots))  # one row
    return own.withColumn("far", F.transform("pivots", lambda p: _distance(p, F.col("unit")))).drop("pivots")


def blocks_of(vectors: DataFrame, key: str, article: str, vector: str, pivots: DataFrame) -> DataFrame:
    """The vectors with ``unit, cell, ring, slot, near``: their block, and the distance from its pivot."""
    seen = _seen_from(vectors, vector, pivots).withColumn("near", F.array_min("far"))
    placed = seen.withColumn("cell", F.array_position("far", F.col("near")).cast("int")).withColumn("ring", F.floor(F.col("near") * RINGS / 2).cast("int"))
    return stored(placed.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")).drop("far"), "blocks")


def near_pairs(queries: DataFrame, blocks: DataFrame, article: str, vector: str, pivots: DataFrame, least: float) -> DataFrame:
    """Every query with the vectors of its article in blocks that may hold a cosine of ``least`` or more, with ``cosine``.

    ``blocks``: of :func:`blocks_of`.  All pairs that reach ``least`` are among them.
    """
    r = (2 - 2 * least) ** 0.5 + _SLACK
    rings = blocks.groupBy(article, "cell", "ring", "slot").agg(F.min("near").alias("inner"), F.max("near").alias("outer"))
    asked = _seen_from(queries, vector, pivots).withColumnRenamed("unit", "q_unit")
    to = F.element_at("far", F.col("cell"))
    within = (to >= F.col("inner") - r) & (to <= F.col("outer") + r) & (to - F.array_min("far") <= 2 * r)
    routed = asked.join(rings, article).where(within).drop("far", "inner", "outer")
    return routed.join(blocks.drop("near"), [article, "cell", "ring", "slot"]).withColumn("cosine", _dot(F.col("q_unit"), F.col("unit"))).drop("q_unit", "unit", "cell", "ring", "slot")
