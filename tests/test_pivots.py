"""Threshold search by pivots against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import pivots as P


def vectors(rng, n, centres, spread):
    middle = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(centres)]
    return [(i, rng.choice([0, 0, 0, i % 5]), [x + spread * rng.gauss(0, 1) for x in rng.choice(middle)]) for i in range(n)]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("centres, spread, least", [(20, 0.2, 0.9), (1, 1.0, 0.7), (6, 0.5, 0.2)])
def test_all_near_pairs_are_met(spark, centres, spread, least):
    rows = vectors(random.Random(centres), 500, centres, spread)
    table = spark.createDataFrame(rows, "e long, a int, v array<double>")
    pivots = P.pivots_of(table, "e", "v")
    blocks = P.blocks_of(table, "e", "a", "v", pivots)
    asked = table.where("e % 10 = 0").select(F.col("e").alias("q"), "a", F.col("v").alias("w"))
    met = {(r.q, r.e): r.cosine for r in P.near_pairs(asked, blocks, "a", "w", pivots, least).select("q", "e", "cosine").collect()}
    every = {(i, j): cosine(v, w) for i, a, v in rows if i % 10 == 0 for j, b, w in rows if a == b}
    near = {k for k, s in every.items() if s >= least}
    assert near <= set(met) <= set(every) and all(abs(every[k] - s) < 1e-9 for k, s in met.items())
    if centres == 20:
        assert len(met) < 0.25 * len(every)
    # no block holds most of the hot article
    assert blocks.where("a = 0").groupBy("cell", "ring", "slot").count().agg(F.max("count")).first()[0] < 0.5 * sum(r[1] == 0 for r in rows)


def test_no_vectors(spark):
    table = spark.createDataFrame([], "e long, a int, v array<double>")
    pivots = P.pivots_of(table, "e", "v")
    asked = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q long, a int, w array<double>")
    assert P.near_pairs(asked, P.blocks_of(table, "e", "a", "v", pivots), "a", "w", pivots, 0.5).count() == 0
