"""Validators of evaluation sets: each kind of problem is found, and nothing else."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import validation as V

SCHEMA = "id string, row_id long, query string, register string"


def sets(spark, rows):
    kit = spark.createDataFrame([(1, "Screen is black"), (2, "No sound at all"), (3, "It is slow")], "row_id long, query string")
    return kit, spark.createDataFrame(rows, SCHEMA)


def found(spark, rows, want=2):
    kit, made = sets(spark, rows)
    return sorted(tuple(r)[1:] for r in V.validate({"p": made}, kit, {"p": want}, {"p": ["formal", "terse"]}).collect())


FINE = [("a", 1, "the display stays dark", "formal"), ("b", 1, "dark display", "terse"), ("c", 2, "I hear nothing", "formal"), ("d", 2, "mute", "terse"), ("e", 3, "everything lags", "formal"), ("f", 3, "laggy", "terse")]


def test_a_right_set_has_no_findings(spark):
    assert found(spark, FINE) == []


def test_every_kind_of_problem_is_found(spark):
    bad = FINE[:-1] + [("f", 1, " screen is BLACK ", "terse"), ("g", 9, "lost", "terse"), ("g", 3, None, "shouted"), ("h", 3, "Lost ", None)]
    assert found(spark, bad) == [
        ("empty_query", "fail", "g", ""), ("missing_register", "warn", "3", "terse"), ("not_held_out", "fail", "f", ""), ("repeated_id", "fail", "g", "2"), ("repeated_query", "fail", "g", "2"),
        ("row_count", "fail", "1", "3"), ("row_count", "fail", "3", "3"), ("unknown_register", "fail", "g", "shouted"), ("unknown_register", "fail", "h", ""), ("unknown_row", "fail", "g", "9"),
    ]


def test_empty_sets_and_kits(spark):
    kit, made = sets(spark, FINE)
    assert [f[:3] for f in found(spark, [])] == [("row_count", "fail", k) for k in "123"]
    assert {tuple(r)[1] for r in V.validate({"p": made}, kit.limit(0), {"p": 2}, {"p": ["formal", "terse"]}).collect()} == {"unknown_row"}


def test_near_misses_are_a_trap_if_they_are_closer(spark):
    kit, far = sets(spark, FINE)
    _, near = sets(spark, [("x", 1, "Screen is white", "formal"), ("y", 8, "of no kit row", "formal")])
    words = lambda c: F.array_distinct(T.words(c))
    got = {r.set_name: r for r in V.closeness({"far": far, "near": near}, kit, words, "far", "near").collect()}
    assert got["near"].overlap == 0.25 and got["near"].n == 2 and got["far"].overlap == 0.0 and got["near"].trap
    assert all(r.trap is None for r in V.closeness({"far": far, "near": near.limit(0)}, kit, words, "far", "near").collect())
