"""Verdicts brought into form, their summary, and results joined to their kit."""

from pyspark.sql import functions as F

from tessera.operators import judging as J

SCHEMA = """id string, source string, domain string, self_graded boolean, step_ids array<string>, link_ids array<string>,
  verdict struct<score: int, steps: array<struct<id: string, verdict: string, issue: string>>, links: array<struct<action: string, relevance: int>>, missing: array<string>, order_ok: boolean>"""


def rows(spark):
    good = (9, [("s2", "partial", "duplicate"), (" s1 ", "correct", "fragment"), ("s1", "wrong", "fragment"), ("zz", "wrong", "none")], [("a1", 7), ("a1", 0), ("a9", 1)], ["one", "two"], False)
    odd = (None, [("t1", "superb", "strange"), ("t2", None, "irrelevant")], None, None, None)
    data = [
        ("good", "kit", "Display", True, ["s1", "s2", "s3"], ["a1"], good),
        ("odd", "unseen", None, None, ["t1", "t2"], ["b1"], odd),
        ("failed", "kit", "Display", True, ["u1"], ["c1"], None),
        ("empty", "kit", None, True, [], [], None),
        ("null", "unseen", None, False, None, None, good),
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_verdicts_are_cleaned(spark):
    got = {r.id: r for r in J.cleaned(rows(spark)).collect()}
    good, odd = got["good"], got["odd"]
    assert (good.score, good.order_ok, good.n_missing, good.unjudged) == (3, False, 2, ["s3"])
    assert [tuple(s) for s in good.steps] == [("s1", "correct", "none"), ("s2", "partial", "duplicate")]
    assert [tuple(x) for x in good.links] == [("a1", 2)]
    assert (odd.score, odd.order_ok, odd.n_missing, odd.links, odd.judged) == (0, True, 0, [], True)
    assert [tuple(s) for s in odd.steps] == [("t1", "wrong", "none"), ("t2", "wrong", "irrelevant")]
    assert not got["failed"].judged
    assert all(got[k].judged and got[k].empty and got[k].score == 0 and got[k].order_ok and got[k].n_missing == 0 for k in ("empty", "null"))


def test_summary_counts_everything_once(spark):
    got = {(r.section, r.key): (r.n, r["mean"]) for r in J.summary(J.cleaned(rows(spark))).collect()}
    assert {k: got["plans", k][0] for k in ("n", "judged", "failed", "empty", "self_graded", "order_problems", "missing_a_fix")} == {"n": 5, "judged": 4, "failed": 1, "empty": 2, "self_graded": 1, "order_problems": 1, "missing_a_fix": 1}
    assert got["score", "mean"] == (4, 0.75) and [got["score", str(k)][0] for k in range(4)] == [3, 0, 0, 1]
    assert got["source", "kit"] == (2, 1.5) and got["source", "unseen"] == (2, 0.0)
    assert got["domain", "Display"] == (1, 3.0) and got["domain", "unknown"] == (3, 0.0)
    assert got["steps", "credit"] == (4, 0.375) and got["steps", "unjudged"] == (1, None)
    assert [got["verdict", v][0] for v in J.CREDIT] == [1, 1, 2]
    assert {k: v for k, v in got.items() if k[0] == "issue"} == {("issue", "duplicate"): (1, None), ("issue", "irrelevant"): (1, None)}
    assert got["links", "relevance"] == (1, 2.0)


def test_summary_of_nothing(spark):
    got = J.summary(J.cleaned(rows(spark).limit(0))).collect()
    assert len(got) == 18 and all(r.n == 0 and r["mean"] is None for r in got)


def test_unmatched_results_stay(spark):
    kit = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "key string, row_id long, article string")
    results = spark.createDataFrame([("a", "r1"), ("b", "r2"), (None, "r3"), ("a", "r1")], "key string, line string")
    got = sorted(map(tuple, J.joined_results(results, kit, "key", "row_id").withColumn("key", F.coalesce("key", F.lit(""))).collect()))
    assert got == [("", "r3", None, None, False), ("a", "r1", 2, "y", True), ("a", "r1", 2, "y", True), ("b", "r2", None, None, False)]
