"""Answers against schemas with ids of their own row."""

import json

from pyspark.sql import functions as F

from tessera.operators import schemas as C


def found(spark, *answers):
    rows = spark.createDataFrame([(n, a if isinstance(a, str | None) else json.dumps(a), ["S1", "S2"] if n % 2 == 0 else ["S9"]) for n, a in enumerate(answers)], "n int, answer string, ids array<string>")
    out = {}
    for r in C.violations(rows, ["n"], "answer", C.selection(F.col("ids"), F.array(F.lit("open"), F.lit("set")), 2, 2)).collect():
        out.setdefault(r.n, set()).add((r.path, r.kind, r.found))
    return out


def action(**more):
    return {"ids": ["S1"], "name": "Do", "desc": "It will", "path": None, "verb": "open"} | more


def goal(*actions, **more):
    return {"intent_index": 0, "topic": "t", "actions": list(actions)} | more


def test_violations(spark):
    lacking = action()
    del lacking["name"]
    got = found(
        spark, {"goals": [goal(action(), action(ids=["S2", "S9"]))]}, {"goals": [goal(action())]}, {"goals": [goal(lacking, action(verb="fly", extra=1))]}, {"goals": "none"}, "not json", None, {}, [],
        {"goals": [goal(action(ids="S1", path=3)), goal(intent_index="0"), goal()]}, {"goals": [goal(*[action(ids=["S9"])] * 3)]}, {"goals": [goal(action(verb=None, path="Settings > A"))]}, {"goals": [None, goal(intent_index=1.5)]},
    )
    assert got == {
        0: {("$.goals[0].actions[1].ids[1]", "not_allowed", "S9")}, 1: {("$.goals[0].actions[0].ids[0]", "not_allowed", "S1")},
        2: {("$.goals[0].actions[0].name", "missing", None), ("$.goals[0].actions[1].verb", "not_allowed", "fly"), ("$.goals[0].actions[1].extra", "unknown_field", None)},
        3: {("$.goals", "wrong_type", "STRING")}, 4: {("$", "not_json", None)}, 5: {("$", "not_json", None)}, 6: {("$.goals", "missing", None)}, 7: {("$", "wrong_type", "ARRAY<VOID>")},
        8: {("$.goals", "too_many", "3"), ("$.goals[0].actions[0].ids", "wrong_type", "STRING"), ("$.goals[0].actions[0].path", "wrong_type", "BIGINT"), ("$.goals[1].intent_index", "wrong_type", "STRING")},
        9: {("$.goals[0].actions", "too_many", "3")}, 11: {("$.goals[0]", "wrong_type", "VOID"), ("$.goals[1].intent_index", "wrong_type", "DECIMAL(2,1)")},
    }
