"""Pruned ranking against plain scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import impacts as I
from tessera.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["onURL", "offURL"])) for i in range(400)]
    docs += [(400 + i, docs[7][1], "onURL") for i in range(30)] + [(500, "the of and", "onURL"), (501, None, "offURL")]  # ties, stop words alone, nothing
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for q in range(12)] + [(12, "w1 w1 w2 unheard"), (13, "unheard"), (14, docs[7][1])]
    return spark.createDataFrame(docs, "doc_id long, text string, kind string"), spark.createDataFrame(queries, "q long, text string"), docs, queries


def tokens(text):
    return [t for t in re.findall("[a-z0-9]+", (text or "").lower()) if t not in T.RANK_STOP]


def plain(docs, queries, k, wanted=None):
    held = {i: Counter(tokens(t)) for i, t, _ in docs}
    held = {i: c for i, c in held.items() if c}
    n, mean = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    kind = {i: x for i, _, x in docs}
    out = []
    for q, text in queries:
        scored = []
        for i, c in held.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in tokens(text) if t in c)
            if s > 0:
                scored.append((-round(s + 1.5 * bool(wanted and wanted.get(q) == kind[i]), 6), i))
        out += [(q, i, round(-s, 5), rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows(found):
    return sorted((r.q, r.key, round(r.score, 5), r.rank) for r in found.best.collect())


@pytest.mark.parametrize("k", [1, 3, 20])
def test_pruned_bm25_is_the_plain_ranking(spark, corpus, k):
    docs, queries, d, q = corpus
    asked = R.query_terms(queries, "q", "text")
    for terms in (None, asked):
        found = I.bm25_pruned(I.impact_index(docs, "doc_id", {"text": 1}, terms), asked, "q", k)
        assert rows(found) == plain(d, q, k)


def test_wanted_kinds_gain_a_bonus(spark, corpus):
    docs, queries, d, q = corpus
    wanted = {i: "onURL" if i % 2 else "offURL" for i in range(10)}
    table = spark.createDataFrame(list(wanted.items()), "q long, kind string")
    kinds = docs.select(F.col("doc_id").alias("key"), "kind")
    found = I.bm25_pruned(I.impact_index(docs, "doc_id", {"text": 1}), R.query_terms(queries, "q", "text"), "q", 5, kinds, table)
    assert rows(found) == plain(d, q, 5, wanted)


def test_pruning_leaves_out_what_cannot_pass(spark, corpus):
    docs, queries, d, q = corpus
    asked = R.query_terms(queries, "q", "text")
    index = I.impact_index(docs, "doc_id", {"text": 1})
    found = I.bm25_pruned(index, asked, "q", 1)
    everything = index.rows.join(asked, "term")
    assert found.met.count() < 0.5 * everything.count() and found.candidates.count() < 0.5 * everything.select("q", "key").distinct().count()
    # nothing but each task's best rows is shuffled
    plan = found.best._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "WindowGroupLimit" in plan


def test_pruned_overlap_is_the_plain_ranking(spark, corpus):
    docs, queries, d, q = corpus
    index, asked = I.impact_index(docs, "doc_id", {"text": 1}), R.query_terms(queries, "q", "text")
    sets = {i: set(tokens(t)) for i, t, _ in d}
    for k in (1, 4):
        want = []
        for no, text in q:
            own = set(tokens(text))
            scored = sorted((-round(len(own & s) / len(own | s), 6), i) for i, s in sets.items() if own & s)
            want += [(no, i, round(-s, 5), rank) for rank, (s, i) in enumerate(scored[:k], 1)]
        found = I.overlap_pruned(index, asked, "q", k, asked.groupBy("q").agg(F.count("*").alias("qn")))
        assert rows(found) == sorted(want)


def test_fields_count_by_weight(spark):
    docs = spark.createDataFrame([(1, "red bolt", "big"), (2, "bolt", "red"), (3, None, None)], "id long, a string, b string")
    index = I.impact_index(docs, "id", {"a": 2, "b": 1})
    got = {(r.key, r.term): r for r in index.rows.collect()}
    assert index.documents == 2 and got[1, "red"].impact == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 5 / 4))) and got[2, "red"].size == 2
    assert got[2, "red"].impact < got[2, "bolt"].impact and got[2, "bolt"].level < got[2, "red"].level


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "w1", 1)], "q long, term string, qn long")
    index = I.impact_index(docs, "doc_id", {"text": 1})
    assert I.bm25_pruned(index, asked, "q").best.count() == 0 and I.overlap_pruned(index, asked, "q").best.count() == 0
