"""Prompts against plain joins and cuts."""

import random

import pytest

from tessera.operators import prompts as P


@pytest.mark.parametrize("most", [None, 1, 7, 40, 10_000])
def test_packed_is_the_cut_join(spark, most):
    rng = random.Random(most or 0)
    texts = {k: ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))] for k in range(60)}
    rows = spark.createDataFrame([(k, n, t) for k, lines in texts.items() for n, t in enumerate(lines)] + [(0, 99, None)], "k int, n int, t string")
    got = {r.k: r.text for r in P.packed(rows, "k", ["n"], "t", most, "!").collect()}
    for k, lines in texts.items():
        whole = "\n".join(lines)
        assert got[k] == (whole if most is None or len(whole) <= most else whole[:most] + "!")


def test_builders(spark):
    s = spark.createDataFrame([(1, 1, "Intro", "One.", None), (1, 2, "Intro", "Two.", True), (1, 3, "Far", "Three.", False), (1, 4, "", "Four.", True), (1, 5, None, "Five.", True)], "k int, no int, section string, text string, relevant boolean")
    assert P.sentence_prompt(s, "k").first().text == "### Intro\n[S1] One.\n[S2] Two.\n\n### Far  [probably unrelated to the complaint]\n[S3] Three.\n\n### Article\n[S4] Four.\n\n### Article\n[S5] Five."
    p = spark.createDataFrame([(1, 1, "H", "Update software.", 1), (1, 2, "H", "c" * 300, None), (1, 3, "H", "u" * 900, 2)], "k int, no int, section string, text string, unit int")
    assert P.paragraph_prompt(p, "k").first().text == f"### H\n[P1] Update software.\n- {'c' * 200}\n[P2] {'u' * 700}"
    i = spark.createDataFrame([(1, 0, "Black screen", "Screen"), (1, 1, "Slow", None)], "k int, no int, text string, title string")
    assert P.intent_prompt(i, "k").first().text == "0. Black screen (title: Screen)\n1. Slow (title: -)"
    assert P.intent_prompt(i, "k", 18).first().text == "0. Black screen (t"
    long = spark.createDataFrame([(1, n, "x" * 100) for n in range(200)], "k int, n int, t string")
    text = P.article_prompt(long, "k", ["n"], "t").first().text
    assert text == "\n".join(["x" * 100] * 200)[:14_000] + "\n[article truncated]"
