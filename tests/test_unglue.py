"""Lost spaces against a plain version, golden cases and a hostile run."""

import gzip
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import repair
from tessera.operators import unglue as U
from tessera.sources import files

COMMON = "the to your device and then restart phone screen in it a is go settings tap power button hold off on for with can try lock locked unlock due security reasons i at or of".split()
RARE = ["foldable", "keyboard", "sec", "uri", "ty", "gos", "phones"]


@pytest.fixture(scope="module")
def ranks(spark):
    words = COMMON + [f"filler{i}" for i in range(3)] + RARE
    return spark.createDataFrame([(w, i if w not in RARE else 20_000 + i) for i, w in enumerate(words)], "word string, rank int")


def mended(spark, ranks, corpus, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return [r.text for r in U.unglued(rows, ["k"], "t", ranks, spark.createDataFrame([(w,) for w in corpus] or [("none",)], "word string")).orderBy("k").collect()]


def test_a_glued_text_gets_its_spaces_back(spark, ranks):
    glued = "To unlockyourdevicelockedduetosecurity reasons.restartyourdeviceandthentap the screen,Thengotosettingsandtappower now"
    got = mended(spark, ranks, [], glued, "Use it on your foldable phone with SmartThings.view.Once more", None, "")
    assert got[0] == "To unlock your device locked due to security reasons. restart your device and then tap the screen, Then go to settings and tap power now"
    assert got[1] == "Use it on your foldable phone with SmartThings.view. Once more" and got[2] is None and got[3] == ""


def test_a_hostile_run_is_left_alone(spark, ranks):
    began = time.time()
    text = "x" * 20000 + " " + "restartyourdevice" * 300 + " " + "restartyourdevice" * 23 + " " + "unlockyourdeviceandthen" * 2
    got = mended(spark, ranks, [], text)[0].split(" ")
    assert got[0] == "x" * 20000 and got[1] == "restartyourdevice" * 300 and got[2:5] == ["restart", "your", "device"] and time.time() - began < 60


def plain_cut(run, rank_of, article, corpus, scale):
    """All cuts by recursion over prefixes, the cheapest remembered."""

    def price(w):
        r = rank_of.get(w)
        if w in article:
            r = min(100 if r is None else r, 100)
        elif w in corpus and r is not None:
            r = min(r, max(r // 10, 100))
        if len(w) == 1:
            return math.log((r + 1) * scale) if w in "ai" and r is not None else math.inf
        if r is None or len(w) <= 3 and r > 10_000:
            return 6 + 4 * len(w) if len(w) >= 4 else math.inf
        return math.log((r + 1) * scale)

    memo = {0: (0.0, [])}
    for end in range(1, len(run) + 1):
        memo[end] = min(((memo[s][0] + price(run[s:end]), memo[s][1] + [end - s]) for s in range(max(0, end - 20), end)), key=lambda x: x[0])
    return memo[len(run)][1] if memo[len(run)][0] < math.inf else None


def test_cuts_are_the_cheapest(spark, ranks):
    rng = random.Random(8)
    pool = COMMON + RARE + ["blorp", "zz", "q", "unlocked", "restarting"]
    runs = {(rng.randrange(3), "".join(rng.choice(pool) for _ in range(rng.randint(2, 8)))) for _ in range(150)}
    article = {k: {w + e for w in rng.sample(COMMON + RARE, 6) for e in ("", "s", "ed", "ing", "d")} for k in range(3)}
    corpus = set(rng.sample(RARE + COMMON, 8))
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = U.run_cuts(table(list(runs), "k int, word string"), ["k"], ranks, table([(k, w) for k, ws in article.items() for w in ws], "k int, word string"), table([(w,) for w in corpus], "word string"))
    found = {(r.k, r.word): r.sizes for r in got.collect()}
    rank_of = {r.word: r["rank"] for r in ranks.collect()}
    for k, run in runs:
        assert found[k, run] == plain_cut(run, rank_of, article[k], corpus, math.log(len(rank_of) + 2)), run


def test_cuts_in_steps_and_full_maps(monkeypatch):
    """Words of several articles, a few letters and sums at a time, by maps in which most slots are set."""
    for name, n in (("LETTERS_AT_ONCE", 40), ("SUMS_AT_ONCE", 90), ("MAP_BITS", 6), ("SMALL_MAP_BITS", 6)):
        monkeypatch.setattr(U, name, n)
    rng, scale = random.Random(4), math.log(60)
    pool = COMMON + RARE + ["blorp", "zz", "q", "\u00e9t\u00e9", "\U0001f600"]
    rank_of = {w: i if w not in RARE else 20_000 + i for i, w in enumerate(COMMON + RARE)}
    articles = [list({"".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 9))}) for _ in range(40)]
    articles[7].append("restartyourdevice" * 23)
    price = lambda r: math.log((r + 1) * scale)
    known = {w: price(r) for w, r in rank_of.items() if len(w) > 3 or r <= 10_000}
    mine = [set(rng.sample(COMMON + RARE + ["blorp", "zz"], 6)) for _ in articles]
    own = {a: {w: price(min(rank_of.get(w, 100), 100)) for w in ws if len(w) > 1 or w in rank_of} for a, ws in enumerate(mine)}
    got, told = [], []
    for words, of in U._in_steps(articles):
        got += U._cheapest(words, of, known, U._map_for(list(known), None), own)
        told += zip(of.tolist(), words)
    assert told == [(a, w) for a, ws in enumerate(articles) for w in ws]
    assert got == [plain_cut(w, rank_of, mine[a], set(), scale) for a, w in told]
    listed = U._map_for(list(known), None)
    met = U._pieces_in_map(articles, listed)
    whole = " ".join(w for ws in articles for w in ws)
    assert len(met) == len(set(met)) and {w for w in known if w in whole} <= set(met) and all(p in whole for p in met)


def test_pieces_are_not_rows_for_each_place(spark, ranks):
    """A dictionary's piece is a row of a portion however often its articles hold it, and no other piece is one."""
    runs = spark.createDataFrame([(k, "restartyourdevice" * n + "qqqq") for k in range(50) for n in (1, 3, 5)], "k int, word string")
    none = spark.createDataFrame([], "k int, word string")
    got = U.run_cuts(runs, ["k"], ranks, none, none.select("word"))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.sizes) for r in got.collect()} == {(7, 4, 6) * n + (4,) for n in (1, 3, 5)}


def test_a_ranked_list_counts_first_lines(spark, tmp_path):
    for name, opener in (("words.txt", open), ("words.txt.gz", gzip.open)):
        with opener(tmp_path / name, "wt") as f:
            f.write("the\nof\nthe\n\nand of\nzebra\n")
        assert {r.word: r["rank"] for r in files.ranked_words(spark, f"file://{tmp_path}/{name}").collect()} == {"the": 0, "of": 1, "and": 3, "zebra": 5}


def test_ranks_of_forms_have_three_letters(spark, ranks):
    words = spark.createDataFrame([("phones",), ("buttons",), ("ofs",), ("of",), ("itd",), ("zzz",)], "word string")
    assert {r.word: r["rank"] for r in repair.word_ranks(words, ranks).collect()} == {"phones": COMMON.index("phone"), "buttons": COMMON.index("button"), "ofs": None, "of": None, "itd": None, "zzz": None}


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distances_with_swaps(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(300)] + [("ca", "abc"), ("", ""), ("ab", "ba")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", repair.swap_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == osa(r.a, r.b) for r in got)


def test_corrections_by_tier_with_two_edits_in_the_lexicon(spark):
    known = spark.createDataFrame([("black", 0, 50), ("screen", 0, 60), ("flicker", 0, 10**9), ("lagging", 2, 9000), ("logging", 2, 800), ("blak", 2, 9999), ("block", 2, 10), ("cloud", 1, 70), ("could", 2, 5)], "word string, tier int, rank int")
    words = spark.createDataFrame([(w,) for w in ("blak", "lagging", "screeen", "fliker", "fikcer", "clould", "scren", "flkr", "xyzxyzxyz", "abc")], "word string")
    got = {r.word: r.candidate for r in repair.corrected_words(words, known, 5000).collect()}
    assert got == {"blak": "black", "screeen": "screen", "fliker": "flicker", "fikcer": "flicker", "clould": "cloud", "scren": "screen"}


def test_golden_mark_spaces(spark):
    rows = spark.createDataFrame([("a.b e.g. x biometrics,and 8.5 done.Next",)], "t string")
    assert rows.select(repair.spaced(F.col("t"), F.lit(True)).alias("x")).first().x == re.sub(r"(?<=[a-z]{2})([.!?;,])([A-Za-z])(?=[A-Za-z])", r"\1 \2", rows.first().t)


def test_parts_are_told_apart_where_one_is_cut():
    cuts = {"unlockyour": [6, 4], "tapthescreen": [3, 3, 6]}
    text = "UnlockYour5GB tapthescreen, 5Gx éunlockyour " + "9" * 401 + "unlockyour"
    assert U._mended(text, cuts) == "Unlock Your 5 GB tap the screen, 5Gx éunlock your " + "9" * 401 + "unlockyour"
