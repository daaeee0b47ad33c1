"""Spelling repair by deletion neighbourhoods, lost spaces, and glued words cut apart."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.operators.ranges import numbered

# The longest piece of a glued word and the longest word that is cut, costs of unknown pieces, and the
# rank from which a short word is a fragment.
LONGEST_PIECE, LONGEST_WORD = 20, 400
UNKNOWN, UNKNOWN_LETTER, UNKNOWN_LEAST = 6.0, 4.0, 4
FRAGMENT_RANK = 10_000
GLUED_RUN, GLUED_RUNS = 16, 3
# Letters from which a word is put right, and from which by two edits; the lowest tier of known words; the rank beyond
# which a dictionary word is too rare to count as known.
LEAST_TYPO, LEAST_TWO_EDITS, LEXICON_TIER, KNOWN_RANK = 4, 6, 0, 30_000


def _deletions(word):
    """The word and all its forms with one letter less."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.length(word))))
    return F.array_distinct(F.array_append(less, word))


def one_edit(a, b):
    """Whether two words are one insertion, deletion, replacement or swap of neighbours apart."""
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2, F.length(a))) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & swap))


def corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word, candidate, freq``: the most frequent of ``known`` (word, n) one edit from each word.

    Words one edit apart share a form with one letter less (or are one), so the
    candidates come from an equi-join and are then verified.
    """
    left = words.select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    right = known.select(F.col("word").alias("candidate"), "n", F.explode(_deletions(F.col("word"))).alias("form"))
    near = left.join(right, "form").select("word", "candidate", "n").distinct().where(one_edit(F.col("word"), F.col("candidate")))
    best = Window.partitionBy("word").orderBy(F.desc("n"), "candidate")
    return near.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("word", "candidate", F.col("n").alias("freq"))


def ranked_corrections(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word, candidate``: of ``known`` (word, tier, rank) one edit away, the one of the lowest tier, then rank, then by name."""
    left = words.select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    right = known.select(F.col("word").alias("candidate"), "tier", "rank", F.explode(_deletions(F.col("word"))).alias("form"))
    near = left.join(right, "form").where(one_edit(F.col("word"), F.col("candidate")))
    return near.groupBy("word").agg(F.min(F.struct("tier", "rank", "candidate")).alias("b")).select("word", F.col("b.candidate").alias("candidate"))


def swap_distance(a: Column, b: Column) -> Column:
    """Edits between two words, a swap of neighbours being one (optimal string alignment); rows of the usual table, folded."""
    letter = lambda w, i: F.substr(w, i, F.lit(1))
    first = F.sequence(F.lit(0), F.length(b))

    def row(s: Column, i: Column) -> Column:
        def cell(left: Column, j: Column) -> Column:
            same = F.when(letter(a, i) == letter(b, j), 0).otherwise(1)
            swap = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            best = F.least(F.get(s["old"], j) + 1, F.get(left, j - 1) + 1, F.get(s["old"], j - 1) + same, F.when(swap, F.get(s["older"], j - 2) + 1))
            return F.concat(left, F.array(best))

        new = F.when(F.length(b) == 0, F.array(i)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(i), cell))
        return F.struct(s["old"].alias("older"), new.alias("old"))

    rows = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.struct(first.alias("older"), first.alias("old")), row, lambda s: F.get(s["old"], F.length(b)))
    return F.when(F.length(a) == 0, F.length(b)).otherwise(rows)


def corrected_words(words: DataFrame, known: DataFrame, rarest: int = KNOWN_RANK) -> DataFrame:
    """``word, candidate``: words that are put right, and by what.

    ``known``: word, tier (0: the lexicon, 1: the corpus, 2: a dictionary), rank.  A dictionary
    word beyond ``rarest`` is real but not known: it becomes a word of the lexicon or stays.
    Words of four letters and more become the known word one edit away of the lowest
    tier, then rank, then name; without one, those of six and more become a word of the
    lexicon two edits away.  Candidates come from equi-joins on shared deletions.
    """
    good = known.where((F.col("tier") < 2) | (F.col("rank") <= rarest)).where(F.length("word") >= 3)
    wrong = words.select("word").distinct().where(F.length("word") >= LEAST_TYPO).join(good.select("word"), "word", "left_anti")
    rare = known.select("word").distinct().withColumn("rare", F.lit(True))
    asked = wrong.join(rare, "word", "left").select("word", F.coalesce("rare", F.lit(False)).alias("rare"))
    target = good.select(F.col("word").alias("candidate"), "tier", "rank")
    one = asked.withColumn("form", F.explode(_deletions(F.col("word")))).join(target.withColumn("form", F.explode(_deletions(F.col("candidate")))), "form")
    near = one.where(one_edit(F.col("word"), F.col("candidate")) & (~F.col("rare") | (F.col("tier") == LEXICON_TIER))).select("word", "candidate", "tier", "rank")
    twice = lambda w: F.array_distinct(F.flatten(F.transform(_deletions(w), _deletions)))
    left = asked.where(~F.col("rare") & (F.length("word") >= LEAST_TWO_EDITS)).join(near.select("word"), "word", "left_anti")
    lexicon = target.where(F.col("tier") == LEXICON_TIER)
    two = left.withColumn("form", F.explode(twice(F.col("word")))).join(lexicon.withColumn("form", F.explode(twice(F.col("candidate")))), "form").select("word", "candidate", "tier", "rank").distinct()
    two = two.where((F.abs(F.length("word") - F.length("candidate")) <= 2) & (swap_distance(F.col("word"), F.col("candidate")) <= 2))
    return near.unionByName(two).groupBy("word").agg(F.min(F.struct("tier", "rank", "candidate")).alias("b")).select("word", F.col("b.candidate").alias("candidate"))


def rewritten(texts: DataFrame, keys: list[str], text: str, fixes: DataFrame) -> DataFrame:
    """``keys, text``: texts with each word of ``fixes`` (word, candidate) put right; the rest is kept as it is.

    A word that touches a digit is a model's name and stays.
    """
    whole = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Za-z']+|[^A-Za-z']+)"), F.lit(1))
    parts = texts.select(*keys, whole.alias("w")).select(*keys, F.posexplode_outer(F.transform("w", lambda x, i: F.struct(
        x.alias("part"), (F.coalesce(F.get("w", i - 1), F.lit("")).rlike("[0-9]$") | F.coalesce(F.get("w", i + 1), F.lit("")).rlike("^[0-9]")).alias("model")
    ))).alias("pos", "p"))
    looked = parts.select(*keys, "pos", "p.part", F.when(~F.col("p.model"), F.lower("p.part")).alias("word")).join(fixes.select("word", "candidate"), "word", "left")
    shown = F.struct("pos", F.coalesce("candidate", "part").alias("x"))
    return looked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), shown))), lambda x: x["x"]), "").alias("text"))


def word_ranks(words: DataFrame, ranks: DataFrame) -> DataFrame:
    """``word, rank``: the best rank of a word, of it without its last letter, or without two; null if none is known.

    ``ranks``: word, rank.  Forms under three letters have none.
    """
    forms = F.array_distinct(F.array(F.col("word"), F.expr("left(word, length(word) - 1)"), F.expr("left(word, length(word) - 2)")))
    looked = words.select("word", F.explode(forms).alias("form")).where("length(form) >= 3").join(ranks.select(F.col("word").alias("form"), "rank"), "form")
    return words.join(looked.groupBy("word").agg(F.min("rank").alias("rank")), "word", "left")


def inflected(known: DataFrame) -> DataFrame:
    """``word``: known words with the endings that they may have in a text."""
    return known.select(F.explode(F.transform(F.array(*[F.lit(e) for e in ("", "s", "ed", "ing", "d")]), lambda e: F.concat("word", e))).alias("word")).distinct()


def glued(texts: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """``keys, glued``: whether a text has lost its spaces: several long runs of letters that no dictionary knows."""
    runs = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{GLUED_RUN},}})"), F.lit(1))).alias("word"))
    many = runs.join(known.select("word"), "word", "left_anti").groupBy(*keys).agg((F.count("*") >= GLUED_RUNS).alias("glued"))
    return texts.select(*keys).join(many, keys, "left").select(*keys, F.coalesce("glued", F.lit(False)).alias("glued"))


def spaced(text: Column, is_glued: Column) -> Column:
    """The space after punctuation put back: in a glued text after any mark, else only between sentences ("view.Once")."""
    every = F.regexp_replace(text, r"(?<=[a-z]{2})([.!?;,])(?=[A-Za-z][A-Za-z])", "$1 ")
    breaks = F.regexp_replace(text, r"(?<=[a-z]{2})([.!?])(?=[A-Z][a-z])", "$1 ")
    return F.when(is_glued, every).otherwise(breaks)


def word_breaks(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word, pieces``: the cut of each word into known and unknown pieces of the least summed cost.

    A known piece costs ln((rank + 1) * ln(V + 2)), ranks being those of ``known``
    (word, n) by frequency among its V words; an unknown one of four letters or more
    6 and 4 a letter; shorter unknown ones, single letters but a and i, and short
    rare words can't stand.  Pieces meet the dictionary by an equi-join, so no task
    holds it, and gather with their word's own row, so nothing is joined back.
    Words of over 400 letters stay whole.
    """
    order = F.concat(F.lpad((F.lit(10**15) - F.col("n")).cast("string"), 16, "0"), F.col("word"))
    ranked = numbered(known.select("word", order.alias("o")), "o", "rank").select("word", (F.col("rank") - 1).alias("rank"))
    size = math.log(known.count() + 2)
    stands = F.when(F.length("word") == 1, F.col("word").isin("a", "i")).when(F.length("word") <= 3, F.col("rank") <= FRAGMENT_RANK).otherwise(True)
    costs = ranked.where(stands & (F.length("word") <= LONGEST_PIECE)).select(F.col("word").alias("piece"), F.log((F.col("rank") + 1) * size).alias("cost"))
    each = words.groupBy("word").agg(F.count("*").alias("times"))
    short = each.where(F.length("word").between(1, LONGEST_WORD))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_PIECE), F.length("word") - i + 1)), lambda k: F.struct(i.alias("at"), F.substr("word", i, k).alias("piece")))))
    met = short.select("word", F.explode(places).alias("p")).select("word", "p.at", "p.piece").join(costs, "piece")
    found = met.select("word", F.lit(0).cast("long").alias("times"), F.struct("at", F.length("piece").alias("size"), "cost").alias("known"))
    own = each.select("word", "times", F.lit(None).cast(found.schema["known"].dataType).alias("known"))
    by_word = own.unionByName(found).groupBy("word").agg(F.sum("times").alias("times"), F.collect_list("known").alias("known"))

    @F.pandas_udf(StringType())
    def cut(word: pd.Series, found: pd.Series) -> pd.Series:
        def one(w, pieces):
            if w is None or len(w) > LONGEST_WORD:
                return w
            n = len(w)
            price = {(p["at"] - 1, p["size"]): p["cost"] for p in (pieces if pieces is not None else ())}
            best = [(0.0, 0)] + [(math.inf, 0)] * n
            for end in range(1, n + 1):
                for start in range(max(0, end - LONGEST_PIECE), end):
                    k = end - start
                    more = price.get((start, k), UNKNOWN + UNKNOWN_LETTER * k if k >= UNKNOWN_LEAST else math.inf)
                    if best[start][0] + more < best[end][0]:
                        best[end] = (best[start][0] + more, start)
            if math.isinf(best[-1][0]):
                return w
            out, end = [], n
            while end:
                out.append(w[best[end][1] : end])
                end = best[end][1]
            return " ".join(out[::-1])

        return pd.Series([one(w, f) for w, f in zip(word, found)])

    done = by_word.select("word", "times", cut("word", "known").alias("pieces"))
    return done.select("word", "pieces", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("word", "pieces")
