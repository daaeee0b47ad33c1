"""Lost spaces put back: words run together are cut by costs that know the article and the corpus.

Places of a run that may hold a piece of the ranked dictionary are told by a map of bits,
of one size however long the list is.  What a portion of the articles may hold meets the
dictionary by an equi-join, each piece once, and the prices found gather with the portion.
There the cheapest cuts of many runs are found together, letter by letter, so the time is
linear in the runs' letters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.operators.repair import FRAGMENT_RANK, LONGEST_PIECE, LONGEST_WORD, UNKNOWN, UNKNOWN_LEAST, UNKNOWN_LETTER, glued, inflected, spaced
from tessera.sources.files import stored

# Letters from which an unknown run is cut, the rank that an article's own words have at most, and how
# much more frequent the corpus's words count.
LEAST_RUN, ARTICLE_RANK, CORPUS_DIVISOR = 8, 100, 10


def own_words(texts: DataFrame, keys: list[str], text: str, ranks: DataFrame) -> DataFrame:
    """``keys, word``: the dictionary words that each text uses, with their endings."""
    used = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z]{2,})"), F.lit(1)))).alias("word"))
    known = used.join(ranks.select("word"), "word", "left_semi")
    forms = F.transform(F.array(*[F.lit(e) for e in ("", "s", "ed", "ing", "d")]), lambda e: F.concat("word", e))
    return known.select(*keys, F.explode(forms).alias("word")).distinct()


def _price(rank: Column, size: Column, scale: float) -> Column:
    """What a known piece costs by its rank; null where it counts as unknown. One letter is a piece if it is a word (a, i)."""
    return F.when((size > 1) & (size <= 3) & (rank > FRAGMENT_RANK), None).otherwise(F.log((rank + 1) * scale))


#: Bits of the numbers of a dictionary's map and of that of the pieces at hand; letters of a portion of articles, letters and sums that a task works on at a time.
MAP_BITS, SMALL_MAP_BITS = 24, 22
PORTION_LETTERS, LETTERS_AT_ONCE, SUMS_AT_ONCE = 1 << 20, 1 << 18, 1 << 19
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _letters(words: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The words as one text, its letters as numbers, how many there are from each to its word's end, and the words' sizes."""
    text, sizes = "".join(words), np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return text, codes, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)), sizes


def _slots(codes: np.ndarray, salt: np.ndarray | None, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each size of a piece, the slots in a map of the pieces that begin at each letter; those of one salt and the same letters are equal."""
    h = np.zeros(len(codes), np.uint64) if salt is None else salt
    for k in range(1, min(LONGEST_PIECE, len(codes)) + 1):
        h = (h[: len(codes) - k + 1] + codes[k - 1 :]) * _FACTOR
        yield k, ((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)


def _slots_of(pieces: list[str], salt: np.ndarray | None, bits: int) -> np.ndarray:
    """The slot of each piece."""
    _, codes, _, sizes = _letters(pieces)
    begins, out = np.cumsum(sizes) - sizes, np.zeros(len(pieces), np.int64)
    for k, slot in _slots(codes, None if salt is None else np.repeat(salt, sizes), bits):
        out[sizes == k] = slot[begins[sizes == k]]
    return out


def _in_steps(articles: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Articles of about ``LETTERS_AT_ONCE`` letters together: their words, and the place of each word's article."""
    words, of, letters = [], [], 0
    for i, own in enumerate(articles):
        words += own
        of += [i] * len(own)
        letters += sum(map(len, own))
        if words and (letters >= LETTERS_AT_ONCE or i == len(articles) - 1):
            yield words, np.array(of, np.int64)
            words, of, letters = [], [], 0


def _pieces_in_map(articles: list[list[str]], listed: np.ndarray) -> list[str]:
    """The different pieces of the articles' words whose slot is set: all of the map, and a few others."""
    out = set()
    for words, _ in _in_steps(articles):
        text, codes, left, _ = _letters(words)
        for k, slot in _slots(codes, None, MAP_BITS):
            out.update([text[p : p + k] for p in np.flatnonzero(listed[slot] & (left[: len(slot)] >= k)).tolist()])
    return list(out)


def _map_for(pieces: list[str], salt: np.ndarray | None) -> np.ndarray:
    """A map of pieces at hand."""
    out = np.zeros(1 << SMALL_MAP_BITS, bool)
    out[_slots_of(pieces, salt, SMALL_MAP_BITS)] = True
    return out


def _cheapest(words: list[str], of: np.ndarray, known: dict[str, float], listed: np.ndarray, own: dict[int, dict[str, float]]) -> list[list[int] | None]:
    """Sizes of the pieces of each word's cheapest cut, in order; none if there is no cut.

    ``known``: what known pieces cost, ``listed``: their map; ``own``: by articles, what pieces cost there
    instead, ``of`` being each word's article.  Any other piece is unknown and costs by its
    size, if it has letters enough.  Of equally cheap cuts the one whose last piece starts
    first holds.
    """
    text, codes, left, sizes = _letters(words)
    article, begins = np.repeat(of, sizes), np.cumsum(sizes) - sizes
    # a row for each letter that ends a piece: what pieces of twenty letters, nineteen and so on cost
    cost = np.tile([UNKNOWN + UNKNOWN_LETTER * k if k >= UNKNOWN_LEAST else math.inf for k in range(LONGEST_PIECE, 0, -1)], (len(codes), 1))

    def put(k: int, at: np.ndarray, prices: list[float]) -> None:
        price = np.array(prices, float)
        told = ~np.isnan(price)
        cost[at[told] + k - 1, LONGEST_PIECE - k] = price[told]

    for k, slot in _slots(codes, None, SMALL_MAP_BITS):
        at = np.flatnonzero(listed[slot] & (left[: len(slot)] >= k))
        put(k, at, [known.get(text[p : p + k], math.nan) for p in at.tolist()])
    here = {a: own[a] for a in np.unique(of).tolist()}
    salt = lambda articles: (np.asarray(articles, np.uint64) + np.uint64(1)) * _MIX
    mine = _map_for([p for prices in here.values() for p in prices], np.repeat(salt(list(here)), [len(prices) for prices in here.values()]))
    for k, slot in _slots(codes, salt(article), SMALL_MAP_BITS):
        at = np.flatnonzero(mine[slot] & (left[: len(slot)] >= k))
        put(k, at, [here[a].get(text[p : p + k], math.nan) for a, p in zip(article[at].tolist(), at.tolist())])
    out, order, done = [None] * len(words), np.argsort(-sizes, kind="stable"), 0
    while done < len(order):
        longest = int(sizes[order[done]])
        rows = order[done : done + max(1, SUMS_AT_ONCE // (LONGEST_PIECE + longest))]
        done += len(rows)
        best, back = np.full((len(rows), LONGEST_PIECE + longest + 1), math.inf), np.zeros((len(rows), longest + 1), np.uint8)
        best[:, LONGEST_PIECE] = 0  # before it lies nothing that a piece could follow
        for end in range(1, longest + 1):
            live = int(np.searchsorted(-sizes[rows], -end, side="right"))  # longer words come first
            sums = best[:live, end : end + LONGEST_PIECE] + cost[begins[rows[:live]] + end - 1]
            least = sums.argmin(axis=1)
            best[:live, LONGEST_PIECE + end] = sums[np.arange(live), least]
            back[:live, end] = LONGEST_PIECE - least
        there = best[np.arange(len(rows)), LONGEST_PIECE + sizes[rows]] < math.inf
        for row, w, end in zip(back[there].tolist(), rows[there].tolist(), sizes[rows[there]].tolist()):
            pieces = []
            while end:
                pieces.append(row[end])
                end -= row[end]
            out[w] = pieces[::-1]
    return out


def _mended(text: str, cuts: dict[str, Sequence[int]]) -> str:
    """The text with its words of ``cuts`` in pieces of these sizes; what stands together with one is told apart."""

    def apart(token: re.Match) -> str:
        parts = re.findall("[A-Za-z]+|[0-9]+", token[0]) if len(token[0]) <= LONGEST_WORD else []
        found = [cuts.get(p.lower()) for p in parts]
        if all(f is None for f in found):
            return token[0]
        ends = [[len(p)] if f is None else np.cumsum(f).tolist() for p, f in zip(parts, found)]
        return " ".join(p[a:b] for p, at in zip(parts, ends) for a, b in zip([0, *at], at))

    return re.sub("[A-Za-z0-9]+", apart, text)


def _map_of(pieces: DataFrame) -> np.ndarray:
    """The map of a column of pieces, in bytes of eight bits: a task works its part out, bits of one byte are joined."""

    @F.pandas_udf("long")
    def slot(piece: pd.Series) -> pd.Series:
        return pd.Series(_slots_of(piece.tolist(), None, MAP_BITS))

    byte = pieces.select(slot(pieces.columns[0]).alias("slot")).groupBy(F.floor(F.col("slot") / 8).alias("byte"))
    set_bits = byte.agg(F.bit_or(F.expr("shiftright(128, cast(slot % 8 AS int))")).alias("bits")).toPandas()
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    out[set_bits["byte"].to_numpy(dtype=np.int64)] = set_bits["bits"].to_numpy(dtype=np.uint8)
    return out


def run_cuts(runs: DataFrame, keys: list[str], ranks: DataFrame, article: DataFrame, corpus: DataFrame) -> DataFrame:
    """``keys, word, sizes``: the cheapest cut of each run of letters, as sizes of pieces; null if there is none.

    ``runs``: keys, word (lower case, up to 400 letters); ``ranks``: word, rank (0 is the
    most frequent); ``article``: keys, word; ``corpus``: word.

    An article is a row with its runs, and articles are dealt into portions of bounded size.  Of the
    pieces of a portion only those go on that are in the dictionary's map, each once; what the
    dictionary knows of them comes back to the portion.
    """
    scale = math.log(ranks.count() + 2)
    spark, schema = runs.sparkSession, runs.schema
    each = stored(runs.select(*keys, "word").where(F.length("word").between(1, LONGEST_WORD)).groupBy(*keys).agg(F.collect_set("word").alias("words")), "runs")
    letters = each.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)))).first()[0] or 0
    portions = max(4 * spark.sparkContext.defaultParallelism, letters // PORTION_LETTERS)
    each = each.withColumn("_portion", F.pmod(F.xxhash64(*keys), F.lit(portions)))
    size = F.length("_piece")
    common = corpus.select(F.col("word").alias("_piece")).distinct().withColumn("_common", F.lit(True))
    usual = F.when(F.col("_common"), F.least(F.col("rank"), F.greatest(F.floor(F.col("rank") / CORPUS_DIVISOR), F.lit(ARTICLE_RANK)))).otherwise(F.col("rank"))
    known = ranks.select(F.col("word").alias("_piece"), "rank").join(common, "_piece", "left").where(size.between(1, LONGEST_PIECE) & ((size > 1) | F.col("_piece").isin("a", "i")))
    # an article's own words count where their rank isn't better already
    known = known.select("_piece", _price(usual, size, scale).alias("cost"), (F.col("rank") <= ARTICLE_RANK).alias("settled"))
    known = stored(known.where("cost IS NOT NULL"), "known")
    own_cost = spark.range(1).select(_price(F.lit(ARTICLE_RANK), F.lit(LONGEST_PIECE), scale)).first()[0]
    bits = spark.sparkContext.broadcast(_map_of(known.select("_piece")))

    def may_be_known(articles: pa.Table) -> pa.Table:
        pieces = _pieces_in_map(articles["words"].to_pylist(), np.unpackbits(bits.value).view(bool))
        return pa.table({"_portion": pa.array([articles["_portion"][0].as_py()] * len(pieces), pa.int64()), "_piece": pa.array(pieces, pa.string())})

    def cut(articles: pa.Table, prices: pa.Table) -> pa.Table:
        pieces, words, which, sizes = prices["_piece"].to_pylist(), [], [], []
        known, settled = dict(zip(pieces, prices["cost"].to_pylist())), {p for p, s in zip(pieces, prices["settled"].to_pylist()) if s}
        own = {a: {p: own_cost for p in mine or [] if p not in settled and (len(p) > 1 or p in known)} for a, mine in enumerate(articles["_own"].to_pylist())}
        listed = _map_for(pieces, None)
        for some, of in _in_steps(articles["words"].to_pylist()):
            words += some
            which.append(of)
            sizes += _cheapest(some, of, known, listed, own)
        at = np.concatenate(which) if which else np.zeros(0, np.int64)
        return pa.table([articles[k].take(pa.array(at)) for k in keys] + [pa.array(words, pa.string()), pa.array(sizes, pa.list_(pa.int32()))], names=[*keys, "word", "sizes"])

    met = each.select("_portion", "words").groupBy("_portion").applyInArrow(may_be_known, "_portion long, _piece string").join(known, "_piece")
    own = article.where(F.length("word").between(1, LONGEST_PIECE)).groupBy(*keys).agg(F.collect_set("word").alias("_own"))
    whole = each.join(own, keys, "left").select(*keys, "_portion", "words", "_own")
    shape = StructType([StructField(k, schema[k].dataType) for k in keys] + [StructField("word", StringType()), StructField("sizes", ArrayType(IntegerType()))])
    return whole.groupBy("_portion").cogroup(met.select("_portion", "_piece", "cost", "settled").groupBy("_portion")).applyInArrow(cut, shape)


def unglued(texts: DataFrame, keys: list[str], text: str, ranks: DataFrame, corpus: DataFrame) -> DataFrame:
    """``keys, text``: texts with their lost spaces back.

    Of a glued text marks get their space, and unknown runs of eight letters and more are
    cut; runs of over 400 letters and digits stay, and parts of letters and digits are
    told apart only where something was cut.  Other texts only get lost sentence
    breaks.  The letters and their case stay.  ``keys`` tell the rows apart; null
    texts stay null.  ``ranks``: word, rank; ``corpus``: words that count as frequent.
    """
    given = texts.select(*keys, F.col(text).alias("text"))
    rows = stored(given.join(glued(given, keys, "text", ranks), keys).select(*keys, spaced(F.col("text"), F.col("glued")).alias("text"), "glued"), "spaced")
    torn = rows.where("glued")
    tokens = torn.select(*keys, F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))).alias("token")).where(F.length("token") <= LONGEST_WORD)
    parts = tokens.select(*keys, F.explode(F.regexp_extract_all("token", F.lit("([A-Za-z]+)"), F.lit(1))).alias("part"))
    runs = parts.where(F.length("part") >= LEAST_RUN).select(*keys, F.lower("part").alias("word")).join(ranks.select("word"), "word", "left_anti")
    cuts = run_cuts(runs, keys, ranks, own_words(torn, keys, "text", ranks), inflected(corpus)).where(F.size("sizes") > 1)
    by_article = cuts.groupBy(*keys).agg(F.collect_list(F.struct("word", "sizes")).alias("_cuts"))

    @F.pandas_udf("string")
    def mended(text: pd.Series, words: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([t if w is None else _mended(t, dict(zip(w, s))) for t, w, s in zip(text, words, sizes)], dtype=object)

    return rows.join(by_article, keys, "left").select(*keys, mended("text", "_cuts.word", "_cuts.sizes").alias("text"))
