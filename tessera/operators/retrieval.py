"""Ranking: BM25, cosine, rank fusion, re-scoring and tiers."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

K1, B = 1.5, 0.75


def postings(docs: DataFrame, key: str, fields: dict[str, float], stop: list[str] = T.RANK_STOP) -> DataFrame:
    """``key, term, tf``: weighted counts; a field of weight 2 counts its terms twice."""
    parts = None
    for column, weight in fields.items():
        rows = docs.select(key, F.explode(T.without_words(T.words(F.col(column)), stop)).alias("term")).groupBy(key, "term").agg((F.count("*") * weight).alias("tf"))
        parts = rows if parts is None else parts.unionAll(rows)
    return parts.groupBy(key, "term").agg(F.sum("tf").alias("tf")) if len(fields) > 1 else parts


def bm25(index: DataFrame, key: str, queries: DataFrame, qkey: str, k: int = 20) -> DataFrame:
    """``qkey, key, score, rank``: the ``k`` best documents of each query by BM25, ties by key.

    ``index`` is from :func:`postings`, ``queries`` has ``qkey, term, qn`` (a
    query's repeats of a term add up).  Query terms are pushed into the index
    first, so documents' other terms are only counted for their lengths.
    """
    lengths = index.groupBy(key).agg(F.sum("tf").alias("len"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    terms = queries.select("term").distinct()
    useful = index.join(terms, "term", "left_semi")
    df = useful.groupBy("term").agg(F.count("*").alias("df"))
    n, c, tf = F.col("n"), F.col("df"), F.col("tf")
    idf = F.log(1 + (n - c + 0.5) / (c + 0.5))
    part = F.col("qn") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    scored = useful.join(df, "term").join(lengths, key).crossJoin(F.broadcast(stats)).join(queries, "term").withColumn("part", part).groupBy(qkey, key).agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored.where("score > 0"), [qkey], [F.desc("score"), F.col(key)], k)


def top(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``; Spark limits each group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def query_terms(rows: DataFrame, key: str, text: str, stop: list[str] = T.RANK_STOP) -> DataFrame:
    return rows.select(key, F.explode(T.without_words(T.words(F.col(text)), stop)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qn"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of the same length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def square(a: Column) -> Column:
    """The sum of an array's squares."""
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def unit(a: Column, least: float = 1e-12) -> Column:
    """An array scaled to a norm of 1; norms under ``least`` count as that."""
    norm = F.greatest(F.sqrt(square(a)), F.lit(least))
    return F.transform(a, lambda v: v.cast("double") / norm)


def against_all(rows: DataFrame, queries: DataFrame, key: str, condition: Column, block: int = 4096) -> DataFrame:
    """Every row with every query for which ``condition`` holds: a stated query set against all rows.

    Queries go to all rows in blocks of about ``block``, each a broadcast of bounded
    size and a pass over the rows, however many queries there are.
    """
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        met = rows.join(F.broadcast(part), condition)
        out = met if out is None else out.unionAll(met)
    return out


def scored_against_all(vectors: DataFrame, queries: DataFrame, *columns: str) -> DataFrame:
    """``query_id, vec_id, score, columns``: cosine of each of ``queries`` with all other ``vectors`` (vec_id, embedding, columns).

    Norms are taken once for each vector.
    """
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), square(F.col("embedding")).alias("qq"))
    v = vectors.select("vec_id", "embedding", square(F.col("embedding")).alias("vv"), *columns)
    dot = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return against_all(v, q, "query_id", F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot / F.sqrt(F.col("qq") * F.col("vv")), 6).alias("score"), *columns)


#: Rows and queries of a block of :func:`best_against_all`, and scores that a task holds at a time.
BLOCK_ROWS, BLOCK_QUERIES, SCORES_AT_ONCE = 32768, 32768, 1 << 21
_NEAR = 3e-6  # of scores rounded to six digits
_PAIRS_AT_ONCE = 1 << 16  # whose scores are summed in order


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To six digits as Spark rounds: halves of the shortest form go up."""
    out = np.floor(scores * 1e6 + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scores * 1e6 - np.floor(scores * 1e6) - 0.5) < 1e-6):  # at a half its shortest form decides
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _largest(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of each row; without so many, less than all."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf, scores.dtype)
    return scores.max(axis=1) if k == 1 else np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _block_best(v: pd.DataFrame, q: pd.DataFrame, k: int, kinds: int | None = None) -> pd.DataFrame:
    """Of a block of vectors and one of queries (both: id, embedding, norm; vectors: kind): each query's ``k`` best of each kind.

    A product of unit vectors in single precision finds what may be among them, by a margin
    that covers its errors; their scores are then summed in order as :func:`cosine` does, and
    rounded.  With ``kinds`` (``k`` is 1) a query keeps the kinds whose best reaches that of its ``kinds``-th one.
    """
    v, q = (x[(x["norm"] > 0) & (x["norm"] < np.inf)].sort_values("id") for x in (v, q))
    kind, names = pd.factorize(v["kind"], use_na_sentinel=False)
    by_kind = np.argsort(kind, kind="stable")
    v, kind = v.iloc[by_kind], kind[by_kind]
    parts = [slice(*np.searchsorted(kind, (c, c + 1))) for c in range(len(names))]
    (asked, qid, qq), (given, ids, vv) = ((np.array(x["embedding"].tolist(), dtype=float), x["id"].to_numpy(), x["norm"].to_numpy()) for x in (q, v))
    found = []
    if len(ids) and len(qid):
        units, others = ((x / np.sqrt(n)[:, None]).astype(np.float32) for x, n in ((asked, qq), (given, vv)))
        margin = np.float32(_NEAR + 2 * (given.shape[1] + 3) * 2.0**-23)
        least = np.finfo(np.float32).min  # a query itself lies below
        at_id = np.argsort(ids, kind="stable")
        own = [np.searchsorted(ids[at_id], qid, side) for side in ("left", "right")]
        step = max(1, SCORES_AT_ONCE // len(ids))
        for at in range(0, len(qid), step):
            near = units[at : at + step] @ others.T
            for i in np.flatnonzero(own[1][at : at + step] > own[0][at : at + step]):
                near[i, at_id[own[0][at + i] : own[1][at + i]]] = -np.inf
            level = np.stack([_largest(near[:, p], k) for p in parts], axis=1)
            if kinds and len(names) > kinds:
                level[level < _largest(level, kinds)[:, None] - margin] = np.inf
            level = np.maximum(level - margin, least)
            may = [np.nonzero(near[:, p] >= level[:, c, None]) for c, p in enumerate(parts)]
            i, j = np.concatenate([m[0] for m in may]) + at, np.concatenate([m[1] + p.start for m, p in zip(may, parts)])
            some = [slice(x, x + _PAIRS_AT_ONCE) for x in range(0, len(i), _PAIRS_AT_ONCE)]
            dot = np.concatenate([np.cumsum(asked[i[x]] * given[j[x]], axis=1)[:, -1] for x in some] or [np.zeros(0)])
            score = _rounded(dot / np.sqrt(qq[i] * vv[j]))
            order = np.lexsort((ids[j], -score, kind[j], i))
            i, j, score = i[order], j[order], score[order]
            begins = np.flatnonzero(np.diff(i, prepend=-1) | np.diff(kind[j], prepend=-1))
            place = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
            stay = place < k
            if kinds and len(names) > kinds:
                first = np.full((len(near), len(names)), -np.inf)
                first[i[begins] - at, kind[j[begins]]] = score[begins]
                stay &= first[i - at, kind[j]] >= _largest(first, kinds)[i - at]
            found.append((i[stay], j[stay], score[stay]))
    i, j, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, kind_of) for c, kind_of in enumerate((int, int, float)))
    names = np.array([None if pd.isna(x) else x for x in names], dtype=object)
    return pd.DataFrame({"query_id": qid[i], "vec_id": ids[j], "kind": names[kind[j]], "score": score})


def best_against_all(vectors: DataFrame, queries: DataFrame, k: int, kind: Column, kinds: int | None = None) -> DataFrame:
    """``query_id, vec_id, kind, score``: exactly, the ``k`` best other vectors of each kind for each query, ties by id.

    ``vectors`` and ``queries``: vec_id, embedding, all of one length; rows without a
    vector, or with one of norm 0, are in no pair.  Vectors and queries are dealt into blocks, every pair of
    which is a group of bounded size: all pairs are scored, and each group hands on its
    best.  The work is that of all pairs; a block of queries passes the vectors once.
    With ``kinds``, for a ``k`` of 1, the best of a query's ``kinds`` best kinds is told, and of further kinds any lesser row or none.
    """
    if kinds and k != 1:
        raise ValueError("kinds are told apart by the best of each: k must be 1")
    side = lambda rows: rows.where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", square(F.col("embedding")).alias("norm"), *rows.columns[2:])
    v, q = side(vectors.select("vec_id", "embedding", kind.cast("string").alias("kind"))), side(queries.select("vec_id", "embedding"))
    (n, m), cores = (x.count() for x in (v, q)), vectors.sparkSession.sparkContext.defaultParallelism
    # a vector goes to all blocks of queries and a query to all of vectors: as many queries as vectors are dealt into a square
    across = max(min(2 * cores, math.ceil(math.sqrt(4 * cores * n / max(m, 1)))), -(-n // BLOCK_ROWS), 1)
    down = max(-(-2 * cores // across), -(-m // BLOCK_QUERIES))
    block = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = v.withColumn("_v", block(across)).withColumn("_q", every(down))
    asked = q.withColumn("_q", block(down)).withColumn("_v", every(across))

    def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _block_best(rows, asked, k, kinds)

    found = rows.groupBy("_v", "_q").cogroup(asked.groupBy("_v", "_q")).applyInPandas(best, "query_id long, vec_id long, kind string, score double")
    return top(found, ["query_id", "kind"], [F.desc("score"), F.col("vec_id")], k).drop("rank")


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact nearest vectors, the query itself left out."""
    return top(best_against_all(vectors, queries, k, F.lit("")).drop("kind"), ["query_id"], [F.desc("score"), F.col("vec_id")], k)


def overlap(docs: DataFrame, key: str, queries: DataFrame, qkey: str, k: int, text: str = "text") -> DataFrame:
    """``qkey, key, score, rank``: the documents whose word sets are most like each query's (Jaccard), by an equi-join on terms."""
    words = lambda rows, name: rows.select(name, F.explode(F.array_distinct(T.without_words(T.words(F.col(text)), T.RANK_STOP))).alias("term"))
    d, q = words(docs, key), words(queries, qkey)
    d_n, q_n = d.groupBy(key).agg(F.count("*").alias("dn")), q.groupBy(qkey).agg(F.count("*").alias("qn"))
    common = d.join(q, "term").groupBy(qkey, key).agg(F.count("*").alias("c"))
    scored = common.join(d_n, key).join(q_n, qkey).select(qkey, key, F.round(F.col("c") / (F.col("dn") + F.col("qn") - F.col("c")), 6).alias("score"))
    return top(scored, [qkey], [F.desc("score"), F.col(key)], k)


def overlap_of(pairs: DataFrame, docs: DataFrame, key: str, queries: DataFrame, qkey: str, text: str = "text") -> DataFrame:
    """``pairs`` (qkey, key) with ``overlap``: the same similarity, for these pairs alone."""
    words = lambda c: F.array_distinct(T.without_words(T.words(c), T.RANK_STOP))
    d = docs.join(pairs.select(key).distinct(), key, "left_semi").select(key, words(F.col(text)).alias("dw"))
    q = queries.select(qkey, words(F.col(text)).alias("qw"))
    return pairs.join(d, key).join(q, qkey).withColumn("overlap", F.round(T.jaccard(F.col("dw"), F.col("qw"), 0.0), 6)).drop("dw", "qw")


def rrf(lists: list[DataFrame], qkey: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``qkey, key, score, rank``."""
    union = None
    for one in lists:
        rows = one.select(qkey, key, "rank")
        union = rows if union is None else union.unionAll(rows)
    fused = union.groupBy(qkey, key).agg(F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return top(fused, [qkey], [F.desc("score"), F.col(key)], k)


# How much a step's verb and an entry's polarity agree or clash, and what an entry on another surface loses.
AGREES, CLASHES, ELSEWHERE, LEAF = 0.25, -0.35, -0.3, 0.6
WANTED = {"enable": "onURL", "disable": "offURL", "set": "updateURL", "adjust": "updateURL", "open": "onClickURL", "check": "onClickURL"}
OPPOSITE = {"enable": "offURL", "disable": "onURL"}


def polarity_bonus(verb: Column, kinds: Column) -> Column:
    """By the polarities of a node's entries: agreement where the wanted one is among them; a clash only where the opposite is all there is."""
    out = F.lit(0.0)
    for name, kind in OPPOSITE.items():
        out = F.when((verb == name) & (F.size(kinds) > 0) & F.forall(kinds, lambda k: k == kind), CLASHES).otherwise(out)
    for name, kind in WANTED.items():
        out = F.when((verb == name) & F.array_contains(kinds, kind), AGREES).otherwise(out)
    return out


def leaf_overlap(leaf: Column, message: Column, description: Column, verbs: list[str]) -> Column:
    """Similarity of a leaf with an entry's message without verbs, or with its description, whichever is more; 0 for nothing."""
    words = lambda c: F.array_distinct(T.words(F.coalesce(c, F.lit(""))))
    return F.greatest(T.jaccard(words(leaf), T.without_words(words(message), verbs), 0.0), T.jaccard(words(leaf), words(description), 0.0))


def rescored(score: Column, best: Column, leaf: Column, polarity: Column, elsewhere: Column) -> Column:
    """A fused score against the best one, with what leaf, polarity and surface add."""
    return score / best + LEAF * leaf + polarity + F.when(elsewhere, ELSEWHERE).otherwise(0.0)


def page_on_path(path: Column, node: Column, least: float = 0.5) -> Column:
    """Whether some part of a step's path but ``settings`` is like a part of the node's path; parts without words are passed by."""
    parts = lambda c: F.filter(F.transform(F.split(F.lower(c), r"[>/]"), lambda p: F.array_distinct(T.words(p))), lambda w: F.size(w) > 0)
    own = F.filter(parts(path), lambda w: ~((F.size(w) == 1) & (F.element_at(w, 1) == "settings")))
    return F.exists(own, lambda w: F.exists(parts(node), lambda x: T.jaccard(w, x, 0.0) >= least))


def screen_docs(members: DataFrame, node: str, order: str, *fields: str) -> DataFrame:
    """``node, doc``: the distinct texts of a node's members, in order, as one document."""
    texts = F.array_compact(F.array(*[F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields]))
    rows = members.groupBy(node).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), texts.alias("t")))).alias("r"))
    return rows.select(node, F.array_join(F.array_distinct(F.flatten(F.transform("r", lambda x: x["t"]))), ". ").alias("doc"))


def section_relevance(sections: DataFrame, intents: DataFrame, key: str) -> DataFrame:
    """``key, section, intent, relevance``: cosine of each section with each intent of its request, 0 to 1, two digits.

    ``sections``: key, section, vec; ``intents``: key, intent, ivec.  A request has
    a few of both.
    """
    rel = F.round(F.least(F.greatest(cosine(F.col("vec"), F.col("ivec")), F.lit(0.0)), F.lit(1.0)), 2)
    return sections.join(intents, key).select(key, "section", "intent", F.coalesce(rel, F.lit(0.0)).alias("relevance"))


def tier(score: Column, verb: Column, path: Column, floor: float = 1.6) -> Column:
    """Where a step leads: a catalogue entry, a page of the settings, or nowhere."""
    off_screen = F.coalesce(verb.isin(OFF_SCREEN), F.lit(False))
    return F.when(off_screen, "manual").when(score >= floor, "catalog").when(F.lower(path).rlike("^settings"), "dummy").otherwise("manual")


#: Verbs that no screen serves, and those that change a setting.
OFF_SCREEN = ["restart", "reset", "charge", "contact", "visit", "inspect", "clean"]
CHANGES = ["enable", "disable", "set", "adjust"]


def resolved(score: Column, verb: Column, path: Column, page: Column, on_path: Column, floor: float = 1.6) -> Column:
    """The tier with the fallback to a page: a step that changes a setting, and finds no entry good enough,
    takes the page (``page``: the score of a search for the screen itself) if that lies on its path."""
    own = tier(score, verb, path, floor)
    take = (own != "catalog") & verb.isin(CHANGES) & F.coalesce(page >= floor, F.lit(False)) & F.coalesce(on_path, F.lit(False))
    return F.when(take, "page").otherwise(own)


def confidence(score: Column, most: float = 1.85) -> Column:
    return F.round(F.least(score / most, F.lit(1.0)), 2)


def with_margin(rows: DataFrame, keys: list[str], score: str, tie: str, least: float, lead: float) -> DataFrame:
    """The best row of each group if it reaches ``least`` and is ``lead`` ahead of the second (none: of 0)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return ranked.where((F.col("rank") == 1) & (F.col(score) >= least) & (F.round(F.col(score) - F.col("second"), 6) >= lead)).drop("rank")
