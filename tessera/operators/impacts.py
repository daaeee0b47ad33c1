"""Ranking that prunes: an impact-ordered posting table in blocks, and top-k in two phases.

Each posting carries its *impact*, the part of BM25 that doesn't depend on the
query, and lies in the block of its term and impact level; a small table holds
every block's number of postings and largest impact.  A query's first phase scores
the documents of its most promising blocks, which gives a score that k documents
are known to reach.  The second leaves out blocks, from the weakest terms on, for
as long as everything left out together stays below that score: a document that
occurs in none of the other blocks can't be among the best.  What is met in these is
bounded from above, and only what can still pass is scored in full.  The table lies
in buckets of documents, blocks in order inside each, so that pairs of queries and
documents are made, bounded and scored where the postings are; what is shuffled is
each task's best ``k`` of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.retrieval import B, K1, top
from tessera.sources.files import bucketed, stored

LEVELS = 64  # impact levels; a block is a term's postings of one level
FIRST = 8  # postings for each of the k results that the first phase looks at
SLACK = 1e-6  # scores are compared as rounded to six digits
BONUS = 1.5  # fixed value: what a wanted kind adds to a score


@dataclass
class ImpactIndex:
    """``rows`` (term, level, key, impact, size) in buckets of keys, there by term and impact, ``blocks`` (term, level, n, most), and the number of documents.

    ``size`` is the number of a document's different terms.
    """

    rows: DataFrame
    blocks: DataFrame
    documents: int

    def terms(self) -> DataFrame:
        """``term, df``."""
        return self.blocks.groupBy("term").agg(F.sum("n").alias("df"))


def impact_index(docs: DataFrame, key: str, fields: dict[str, float], terms: DataFrame | None = None, stop: list[str] = T.RANK_STOP) -> ImpactIndex:
    """The index of ``docs``; a field of weight 2 counts its terms twice; ``key`` is unique and not null.

    Lengths come from the row itself and go with its postings.  With ``terms`` only
    their postings are kept (statistics still cover all).  A term that most documents
    hold is spread over all buckets.
    """
    by_weight = {w: F.concat(*[T.without_words(T.words(F.coalesce(F.col(c), F.lit(""))), stop) for c, v in fields.items() if v == w]) for w in sorted(set(fields.values()))}
    split = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[x.alias(f"words{i}") for i, x in enumerate(by_weight.values())])
    words = {w: F.col(f"words{i}") for i, w in enumerate(by_weight)}
    all_words = F.concat(*words.values())
    length = sum((F.size(x) * F.lit(w) for w, x in words.items()), F.lit(0))
    weighed = lambda w: lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("weight"))
    held = F.concat(*[F.transform(x, weighed(w)) for w, x in words.items()])
    # sizes first: what stands beside a generator is evaluated for each of its rows
    sized = split.select("key", length.cast("double").alias("len"), F.size(F.array_distinct(all_words)).alias("size"), held.alias("held"))
    given = sized.select("key", "len", "size", F.posexplode("held").alias("at", "p"))
    if terms is None:
        asked = given.withColumn("asked", F.lit(True))
    else:  # what nobody asks for goes before it is counted, but for the head of each document
        flags = terms.select(F.col("term").alias("_term")).distinct().withColumn("asked", F.lit(True))
        asked = given.join(flags, F.col("p.term") == F.col("_term"), "left").where("asked OR at = 0")
    counted = asked.groupBy("key", "len", "size", F.col("p.term").alias("term")).agg(F.sum("p.weight").alias("tf"), F.max(F.col("at") == 0).alias("head"), F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))
    postings = stored(counted, "postings")
    # the head of each document counts it once
    documents, total = postings.where("head").agg(F.count("*"), F.sum("len")).first()
    mean = F.lit((total or 1.0) / max(1, documents))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    level = (LEVELS - F.floor(impact / (K1 + 1) * LEVELS)).cast("int")  # the largest impacts first
    rows = bucketed(postings.where("asked").select("term", level.alias("level"), "key", impact.alias("impact"), "size"), "impacts", "key", "term", "level")
    blocks = stored(rows.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("most")), "blocks")
    return ImpactIndex(rows, blocks, documents)


def _first(blocks: DataFrame, qkey: str, order: list[Column], k: int) -> DataFrame:
    """The blocks of each query, in an order, until they hold ``FIRST * k`` postings."""
    seen = Window.partitionBy(qkey).orderBy(*order)
    before = F.sum("n").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIRST * k)


def _reached(scored: DataFrame, qkey: str, k: int) -> DataFrame:
    """``qkey, reach``: the k-th best score of each query that has as many."""
    best = top(scored, [qkey], [F.desc("score"), F.col("key")], k)
    return best.groupBy(qkey).agg(F.min("score").alias("reach"), F.count("*").alias("many")).where(F.col("many") >= k).drop("many")


@dataclass
class Pruned:
    """A ranking and what it took: ``candidates`` (query, key) were scored in full, ``met`` postings were looked at beside the first phase's."""

    best: DataFrame
    candidates: DataFrame
    met: DataFrame


def bm25_pruned(index: ImpactIndex, queries: DataFrame, qkey: str, k: int = 20, kinds: DataFrame | None = None, wanted: DataFrame | None = None) -> Pruned:
    """``qkey, key, score, rank``: the ``k`` best documents of each query by BM25, ties by key.

    ``queries`` has ``qkey, term, qn`` (a query's repeats of a term add up).  ``kinds``
    (key, kind: one for each document) with ``wanted`` (qkey, kind) adds ``BONUS`` to
    documents of a wanted kind that hold a term of the query.  Terms that no
    document holds are passed by.
    """
    n, c = F.lit(index.documents), F.col("df")
    # of a query set and the terms' blocks: small beside the postings
    q = stored(queries.join(index.terms(), "term").select(qkey, "term", (F.col("qn") * F.log(1 + (n - c + 0.5) / (c + 0.5))).alias("w")), "weights")
    blocks = stored(q.join(index.blocks, "term").select(qkey, "term", "level", "n", "w", (F.col("w") * F.col("most")).alias("bound")), "bounds")
    extra = BONUS if wanted is not None else 0.0

    def exact(pairs: DataFrame) -> DataFrame:
        scores = pairs.join(index.rows, "key").join(q, [qkey, "term"]).groupBy(qkey, "key").agg(F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
        if wanted is not None:
            liked = wanted.select(qkey, "kind").distinct().withColumn("liked", F.lit(BONUS))
            scores = scores.join(kinds.select("key", "kind"), "key", "left").join(liked, [qkey, "kind"], "left").withColumn("score", F.col("score") + F.coalesce("liked", F.lit(0.0)))
        return scores.select(qkey, "key", F.round("score", 6).alias("score"))

    first = stored(_first(blocks, qkey, [F.desc("bound"), F.col("term"), F.col("level")], k).select(qkey, "term", "level"), "first")
    seeds = index.rows.join(first, ["term", "level"]).select(qkey, "key").distinct()
    reach = stored(_reached(exact(seeds), qkey, k), "reach")
    # terms from the weakest on: all of them whose bounds together stay below the score to reach are left out,
    # and of the next one the blocks that still do
    weakest = Window.partitionBy(qkey).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, -1)
    by_term = blocks.groupBy(qkey, "term").agg(F.max("bound").alias("bound")).withColumn("below", F.coalesce(F.sum("bound").over(weakest), F.lit(0.0))).drop("bound")
    ranked = blocks.join(by_term, [qkey, "term"]).join(reach, qkey, "left").withColumn("out", F.col("below") + F.col("bound") + extra < F.coalesce("reach", F.lit(0.0)) - SLACK)
    rest = ranked.where("out").groupBy(qkey, "term").agg(F.max("bound").alias("bound")).groupBy(qkey).agg(F.sum("bound").alias("rest"))
    need = stored(reach.join(rest, qkey, "left").select(qkey, (F.col("reach") - SLACK - extra - F.coalesce("rest", F.lit(0.0))).alias("need")), "need")
    chosen = stored(ranked.where("NOT out").select(qkey, "term", "level", "w"), "chosen")
    met = index.rows.join(chosen, ["term", "level"])
    able = met.groupBy(qkey, "key").agg(F.sum(F.col("w") * F.col("impact")).alias("part")).join(need, qkey, "left").where("need IS NULL OR part >= need")
    candidates = able.select(qkey, "key")
    return Pruned(top(exact(candidates), [qkey], [F.desc("score"), F.col("key")], k), candidates, met)


def overlap_pruned(index: ImpactIndex, queries: DataFrame, qkey: str, k: int = 20, sizes: DataFrame | None = None) -> Pruned:
    """``qkey, key, score, rank``: the documents whose sets of terms are most like each query's (Jaccard), ties by key.

    A document that reaches a similarity s shares at least ``s`` of the query's terms:
    it holds one of the rarest that are left when so many are taken away, and has
    between ``s`` and ``1 / s`` times as many terms as the query.  ``sizes`` (qkey, qn)
    counts each query's different terms where it has some that no document holds.
    """
    own = queries.select(qkey, "term").distinct()
    counts = sizes if sizes is not None else own.groupBy(qkey).agg(F.count("*").alias("qn"))
    q = stored(own.join(index.terms().withColumnRenamed("df", "n"), "term").join(counts, qkey).select(qkey, "term", "n", "qn"), "weights")

    def exact(pairs: DataFrame) -> DataFrame:
        common = pairs.join(index.rows, "key").join(q, [qkey, "term"]).groupBy(qkey, "key").agg(F.count("*").alias("c"), F.max("size").alias("size"), F.max("qn").alias("qn"))
        return common.select(qkey, "key", F.round(F.col("c") / (F.col("size") + F.col("qn") - F.col("c")), 6).alias("score"))

    rarest = [F.col("n"), F.col("term")]
    first = stored(_first(q, qkey, rarest, k).select(qkey, "term"), "first")
    reach = _reached(exact(index.rows.join(first, "term").select(qkey, "key").distinct()), qkey, k)
    least = F.greatest(F.coalesce("reach", F.lit(0.0)) - SLACK, F.lit(0.0))
    ranked = q.join(reach, qkey, "left").withColumn("least", least).withColumn("at", F.row_number().over(Window.partitionBy(qkey).orderBy(*rarest)))
    # of the query's terms that documents hold, so many may be missing
    held = F.count("*").over(Window.partitionBy(qkey))
    chosen = ranked.withColumn("held", held).where(F.col("at") <= F.col("held") - F.greatest(F.ceil(F.col("least") * F.col("qn")), F.lit(1)) + 1)
    chosen = stored(chosen.select(qkey, "term", "qn", "least"), "chosen")
    fits = (F.col("size") >= F.col("least") * F.col("qn")) & (F.col("size") * F.col("least") <= F.col("qn"))
    met = index.rows.join(chosen, "term").where(fits)
    candidates = met.select(qkey, "key").distinct()
    return Pruned(top(exact(candidates), [qkey], [F.desc("score"), F.col("key")], k), candidates, met)
