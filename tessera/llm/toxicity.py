"""Toxicity scores from the nearest labelled examples (operator 2).

Fitting, on a bounded sample of labelled training rows (``sample`` rows of each
label, by hash order):

1. features are words and the first three to seven letters of longer words (for
   languages that build words by joining); their counts by label are summed in
   Spark and the most telling ones (chi-squared) become the vocabulary;
2. every example is a TF-IDF vector over the vocabulary, with frequencies counted
   over all documents, and one more term for all other words, which tells a passing
   use in a long text from a dense one; equal vectors are one entry with a count for
   each label;
3. entries go into an inverted index whose lists are cut into blocks that know
   their largest weight;
4. leave-one-out scores of the examples give the calibration: a monotone map
   from votes to the share of toxic documents, weighted to the labels' rates.

Vectors over all words were tried: their neighbours share everyday words, and a few
telling ones hardly count in a long text (figures in the README).

Scoring: the exact ``k`` nearest entries by cosine, found block by block with
the largest weights as bounds, vote with the square of their cosine.
"""

from __future__ import annotations

import math
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices

SAMPLE = 6_000  # training rows of each label
VOCABULARY = 2_048
LEAST_CHI2 = 30.0  # of a term, and one more for each 250 examples
K = 15
BLOCK = 32
PRIOR_WEIGHT = 0.3
EVIDENCE = 3
LOO = 1_500  # examples of each label for the calibration
THRESHOLD = 0.7

WORD = re.compile(r"\w+")


def features(word: str) -> tuple[str, ...]:
    """What a word contributes: itself, and its beginnings if it is longer."""
    return (word, *(word[:n] + "*" for n in range(3, 8) if len(word) > n))


def count_words(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        found[w] = found.get(w, 0) + 1
    return found


class Vectors:
    """TF-IDF vectors over a vocabulary: {term: idf}."""

    KEPT, KEPT_CHARS = 300_000, 40  # words whose terms are remembered, and the longest of them
    REST = -1  # the term of all other words; its count is a power of two

    def __init__(self, terms: list[str], idf: list[float]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.idf = idf
        self._known: dict[str, tuple[int, ...]] = {}

    def terms_of(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= self.KEPT:
                self._known.clear()
            found = tuple(self.number[f] for f in features(word) if f in self.number)
            if len(word) <= self.KEPT_CHARS:
                self._known[word] = found
        return found

    def counts(self, text: str) -> tuple[tuple[int, int], ...]:
        """Terms and how often each occurs, in order; nothing without a term of the vocabulary."""
        total: dict[int, int] = {}
        others = 0
        for word, n in count_words(text).items():
            found = self.terms_of(word)
            others += n if not found else 0
            for t in found:
                total[t] = total.get(t, 0) + n
        if total and others:
            total[self.REST] = 1 << (others.bit_length() - 1)
        return tuple(sorted(total.items()))

    def unit(self, counts) -> dict[int, float]:
        """Weights (1 + ln tf) * idf with a norm of 1."""
        raw = {t: (1 + math.log(n)) * (self.idf[t] if t >= 0 else 1.0) for t, n in counts}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}


class BlockMaxIndex:
    """Exact top-k by cosine over a bounded set of entries.

    Every list knows the largest weight of each block of entries that it
    touches.  A query adds these up to a bound for each block, scores the blocks
    with the largest bounds, and then only those whose bound reaches the k-th
    cosine found.
    """

    FIRST = 8  # blocks that are scored before the k-th cosine is known

    def __init__(self, units: list[dict[int, float]]):
        by_term: dict[int, list[tuple[int, float]]] = {}
        for e, unit in enumerate(units):
            for t, v in unit.items():
                by_term.setdefault(t, []).append((e, v))
        self.lists: dict[int, tuple] = {}
        for t, posts in by_term.items():
            e = np.array([p[0] for p in posts], np.int64)  # ascending
            v = np.array([p[1] for p in posts])
            edges = np.flatnonzero(np.diff(e // BLOCK, prepend=-1))
            self.lists[t] = (e[edges] // BLOCK, np.maximum.reduceat(v, edges), np.append(edges, len(e)), e, v)
        self.blocks = -(-len(units) // BLOCK)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The ``k`` entries with the largest cosine, all above 0, ties by entry."""
        asked = [(v, self.lists[t]) for t, v in query.items() if t in self.lists]
        if not asked:
            return []
        block = np.concatenate([x[0] for _, x in asked])
        bound = np.bincount(block, np.concatenate([v * x[1] for v, x in asked]), self.blocks)

        def scored(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            entries, weights = [], []
            for v, (blocks, _, edges, e, w) in asked:
                at = np.flatnonzero(chosen[blocks])
                if not len(at):
                    continue
                # postings of the chosen blocks alone
                first, size = edges[at], edges[at + 1] - edges[at]
                read = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
                entries.append(e[read])
                weights.append(v * w[read])
            if not entries:
                return np.zeros(0, np.int64), np.zeros(0)
            e = np.concatenate(entries)
            found, which = np.unique(e, return_inverse=True)
            return found, np.round(np.bincount(which, np.concatenate(weights)), 9)

        chosen = np.zeros(self.blocks, bool)
        first = min(self.FIRST, self.blocks)
        chosen[np.argpartition(-bound, first - 1)[:first]] = True
        found, cosine = scored(chosen)
        kth = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
        rest = (bound >= kth - 1e-8) & (bound > 0) & ~chosen
        if rest.any():
            more, there = scored(rest)
            found, cosine = np.append(found, more), np.append(cosine, there)
        order = np.lexsort((found, -cosine))[:k]
        return list(zip(cosine[order].tolist(), found[order].tolist()))


class Model:
    """A fitted scorer: bounded in size, sent to the workers as a broadcast."""

    def __init__(self, terms, idf, entries, toxic, clean, rate, empty_rate):
        self.vectors = Vectors(terms, idf)
        self.toxic, self.clean = toxic, clean  # weighted examples of each entry
        self.rate = rate  # of toxic rows among the labelled
        self.empty_rate = empty_rate  # the same among texts without any term
        self.index = BlockMaxIndex([self.vectors.unit(e) for e in entries])
        self.entries = entries
        self.steps: tuple[list[float], list[float]] = ([], [])
        self._known: dict[bytes, tuple[float, list]] = {}

    def vote(self, counts, own: tuple[int, float, float] | None = None) -> tuple[float, list]:
        """The neighbours' vote and the nearest of them; ``own`` (entry, toxic, clean) is taken off."""
        near = self.index.nearest(self.vectors.unit(counts), K)
        yes = self.rate * PRIOR_WEIGHT
        weight = PRIOR_WEIGHT
        for cosine, e in near:
            t, c = self.toxic[e], self.clean[e]
            if own is not None and own[0] == e:
                t, c = max(0.0, t - own[1]), max(0.0, c - own[2])
            if t + c > 0:
                w = cosine * cosine * (1 + math.log1p(t + c))
                yes += w * t / (t + c)
                weight += w
        return yes / weight, near

    def calibrated(self, vote: float) -> float:
        """The share of toxic texts among examples with such a vote, between steps by line."""
        x, y = self.steps
        return float(np.interp(vote, x, y)) if x else vote

    def score(self, text: str) -> tuple[float, list]:
        counts = self.vectors.counts(text)
        if not counts:
            return self.empty_rate, []
        key = array("q", chain.from_iterable(counts)).tobytes() if len(counts) <= 64 else None  # longer vectors hardly recur
        found = self._known.get(key)
        if found is None:
            if len(self._known) > 100_000:
                self._known.clear()
            vote, near = self.vote(counts)
            found = (min(1.0, max(0.0, self.calibrated(vote))), near[:EVIDENCE])
            if key is not None:
                self._known[key] = found
        return found


def monotone(votes: list[float], labels: list[int], weights: list[float]) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators, with a little weight of 1/2 on each step's sides."""
    pools: list[list[float]] = []  # sum of w*y, sum of w, sum of w*x
    for x, y, w in sorted(zip(votes, labels, weights)):
        pools.append([w * y, w, w * x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [p[2] / p[1] for p in pools], [p[0] / p[1] for p in pools]


def training_fold(id_col: str = "doc_id"):
    """Rows that labels may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


def frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[int, list[int]]:
    """How many documents there are, and how many hold each term."""
    share = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        maker = Vectors(share.value, [1.0] * len(share.value))
        total = np.zeros(len(share.value) + 1, np.int64)
        for part in slices(batches, "text", 1 << 22):
            total[-1] += part.num_rows
            for text in part.column("text").to_pylist():
                for t, _ in maker.counts(text):
                    if t >= 0:
                        total[t] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in counted}
    return n.get(len(terms), 0), [n.get(k, 0) for k in range(len(terms))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` labelled training rows of each label.

    Rows with a null id, label or text are not learned from; several labels of
    one id count as toxic if one of them does, and of several rows of one id one
    counts.  Ties are broken by id.  Texts of any length count as a whole.  Without
    any usable row, as of empty tables, the model gives 0.5 to every text.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training_fold(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    # at most 2 * sample rows of 12 bytes
    rows = chosen.collect()
    if not rows:
        return Model([], [], [], [], [], 0.5, 0.5)
    picked = F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in rows], "doc_id long, y int"))
    examples = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null").join(picked, "doc_id").select("doc_id", "y", "text")

    def count(batches):
        for part in slices(batches, "text", 1 << 22):
            n: dict[str, list[int]] = {}
            for y, text in zip(part.column("y").to_pylist(), part.column("text").to_pylist()):
                for f in {f for w in count_words(text) for f in features(w)}:
                    n.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], ["term", "clean", "toxic"])

    shown = examples.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()
    n = {0: 0, 1: 0} | {r.y: r.n for r in shown}
    all_n = max(1, n[0] + n[1])
    # chi-squared of a 2 x 2 table, for each term
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(float(n[1])) - a, F.lit(float(n[0])) - b
    chi2 = F.lit(float(all_n)) * F.pow(a * d - b * c, F.lit(2)) / F.greatest((a + b) * (c + d) * F.lit(float(max(1, n[0]))) * F.lit(float(max(1, n[1]))), F.lit(1e-9))
    terms = (
        examples.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("clean + toxic >= 3").withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2 + all_n / 250).orderBy(F.desc("chi2"), "term").limit(VOCABULARY).collect()
    )
    names = [t.term for t in terms]
    n_docs, df = frequencies(docs, names, text_col)
    idf = [math.log((1 + n_docs) / (1 + n)) + 1 for n in df]
    share = spark.sparkContext.broadcast((names, idf))

    def vectors(batches):
        maker = Vectors(*share.value)
        for part in slices(batches, "text"):
            found = [maker.counts(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[k for _, k in f] for f in found], pa.list_(pa.int32()))], ["doc_id", "y", "terms", "counts"])

    # at most 2 * sample vectors over the bounded vocabulary
    found = examples.mapInArrow(vectors, "doc_id long, y int, terms array<int>, counts array<int>").dropDuplicates(["doc_id"]).collect()
    seen = sum(totals.values()) or 1
    rate = totals.get(1, 0) / seen
    # an example stands for so many labelled rows of its label
    weight = {y: totals.get(y, 0) / max(1, n[y]) / (seen / all_n) for y in (0, 1)}
    groups: dict[tuple, list[float]] = {}
    for r in sorted(found):
        groups.setdefault(tuple(zip(r.terms, r.counts)), [0.0, 0.0])[r.y] += weight[r.y]
    clean, toxic = groups.pop((), [0.0, 0.0])
    entries = list(groups)
    model = Model(names, idf, entries, [groups[e][1] for e in entries], [groups[e][0] for e in entries], rate, (toxic + rate * PRIOR_WEIGHT) / (toxic + clean + PRIOR_WEIGHT))
    number = {e: k for k, e in enumerate(entries)}
    votes, ys, ws, left = [], [], [], {0: LOO, 1: LOO}
    for r in sorted(found):
        counts = tuple(zip(r.terms, r.counts))
        if counts and left[r.y]:
            left[r.y] -= 1
            w = weight[r.y]
            votes.append(model.vote(counts, (number[counts], w * r.y, w * (1 - r.y)))[0])
            ys.append(r.y)
            ws.append(w)
    if len(set(ys)) == 2:
        model.steps = monotone(votes, ys, ws)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, neighbours`` of every row.

    ``neighbours`` are the nearest entries as ``cosine, toxic, clean`` (how much
    of each label they stand for).  A text without any term of the vocabulary, an
    empty or a null one, gets the rate of toxic rows among such examples.
    Repeated rows are scored alike; null ids are passed on; other columns are left
    out; an empty table gives an empty result; neighbours of one cosine are taken in
    the order of the entries.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("cosine", pa.float64()), ("toxic", pa.float64()), ("clean", pa.float64())]))

    def run(batches):
        m = share.value
        for part in slices(batches, "text"):
            found = [m.score(t) for t in part.column("text").to_pylist()]
            rows = [s for s, _ in found]
            seen = [[{"cosine": c, "toxic": m.toxic[e], "clean": m.clean[e]} for c, e in n] for _, n in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.float64()), pa.array([int(s >= threshold) for s in rows], pa.int32()), pa.array(seen, near)], ["doc_id", "score", "predicted", "neighbours"])

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return only.mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<struct<cosine:double,toxic:double,clean:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    names, kind = docs.columns, docs.schema

    def run(batches):
        m = share.value
        at = names.index(text_col)
        for batch in batches:
            renamed = batch.rename_columns([f"c{k}" for k in range(len(names))])
            for part in slices([renamed], f"c{at}"):
                good = [m.score(t or "")[0] < threshold for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, kind)
