"""Ranked lexical search with a two-level quantised index (operator 12).

The index keeps, document by document, the terms that queries may ask for with
their exact counts (the fine level).  From these, the coarse level holds one byte for
each posting: the term's impact in the document, divided by a fixed step and rounded
up.  Sums of weights times bytes bound a score from above, and with one step less for
each posting from below.  A first pass over the coarse level finds each query's k-th
largest lower bound; a second rescores, exactly and in integers, every document
whose upper bound reaches it.  All others are provably below k documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.storage import Stored, materialise

K = 20
QUERIES = 16_384  # asked in one pass: what a broadcast and the bounds kept in a task are limited to
UNIT = 1_000_000  # impacts are below it
STEP = -(-UNIT // 255)
CELLS = 1 << 20  # scores that are summed at once in a task
PIECE = 1 << 20  # bytes of a text that are taken apart at once
BYTES = 1 << 26  # of the texts of the queries that are asked in one pass

# Bytes of terms are digits, ASCII letters and all of other characters.
_APART = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between terms; a longer term stays whole."""
    at = 0
    while at < len(text):
        gap = _APART.search(text, at + PIECE)
        to = gap.start() if gap else len(text)
        yield text[at:to]
        at = to


def terms(text: bytes) -> Iterator[bytes]:
    """The terms of a text in UTF-8, in order."""
    for piece in pieces(text):
        yield from piece.translate(_FOLD).split()


class Asked(NamedTuple):
    """A block of queries as arrays: term t is asked by ``queries[starts[t]:starts[t + 1]]``, so many ``times`` each."""

    size: int
    starts: np.ndarray
    queries: np.ndarray
    times: np.ndarray


def build(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """The fine level: ``doc_id, n, terms, counts`` of every document, of the terms in ``vocabulary``; ``n`` counts all terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        number = known.value
        for part in slices(batches, "text"):
            n, found, counts = [], [], []
            for text in part.column("text").to_pylist():
                held, size = Counter(), 0
                for piece in pieces(text):
                    words = piece.translate(_FOLD).split()
                    size += len(words)
                    held.update(filter(number.__contains__, words))
                n.append(size)
                found.append([number[t] for t in held])
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return materialise(only.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"), "search-index")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and how many each row has."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Exact impacts of postings: ``counts`` in documents of ``sizes`` terms, in a corpus of so many documents and terms."""
    length = 75 + (25 * sizes * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * length)


def coarse(exact: np.ndarray) -> np.ndarray:
    """The byte of each impact: in steps, rounded up."""
    return (-(-exact // STEP)).astype(np.uint8)


def _posted(batches, asked: Asked, documents: int, total: int):
    """Slices of the index: ids, and for each (document, query) met by a posting: document, query, times, term, exact impact, byte."""
    rows = max(1, CELLS // max(1, asked.size))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            term, many = _flat(part.column("terms"))
            if not len(term):
                continue
            doc = np.repeat(np.arange(part.num_rows), many)
            exact = impacts(_flat(part.column("counts"))[0], part.column("n").to_numpy(zero_copy_only=False)[doc], documents, total)
            # each posting goes to the queries that ask for its term
            width = asked.starts[term + 1] - asked.starts[term]
            posting = np.repeat(np.arange(len(term)), width)
            place = np.arange(len(posting)) - np.repeat(np.cumsum(width) - width, width) + asked.starts[term][posting]
            yield part, doc[posting] * asked.size + asked.queries[place], asked.times[place], term[posting], exact[posting], coarse(exact)[posting].astype(np.int64)


def _sums(cells: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers by cell."""
    out = np.zeros(size, np.int64)
    np.add.at(out, cells, values)
    return out


def _block(docs: DataFrame, items: list[tuple[int, bytes]], k: int, id_col: str, text_col: str) -> DataFrame:
    """``item, doc_id, score, rank`` for a block of items (number, text)."""
    spark = docs.sparkSession
    wanted = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    index = build(docs, vocabulary, id_col, text_col)
    documents, total = index.df.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not vocabulary:
        index.drop()
        return spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    held = {r.t: r.df for r in index.df.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # of the block's terms only
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    by_term = sorted((vocabulary[t], q, n) for q, own in enumerate(wanted) for t, n in own.items())
    term, query, times = (np.array(x, np.int64) for x in zip(*by_term))
    asked = Asked(len(items), np.searchsorted(term, np.arange(len(vocabulary) + 1)), query, times)
    sent = spark.sparkContext.broadcast((asked, weight))

    def bounds(batches):
        asked, weight = sent.value
        best = np.zeros((asked.size, k), np.int64)  # the largest lower bounds
        for part, cells, times, term, _, byte in _posted(batches, asked, documents, total):
            least = _sums(cells, times * weight[term] * np.maximum(byte - 1, 0) * STEP, part.num_rows * asked.size).reshape(-1, asked.size)
            best = np.partition(np.concatenate([best, least.T], axis=1), -k, axis=1)[:, -k:]
        q, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best[q, at])], ["query", "least"])

    found = index.df.where(F.size("terms") > 0)
    lower = found.mapInArrow(bounds, "query long, least long")
    order = Window.partitionBy("query").orderBy(F.desc("least"))
    kth = {r.query: r.least for r in lower.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).groupBy("query").agg(F.min("least").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a number for each query of the block
    limit = spark.sparkContext.broadcast(np.array([kth.get(q, 0) for q in range(len(items))], np.int64))
    ids = np.array([i for i, _ in items], np.int64)

    def rescored(batches):
        asked, weight = sent.value
        reach = np.maximum(limit.value, 1)
        for part, cells, times, term, exact, byte in _posted(batches, asked, documents, total):
            size = part.num_rows * asked.size
            most = _sums(cells, times * weight[term] * byte * STEP, size)
            passed = most >= np.tile(reach, part.num_rows)
            fine = passed[cells]  # postings of the cells that are rescored
            score = _sums(cells[fine], times[fine] * weight[term[fine]] * exact[fine], size)
            hit = np.flatnonzero(score)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit % asked.size]), part.column("doc_id").take(pa.array(hit // asked.size)), pa.array(score[hit])], ["item", "doc_id", "score"])

    scored = found.mapInArrow(rescored, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = materialise(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "search-top")
    index.drop()
    return top.df


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = QUERIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, equal scores by ascending id.

    Null and empty texts hold no terms: such documents are never found and such items
    find nothing.  A repeated document or item is one of its own (ranks are unique in
    an item's row); rows without an id come last among equal scores.  Texts of any
    length are taken whole, in pieces; extra columns are ignored; empty tables
    give an empty result.  Items are asked in blocks of ``most`` (and of ``BYTES``, unless one is
    longer), each with one pass over the texts and two over its index.
    """
    spark = docs.sparkSession
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("text")), "search-items")
    out, after = [], -1
    while ahead := numbered.df.where(F.col("item") > after).select("item", F.length("text").alias("size")).orderBy("item").limit(most).collect():
        until, size = ahead[0].item, ahead[0].size
        for r in ahead[1:]:
            size += r.size
            if size > BYTES:
                break
            until = r.item
        rows = numbered.df.where(F.col("item").between(after + 1, until)).orderBy("item").collect()
        out.append(_block(docs, [(r.item, bytes(r.text)) for r in rows], k, id_col, text_col))
        after = until
    if not out:
        return spark.createDataFrame([], items.select(F.col(item_col).alias("item_id"), F.lit(1).alias("rank"), F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score")).schema)
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found.join(numbered.df.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
