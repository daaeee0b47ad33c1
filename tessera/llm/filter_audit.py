"""Interaction of corpus filters over all their orders (operator 13).

A document's failed filters are a bit mask, so a corpus of any size comes down to
a histogram of ``2 ** n`` masks for each part, of all documents and of those with
each label.  What a filter at a step of an order keeps, removes, finds already
removed or alone removes is a fixed function of the mask: an incidence matrix of
masks by (order, step) cells.  The stacked histograms times these integer matrices
are all outcomes of all orders at once; no order is ever run over the documents.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialise

COPY = "E"  # the filter that fails copies of a smaller id's text
MOST_FILTERS = 6  # 720 orders of six steps: a part's result stays small
OUTCOMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions on which a text (not null) fails: A few words, B few distinct ones, C many capitals, D a special character."""
    words = F.filter(F.split(text, r"[ \x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def incidence(n: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, np.ndarray]]:
    """The (order, step) cells of ``n`` filters and the matrices, masks by cells, of kept, removed, redundant and unique."""
    orders = list(permutations(range(n)))
    cells = [(order, step) for order in orders for step in range(n)]
    masks = np.arange(1 << n)[:, None]
    own = np.array([1 << order[step] for order, step in cells])
    before = np.array([sum(1 << f for f in order[:step]) for order, step in cells])
    reached, fails = (masks & before) == 0, (masks & own) != 0
    found = {"kept": reached & ~fails, "removed": reached & fails, "redundant": ~reached & fails, "unique": masks == own}
    return cells, {k: v.astype(np.int64) for k, v in found.items()}


def masks_of(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], text: Column, part: Column, id_col: str = "doc_id") -> DataFrame:
    """``part, mask, good, toxic`` of every document, the copy filter last.

    The first of equal texts is found by a grouped minimum and met again by an
    equi-join on (digest, id): a text with very many copies spreads over its ids.
    """
    seen = F.coalesce(text, F.lit(""))
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits + F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))
    slim = materialise(docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(seen.cast("binary"), 256)).alias("digest")), "audit-masks")
    first = slim.df.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL")
    known = known.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # rows without an id are never copies and have no labels; they keep away from both joins
    with_id = slim.df.where("id IS NOT NULL").join(known, "id", "left").join(first, ["digest", "id"], "left")
    copied = F.when(F.col("first").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    marked = with_id.select("part", (F.col("bits") + copied).alias("mask"), yes("good"), yes("toxic"))
    return marked.unionAll(slim.df.where("id IS NULL").select("part", F.col("bits").alias("mask"), F.lit(0).cast("long"), F.lit(0).cast("long")))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """``part, filter_order, step`` and the counts of :data:`OUTCOMES` for each part, order and step.

    ``filters`` maps one-letter names to conditions on which a document fails (null:
    it passes; default: :func:`text_filters`); the copy filter ``E`` comes as the last.
    Null texts count as empty, null parts as the empty string.  Rows without an id are
    documents of their own, never copies, without labels; a repeated row of the least
    id is no copy of itself.  Of repeated labels one that is 1 is enough; documents
    without a label are neither good nor toxic.  Texts are taken whole; extra columns
    are ignored; an empty table gives an empty result.

    One pass over the texts writes a mask and a digest for each document; histograms
    combine before their shuffle, so a part with most of the rows costs no more
    than any other, and a part's product is ``2 ** n`` numbers by the matrices.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    filters = text_filters(text) if filters is None else filters
    names = [*filters, COPY]
    if len(names) > MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"at most {MOST_FILTERS} filters with different names, {COPY} for copies")
    bins = masks_of(docs, labels, filters, text, F.col(part_col).cast("string"), id_col).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    rows = bins.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))

    def outcomes(batches):
        cells, m = incidence(len(names))
        orders = ["".join(names[f] for f in order) for order, _ in cells]
        steps = [step + 1 for _, step in cells]
        own = np.array([order[step] for order, step in cells])
        same = (own[:, None] == own[None, :]).astype(np.int64)  # cells of one filter
        shapley = m["removed"] @ same
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("bins").to_pylist()):
                stack = np.zeros((3, 1 << len(names)), np.int64)  # rows: all, good, toxic
                for b in found:
                    stack[:, b["mask"]] = b["n"], b["good"], b["toxic"]
                removed = stack @ m["removed"]
                counts = [stack[0] @ m["kept"], removed[0], stack[0] @ m["redundant"], stack[0] @ m["unique"], removed[1], removed[2], stack[0] @ shapley]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cells)), pa.array(orders), pa.array(steps, pa.int32()), *map(pa.array, counts)], ["part", "filter_order", "step", *OUTCOMES])

    return rows.mapInArrow(outcomes, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUTCOMES))
