"""Benchmark decontamination by SimHash of item-sized windows (operator 6).

Every window of a text that has as many words as a benchmark item is a
candidate; a text shorter than an item is one window as a whole.  Windows in which
fewer shingles occur anywhere in the benchmark than the final similarity needs of
one item can match none of them and are skipped, which loses nothing.  The others
get a 64-bit SimHash of their weighted shingles, and that finds their items: eight
blocks of eight bits index the items' fingerprints, and as fingerprints within
``RADIUS`` = 23 bits differ in at most two bits in one block at least, looking up
all block values within two bits finds every item within the radius.  Candidates
are then verified exactly: weighted Jaccard similarity of the shingle bags,
0.75 or more.  What the radius itself may lose is measured in the tests and the
README.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.shingles import K, shingles_of, words

RADIUS = 23
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
SIEVE_BITS = 22
ITEMS_AT_ONCE = 4096  # items of one pass over the documents


def simhash(bits: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bit sums: bit k is set where the k-th sum is positive."""
    return np.packbits(bits > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def bit_weights(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


class Items:
    """Benchmark items of a block: an index of their fingerprints, and their shingles for verification."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.bags, sizes, prints, shingles = [], [], [], [], [np.zeros(0, np.uint64)]
        w, bounds = words(pa.array(texts, pa.string()))
        self.short: dict[int, dict[int, list[int]]] = {}  # of items under K words: by words, by hash
        for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            s = shingles_of(w[a:b], K)
            if b - a < K:
                self.short.setdefault(b - a, {}).setdefault(int(s[0]), []).append(i)
                continue
            self.ids.append(i)
            sizes.append(len(s))
            self.bags.append(dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))))
            prints.append(simhash(bit_weights(s).sum(0)[None])[0])
            shingles.append(s)
        self.sizes, self.prints = np.array(sizes, np.int64), np.array(prints, np.uint64)
        self.windows = np.unique(self.sizes)
        self.keys = np.unique(np.concatenate(shingles))  # of any item
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.keys >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        #: which items a block's value leads to
        near = [0] + [sum(1 << b for b in c) for r in range(1, BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)]
        self.index = np.zeros((BLOCKS, 1 << BLOCK_BITS, len(self.ids)), bool)
        blocks = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        for k in range(BLOCKS):
            for flip in near:
                self.index[k, blocks[:, k] ^ flip, np.arange(len(blocks))] = True

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        may = np.flatnonzero(self.sieve[(s >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, s[may]), len(self.keys) - 1)
        return may[self.keys[at] == s[may]]

    def match(self, s: np.ndarray, q: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Matches of one text: item id, similarity, first word of the best window, matching windows.

        ``s``: all shingles of the text; ``q``: the positions of its hits.
        """
        found: dict[int, list] = {}  # of each item: similarity and start of the best window, and how many match
        n = len(s)
        for size in self.windows[self.windows <= n].tolist():
            need = -(-6 * size // 7)  # common / (2 * size - common) >= 0.75
            if len(q) < need:
                break  # longer windows need more
            starts = self._windows(q, size, need, n)
            for part in np.split(starts, np.arange(1024, len(starts), 1024)):
                if len(part):
                    self._look_up(s, part, size, self.sizes == size, found)
        longer = self.sizes > n  # the whole text is one window for these
        if longer.any() and len(q) >= -(-3 * (n + int(self.sizes[longer].min())) // 7):
            self._look_up(s, np.zeros(1, np.int64), n, longer, found)
        return [(self.ids[i], *best) for i, best in found.items()]

    @staticmethod
    def _windows(q: np.ndarray, size: int, need: int, n: int) -> np.ndarray:
        """Starts of the windows of ``size`` shingles with ``need`` hits or more."""
        opens = q[: len(q) - need + 1]  # a hit and the need-th from it within a window
        ends = q[need - 1 :]
        fit = ends - opens < size
        spans = [np.arange(max(0, e - size + 1), min(o, n - size) + 1) for o, e in zip(opens[fit].tolist(), ends[fit].tolist())]
        return np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)

    def near(self, prints: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint and an item ``among`` all within RADIUS, by way of the blocks."""
        led = np.zeros((len(prints), len(self.ids)), bool)
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        for k in range(BLOCKS):
            led |= self.index[k, blocks[:, k]]
        row, item = np.nonzero(led & among)
        close = np.bitwise_count(prints[row] ^ self.prints[item]) <= RADIUS
        return row[close], item[close]

    def _look_up(self, s: np.ndarray, starts: np.ndarray, size: int, among: np.ndarray, found: dict[int, list]) -> None:
        """Finds the items of the windows of ``size`` shingles at ``starts`` and verifies them, into ``found``."""
        low, high = int(starts[0]), int(starts[-1]) + size
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(bit_weights(np.ascontiguousarray(s[low:high])), axis=0, out=sums[1:])
        rows, items = self.near(simhash(sums[starts - low + size] - sums[starts - low]), among)
        bag, of = {}, -1
        for row, item in zip(rows.tolist(), items.tolist()):
            if row != of:
                bag, of = {}, row
                for h in s[starts[row] : starts[row] + size].tolist():
                    bag[h] = bag.get(h, 0) + 1
            own = self.bags[item]
            common = sum(min(n, own.get(h, 0)) for h, n in bag.items())
            both = size + int(self.sizes[item]) - common
            if 100 * common >= 75 * both:
                best = found.setdefault(item, [0.0, 0, 0])
                best[2] += 1
                if common / both > best[0]:
                    best[:2] = common / both, int(starts[row])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_windows``: one row for each text and item that it holds.

    ``similarity`` is that of the best window, ``first_word`` its place in the
    text.  Texts that hold nothing have no row.  Items of fewer than five words
    are one shingle and match the same words in a row.  Null and empty texts and
    items match nothing; null ids are passed on; repeated rows match each for
    themselves; repeated items count once for each id; other columns are left out;
    an empty table of either kind gives an empty result; texts of any length are
    read in pieces.  The benchmark is read in blocks of 4096 items, each of which
    is one pass over the texts.
    """
    spark = docs.sparkSession
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    kind = "doc_id long, item_id long, similarity double, first_word long, n_windows long"

    def one_pass(block: list) -> DataFrame:
        share = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))

        def run(batches):
            with np.errstate(over="ignore"):
                items = Items(*share.value)
                for part in slices(batches, "text"):
                    rows = _match_slice(items, part)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "first_word", "n_windows"])

        return only.mapInArrow(run, kind)

    out, block = None, []
    for row in asked.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS_AT_ONCE:
            out, block = one_pass(block) if out is None else out.unionAll(one_pass(block)), []
    if block or out is None:
        out = one_pass(block) if out is None else out.unionAll(one_pass(block))
    return out


def _match_slice(items: Items, part: pa.RecordBatch) -> list[tuple]:
    """Matches of a slice of texts."""
    w, bounds = words(part.column("text"))
    ids = part.column("doc_id").to_pylist()
    rows = []
    if len(w) >= K:
        s = shingles_of(w, K)
        places = items.hits(s)
        # shingles that reach over a text's end belong to no text
        doc = np.searchsorted(bounds, places, "right") - 1
        inside = places + K <= bounds[doc + 1]
        places, doc = places[inside], doc[inside]
        for d in np.unique(doc).tolist():
            own = doc == d
            a, b = int(bounds[d]), int(bounds[d + 1])
            for item, alike, start, n in items.match(s[a : b - K + 1], places[own] - a):
                rows.append((ids[d], item, alike, start, n))
    for n, known in items.short.items():
        for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            found: dict[int, list[int]] = {}
            for start in range(a, b - n + 1):
                for item in known.get(int(shingles_of(w[start : start + n], K)[0]), ()):
                    found.setdefault(item, []).append(start - a)
            rows += [(ids[d], item, 1.0, at[0], len(at)) for item, at in found.items()]
    return rows
