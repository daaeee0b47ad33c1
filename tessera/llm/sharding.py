"""Sharding by histogram sort (operator 5).

Rows are ordered by a 64-bit hash of the text, then by ``doc_id``, then by a number
of the row, so equal texts lie side by side, and are cut into shards of near-equal bytes.  The cuts
are found by rounds of probing: every round counts the exact bytes below
candidate keys in all partitions, keeps for each cut the pair of neighbouring
candidates that encloses its target, and puts new candidates between them.  Keys
of three levels let a cut fall inside a group of equal texts, and of rows that are
equal altogether, so a group that holds a third of all bytes spreads over a third
of the shards.  After the last
round the rows move once, each to its bucket (several to a shard), where they
are numbered.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import materialise

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES, LEAST = 4096, 32  # candidates of a round, and the least between two that enclose a cut
Key = tuple[int, int, int]
LEVELS = ["h", "d", "t"]
START, END = (LOW - 1, HIGH, HIGH), (HIGH, HIGH, HIGH)


def _histogram(keyed: DataFrame, probes: list[Key]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows at or below each probe, added up over all partitions."""
    share = keyed.sparkSession.sparkContext.broadcast(np.array(probes, np.int64).reshape(-1, 3).T)

    def count(batches):
        probes = share.value
        total, rows = np.zeros((2, probes.shape[1] + 1), np.int64)
        for b in batches:
            bucket = _bucket(probes, np.array([b.column(c).to_numpy() for c in LEVELS]))
            np.add.at(total, bucket, b.column("size").to_numpy())
            np.add.at(rows, bucket, 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (used, total[used], rows[used])], ["bucket", "bytes", "n"])

    parts = keyed.select(*LEVELS, "size").mapInArrow(count, "bucket long, bytes long, n long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    total, rows = np.zeros((2, len(probes) + 1), np.int64)
    for r in parts.collect():  # no more rows than probes
        total[r.bucket], rows[r.bucket] = r.bytes, r.n
    return np.cumsum(total)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def _bucket(probes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the number of probes below it; both are three rows of numbers, the probes in order."""
    at = np.searchsorted(probes[0], keys[0], "left")
    tied = np.flatnonzero(np.searchsorted(probes[0], keys[0], "right") > at)
    if len(tied):  # their hash is itself a probe's: order them among the probes by all levels
        both = np.concatenate((keys[:, tied], probes), 1)
        probe = np.arange(both.shape[1]) >= len(tied)
        order = np.lexsort((probe, *both[::-1]))
        below = np.empty(len(order), np.int64)
        below[order] = np.cumsum(probe[order])
        at[tied] = below[: len(tied)]
    return at


def _between(low: Key, high: Key, n: int) -> list[Key]:
    """Up to ``n`` keys after ``low`` and before ``high``, evenly spaced on the first level that leaves room.

    Where ``low`` and ``high`` differ on a level, ``low`` holds all that lies under its number there.
    """
    start = low
    for level in range(3):
        a, b = start[level], high[level]
        if b - a > 1:
            rest = (HIGH,) * (2 - level)
            values = range(a + 1, b) if b - a <= n + 1 else (a + (b - a) * k // (n + 1) for k in range(1, n + 1))
            return [(*high[:level], v, *rest) for v in values]
        if b > a:  # neighbours: what is left lies under the upper one
            start = (*high[: level + 1], *((LOW - 1,) * (2 - level)))
    return []


def splitters(keyed: DataFrame, total: int, cuts: int, tolerance: float = 0.0, rounds: int = 60) -> list[Key]:
    """Keys that cut the bytes into ``cuts`` near-equal parts.

    A cut is final when the bytes below it are within ``tolerance`` (a share of
    a part) of its target, or when no key lies between its two candidates: then
    the nearer one is exact to a row.  More than ``rounds`` are an error.
    """
    targets = [total * k // cuts for k in range(1, cuts)]
    # candidates on either side of each cut: key, bytes and rows up to it
    low = [(START, 0, 0)] * len(targets)
    high = [(END, total, None)] * len(targets)
    done: dict[int, Key] = {}
    asked = _between(START, END, PROBES)
    for _ in range(rounds):
        count, rows = _histogram(keyed, asked)
        for k, target in enumerate(targets):
            if k in done:
                continue
            at = bisect.bisect_right(count, target)  # the first probe beyond the target
            if at and asked[at - 1] > low[k][0]:
                low[k] = (asked[at - 1], count[at - 1], rows[at - 1])
            if at < len(asked) and asked[at] < high[k][0]:
                high[k] = (asked[at], count[at], rows[at])
            near = min(low[k], high[k], key=lambda c: abs(c[1] - target))
            if abs(near[1] - target) <= tolerance * total / cuts or high[k][2] is not None and high[k][2] - low[k][2] <= 1:
                done[k] = near[0]
        probes: set[Key] = set()
        each = max(LEAST, PROBES // max(1, len(targets) - len(done)))
        for k in range(len(targets)):
            if k not in done:
                more = _between(low[k][0], high[k][0], each)
                probes.update(more)
                if not more:
                    done[k] = min(low[k], high[k], key=lambda c: abs(c[1] - targets[k]))[0]
        if not probes:
            break
        asked = sorted(probes)
    else:
        raise RuntimeError(f"no cuts within the tolerance after {rounds} rounds")
    return [done[k] for k in range(len(targets))]


def shard_by_bytes(docs: DataFrame, shards: int = 40, per_shard: int = 8, tolerance: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.  A null
    text has no bytes (size 16) and the checksum of an empty one; a null id
    sorts first; rows that agree in text and id are told apart by a number of
    their own; other columns are left out; an empty table gives an empty result.
    A row that is longer than a shard's share fills a shard by itself.
    ``per_shard`` buckets share a shard's rows, so that no task holds a whole one.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("d"),
            F.xxhash64(F.monotonically_increasing_id()).alias("t"),
        ),
        "shard-keys",
    )
    total = keyed.df.agg(F.sum("size")).first()[0] or 0
    found = sorted(splitters(keyed.df, total, shards * per_shard, tolerance)) if total else []
    share = spark.sparkContext.broadcast(np.array([(LOW, LOW, LOW) if k == START else k for k in found], np.int64).reshape(-1, 3).T)

    def place(batches):
        for b in batches:
            bucket = _bucket(share.value, np.array([b.column(c).to_numpy() for c in LEVELS]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket, pa.int32())], [*b.schema.names, "bucket"])

    placed = keyed.df.mapInArrow(place, "doc_id long, size long, text_crc32 long, h long, d long, t long, bucket int")
    counts = {r.bucket: r.n for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row for each bucket
    before, first = {}, []
    for b in range(shards * per_shard):
        s = b // per_shard
        first.append(before.get(s, 0))
        before[s] = first[-1] + counts.get(b, 0)
    base = spark.createDataFrame([(b, n) for b, n in enumerate(first)], "bucket int, base long")
    order = Window.partitionBy("bucket").orderBy("h", "d", "t")
    numbered = placed.withColumn("place", F.row_number().over(order)).join(F.broadcast(base), "bucket")
    out = numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.expr(f"bucket div {per_shard}").cast("int").alias("shard"),
        (F.col("base") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    answer = materialise(out, "shards")
    keyed.drop()
    return answer.df
