"""Taking rows out of a table of long texts without moving the texts that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import materialise

BITS = 1 << 23


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` (long) is not among ``gone`` (column ``key``); null keys stay.

    A bit filter of fixed size, broadcast as a table of words, clears the rows
    that can't be meant; only the others, the ones that go and a few more, take
    part in the exact anti-join.  If ``gone`` fills the filter, all rows take part.
    Columns of any name pass through; nulls and repeats in ``gone`` don't matter, and
    an empty one removes nothing.
    """
    gone = materialise(gone.select(F.col("key").cast("long").alias("key")).where("key IS NOT NULL").distinct(), "gone").df
    if gone.isEmpty():
        return docs
    names = docs.columns
    k, w, b, g = (_unused(x, names) for x in ("key", "word", "bits", "gone"))
    word = lambda x: (F.pmod(x, F.lit(BITS)) / 64).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    words = gone.groupBy(word(F.col("key")).alias(w)).agg(F.bit_or(bit(F.col("key"))).alias(b))  # BITS / 64 rows at most
    marked = docs.withColumn(k, key.cast("long")).withColumn(w, word(F.col(k))).join(F.broadcast(words), w, "left")
    may = F.coalesce(F.col(b).bitwiseAND(bit(F.col(k))) != 0, F.lit(False))
    clear = marked.where(~may).select(*names)
    rest = marked.where(may).join(gone.withColumnRenamed("key", g), F.col(k) == F.col(g), "left_anti").select(*names)
    return clear.unionAll(rest)


def _unused(name: str, names: list[str]) -> str:
    """A column name like ``name`` that none of ``names`` clashes with."""
    taken = {n.lower() for n in names}
    while name in taken:
        name = f"{name}_"
    return name
