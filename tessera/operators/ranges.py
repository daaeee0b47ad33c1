"""Running sums and numbers over a whole table, range by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import stored

RANGES = 200


def range_of(rows: DataFrame, column: str, n: int = RANGES) -> Column:
    """Which of about ``n`` ranges a value of ``column`` lies in, of about as many distinct values each.

    The cuts are ``n`` of the values, chosen by hash, so they part the others evenly
    and the same table gives the same ranges.  Nulls are in range 0.
    """
    some = rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(n)
    cuts = sorted(r[0] for r in some.collect())
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(column))), F.lit(0))


def running(rows: DataFrame, column: str, value: Column, name: str) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over all rows up to this one by ``column``, which must be unique.

    Each range is summed on its own; what lies before it comes from a table of one
    row for each range.  The rows are stored first: the order is compared with every
    cut, and an expression in its place would be evaluated as often.
    """
    rows = stored(rows.withColumn("own_value", value), "in-order")
    parted = rows.withColumn("range_no", range_of(rows, column))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES + 1 rows
    offsets = parted.groupBy("range_no").agg(F.sum("own_value").alias("total")).select("range_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = F.sum("own_value").over(Window.partitionBy("range_no").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    summed = parted.withColumn("inside", inside).join(F.broadcast(offsets), "range_no")
    return summed.withColumn(name, F.col("inside") + F.col("offset")).drop("range_no", "own_value", "inside", "offset")


def numbered(rows: DataFrame, column: str, name: str = "no") -> DataFrame:
    """The rows with their number from 1 in the order of ``column``, which must be unique."""
    return running(rows, column, F.lit(1), name)
