"""Exact top-k search over binary codes by incremental multi-index hashing (operator 8).

A code is cut into segments of 16 bits, and an index table has a row for each
segment of each distinct code.  Round r looks up, for each query that is still
open, all segment values at exactly r bits from its own; every code found is
verified by its full Hamming distance.  After round r all codes within
segments * (r + 1) - 1 bits are known, as a farther one differs in more than r
bits in every segment, so a query is closed once its k-th verified distance is no
more than that.  Once k are known, codes farther than the k-th are of no use: they
are dropped where they are met, and in the last round only so many segments are
looked up as the k-th distance D still needs (D + 1 - segments * r, as the others
differ in r bits at least).  Of the segments through which a code can be found only the first
of the nearest ones counts, so a code is met once for each query, in one round.
Equal codes are one row with a count and their ``k`` least ids, so thousands of
copies of a vector cost one lookup.

The values looked up grow with r (12,870 of a segment's 65,536 at most; each round's
are one constant array of its plan), so they are dealt over the tasks and meet the index in a shuffled join; nothing is
broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.storage import materialise

SEGMENT_BITS = 16
WORD = 64


def sign_code(vector: Column) -> Column:
    """The signs of a vector's numbers as bits, in an array of longs of 64 bits each.

    Null elements and not-a-number count as not positive; an empty vector has no
    words, a null vector a null code.
    """
    bit = lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(vector, w * WORD + 1, F.lit(WORD)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    n = F.ceil(F.size(vector) / WORD).cast("int")
    return F.when(vector.isNull(), None).when(F.size(vector) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), word))


def _word(code: Column, k: int) -> Column:
    return F.coalesce(F.get(code, k), F.lit(0).cast("long"))


def _segment(code: Column, s: int) -> Column:
    per = WORD // SEGMENT_BITS
    return F.shiftrightunsigned(_word(code, s // per), SEGMENT_BITS * (s % per)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")


def _shell(r: int) -> Column:
    """All segment values of ``r`` bits, as one constant of the plan: a cast of constants is folded, a filter with a lambda would run in every row."""
    values = ",".join(str(x) for x in range(1 << SEGMENT_BITS) if x.bit_count() == r)
    return F.split(F.lit(values), ",").cast("array<int>")


def _by_segment(code: Column, segments: int, name: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(code, s).alias(name)) for s in range(segments)])).alias("s")


def _first_nearest(segments: int, r: int) -> Column:
    """Whether no segment of ``q`` and ``code`` is nearer than ``r`` bits, and ``seg`` is the first at ``r``."""
    apart = [F.bit_count(_segment(F.col("q"), s).bitwiseXOR(_segment(F.col("code"), s))) for s in range(segments)]
    return reduce(lambda a, b: a & b, [F.when(F.col("seg") > s, d > r).otherwise(d >= r) for s, d in enumerate(apart)])


def _words(rows: DataFrame) -> DataFrame:
    """``vec_id, code`` with the code as an array of longs; rows without either are left out."""
    code = F.col("code") if rows.schema["code"].dataType.typeName() == "array" else F.array(F.col("code"))
    return rows.where("vec_id IS NOT NULL AND code IS NOT NULL").select("vec_id", code.cast("array<long>").alias("code")).distinct()


def search(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, distance``: the ``k`` nearest rows of each query, ties by id.

    ``codes`` and ``queries`` have ``vec_id, code`` (a long, or an array of longs
    for more than 64 bits); other columns are left out.  ``bits``: how many bits
    the codes use, by default all of the longest one's words; a shorter code
    counts as if zeros followed.  A query is among the rows, so it finds itself
    at distance 0.  Null codes or ids are neither found nor asked; fewer than
    ``k`` rows give fewer results, an empty table none; repeated ids count once
    for each code.
    """
    codes, queries = _words(codes), _words(queries)
    bits = bits or WORD * (codes.agg(F.max(F.size("code"))).first()[0] or 1)
    segments, words = -(-bits // SEGMENT_BITS), -(-bits // WORD)
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("code").orderBy("vec_id")
    members = materialise(codes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("vec_id", "code"), "mih-members")
    distinct = members.df.groupBy("code").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))  # copies: k at most
    index = materialise(distinct.select("code", "least", "copies", _by_segment(F.col("code"), segments, "val")).select("code", "least", "copies", "s.seg", "s.val"), "mih-index")
    asked = materialise(queries.select(F.col("code").alias("q")).distinct(), "mih-asked")
    k_found = min(k, members.df.count())  # no more can be found
    distance = reduce(lambda a, b: a + b, [F.bit_count(_word(F.col("q"), w).bitwiseXOR(_word(F.col("code"), w))) for w in range(words)])
    nearest = Window.partitionBy("q").orderBy("distance", "least")
    rounds = []  # of each: the best so far of the queries open in it
    open_ = asked.df.withColumn("bound", F.lit(None).cast("int"))  # the distance of the k-th found
    for r in range(SEGMENT_BITS + 1):
        last = r == SEGMENT_BITS
        probe = open_.repartition(parts, "q").select("q", "bound", _by_segment(F.col("q"), segments, "own")).select("q", "bound", "s.seg", "s.own")
        probe = probe.where(F.col("bound").isNull() | (F.col("seg") < F.col("bound") + 1 - segments * r))
        probe = probe.select("q", "bound", "seg", "own", F.explode(_shell(r)).alias("flip")).select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("val"))
        met = probe.hint("merge").join(index.df, ["seg", "val"]).where(_first_nearest(segments, r) & (distance <= F.coalesce("bound", F.lit(bits))))
        found = met.select("q", "code", "least", "copies", distance.alias("distance"))
        if rounds:
            found = found.unionAll(rounds[-1].df.where("NOT closed").select("q", "code", "least", "copies", "distance"))
        kept = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")
        # the distance by which k rows are found, once k are
        kth = kept.withColumn("n", F.sum("copies").over(nearest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("kth", F.min(F.when(F.col("n") >= k_found, F.col("distance"))).over(Window.partitionBy("q")))
        closed = F.lit(True) if last else F.coalesce(F.col("kth") <= segments * (r + 1) - 1, F.lit(False))
        rounds.append(materialise(kth.select("q", "code", "least", "copies", "distance", "kth", closed.alias("closed")), "mih-best"))
        known = rounds[-1].df.groupBy("q").agg(F.max("kth").alias("kth"), F.max("closed").alias("closed"))
        open_ = materialise(open_.select("q").join(known, "q", "left").where("closed IS NULL OR NOT closed").select("q", F.col("kth").cast("int").alias("bound")), "mih-open").df
        if last or open_.isEmpty():
            break
    result = reduce(DataFrame.unionAll, [x.df.where("closed").select("q", "code", "distance") for x in rounds])
    # ids are put in once for each query code, then handed to all queries that share it
    rank = Window.partitionBy("q").orderBy("distance", "vec_id")
    by_code = result.join(members.df, "code").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    out = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).join(by_code, "q")
    answer = materialise(out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance")), "mih-answer")
    for x in (members, index, asked, *rounds):
        x.drop()
    return answer.df
