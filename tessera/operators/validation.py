"""Validators of evaluation sets: every problem is a row ``set_name, check, severity, place, detail``.

A set's rows have ``id, row_id, query``; the kit, which they were made from, has one
``row_id, query`` each.  Rules on single rows are taken in one pass; rules on
counts and repeats aggregate with partial sums, and texts meet by digest, so
neither a row with very many variants nor a query repeated very often gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = ["set_name", "check", "severity", "place", "detail"]


def normed(query: str) -> Column:
    """What a query is compared by: the digest of its trimmed small letters; null stays null."""
    return F.sha2(F.lower(F.trim(query)).cast("binary"), 256)


def _as_findings(rows: DataFrame, set_name: str, check: str, severity: str, place: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(set_name).alias("set_name"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), place.cast("string").alias("place"), detail.cast("string").alias("detail"))


def row_problems(rows: DataFrame, set_name: str, kit: DataFrame, registers: list[str] | None = None) -> DataFrame:
    """Rules on each row: ``empty_query`` (null too), ``unknown_row``, ``not_held_out`` and, with ``registers``, ``unknown_register``."""
    known = kit.select(F.col("row_id").alias("kit_row"), normed("query").alias("kit_key"))
    j = rows.join(known, F.col("row_id") == F.col("kit_row"), "left")
    rules = {
        "empty_query": (F.trim(F.coalesce("query", F.lit(""))) == "", F.lit("")),
        "unknown_row": (F.col("kit_row").isNull(), F.coalesce(F.col("row_id").cast("string"), F.lit(""))),
        "not_held_out": (normed("query") == F.col("kit_key"), F.lit("")),
    }
    if registers is not None:
        rules["unknown_register"] = (~F.coalesce(F.col("register"), F.lit("")).isin(*registers), F.coalesce("register", F.lit("")))
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("check"), detail.alias("detail"))) for name, (cond, detail) in rules.items()]))
    return j.select(F.lit(set_name).alias("set_name"), F.explode(broken).alias("b"), F.lit("fail").alias("severity"), F.col("id").cast("string").alias("place")).select("set_name", "b.check", "severity", "place", "b.detail")


def repeated(rows: DataFrame, set_name: str, check: str, by: Column) -> DataFrame:
    """Values of ``by`` that several rows share: the least id is the place, their number the detail; nulls don't count."""
    groups = rows.select("id", by.alias("by")).where("by IS NOT NULL").groupBy("by").agg(F.min(F.col("id").cast("string")).alias("least"), F.count("*").alias("n")).where("n > 1")
    return _as_findings(groups, set_name, check, "fail", F.col("least"), F.col("n"))


def row_counts(rows: DataFrame, set_name: str, kit: DataFrame, want: int) -> DataFrame:
    """Kit rows that don't have ``want`` rows in the set; those with none have a finding too."""
    counts = kit.select("row_id").join(rows.groupBy("row_id").agg(F.count("*").alias("n")), "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))
    return _as_findings(counts.where(F.col("n") != want), set_name, "row_count", "fail", F.col("row_id"), F.col("n"))


def uncovered(rows: DataFrame, set_name: str, kit: DataFrame, registers: list[str]) -> DataFrame:
    """Kit rows that are in the set, but not in each of ``registers``; only those are gathered, so a row's set is bounded by them."""
    groups = rows.join(kit.select("row_id"), "row_id").groupBy("row_id").agg(F.collect_set(F.when(F.col("register").isin(*registers), F.col("register"))).alias("has"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in registers]), "has"))
    return _as_findings(groups.where(F.size(missing) > 0), set_name, "missing_register", "warn", F.col("row_id"), F.array_join(missing, ","))


def validate(sets: dict[str, DataFrame], kit: DataFrame, want: dict[str, int], registers: dict[str, list[str]]) -> DataFrame:
    """All findings of all ``sets``; ``want``: rows for each kit row, ``registers``: those that a set with the column must cover.

    Empty sets give a ``row_count`` for each kit row; with an empty kit every row is an ``unknown_row``.
    """
    found = None
    for name, rows in sets.items():
        parts = [row_problems(rows, name, kit, registers.get(name)), repeated(rows, name, "repeated_id", F.col("id").cast("string")), repeated(rows, name, "repeated_query", normed("query")), row_counts(rows, name, kit, want[name])]
        if name in registers:
            parts.append(uncovered(rows, name, kit, registers[name]))
        for part in parts:
            found = part if found is None else found.unionByName(part)
    return found.select(*FINDING)


def closeness(sets: dict[str, DataFrame], kit: DataFrame, words, far: str, near: str, digits: int = 6) -> DataFrame:
    """``set_name, n, overlap, trap``: mean word overlap with the kit's query, a row that is not of the kit counting as 0.

    ``trap``: whether ``near``'s mean is above ``far``'s, without which likeness alone
    would tell the sets apart; null if either is empty.  ``words``: from a text column to its distinct words.
    """
    own = kit.select("row_id", words(F.col("query")).alias("kit_words"))
    whole = None
    for name, rows in sets.items():
        j = rows.select("row_id", words(F.coalesce("query", F.lit(""))).alias("w")).join(own, "row_id", "left")
        union = F.size(F.array_union("w", "kit_words"))
        alike = F.when(F.col("kit_words").isNull() | (union == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect("w", "kit_words")), union))
        mean = j.agg(F.lit(name).alias("set_name"), F.count("*").alias("n"), F.round(F.avg(alike), digits).alias("overlap"))
        whole = mean if whole is None else whole.unionAll(mean)
    two = whole.agg(*[F.max(F.when(F.col("set_name") == name, F.col("overlap"))).alias(c) for name, c in ((far, "f"), (near, "n"))]).select((F.col("n") > F.col("f")).alias("trap"))
    return whole.crossJoin(two)  # one row
