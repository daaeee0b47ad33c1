"""Scorecards: graded relevance, summaries by owner and overall, findings, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(gold_tier: Column, tier: Column, predicted: Column, accepted: Column, parents: Column) -> Column:
    """Relevance 0 to 2 of a predicted link against gold."""
    manual = F.when(tier == "manual", 2).otherwise(0)
    dummy = F.when(tier == "dummy", 2).when((tier == "manual") | F.array_contains(parents, predicted), 1).otherwise(0)
    catalog = F.when(predicted.isNull(), 0).when(F.array_contains(accepted, predicted), 2).when(F.array_contains(parents, predicted), 1).otherwise(0)
    return F.when(gold_tier == "manual", manual).when(gold_tier == "dummy", dummy).otherwise(catalog)


def scorecard(rows: DataFrame, owner: str) -> DataFrame:
    """Precision at 1, mean relevance, tier accuracy and wrong links, for each owner and overall (null)."""
    catalog = F.col("gold_tier") == "catalog"
    sets = rows.groupingSets([[F.col(owner)], []], F.col(owner))
    return sets.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(catalog, (F.col("relevance") == 2).cast("double"))), 6).alias("p_at_1"),
        F.round(F.avg("relevance"), 6).alias("mean_relevance"),
        F.round(F.avg((F.col("tier") == F.col("gold_tier")).cast("double")), 6).alias("tier_accuracy"),
        F.round(F.avg(((F.col("tier") != "manual") & (F.col("relevance") == 0)).cast("double")), 6).alias("wrong_rate"),
        *[F.count_if(F.col("relevance") == k).alias(f"rel_{k}") for k in (0, 1, 2)],
    )


def findings(rows: DataFrame, keys: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """``keys, code, severity``: one row for each rule that a row breaks; ``rules``: code to (severity, broken)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, (s, c) in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("f")).select(*keys, "f.code", "f.severity")


def summary(found: DataFrame, key: str) -> DataFrame:
    """Findings by code: how many, the worst severity, and the three least keys."""
    order = Window.partitionBy("code").orderBy(key)
    first = found.withColumn("rn", F.row_number().over(order)).where("rn <= 3").groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col(key))), lambda k: k.cast("string")), ",").alias("examples"))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.max("severity").alias("worst")).join(first, "code")


def provenance(rows: DataFrame, plan: str, owner: str, order: str) -> DataFrame:
    """``source`` of each row's plan: seen earlier for its own owner, for another, or new.

    Firsts are aggregated by plan and owner, so no row carries the set of all earlier ones.
    """
    own = rows.groupBy(plan, owner).agg(F.min(order).alias("own_first"))
    w = Window.partitionBy(plan).orderBy("own_first")
    two = own.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy(plan).agg(F.min_by(owner, "rn").alias("o1"), F.min("own_first").alias("f1"), F.max("own_first").alias("f2"), F.count("*").alias("owners"))
    joined = rows.join(own, [plan, owner]).join(two, plan)
    other = F.when(F.col("o1") != F.col(owner), F.col("f1")).when(F.col("owners") > 1, F.col("f2"))
    return joined.withColumn("source", F.when(F.col("own_first") < F.col(order), "own").when(F.coalesce(other < F.col(order), F.lit(False)), "other").otherwise("new")).drop("own_first", "o1", "f1", "f2", "owners")


def block_score(rates: list[Column], most: float) -> Column:
    """``most`` points times the mean of the rates that were measured; null if none was."""
    known = F.array_compact(F.array(*rates))
    return F.when(F.size(known) > 0, F.round(F.lit(most) * F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 4))
