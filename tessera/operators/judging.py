"""Judged plans: results joined to the set they were asked from, verdicts brought into form, and their summary.

A plan's verdict is cleaned inside its row, against the plan's own step and link
ids.  The summary turns every row into facts (section, key, value) and adds them up
by section and key in one shuffle of partial sums, so it doesn't matter how many
rows share a source or a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts on a step with their credit, and what may be wrong with it.
CREDIT = {"correct": 1.0, "partial": 0.5, "wrong": 0.0}
ISSUES = ["none", "not_an_instruction", "fragment", "irrelevant", "unsupported", "duplicate", "wrong_action"]
MOST_SCORE, MOST_RELEVANCE = 3, 2


def joined_results(results: DataFrame, kit: DataFrame, key: str, kit_id: str) -> DataFrame:
    """All ``results`` with ``kit``'s columns and ``matched``; of kit rows with the same ``key`` the one with the greatest id.

    Results whose key is null or not in the kit stay, with nulls.
    """
    others = [c for c in kit.columns if c != key]
    best = kit.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), kit_id).alias("k"))
    return results.join(best, key, "left").select(*results.columns, *[F.col("k")[c].alias(c) for c in others], F.col("k").isNotNull().alias("matched"))


def _clamped(x: Column, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(x.cast("int"), F.lit(0))))


def _first(entries: Column, field: str, value: Column) -> Column:
    """The first entry for ``value``; null if there is none."""
    return F.get(F.filter(entries, lambda e: F.trim(e[field]) == value), F.lit(0))


def cleaned(items: DataFrame) -> DataFrame:
    """``items`` with ``empty, judged, score, steps, unjudged, links, order_ok, n_missing`` instead of ``verdict``.

    ``items``: ``step_ids``, ``link_ids`` (arrays of strings) and ``verdict``, a struct of
    ``score, steps (id, verdict, issue), links (action, relevance), missing, order_ok``,
    null where the judge gave none.  A plan without steps counts as judged, with
    score 0.  Of entries for the same id the first counts, those for ids that aren't the
    plan's don't; unknown verdicts are wrong, unknown issues and those of correct steps
    none; steps without an entry are ``unjudged``; scores are brought into their range.
    """
    v, ids, links = F.col("verdict"), F.coalesce("step_ids", F.array().cast("array<string>")), F.coalesce("link_ids", F.array().cast("array<string>"))
    empty = F.size(ids) == 0
    verdict = lambda e: F.when(e["verdict"].isin(*CREDIT), e["verdict"]).otherwise("wrong")
    issue = lambda e: F.when(e["verdict"] == "correct", "none").when(e["issue"].isin(*ISSUES), e["issue"]).otherwise("none")
    said = F.filter(F.transform(ids, lambda i: F.struct(i.alias("id"), _first(v["steps"], "id", i).alias("e"))), lambda x: x["e"].isNotNull())
    linked = F.filter(F.transform(links, lambda i: F.struct(i.alias("action"), _first(v["links"], "action", i).alias("e"))), lambda x: x["e"].isNotNull())
    steps = F.transform(said, lambda x: F.struct(x["id"].alias("id"), verdict(x["e"]).alias("verdict"), issue(x["e"]).alias("issue")))
    return items.select(
        *[c for c in items.columns if c != "verdict"],
        empty.alias("empty"),
        (empty | v.isNotNull()).alias("judged"),
        F.when(empty, 0).otherwise(_clamped(v["score"], MOST_SCORE)).alias("score"),
        steps.alias("steps"),
        F.array_except(ids, F.transform(said, lambda x: x["id"])).alias("unjudged"),
        F.transform(linked, lambda x: F.struct(x["action"].alias("action"), _clamped(x["e"]["relevance"], MOST_RELEVANCE).alias("relevance"))).alias("links"),
        (empty | F.coalesce(v["order_ok"], F.lit(True))).alias("order_ok"),
        F.when(empty, 0).otherwise(F.greatest(F.coalesce(F.size(v["missing"]), F.lit(0)), F.lit(0))).alias("n_missing"),
    )


def summary(rows: DataFrame, digits: int = 3) -> DataFrame:
    """``section, key, n, mean`` of :func:`cleaned` rows that have ``source, domain, self_graded``.

    ``plans``: how many there are, are judged, failed, empty, self-graded, out of order
    or miss something.  ``score``: the mean and a histogram.  ``source`` and ``domain``
    (null: unknown): mean scores.  ``steps``: mean credit and how many are unjudged;
    ``verdict`` and ``issue``: how many; ``links``: mean relevance.  Counts have a null
    mean; fixed keys are there with zero even if the table is empty.
    """

    def fact(section: str, key, value: Column | None = None) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        return F.struct(F.lit(section).alias("section"), key.alias("key"), (F.lit(None) if value is None else value).cast("double").alias("value"))

    judged, full, score = F.col("judged"), F.col("judged") & ~F.col("empty"), F.col("score")
    credit = lambda s: F.element_at(F.create_map(*[F.lit(x) for pair in CREDIT.items() for x in pair]), s["verdict"])
    of_plan = [
        fact("plans", "n"), F.when(judged, fact("plans", "judged")).otherwise(fact("plans", "failed")), F.when(judged & F.col("empty"), fact("plans", "empty")), F.when(full & F.col("self_graded"), fact("plans", "self_graded")),
        F.when(full & ~F.col("order_ok"), fact("plans", "order_problems")), F.when(judged & (F.col("n_missing") > 0), fact("plans", "missing_a_fix")),
        F.when(judged, fact("score", "mean", score)), F.when(judged, fact("score", score.cast("string"))),
        F.when(judged, fact("source", F.col("source"), score)), F.when(judged, fact("domain", F.coalesce("domain", F.lit("unknown")), score)),
    ]
    of_steps = [
        F.transform("steps", lambda s: fact("steps", "credit", credit(s))), F.transform("steps", lambda s: fact("verdict", s["verdict"])),
        F.transform(F.filter("steps", lambda s: s["issue"] != "none"), lambda s: fact("issue", s["issue"])), F.transform("unjudged", lambda s: fact("steps", "unjudged")),
        F.transform("links", lambda x: fact("links", "relevance", x["relevance"])),
    ]
    whole = F.array_compact(F.array(*of_plan))
    facts = rows.select(F.explode(F.when(judged, F.concat(whole, *of_steps)).otherwise(whole)).alias("f"), F.lit(1).alias("weight"))
    fixed = [("plans", k) for k in ("n", "judged", "failed", "empty", "self_graded", "order_problems", "missing_a_fix")] + [("score", k) for k in ("mean", *map(str, range(MOST_SCORE + 1)))]
    fixed += [("verdict", k) for k in CREDIT] + [("steps", "credit"), ("steps", "unjudged"), ("links", "relevance")]
    zeros = rows.sparkSession.range(1).select(F.explode(F.array(*[fact(s, k) for s, k in fixed])).alias("f"), F.lit(0).alias("weight"))
    return facts.unionAll(zeros).groupBy("f.section", "f.key").agg(F.sum("weight").alias("n"), F.round(F.avg("f.value"), digits).alias("mean"))
