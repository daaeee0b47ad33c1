"""Texts for a model, put together under headings and packed into a number of characters.

What doesn't fit is left out by running sums of lengths before anything is gathered,
so no row holds more than its limit, however long an article is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a query, a context paragraph, an instruction paragraph, a section's body where it is compared, and an article.
QUERY, CONTEXT, UNIT, SECTION, ARTICLE = 2000, 200, 700, 400, 14_000
TRUNCATED = "\n[article truncated]"
UNRELATED = "  [probably unrelated to the complaint]"


def cut(text: Column, most: int = QUERY) -> Column:
    """The first ``most`` characters."""
    return F.substring(text, 1, most)


def packed(lines: DataFrame, key: str, order: list[str], line: str, most: int | None = None, note: str = "") -> DataFrame:
    """``key, text``: each key's lines in order, joined by line feeds and cut at ``most`` characters, with ``note`` where something was cut.

    Null lines are left out.  Only lines that begin before the cut are gathered.
    """
    rows = lines.where(F.col(line).isNotNull()).select(key, *order, F.col(line).alias("_line"))
    w = Window.partitionBy(key).orderBy(*order)
    size = (F.length("_line") + 1).cast("long")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).withColumn("_total", F.sum(size).over(Window.partitionBy(key)) - 1)
    limit = F.lit(most) if most is not None else F.col("_total")
    fits = F.lit(True) if most is None else (F.col("_before") < most) | (F.col("_before") == 0)
    kept = rows.where(fits).withColumn("_line", F.substr("_line", F.lit(1), F.greatest(limit - F.col("_before"), F.lit(0)).cast("int")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]), "\n")
    joined = kept.groupBy(key).agg(text.alias("text"), F.max("_total").alias("total"))
    if most is None:
        return joined.select(key, "text")
    # a cut behind a line's feed keeps the feed
    whole = F.when(F.length("text") < F.least("total", F.lit(most)), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return joined.select(key, F.when(F.col("total") > most, F.concat(whole, F.lit(note))).otherwise(whole).alias("text"))


def _headed(rows: DataFrame, key: str, order: list[str], section: str, mark: Column, line: Column) -> DataFrame:
    """``key, order, line``: lines, the first of each run of a section behind its heading; a blank line parts the runs."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    opens = first | ~F.lag(section).over(w).eqNullSafe(F.col(section))
    title = F.concat(F.when(first, "").otherwise("\n"), F.lit("### "), F.coalesce(F.nullif(F.col(section), F.lit("")), F.lit("Article")), mark)
    return rows.select(key, *order, F.when(opens, F.concat(title, F.lit("\n"), line)).otherwise(line).alias("line"))


def sentence_prompt(sentences: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``key, text``: numbered sentences under their headings; unrelated sections are marked.

    ``sentences``: key, no, section, text, relevant (null: yes).
    """
    mark = F.when(F.coalesce("relevant", F.lit(True)), "").otherwise(UNRELATED)
    line = F.concat(F.lit("[S"), F.col("no").cast("string"), F.lit("] "), "text")
    return packed(_headed(sentences, key, ["no"], "section", mark, line), key, ["no"], "line", most)


def paragraph_prompt(paragraphs: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``key, text``: instruction paragraphs with their numbers, up to ``UNIT`` characters each, the others as context, up to ``CONTEXT``.

    ``paragraphs``: key, no, section, text, unit (null: context).  A heading that is a step comes as
    the first paragraph of its section.
    """
    line = F.when(F.col("unit").isNull(), F.concat(F.lit("- "), cut(F.col("text"), CONTEXT))).otherwise(F.concat(F.lit("[P"), F.col("unit").cast("string"), F.lit("] "), cut(F.col("text"), UNIT)))
    return packed(_headed(paragraphs, key, ["no"], "section", F.lit(""), line), key, ["no"], "line", most)


def intent_prompt(intents: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """``key, text``: intents by number with their titles; ``intents``: key, no (from 0), text, title."""
    line = F.concat(F.col("no").cast("string"), F.lit(". "), F.coalesce("text", F.lit("")), F.lit(" (title: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("-")), F.lit(")"))
    return packed(intents.withColumn("line", line), key, ["no"], "line", most)


def article_prompt(lines: DataFrame, key: str, order: list[str], line: str, most: int = ARTICLE) -> DataFrame:
    """``key, text``: an article's lines up to ``most`` characters, and a note where it was cut."""
    return packed(lines, key, order, line, most, TRUNCATED)
