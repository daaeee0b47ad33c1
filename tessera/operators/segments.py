"""Lines, sections and sentences of texts, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.steps import let


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: the lines that are not blank, numbered from 1 with the blank ones."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    return parts.select(key, (F.col("i") + 1).alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def preamble(text: Column) -> Column:
    """``title, intro, rest`` of an article: what stands before its first ``#``, without the breadcrumb that opens it.

    A breadcrumb is ``<categories> <title> (<categories>):``, its categories compared
    without spaces.  One line without a sentence is a breadcrumb of another shape.
    """
    squash = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    at = F.instr(text, "#")
    pre = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
    rest = F.when(at > 0, F.substr(text, at)).otherwise(F.lit(""))
    crumb = r"^\s*([^\n()]{1,600}?)\(\s*([^()\n]{1,600}?)\s*\)\s*:\s*"
    words = F.struct(F.trim(F.regexp_extract(pre, crumb, 1)).alias("head"), squash(F.regexp_extract(pre, crumb, 2)).alias("cats"))

    def title(w: Column) -> Column:
        """What follows the categories in the head, which may space them otherwise; null: no breadcrumb."""
        n = F.length(w["cats"])
        size = lambda a, x: a["seen"] + F.length(x)
        # the categories' letters are passed by, with the blanks between: by words, not by letters
        step = lambda a, x: F.when(a["seen"] >= n, F.struct(a["seen"].alias("seen"), F.concat(a["left"], x).alias("left"))).when(x.rlike(r"^\s"), a).otherwise(
            F.struct(size(a, x).alias("seen"), F.when(size(a, x) > n, F.substr(x, n - a["seen"] + 1)).otherwise(F.lit("")).alias("left"))
        )
        left = lambda: F.aggregate(F.regexp_extract_all(w["head"], F.lit(r"(\S+|\s+)"), F.lit(1)), F.struct(F.lit(0).alias("seen"), F.lit("").alias("left")), step, lambda a: a["left"])
        is_crumb = (w["cats"] != "") & squash(w["head"]).startswith(w["cats"])
        return F.when(is_crumb, F.regexp_replace(left(), r"^[ ,:]+|[ ,:]+$", ""))

    label = (at > 0) & ~pre.rlike(r"(?s)\S.*\n.*\S") & ~pre.rlike(r"[.!?]\s")

    def parts(name: Column) -> Column:
        intro = F.when(name.isNotNull(), F.regexp_replace(pre, crumb, "")).when(label, F.lit("")).otherwise(pre)
        return F.struct(F.coalesce(name, F.lit("")).alias("title"), F.regexp_replace(intro, r"^\s+|\s+$", "").alias("intro"), rest.alias("rest"))

    return let(words, lambda w: let(title(w), parts))


def section_text(heading: Column, body: Column, most: int = 400) -> Column:
    """What a section is compared by: its heading and the start of its body, where the limit is the feature."""
    return F.trim(F.concat_ws(" ", heading, F.substring(body, 1, most)))


def sections(rows: DataFrame, key: str, header: str = r"^#{1,6} ") -> DataFrame:
    """``key, section, heading, n_lines, n_chars``: lines under the header before them (section 0: none)."""
    order = Window.partitionBy(key).orderBy("line_no")
    head = F.col("line").rlike(header)
    marked = rows.withColumn("header", head.cast("int")).withColumn("section", F.sum("header").over(order))
    return marked.groupBy(key, F.col("section").cast("long").alias("section")).agg(
        F.coalesce(F.max(F.when(F.col("header") == 1, F.col("line"))), F.lit("")).alias("heading"),
        F.sum(1 - F.col("header")).cast("long").alias("n_lines"),
        F.sum(F.when(F.col("header") == 0, F.length("line")).otherwise(0)).cast("long").alias("n_chars"),
    )


def sentences(rows: DataFrame, key: str) -> DataFrame:
    """``key, no, line_no, sentence``: sentences numbered through each text."""
    cut = F.split(F.regexp_replace("line", r"([.!?])\s+([A-Z])", "$1\u0001$2"), "\u0001")
    parts = rows.select(key, "line_no", F.posexplode(cut).alias("pos", "sentence"))
    return parts.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("line_no", "pos"))).select(key, "no", "line_no", "sentence")


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys, island, value, first, last, n``: runs of equal values in each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return marked.groupBy(*keys, "island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def runs(rows: DataFrame, keys: list[str], order: str, gap: int, starts: Column | None = None) -> DataFrame:
    """The rows with ``run``: a new one where ``order`` jumps by ``gap`` or more, and ``starts`` (a condition) holds if given."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(order) - F.lag(order).over(w) >= gap
    return rows.withColumn("run", F.sum(F.when(step if starts is None else step & starts, 1).otherwise(0)).over(w))


def look_around(rows: DataFrame, key: str, order: str, flag: str, back: int, ahead: int) -> DataFrame:
    """``key, order``: rows that lie up to ``back`` before or ``ahead`` after a flagged one, and these.

    One pass with bounded frames; no self-join.
    """
    w = Window.partitionBy(key).orderBy(order)
    near = F.max(F.col(flag).cast("int")).over(w.rangeBetween(-back, ahead))
    return rows.withColumn("near", near).where("near = 1").select(key, order)
