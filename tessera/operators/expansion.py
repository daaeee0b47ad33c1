"""What an action's chosen sentences leave out: the start of their procedure, its last step, and a cut between two fixes.

An article's sentences are one array in its row, beside the action's ids; each rule
looks at a bounded stretch of it, so there is no join of sentences with sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T

BACK, AHEAD = 8, 2


def lines_of(sentences: DataFrame, key: str) -> DataFrame:
    """``key, lines``: each article's sentences in order with what the rules ask of them; ``sentences``: key, no (1, 2, ...), section, text, instructs."""
    text = F.col("text")
    bare = F.regexp_replace(F.trim(text), S.LEAD_IN, "")
    row = F.struct(
        "no", "section", "text", "instructs", T.content_terms(text).alias("terms"), bare.rlike(S.FLAGS["starts_procedure"]).alias("starts"), F.regexp_like(text, F.lit(rf"(?i)^(?:again\b|to confirm\b|(?:then|next|afterwards?|after that|to do (?:this|so))\b)")).alias("goes_on"), text.rlike(r":\s*$").alias("opens"),
    )
    return sentences.groupBy(key).agg(F.array_sort(F.collect_list(row), lambda a, b: a["no"] - b["no"]).alias("lines"))


def _prefix(items: Column, holds) -> Column:
    """The items before the first that doesn't hold."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(holds(x), F.lit(False))), False)
    return F.when(at == 0, items).otherwise(F.slice(items, 1, F.greatest(at - 1, F.lit(0)).cast("int")))


def _covers(terms: Column, leaf: Column) -> Column:
    return F.size(F.array_except(leaf, terms)) == 0


def with_start(ids: Column, lines: Column, about: Column) -> Column:
    """The ids, and before them the instructions between the line that introduces their procedure and the first of them.

    The line ends with a colon, shares a term with ``about``, and lies up to ``BACK`` sentences
    before, in the section; nothing if the first id begins a procedure itself.
    """

    def of(at: Column) -> Column:
        first = F.get(lines, at - 1)
        many = F.least(F.lit(BACK), at - 1)
        before = F.reverse(F.slice(lines, F.greatest(at - many, F.lit(1)), many))
        inside = lambda x: (x["section"].eqNullSafe(first["section"])) & ~F.array_contains(ids, x["no"])

        def found(run: Column) -> Column:
            line = F.get(before, F.size(run))
            named = F.coalesce(inside(line) & ~line["instructs"] & line["opens"] & F.arrays_overlap(line["terms"], about), F.lit(False))
            return F.when(named & (F.size(run) > 0) & ~first["starts"], F.concat(F.transform(F.reverse(run), lambda x: x["no"]), ids)).otherwise(ids)

        return S.let(_prefix(before, lambda x: inside(x) & x["instructs"]), found)

    return F.when(F.size(ids) == 0, ids).otherwise(S.let(F.array_min(ids), of))


def with_tail(ids: Column, lines: Column, leaf: Column) -> Column:
    """The ids, and up to ``AHEAD`` instructions after the last of them if these end with the one that names the action's setting (terms ``leaf``), which none of the ids does."""
    chosen = F.transform(ids, lambda i: F.get(lines, i - 1))
    last = F.element_at(chosen, -1)
    after = F.slice(lines, last["no"] + 1, F.lit(AHEAD))
    close = _prefix(after, lambda x: x["section"].eqNullSafe(last["section"]) & ~F.array_contains(ids, x["no"]) & x["instructs"])

    def of(near: Column) -> Column:
        at = F.array_position(F.transform(near, lambda x: _covers(x["terms"], leaf)), True).cast("int")
        return F.when(at > 0, F.concat(ids, F.transform(F.slice(near, 1, at), lambda x: x["no"]))).otherwise(ids)

    usable = (F.size(ids) > 0) & (F.size(F.coalesce(leaf, F.array().cast("array<string>"))) > 0) & ~F.exists(chosen, lambda x: _covers(x["terms"], leaf))
    return F.when(F.coalesce(usable, F.lit(False)), S.let(close, of)).otherwise(ids)


def split_at_setting(ids: Column, lines: Column, leaf: Column) -> Column:
    """The ids as one or two lists: before and from where the procedure of the action's own setting starts.

    Only if what stands before is an instruction that neither opens the settings nor
    names the setting.
    """
    whole = F.array(ids)

    def of(chosen: Column) -> Column:
        reach = F.array_position(F.transform(chosen, lambda x: _covers(x["terms"], leaf)), True).cast("int") - 1
        may = F.filter(F.transform(chosen, lambda x, i: F.struct(i.alias("i"), (x["starts"] | x["goes_on"]).alias("cut"))), lambda x: (x["i"] >= 1) & (x["i"] <= reach) & x["cut"])

        def back(cut: Column) -> Column:
            # starts that stand right before the cut belong to it
            run = _prefix(F.reverse(F.slice(chosen, 2, F.greatest(cut - 1, F.lit(0)))), lambda x: x["starts"])

            def parts(n: Column) -> Column:
                head = F.slice(chosen, 1, n)
                own = ~F.array_join(F.transform(head, lambda x: x["text"]), " ").rlike(S.ENTRY) & F.exists(head, lambda x: x["instructs"])
                return F.when(own, F.array(F.slice(ids, 1, n), F.slice(ids, n + 1, F.size(ids)))).otherwise(whole)

            return F.when(cut.isNull(), whole).otherwise(S.let(cut - F.size(run), parts))

        return F.when(reach > 0, S.let(F.array_max(F.transform(may, lambda x: x["i"])), back)).otherwise(whole)

    usable = (F.size(ids) >= 2) & (F.size(F.coalesce(leaf, F.array().cast("array<string>"))) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), S.let(F.transform(ids, lambda i: F.get(lines, i - 1)), of)).otherwise(whole)


def finished(actions: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """The actions with ``part, ids``: their sentences with the start and the tail of the procedure, cut in two where they are two fixes.

    ``actions``: key, ids (in the order of choice), name, path, and other columns, which stay.
    ``sentences``: key, no, section, text, instructs.  Ids that the article doesn't have are left out;
    actions without a path have no tail and are never cut.
    """
    lines = lines_of(sentences, key)
    met = actions.join(lines, key).withColumn("ids", F.filter("ids", lambda i: i.between(1, F.size("lines"))))
    leaf = F.when(F.col("path").isNotNull(), T.content_terms(T.leaf(F.col("path"))))
    about = T.content_terms(F.concat_ws(" ", "name", "path"))
    met = met.withColumn("_leaf", leaf).withColumn("ids", with_start(F.col("ids"), F.col("lines"), about)).withColumn("ids", with_tail(F.col("ids"), F.col("lines"), F.col("_leaf")))
    cut = met.withColumn("_parts", split_at_setting(F.col("ids"), F.col("lines"), F.col("_leaf"))).drop("ids", "lines", "_leaf")
    return cut.select(*[c for c in cut.columns if c != "_parts"], F.posexplode("_parts").alias("part", "ids"))
