"""Slots of short texts by a lexicon, and word-set similarity within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import DENIALS, GENERAL_FIX, GENERIC, STOPWORDS, UI_VERBS, lexicon_rows

LEXICON = lexicon_rows()


def _lexicon(spark, rows) -> DataFrame:
    """The phrases with their first word, as a broadcast: a few hundred rows."""
    lex = spark.createDataFrame(rows, "field string, label string, phrase string, weak int")
    return F.broadcast(lex.withColumn("first_word", F.regexp_extract("phrase", "([a-z0-9]+)", 1)))


def _found(texts: DataFrame, keys: list[str], text: str, lexicon: list, pattern: Column) -> DataFrame:
    """``keys, field, label, weak, size, pos, s``: where each phrase first occurs, by way of its first word."""
    base = texts.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    tokens = base.select(*keys, "s", F.explode(F.array_distinct(T.words(F.col("s")))).alias("first_word"))
    met = tokens.join(_lexicon(texts.sparkSession, lexicon), "first_word")
    return met.withColumn("pos", F.regexp_instr("s", pattern)).where("pos > 0").withColumn("size", F.length("phrase"))


def denied(text: Column, pos: Column, denials: list[str] = DENIALS) -> Column:
    """Whether the fourteen characters before a place end in a denial."""
    before = F.substr(text, F.greatest(pos - 14, F.lit(1)), F.least(pos - 1, F.lit(14)))
    out = F.lit(False)
    for w in denials:
        out = out | before.endswith(w)
    return out


def matches(texts: DataFrame, keys: list[str], text: str, lexicon: list = LEXICON, denials: list[str] = DENIALS) -> DataFrame:
    """``keys, field, label, weak, size, pos``: phrases found as whole words and not denied; first occurrences.

    Each distinct token of a text is looked up by a phrase's first word, so the
    broadcast lexicon is joined on equality.  A phrase whose first occurrence is
    denied is not found, even if it occurs again.
    """
    whole = F.concat(F.lit(r"\b\Q"), F.col("phrase"), F.lit(r"\E\b"))
    found = _found(texts, keys, text, lexicon, whole)
    return found.where(~denied(F.col("s"), F.col("pos"), denials)).select(*keys, "field", "label", "weak", "size", "pos")


def named(texts: DataFrame, keys: list[str], text: str, lexicon: list = LEXICON, denials: list[str] = DENIALS) -> DataFrame:
    """``keys, components``: all parts that a text names, but weak ones and denied mentions; in order."""
    m = matches(texts, keys, text, lexicon, denials).where("field = 'component' AND weak = 0")
    some = m.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("components"))
    return texts.select(*keys).join(some, keys, "left").select(*keys, F.coalesce("components", F.array().cast("array<string>")).alias("components"))


def mentions(texts: DataFrame, keys: list[str], text: str, lexicon: list = LEXICON) -> DataFrame:
    """``keys, components``: parts that a text mentions by any phrase, plurals included, denied or not."""
    rows = [r for r in lexicon if r[0] == "component"]
    y = F.col("phrase").endswith("y")
    stem = F.when(y, F.concat(F.lit(r"\Q"), F.expr("left(phrase, length(phrase) - 1)"), F.lit(r"\E(?:y|ies)"))).otherwise(F.concat(F.lit(r"\Q"), F.col("phrase"), F.lit(r"\E")))
    # a plural may be the first word itself, so its ending is taken off before the lookup
    base = texts.select(*keys, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    forms = F.array_distinct(F.flatten(F.transform(T.words(F.col("s")), lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "es$", ""), F.regexp_replace(w, "ies$", "y")))))
    tokens = base.select(*keys, "s", F.explode(forms).alias("first_word"))
    met = tokens.join(_lexicon(texts.sparkSession, rows), "first_word").where(F.regexp_instr("s", F.concat(F.lit(r"\b"), stem, F.lit(r"(?:s|es)?\b"))) > 0)
    some = met.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("components"))
    return texts.select(*keys).join(some, keys, "left").select(*keys, F.coalesce("components", F.array().cast("array<string>")).alias("components"))


def distinctive(text: Column) -> Column:
    """Words that could say what is wrong: three letters or more, no digits, none that every complaint or article has; in order, once each."""
    out = F.transform(T.hyphen_words(text), lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(T.without_words(out, STOPWORDS + UI_VERBS + GENERIC + GENERAL_FIX), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]")))


def alphabetic(text: Column) -> Column:
    """Words of four letters or more, letters only, but those that every complaint uses."""
    out = F.transform(T.hyphen_words(text), lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    return F.array_distinct(F.filter(T.without_words(out, STOPWORDS + UI_VERBS + GENERIC), lambda w: w.rlike("^[a-z]{4,}$")))


def component_absent(symptom: Column, intent: Column, components: Column, mentioned: Column) -> Column:
    """Parts that a fault complaint with a symptom names and its article never mentions; none where that proves nothing."""
    counts = symptom.isNotNull() & (intent == "fault") & (F.size(components) > 0) & ~F.arrays_overlap(components, mentioned)
    return F.when(F.coalesce(counts, F.lit(False)), components).otherwise(F.array().cast("array<string>"))


def mismatch(words: Column, others: Column, stems: Column, common: Column, known: Column, absent: Column) -> Column:
    """``path, terms, shared, typos``: why an article doesn't fit a complaint, if it doesn't.

    ``words, others``: distinctive and alphabetic words of the complaint; ``stems``:
    of the article's words; ``common, known``: arrays of words that are frequent, or
    in the dictionary at all; ``absent``: from :func:`component_absent`.
    """
    terms = F.array_sort(F.array_intersect(words, common))
    shared = F.array_sort(F.filter(words, lambda w: F.array_contains(stems, T.stem(w))))
    typos = F.array_sort(F.filter(F.array_except(others, known), lambda w: ~F.array_contains(stems, T.stem(w))))
    alone = (F.size(terms) > 0) & (F.size(shared) == 0) & (F.size(typos) == 0)
    return F.struct(F.when(alone, "no_shared_word").when(F.size(absent) > 0, "component_absent").alias("path"), terms.alias("terms"), shared.alias("shared"), typos.alias("typos"))


def turned_away(verdict: Column, path: Column, absent: Column) -> Column:
    """Whether an article is refused: a verdict of ``unrelated`` with evidence of either path, or, without a verdict, an absent part alone."""
    return F.coalesce(F.when(verdict == "unrelated", path.isNotNull()).when(verdict.isNull(), F.size(absent) > 0), F.lit(False))


#: Why an answer is empty, the first that holds; and what is said to the reader.
EMPTY = ["mismatch", "unreadable", "no_grounded_fix", "rules_only"]
MESSAGES = {
    "mismatch": "The article is about another problem.",
    "unreadable": "The question holds no word that could be recognised.",
    "no_grounded_fix": "The article holds no step that answers the question.",
    "rules_only": "No model was free; rules found nothing to answer with.",
}


def empty_reason(actions: Column, refused: Column, readable: Column, model: Column) -> Column:
    """Why a plan has no actions; null if it has some."""
    why = F.when(refused, "mismatch").when(~readable, "unreadable").when(model, "no_grounded_fix").otherwise("rules_only")
    return F.when(actions == 0, why)


def message(reason: Column, messages: dict[str, str] = MESSAGES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in messages.items() for x in pair]), reason)


def extract(texts: DataFrame, keys: list[str], text: str, lexicon: list = LEXICON, denials: list[str] = DENIALS) -> DataFrame:
    """``keys, component, symptom, intent, direction``: strong labels before weak ones, the earliest first, a longer phrase on ties."""
    best = F.struct("weak", "pos", (-F.col("size")).alias("less"), "label")
    m = matches(texts, keys, text, lexicon, denials)
    first = lambda field: F.min(F.when(F.col("field") == field, best))["label"]
    conf = F.max(F.when(F.col("field") == "configure", F.lit(True)))
    sides = F.collect_set(F.when(F.col("field") == "direction", F.col("label")))
    slots = m.groupBy(*keys).agg(first("component").alias("component"), first("symptom").alias("symptom"), conf.alias("conf"), sides.alias("sides"))
    out = texts.select(*keys).join(slots, keys, "left")
    configure = F.coalesce("conf", F.lit(False))
    return out.select(*keys, "component", "symptom", F.when(configure, "configure").otherwise("fault").alias("intent"), F.when(configure & (F.size("sides") == 1), F.element_at("sides", 1)).alias("direction"))


def compatible(q: str, c: str) -> Column:
    """Whether the slots of a query and a cached entry agree: ``q`` and ``c`` are column prefixes.

    Component and intent are wild where either is null; a symptom is wild only
    where the query has none; directions clash only where both name one.
    """
    free = lambda f: F.col(f"{q}{f}").isNull() | F.col(f"{c}{f}").isNull() | (F.col(f"{q}{f}") == F.col(f"{c}{f}"))
    symptom = F.col(f"{q}symptom").isNull() | F.coalesce(F.col(f"{q}symptom") == F.col(f"{c}symptom"), F.lit(False))
    return free("component") & free("intent") & symptom & free("direction")


def pairs(rows: DataFrame, group: str, order: str, text: str, digits: int | None = 6) -> DataFrame:
    """``group, turn_a, turn_b, jaccard`` of the word sets of each group's rows."""
    sets = rows.select(group, F.col(order).alias("turn"), F.array_distinct(T.words(F.col(text))).alias("w"))
    a, b = sets.alias("a"), sets.alias("b")
    j = T.jaccard(F.col("a.w"), F.col("b.w"))
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.turn") < F.col("b.turn"))).select(f"a.{group}", F.col("a.turn").alias("turn_a"), F.col("b.turn").alias("turn_b"), (F.round(j, digits) if digits else j).alias("jaccard"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first by ``order``; the upsert of a batch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
