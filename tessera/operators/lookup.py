"""Exact, guarded and tiered lookups, and clusters of catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.pivots import blocks_of, near_pairs, pivots_of
from tessera.operators.ranges import numbered
from tessera.operators.slots import compatible
from tessera.sources.files import stored


def guarded(queries: DataFrame, cache: DataFrame, least: float, key: str = "siis_hash") -> DataFrame:
    """The most similar other cached row of the same article whose slots agree: ``query_id, entry_id, score``.

    ``queries``: query_id, key, q_component, q_symptom, q_intent, q_direction, q_vec, q_version;
    ``cache``: entry_id, key, c_..., c_vec, c_version. The article is an equi-join, within
    which a query meets the blocks that can reach the threshold; slots are checked before
    the choice. A null version on either side passes.
    """
    return _best(queries, cache, least, key, compatible("q_", "c_") & (F.col("q_version").isNull() | F.col("c_version").isNull() | (F.col("q_version") == F.col("c_version"))))


def any_article(queries: DataFrame, cache: DataFrame, least: float, fits: Column) -> DataFrame:
    """The most similar other row of any article for which ``fits`` holds: ``query_id, entry_id, score``."""
    everywhere = lambda rows: rows.withColumn("_all", F.lit(0))
    return _best(everywhere(queries), everywhere(cache), least, "_all", fits)


def _best(queries: DataFrame, cache: DataFrame, least: float, key: str, fits: Column) -> DataFrame:
    """Of the pairs of one ``key`` that fit, each query's best: by score of six digits, then by the lesser entry."""
    pivots = stored(pivots_of(cache, "entry_id", "c_vec"), "pivots")
    met = near_pairs(queries, blocks_of(cache, "entry_id", key, "c_vec", pivots), key, "q_vec", pivots, least - 1e-6)
    scored = met.where(fits & (F.col("query_id") != F.col("entry_id"))).withColumn("score", F.round("cosine", 6)).where(F.col("score") >= least)
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "entry_id")).alias("b"))
    return best.select("query_id", F.col("b.entry_id").alias("entry_id"), (-F.col("b.s")).alias("score"))


def tiered(queries: DataFrame, exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """``query_id, entry_id, tier``: the exact hit if there is one but the query itself, else the semantic one, else a miss.

    ``queries`` and ``exact`` have ``key``; only what the exact join leaves is looked up further.
    """
    hit = queries.join(exact, "key").where(F.col("query_id") != F.col("entry_id")).groupBy("query_id").agg(F.min("entry_id").alias("entry_id")).withColumn("tier", F.lit("exact"))
    left = queries.join(hit, "query_id", "left_anti")
    soft = left.join(semantic.select("query_id", "entry_id"), "query_id", "left").select("query_id", "entry_id", F.when(F.col("entry_id").isNull(), "miss").otherwise("semantic").alias("tier"))
    return hit.select("query_id", "entry_id", "tier").unionByName(soft)


def clusters(rows: DataFrame, key: str, link: str, description: str) -> DataFrame:
    """``key, node``: rows with one link (without: one description) are grouped, groups whose first
    member has an equal description are folded, and nodes are numbered by description."""
    first = F.coalesce(F.concat(F.lit("link:"), F.col(link)), F.concat(F.lit("text:"), F.col(description)))
    named = rows.select(key, first.alias("grp"), F.col(description).alias("d"))
    heads = named.groupBy("grp").agg(F.min_by("d", key).alias("head"))
    nodes = numbered(heads.select("head").distinct(), "head").select("head", F.format_string("SN-%04d", "no").alias("node"))
    return named.join(heads, "grp").join(nodes, "head").select(key, "node")


def nodes_of(members: DataFrame, key: str, polarity: str, name: str) -> DataFrame:
    """``node, by_polarity, name, synonyms``: members (node, key, polarity, name) as one row for each node.

    ``by_polarity`` maps each polarity to its members in order; the shortest name
    stands for the node, and the others are its synonyms in order.
    """
    lists = members.groupBy("node", polarity).agg(F.array_sort(F.collect_list(key)).alias("ids")).groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(polarity, F.lit("unknown")), "ids")))).alias("by_polarity"))
    names = members.groupBy("node").agg(F.array_sort(F.collect_set(F.struct(F.length(name).alias("size"), F.col(name).alias("name")))).alias("n"))
    own = F.element_at("n", 1)["name"]
    return lists.join(names, "node").select("node", "by_polarity", own.alias("name"), F.array_sort(F.transform(F.slice("n", 2, F.size("n")), lambda x: x["name"])).alias("synonyms"))


#: For each verb, the polarities of an entry in the order in which they serve it.
PREFERENCE = {
    "enable": ["onURL", "onClickURL", "updateURL"],
    "disable": ["offURL", "onClickURL", "updateURL"],
    "set": ["updateURL", "onClickURL"],
    "adjust": ["updateURL", "onClickURL"],
    "open": ["onClickURL", "updateURL", "onURL"],
    "check": ["onClickURL", "updateURL", "onURL"],
}
FALLBACK = ["onClickURL", "updateURL", "onURL", "offURL"]


def preference(verb: Column, polarity: Column) -> Column:
    """How well an entry's polarity serves a verb: 0 is best; kinds that a verb doesn't name follow in a common order."""
    later = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FALLBACK]), polarity), F.lit(0))
    rank = F.when(later > 0, 9 + later).otherwise(99)
    for name, kinds in PREFERENCE.items():
        at = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in kinds]), polarity), F.lit(0))
        rank = F.when((verb == name) & (at > 0), at - 1).otherwise(rank)
    return rank.cast("int")


def _by_kind(entries: DataFrame, key: str, entry: str) -> DataFrame:
    """``key, kinds``: the least entry of each polarity under a key, in one row; all that a choice by verb can take."""
    least = entries.where(F.col(key).isNotNull()).groupBy(key, "polarity").agg(F.min(entry).alias("least"))
    return least.groupBy(key).agg(F.collect_list(F.struct("polarity", "least")).alias("kinds"))


def _serving(verb: Column, kinds: Column) -> Column:
    """``rank, least`` of the entry that serves a verb best, of :func:`_by_kind`."""
    return F.array_min(F.transform(kinds, lambda k: F.struct(preference(verb, k["polarity"]).alias("rank"), k["least"].alias("least"))))


def siblings(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``query_id, entry_id``: of the entries on the node that was found, the one that serves the verb best.

    ``asked``: query_id, entry_id (found), verb; ``entries``: entry_id, node, polarity.
    An entry without a node stays itself.  A node is one row with the least entry of
    each polarity, so a query meets one row however many entries its node has.
    """
    found = asked.join(entries.select("entry_id", "node"), "entry_id", "left")
    met = found.join(_by_kind(entries, "node", "entry_id"), "node", "left").withColumn("b", _serving(F.col("verb"), F.col("kinds")))
    return met.groupBy("query_id").agg(F.coalesce(F.min("b")["least"], F.first("entry_id")).alias("entry_id"))


def by_rules(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``query_id, entry_id, how``: an entry whose name is the step's leaf, else one whose description holds it; then by verb.

    ``asked``: query_id, leaf, verb; ``entries``: entry_id, name, description, polarity.
    Names meet by equality.  So do descriptions: their runs of as many words as some
    leaf has are phrases.  A name or phrase is one row with the least entry of each
    polarity, so a query meets one row however many entries bear it.
    """
    low = lambda c: F.lower(F.trim(c))
    q = asked.select("query_id", low("leaf").alias("leaf"), "verb").where("leaf <> ''")
    pick = lambda rows, how: rows.withColumn("b", _serving(F.col("verb"), F.col("kinds"))).groupBy("query_id").agg(F.min("b")["least"].alias("entry_id")).withColumn("how", F.lit(how))
    exact = pick(q.join(_by_kind(entries.select("entry_id", "polarity", low("name").alias("leaf")), "leaf", "entry_id"), "leaf"), "name")
    tokens = lambda c: F.split(c, "[^a-z0-9]+")
    rest = q.join(exact, "query_id", "left_anti").withColumn("phrase", F.array_join(tokens("leaf"), " "))
    sizes = q.agg(F.collect_set(F.size(tokens("leaf"))).alias("sizes"))  # one row
    # entries of one description count once
    told = entries.select("entry_id", "polarity", low("description").alias("d")).groupBy("d", "polarity").agg(F.min("entry_id").alias("entry_id"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
    cut = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.size("t")), runs))
    phrases = told.where("d IS NOT NULL").withColumn("t", tokens("d")).join(F.broadcast(sizes)).select("entry_id", "polarity", F.explode(F.array_distinct(cut)).alias("phrase"))
    return exact.unionByName(pick(rest.join(_by_kind(phrases, "phrase", "entry_id"), "phrase"), "description"))
