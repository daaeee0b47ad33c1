"""Catalogue entries: names, nodes, siblings and page guards; parts stand for entries, suppliers for steps that look for one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T
from tessera.operators import lookup as L
from tessera.operators import retrieval as R
from tessera.queries.registry import query

_KIND = "CASE p_size % 5 WHEN 0 THEN 'onURL' WHEN 1 THEN 'offURL' WHEN 2 THEN 'updateURL' WHEN 3 THEN 'onClickURL' END"
_VERB = "CASE s_nationkey % 5 WHEN 0 THEN 'enable' WHEN 1 THEN 'disable' WHEN 2 THEN 'set' WHEN 3 THEN 'open' ELSE 'visit' END"
#: The order in which polarities serve each verb, written out.
_PREF = """pref(verb, polarity, rank) AS (VALUES
  ('enable','onURL',0),('enable','onClickURL',1),('enable','updateURL',2),('enable','offURL',13), ('disable','offURL',0),('disable','onClickURL',1),('disable','updateURL',2),('disable','onURL',12),
  ('set','updateURL',0),('set','onClickURL',1),('set','onURL',12),('set','offURL',13), ('open','onClickURL',0),('open','updateURL',1),('open','onURL',2),('open','offURL',13),
  ('visit','onClickURL',10),('visit','updateURL',11),('visit','onURL',12),('visit','offURL',13))"""


def _kind():
    k = F.col("p_size") % 5
    return F.when(k == 0, "onURL").when(k == 1, "offURL").when(k == 2, "updateURL").when(k == 3, "onClickURL")


def _verb():
    k = F.col("s_nationkey") % 5
    return F.when(k == 0, "enable").when(k == 1, "disable").when(k == 2, "set").when(k == 3, "open").otherwise("visit")


@query(f"""WITH {_PREF}, e AS (SELECT p_partkey AS entry_id, p_brand || '-' || p_size AS node, {_KIND} AS polarity FROM part),
  q AS (SELECT s_suppkey AS query_id, s_suppkey AS found, {_VERB} AS verb FROM supplier),
  c AS (SELECT q.query_id, s.entry_id, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(rank, 99), s.entry_id) AS rn
        FROM q JOIN e f ON f.entry_id = q.found JOIN e s ON s.node = f.node LEFT JOIN pref p ON p.verb = q.verb AND p.polarity = s.polarity)
  SELECT query_id, entry_id FROM c WHERE rn = 1 UNION ALL SELECT query_id, found FROM q WHERE found NOT IN (SELECT entry_id FROM e)""")
def verb_siblings(t):
    """Of the entries on the node that a step found, the one that serves its verb best."""
    entries = t.part.select(F.col("p_partkey").alias("entry_id"), F.concat_ws("-", "p_brand", "p_size").alias("node"), _kind().alias("polarity"))
    asked = t.supplier.select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("entry_id"), _verb().alias("verb"))
    return L.siblings(asked, entries)


@query(f"""WITH {_PREF}, e AS (SELECT p_partkey AS entry_id, p_name AS name, 'Opens the ' || p_type || ' ' || p_brand || ' settings page' AS d, {_KIND} AS polarity FROM part),
  q AS (SELECT s_suppkey AS query_id, {_VERB} AS verb, CASE s_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN lower(p_type) || ' ' || lower(p_brand) ELSE 'nothing here' END AS leaf FROM supplier JOIN part ON p_partkey = s_suppkey),
  x AS (SELECT q.query_id, e.entry_id, 'name' AS how, rank FROM q JOIN e ON lower(e.name) = q.leaf LEFT JOIN pref p ON p.verb = q.verb AND p.polarity = e.polarity),
  y AS (SELECT q.query_id, e.entry_id, 'description' AS how, rank FROM q JOIN e ON instr(' ' || regexp_replace(lower(d), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(leaf, '[^a-z0-9]+', ' ', 'g') || ' ') > 0
        LEFT JOIN pref p ON p.verb = q.verb AND p.polarity = e.polarity WHERE q.query_id NOT IN (SELECT query_id FROM x)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rank, 99), entry_id) AS rn FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
  SELECT query_id, entry_id, how FROM r WHERE rn = 1""")
def rules_lookup(t):
    """An entry by its name, else by a description that holds the leaf, then by the verb."""
    entries = t.part.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), F.concat(F.lit("Opens the "), "p_type", F.lit(" "), "p_brand", F.lit(" settings page")).alias("description"), _kind().alias("polarity"))
    k = F.col("s_suppkey") % 3
    asked = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), _verb().alias("verb"), F.when(k == 0, F.col("p_name")).when(k == 1, F.lower(F.concat_ws(" ", "p_type", "p_brand"))).otherwise("nothing here").alias("leaf"))
    return L.by_rules(asked, entries)


@query("""
  WITH p AS (SELECT p_partkey, 'Settings > ' || p_brand || ' > ' || p_name AS path, CASE WHEN p_size % 2 = 0 THEN 'Apps > ' || p_name || ' menu' ELSE 'Settings > ' || p_type END AS node FROM part),
  s AS (SELECT p_partkey, list_filter(list_transform(string_split(lower(path), '>'), lambda x: list_distinct(regexp_extract_all(x, '[a-z0-9]+'))), lambda w: w <> ['settings']) AS a,
               list_transform(string_split(lower(node), '>'), lambda x: list_distinct(regexp_extract_all(x, '[a-z0-9]+'))) AS b FROM p)
  SELECT p_partkey, len(list_filter(a, lambda x: len(list_filter(b, lambda y: len(list_intersect(x, y)) * 2 >= len(list_distinct(list_concat(x, y))))) > 0)) > 0 AS on_path FROM s""")
def page_guard(t):
    """Whether a page lies on the path that a step names."""
    path = F.concat(F.lit("Settings > "), "p_brand", F.lit(" > "), "p_name")
    node = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Apps > "), "p_name", F.lit(" menu"))).otherwise(F.concat(F.lit("Settings > "), "p_type"))
    return t.part.select("p_partkey", R.page_on_path(path, node).alias("on_path"))


@query("""
  WITH t AS (SELECT p_brand, unnest([p_name, p_type]) AS x, p_partkey * 2 + generate_subscripts([p_name, p_type], 1) AS o FROM part), f AS (SELECT p_brand, x, min(o) AS o FROM t GROUP BY p_brand, x)
  SELECT p_brand, string_agg(x, '. ' ORDER BY o) AS doc FROM f GROUP BY p_brand""")
def screen_docs(t):
    """One document for each node: the distinct texts of its members, in order."""
    return R.screen_docs(t.part, "p_brand", "p_partkey", "p_name", "p_type")


@query(f"""
  WITH m AS (SELECT p_brand AS node, p_partkey AS k, coalesce({_KIND}, 'unknown') AS polarity, p_name || ' ' || p_size AS name FROM part),
  p AS (SELECT node, polarity, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY k) AS ids FROM m GROUP BY node, polarity), q AS (SELECT node, string_agg(polarity || ':' || ids, ',' ORDER BY polarity) AS by_polarity FROM p GROUP BY node),
  n AS (SELECT node, name, row_number() OVER (PARTITION BY node ORDER BY length(name), name) AS rn FROM (SELECT DISTINCT node, name FROM m))
  SELECT node, by_polarity, max(CASE WHEN rn = 1 THEN name END) AS name, coalesce(string_agg(CASE WHEN rn > 1 THEN name END, ',' ORDER BY name), '') AS synonyms FROM n JOIN q USING (node) GROUP BY node, by_polarity""")
def node_build(t):
    """Nodes with their entries by polarity, the shortest name, and the other names in order."""
    m = t.part.select(F.col("p_brand").alias("node"), "p_partkey", _kind().alias("polarity"), F.concat_ws(" ", "p_name", "p_size").alias("name"))
    entry = lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda v: v.cast("string")), " "))
    return L.nodes_of(m, "p_partkey", "polarity", "name").select("node", F.array_join(F.transform(F.map_entries("by_polarity"), entry), ",").alias("by_polarity"), "name", F.array_join("synonyms", ",").alias("synonyms"))


@query("""SELECT p_partkey, p_name AS plain, p_name || ' settings' AS screen, CASE WHEN p_size % 3 = 0 THEN 'device Settings' WHEN p_size % 3 = 1 THEN 'Samsung Members' ELSE 'device Settings' END AS surface,
  CASE WHEN p_size % 3 = 2 THEN p_name || ' level' ELSE p_name END AS name, p_name || '. ' || p_type AS doc FROM part""")
def catalog_texts(t):
    """Names, surfaces and documents out of wrapped catalogue texts."""
    k = F.col("p_size") % 3
    message = F.concat(F.lit("View "), F.initcap("p_name"), F.lit(" Settings"))
    wrapped = F.when(k == 0, F.concat(F.lit("Opens the "), "p_name", F.lit(" settings page via device Settings on the device."))).when(k == 1, F.concat(F.lit("Enables the "), "p_name", F.lit(" in Samsung Members on the device"))).otherwise(F.concat(F.lit("Retrieves the "), "p_name", F.lit(" level for monitoring.")))
    return t.part.select("p_partkey", S.plain_screen_name(message).alias("plain"), S.screen_name(message, wrapped, ["view"]).alias("screen"), S.surface(wrapped).alias("surface"), S.catalog_name(wrapped).alias("name"), T.joined_fields(F.col("p_name"), F.lit(" "), F.col("p_type")).alias("doc"))


@query("""
  SELECT p_partkey, p_name AS leaf, CASE WHEN p_size % 2 = 0 THEN p_brand END AS parent, 'Opens the ' || CASE WHEN p_size % 2 = 0 THEN lower(p_brand) || ' ' ELSE '' END || p_name || ' settings page' AS description,
         CASE WHEN p_size % 2 = 0 THEN 'Open ' || lower(p_brand) || ' ' || p_name || ' screen' ELSE 'Open the ' || p_name || ' settings screen' END AS message FROM part""")
def dummy_links(t):
    """Leaf and parent of screen paths, and the placeholder links that name them."""
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Settings > "), "p_brand", F.lit(" > "), "p_name")).otherwise(F.concat(F.lit("Settings / "), "p_name"))
    d = S.dummy_link(path)
    return t.part.select("p_partkey", S.screen_parts(path)["leaf"].alias("leaf"), S.screen_parts(path)["parent"].alias("parent"), d["description"].alias("description"), d["message"].alias("message"))


@query("""
  WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM s)
  SELECT vec_id, round(list_sum(u), 6) AS total, round(list_dot_product(u, u), 6) AS norm FROM u""")
def unit_vectors(t):
    """Vectors scaled to a norm of 1."""
    u = t.embeddings.select("vec_id", R.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(R.square(F.col("u")), 6).alias("norm"))


@query("""
  WITH v AS (SELECT vec_id // 10 AS k, vec_id % 10 AS no, embedding::DOUBLE[] AS e FROM embeddings)
  SELECT s.k, s.no AS section, i.no - 7 AS intent, round(least(greatest(round(list_dot_product(s.e, i.e) / sqrt(list_dot_product(s.e, s.e) * list_dot_product(i.e, i.e)), 9), 0), 1), 2) AS relevance FROM v s JOIN v i ON s.k = i.k AND s.no < 7 AND i.no >= 7""")
def section_relevance(t):
    """Relevance of each section of a request for each of its intents; tens of vectors stand for requests."""
    v = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("k"), (F.col("vec_id") % 10).alias("no"), "embedding")
    s = v.where("no < 7").select("k", F.col("no").alias("section"), F.col("embedding").alias("vec"))
    i = v.where("no >= 7").select("k", (F.col("no") - 7).alias("intent"), F.col("embedding").alias("ivec"))
    return R.section_relevance(s, i, "k")


@query("""
  WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'c' || (vec_id % 2) END AS component FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 6) AS score FROM s q JOIN s c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND (q.component IS NULL OR c.component IS NULL OR q.component = c.component)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rn FROM p WHERE score >= 0.3) SELECT query_id, entry_id, score FROM r WHERE rn = 1""")
def any_article_lookup(t):
    """The most similar other vector whose part agrees, whatever its label, above a higher threshold."""
    part = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("c"), F.col("vec_id") % 2))
    rows = t.embeddings.withColumn("component", part)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), F.col("component").alias("own"))
    cache = rows.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("c_vec"), "component")
    return L.any_article(asked, cache, 0.3, F.col("own").isNull() | F.col("component").isNull() | (F.col("own") == F.col("component")))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'manual' WHEN p_retailprice >= 1200 THEN 'catalog' WHEN p_size % 4 IN (1, 2) AND p_retailprice + 150 >= 1200 AND p_size % 3 = 0 THEN 'page' WHEN p_size % 2 = 1 THEN 'dummy' ELSE 'manual' END AS tier FROM part""")
def resolve_with_page(t):
    """Tiers of steps, with the fallback to a page on the path for steps that change a setting."""
    k = F.col("p_size") % 4
    verb = F.when(k == 0, "restart").when(k == 1, "enable").when(k == 2, "set").otherwise("open")
    path = F.when(F.col("p_size") % 2 == 1, "Settings > x").otherwise("x")
    return t.part.select("p_partkey", R.resolved(F.col("p_retailprice"), verb, path, F.col("p_retailprice") + 150, F.col("p_size") % 3 == 0, 1200.0).alias("tier"))


@query("""SELECT p_partkey, round(p_retailprice / 2000 + 0.6 * CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END + CASE p_size % 5 WHEN 0 THEN 0.25 WHEN 1 THEN -0.35 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN -0.3 ELSE 0 END, 6) AS score FROM part""")
def rescore_parts(t):
    """Scores with leaf, polarity and surface: the step wants to enable, so only an entry that disables clashes."""
    leaf = R.leaf_overlap(F.col("p_name"), F.concat(F.lit("view "), "p_name"), F.lit("other"), ["view"])
    half = R.leaf_overlap(F.lit("one"), F.lit("x"), F.lit("one two"), [])
    polar = R.polarity_bonus(F.lit("enable"), F.array_compact(F.array(_kind())))
    return t.part.select("p_partkey", F.round(R.rescored(F.col("p_retailprice"), F.lit(2000.0), F.when(F.col("p_size") % 2 == 0, leaf).otherwise(half), polar, F.col("p_size") % 7 == 0), 6).alias("score"))
