"""Plans: conversations stand for requests, their turns for actions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import sql_list
from tessera.operators import plans as P
from tessera.operators import segments
from tessera.operators.ranges import numbered
from tessera.queries.registry import query

_DIS = r"""CASE WHEN regexp_matches(lower(head), '\brestart(ing|s|ed)?\b|\breboot|\bsafe mode\b|\bsoftware updates?\b|\bsystem update|\bfirmware update|\bfactory (data )?reset\b|\breset\b.*\bfactory\b') THEN 5
  WHEN regexp_matches(head, '(?i)service cent|\bcontact\b|samsung support|customer support|\bcarrier\b|\brepair\b|authori[sz]ed') THEN 4 WHEN regexp_matches(head, '(?i)samsung members|diagnos') THEN 3
  WHEN regexp_matches(head, '(?i)reset network|network settings|\bsign (in|out)\b|re-?add|(remove|add) (the |your )?(\w+ )?account|\bre-?log') THEN 2
  WHEN regexp_matches(head, '(?i)clear (the )?(app''?s? )?(cache|data|storage)|\bcache\b|uninstall|reinstall|force stop|app updates?') THEN 1
  WHEN regexp_matches(text, '(?i)service cent|\bcontact\b|samsung support|customer support|\bcarrier\b|\brepair\b|authori[sz]ed') THEN 4 WHEN regexp_matches(text, '(?i)samsung members|diagnos') THEN 3 ELSE 0 END"""


@query(f"""WITH d AS (SELECT doc_id, source, {_DIS} AS rank FROM (SELECT doc_id, source, text, split_part(text, chr(10), 1) AS head FROM documents))
  SELECT doc_id, rank, row_number() OVER (ORDER BY rank, doc_id) AS place FROM d""")
def disruption_order(t):
    """Documents from the least to the most disruptive, numbered range by range: ids are parted into ranges inside each rank."""
    d = t.documents.select("doc_id", P.disruption(F.substring_index("text", "\n", 1), F.col("text")).alias("rank"))
    key = F.concat(F.col("rank").cast("string"), F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    return numbered(d.withColumn("o", key), "o", "place").select("doc_id", "rank", F.col("place").cast("long").alias("place"))


@query("""
  WITH a AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'backup' WHEN 1 THEN 'reset' ELSE 'other' END AS kind FROM conversations), b AS (SELECT *, max(CASE WHEN kind = 'backup' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM a),
  c AS (SELECT *, coalesce(kind = 'reset' AND turn < last, false) AS moves FROM b)
  SELECT conv_id, turn, kind, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN moves THEN last ELSE turn END, moves, CASE WHEN moves THEN -turn END) AS place FROM c""")
def dependency_order(t):
    """Turns of each conversation with dependents moved behind what they need."""
    kind = F.when(F.length("text") % 3 == 0, "backup").when(F.length("text") % 3 == 1, "reset").otherwise("other")
    rows = t.conversations.select("conv_id", "turn", kind.alias("kind"), F.array(kind).alias("provides"), F.when(kind == "reset", F.array(F.lit("backup"))).otherwise(F.array().cast("array<string>")).alias("needs"))
    return P.after_providers(rows, "conv_id", "turn", "provides", "needs").join(rows.select("conv_id", "turn", "kind"), ["conv_id", "turn"]).select("conv_id", "turn", "kind", F.col("now").alias("place"))


_SETS = r"t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)"
_ALIKE = "len(list_intersect(x.w, t.w)) >= {} * greatest(1, len(list_distinct(list_concat(x.w, t.w))))"
_NEAR, _LIKE = f"len(list_filter(r.kept, lambda x: {_ALIKE.format(0.6)}))", f"list_filter(r.heads, lambda x: {_ALIKE.format(0.2)})"


@query(f"""
  WITH RECURSIVE {_SETS}, r AS (
    SELECT conv_id, turn, n, [{{'h': turn, 'w': w}}] AS kept, 'kept' AS verdict FROM t WHERE n = 1
    UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN len(r.kept) < 10 AND {_NEAR} = 0 THEN list_append(r.kept, {{'h': t.turn, 'w': t.w}}) ELSE r.kept END, CASE WHEN len(r.kept) >= 10 THEN 'full' WHEN {_NEAR} > 0 THEN 'near_copy' ELSE 'kept' END
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
  SELECT conv_id, turn, verdict FROM r""")
def diversity_filter(t):
    """Turns of each conversation that are unlike those kept before."""
    return P.diverse(t.conversations, "conv_id", "turn", "text")


@query(f"""
  WITH RECURSIVE {_SETS}, r AS (
    SELECT conv_id, turn, n, [{{'h': turn, 'w': w}}] AS heads, turn AS head FROM t WHERE n = 1
    UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN len({_LIKE}) = 0 THEN list_append(r.heads, {{'h': t.turn, 'w': t.w}}) ELSE r.heads END, CASE WHEN len({_LIKE}) = 0 THEN t.turn ELSE {_LIKE}[1].h END
    FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)
  SELECT conv_id, turn, head FROM r""")
def goal_merge(t):
    """Turns of each conversation under the earliest one that they are like."""
    return P.first_come(t.conversations, "conv_id", "turn", "text", 0.2)


_SAME = "((a.screen = b.screen AND a.verb = b.verb) OR a.name = b.name OR len(list_intersect(a.words, b.words)) >= 0.8 * len(list_distinct(list_concat(a.words, b.words))))"


@query(f"""
  WITH RECURSIVE l AS (
    SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos, l_returnflag AS goal, lower(p_type) AS screen, l_linestatus AS verb, lower(p_name) AS name, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS words, l_discount AS relevance
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  p AS (SELECT a.l_orderkey, a.pos, a.goal, a.relevance, list({{'less': -b.relevance, 'goal': b.goal, 'pos': b.pos}} ORDER BY b.pos) FILTER (WHERE b.pos IS NOT NULL) AS others
        FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.pos > a.pos AND a.goal <> b.goal AND {_SAME} GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS i FROM p),
  r AS (
    SELECT l_orderkey, 0::BIGINT AS i, []::STRUCT(pos INTEGER, "by" INTEGER)[] AS gone FROM (SELECT DISTINCT l_orderkey FROM l)
    UNION ALL
    SELECT r.l_orderkey, n.i, CASE WHEN len(list_filter(r.gone, lambda g: g.pos = n.pos)) > 0 OR n.others IS NULL THEN r.gone ELSE list_concat(r.gone,
      list_transform(list_filter(list_prepend({{'less': -n.relevance, 'goal': n.goal, 'pos': n.pos}}, list_filter(n.others, lambda o: len(list_filter(r.gone, lambda g: g.pos = o.pos)) = 0)),
          lambda x: x.pos <> list_sort(list_prepend({{'less': -n.relevance, 'goal': n.goal, 'pos': n.pos}}, list_filter(n.others, lambda o: len(list_filter(r.gone, lambda g: g.pos = o.pos)) = 0)))[1].pos),
        lambda x: {{'pos': x.pos::INTEGER, 'by': list_sort(list_prepend({{'less': -n.relevance, 'goal': n.goal, 'pos': n.pos}}, list_filter(n.others, lambda o: len(list_filter(r.gone, lambda g: g.pos = o.pos)) = 0)))[1].pos::INTEGER}})) END
    FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.i = r.i + 1),
  z AS (SELECT l_orderkey, arg_max(gone, i) AS gone FROM r GROUP BY l_orderkey)
  SELECT l.l_orderkey, l.pos, list_filter(gone, lambda g: g.pos = l.pos)[1]."by" AS "by", list_filter(gone, lambda g: g.pos = l.pos)[1] IS NULL AS kept FROM l JOIN z USING (l_orderkey)""")
def goals_deduped(t):
    """Lines of an order that are one action in several goals, as return flags have it: the same type and status, name, or words."""
    l = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))  # noqa: E741
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))  # line numbers repeat
    rows = l.select("l_orderkey", pos.alias("pos"), F.col("l_returnflag").alias("goal"), F.col("p_type").alias("screen"), F.col("l_linestatus").alias("verb"), F.col("p_name").alias("name"), F.array("p_name", "p_brand").alias("steps"), F.col("l_discount").alias("relevance"))
    return P.across_goals(rows, "l_orderkey", "pos")


@query("""
  SELECT l_orderkey, round(least(greatest(0.4 * avg(l_discount * 10) + 0.3 * avg(l_tax * 10) + 0.3 * coalesce(avg(CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END END), 1.0), 0.0), 1.0), 6) AS score
  FROM lineitem GROUP BY l_orderkey""")
def goal_score(t):
    """Weighted score of each order from its lines."""
    links = F.avg(F.when(F.col("l_returnflag") != "N", F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.5)))
    return t.lineitem.groupBy("l_orderkey").agg(P.goal_score(F.avg(F.col("l_discount") * 10), F.avg(F.col("l_tax") * 10), links, digits=6).alias("score"))


_SENT = r"""
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
  p AS (SELECT doc_id, line_no, string_split(regexp_replace(trim(line), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM l WHERE trim(line) <> ''),
  s AS (SELECT doc_id, line_no, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS pos FROM p),
  n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, pos) AS no, sentence FROM s)"""
_STOP = sql_list(T.RANK_STOP)
_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP})))"
_A, _B = _TERMS.format("text"), _TERMS.format("source")


@query(f"""WITH {_SENT},
  q AS (SELECT conv_id AS doc_id, turn AS step_no, turn % 4 + 1 AS cites, text FROM conversations),
  j AS (SELECT q.doc_id, step_no, text, sentence AS source FROM q LEFT JOIN n ON n.doc_id = q.doc_id AND n.no = cites),
  k AS (SELECT *, {_A} AS a, {_B} AS b, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS ta, array_to_string(regexp_extract_all(lower(source), '[a-z0-9]+'), ' ') AS tb FROM j),
  z AS (SELECT *, CASE WHEN source IS NULL THEN 0 WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) * 1.0 / len(list_distinct(list_concat(a, b))), 2) END AS score FROM k)
  SELECT doc_id, step_no, CASE WHEN source IS NULL THEN 'unknown_source' WHEN instr(' ' || tb || ' ', ' ' || ta || ' ') > 0 THEN 'verbatim' WHEN score >= 0.5 THEN 'similar' WHEN len(list_intersect(a, b)) = 0 THEN 'no_shared_term' ELSE 'below_threshold' END AS verdict, score FROM z""")
def ground_steps(t):
    """Turns as steps that cite sentences of the document of the same number."""
    sources = segments.sentences(segments.lines(t.documents, "doc_id", "text"), "doc_id").select("doc_id", "no", F.col("sentence").alias("source"))
    steps = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("step_no"), (F.col("turn") % 4 + 1).alias("cites"), "text")
    return P.grounded(steps, sources, "doc_id")


@query(f"""WITH {_SENT},
  f AS (SELECT doc_id, no, sentence, length(sentence) AS size FROM n WHERE sentence LIKE '%the%' AND length(sentence) BETWEEN 20 AND 400),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, no) AS rn FROM f),
  k AS (SELECT doc_id, no, sentence FROM r WHERE rn <= 4)
  SELECT doc_id, count(*) AS n_actions, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS source_ids, md5(string_agg(sentence, chr(10) ORDER BY no)) AS plan_md5 FROM k GROUP BY doc_id""")
def rules_extract(t):
    """The four best sentences of each document by a rule, back in the document's order."""
    s = segments.sentences(segments.lines(t.documents, "doc_id", "text"), "doc_id").where(F.col("sentence").contains("the") & F.length("sentence").between(20, 400))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("sentence")), "no"))).where("rn <= 4")
    g = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "sentence"))).alias("a"))
    return g.select("doc_id", F.size("a").cast("long").alias("n_actions"), F.array_join(F.transform("a", lambda x: x["no"].cast("string")), ",").alias("source_ids"), F.md5(F.array_join(F.transform("a", lambda x: x["sentence"]), "\n").cast("binary")).alias("plan_md5"))


@query("""
  WITH g AS (SELECT o_custkey, o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS steps FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey)
  SELECT o_custkey, CAST(to_json(list({'no': o_orderkey, 'steps': steps} ORDER BY o_orderkey)) AS VARCHAR) AS plan FROM g GROUP BY o_custkey""")
def compile_plan(t):
    """Lines under orders under customers, nested in order and written as JSON."""
    rows = t.orders.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return P.nested(rows, "o_custkey", "o_orderkey", "l_linenumber", "l_partkey").select("o_custkey", F.to_json("plan").alias("plan"))
