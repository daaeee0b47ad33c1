"""Steps, titles and plans flattened again; parts stand for the catalogue, events for stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T
from tessera.operators import plans as P
from tessera.operators import retrieval as R
from tessera.operators import schemas
from tessera.queries.registry import query

@query("""
  WITH w AS (SELECT p_partkey, list_filter(string_split(trim(p_name), ' '), lambda x: x <> '') AS w FROM part), c AS (SELECT p_partkey, w[1:3] AS c FROM w),
  f AS (SELECT p_partkey, lower(array_to_string(CASE WHEN len(c) = 0 THEN ['Troubleshooting', 'issue'] WHEN len(c) = 1 THEN list_append(c, 'issue') ELSE c END, ' ')) AS low FROM c)
  SELECT p_partkey, upper(substr(low, 1, 1)) || substr(low, 2) AS title FROM f""")
def title_trim(t):
    """Titles of two or three words from part names."""
    return t.part.select("p_partkey", S.title(F.col("p_name")).alias("title"))


@query()
def description_trim(t):
    """Descriptions of five to seven words from the turns."""
    return t.conversations.select("conv_id", "turn", S.description(F.col("text")).alias("description"))


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'onURL' WHEN p_size % 4 = 1 THEN 'offURL' WHEN p_size % 4 = 2 THEN 'updateURL' END AS polarity,
  'Follow these steps to perform this ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') || ' Troubleshooting.' AS goal FROM part""")
def catalog_clean(t):
    """Catalogue texts built around part names, and the names, polarities and goals found in them again."""
    k = F.col("p_size") % 4
    wrapped = F.when(k == 0, F.concat(F.lit("Enables the "), "p_name")).when(k == 1, F.concat(F.lit("Opens the "), "p_name", F.lit(" settings page."))).when(k == 2, F.concat(F.lit("Retrieves the "), "p_name", F.lit(" for monitoring"))).otherwise(F.concat(F.lit("Sets "), "p_name"))
    kind, message = F.when(k == 2, "updateURL"), F.when(k == 0, " OnURL").when(k == 1, "offurl").otherwise("x")
    return t.part.select("p_partkey", S.catalog_name(wrapped).alias("name"), S.polarity(kind, message).alias("polarity"), S.goal(F.concat("p_name", F.lit(" Troubleshooting Configuration"))).alias("goal"))


@query("""SELECT conv_id, string_agg(regexp_replace(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), '"', '', 'g'), ' ' ORDER BY turn) AS query FROM conversations GROUP BY conv_id""")
def unlist_queries(t):
    """Turns written as a numbered, quoted list and joined again."""
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit('. "'), F.regexp_replace(T.collapse(F.col("text")), '"', ""), F.lit('"'))
    listed = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return listed.select("conv_id", S.unlisted(F.col("text")).alias("query"))


@query("""SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' {{unknown}}' AS prompt FROM events""")
def template_render(t):
    """A prompt template filled from columns."""
    return t.events.select("event_id", S.rendered("user {{user}} did {{what}} {{unknown}}", {"user": F.col("user_id"), "what": F.col("event_type")}).alias("prompt"))


@query("""
  WITH d AS (SELECT conv_id, text, min(turn) AS first FROM conversations GROUP BY conv_id, text)
  SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) AS BIGINT) AS pos, text AS phrasing FROM d""")
def prewarm_phrasings(t):
    """One row for each phrasing of a conversation, repeats dropped, the first order kept."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    lists = t.conversations.groupBy("conv_id").agg(F.array_distinct(turns).alias("p"))
    return lists.select("conv_id", F.posexplode("p").alias("pos", "phrasing")).withColumn("pos", (F.col("pos") + 1).cast("long"))


@query("""
  WITH k AS (SELECT lower(c_mktsegment) AS key, min(c_custkey) AS by_key FROM customer GROUP BY 1), n AS (SELECT c_nationkey, min(c_custkey) AS by_nation FROM customer GROUP BY 1)
  SELECT s_suppkey, coalesce(by_key, by_nation) AS found FROM supplier LEFT JOIN k ON key = CASE WHEN s_suppkey % 2 = 0 THEN 'building' ELSE 'none' END LEFT JOIN n ON c_nationkey = s_nationkey""")
def fallback_join(t):
    """A first key, and a second one where it finds nothing."""
    k = t.customer.groupBy(F.lower("c_mktsegment").alias("key")).agg(F.min("c_custkey").alias("by_key"))
    n = t.customer.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.min("c_custkey").alias("by_nation"))
    s = t.supplier.withColumn("key", F.when(F.col("s_suppkey") % 2 == 0, "building").otherwise("none"))
    return s.join(k, "key", "left").join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("by_key", "by_nation").alias("found"))


_COS = "round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6)"


@query(f"""
  WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, {_COS} AS score, CASE WHEN c.vec_id % 2 = 0 THEN 'kit' ELSE 'cache' END AS source FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE source WHEN 'kit' THEN 0 ELSE 1 END, entry_id) AS rn FROM s WHERE score >= 0.25) SELECT query_id, entry_id, score, source FROM r WHERE rn = 1""")
def two_source_best(t):
    """The best of two tables for each query; the first table wins ties."""
    source = F.when(F.col("vec_id") % 2 == 0, "kit").otherwise("cache")
    s = R.best_against_all(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 1, source).select("query_id", F.col("vec_id").alias("entry_id"), "score", F.col("kind").alias("source"))
    return R.top(s.where("score >= 0.25"), ["query_id"], [F.desc("score"), F.desc("source"), "entry_id"], 1).drop("rank")


@query("""SELECT a.p_partkey, count(*) AS same_screen FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey""")
def same_screen(t):
    """How many other parts share a link; counted by group instead of paired."""
    n = t.part.groupBy("p_brand", "p_size").agg((F.count("*") - 1).alias("same_screen")).where("same_screen > 0")
    return t.part.join(n, ["p_brand", "p_size"]).select("p_partkey", "same_screen")


@query("""
  WITH r AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM r)
  SELECT user_id, event_type AS majority, n FROM o WHERE rn = 1""")
def majority_goal(t):
    """The most frequent type of each user; the first by name on ties."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "event_type")).alias("b")).select("user_id", F.col("b.event_type").alias("majority"), (-F.col("b.less")).alias("n"))


@query("""
  WITH b AS (SELECT user_id, event_id, event_type, bool_or(event_type = 'signup') OVER (PARTITION BY user_id) AS has, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS phase FROM events)
  SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN has THEN phase ELSE 0 END, event_id) AS INTEGER) AS place FROM b""")
def safe_mode_order(t):
    """Events of each user with enter, during and leave brought together if there is an enter."""
    phase = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    has = F.bool_or(F.col("event_type") == "signup").over(Window.partitionBy("user_id"))
    rows = t.events.withColumn("o", F.when(has, phase).otherwise(0))
    return P.ordered(rows, ["user_id"], ["o", "event_id"]).select("event_id", "place")


@query("""
  WITH s AS (SELECT user_id, event_id, value, event_type <> 'error' AS ok, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events),
  u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM s WHERE ok AND spent <= 100) SELECT user_id, event_id AS rung, round(spent, 4) AS spent FROM u WHERE rn = 1""")
def ladder_replay(t):
    """The first usable rung of each user's ladder within a budget."""
    spent = F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    s = t.events.withColumn("spent", spent).where((F.col("event_type") != "error") & (F.col("spent") <= 100))
    return s.groupBy("user_id").agg(F.min(F.struct("event_id", "spent")).alias("b")).select("user_id", F.col("b.event_id").alias("rung"), F.round("b.spent", 4).alias("spent"))


@query("""
  WITH p AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS a FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
  l AS (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS b FROM lineitem)
  SELECT o_custkey, 'A' || a || '.' || b AS id, 'contexts[' || (a - 1) || '].steps[' || (b - 1) || ']' AS path, l_partkey FROM p JOIN l ON l_orderkey = o_orderkey""")
def flatten_plan(t):
    """Nested plans flattened, with step ids and dotted paths."""
    rows = t.orders.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    plan = P.nested(rows, "o_custkey", "o_orderkey", "l_linenumber", "l_partkey")
    flat = plan.select("o_custkey", F.posexplode("plan").alias("a", "action")).select("o_custkey", "a", F.posexplode("action.steps").alias("b", "l_partkey"))
    return flat.select("o_custkey", F.format_string("A%d.%d", F.col("a") + 1, F.col("b") + 1).alias("id"), F.format_string("contexts[%d].steps[%d]", "a", "b").alias("path"), "l_partkey")


@query("""
  SELECT user_id, count(*) AS votes, count(*) FILTER (WHERE event_type = 'error') AS empty, count(*) FILTER (WHERE event_type = 'error') >= 2 AND bool_and(event_type = 'error') AS no_match,
         bool_or(event_type = 'click') AS primary_voted FROM events GROUP BY user_id""")
def vote_gate(t):
    """Empty answers count only together: at least two, and nothing else."""
    e = F.col("event_type") == "error"
    return t.events.groupBy("user_id").agg(F.count("*").alias("votes"), F.count_if(e).alias("empty"), ((F.count_if(e) >= 2) & F.bool_and(e)).alias("no_match"), F.bool_or(F.col("event_type") == "click").alias("primary_voted"))


@query("""
  WITH r AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS run, max(o_orderstatus) AS version FROM orders GROUP BY o_custkey), h AS (SELECT version, min(o_custkey) AS head FROM r GROUP BY version)
  SELECT r.o_custkey, r.version, r.run = x.run AS same_as_head FROM r JOIN h ON h.version = r.version JOIN r x ON x.o_custkey = h.head""")
def stale_runs(t):
    """Whether a run's list equals that of its version's headline run."""
    r = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("run"), F.max("o_orderstatus").alias("version"))
    head = r.groupBy("version").agg(F.min_by("run", "o_custkey").alias("head"))
    return r.join(head, "version").select("o_custkey", "version", (F.col("run") == F.col("head")).alias("same_as_head"))


@query("""
  WITH h AS (SELECT doc_id, split_part(text, chr(10), 1) AS head, text FROM documents),
  a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(head), '[a-z]+')) AS ids, regexp_extract_all(lower(substr(text, length(head) + 2)), '[a-z]+') AS allowed FROM h)
  SELECT doc_id, len(ids) AS n_ids, len(list_filter(ids, lambda x: NOT list_contains(allowed, x))) AS n_unknown FROM a""")
def answer_ids(t):
    """Ids of an answer (words of the first line) that its article (all other lines) doesn't have."""
    head = F.substring_index("text", "\n", 1)
    rows = t.documents.select("doc_id", F.array_distinct(T.words(head, "[a-z]+")).alias("i"), T.words(F.substr("text", F.length(head) + 2), "[a-z]+").alias("a"))
    return rows.select("doc_id", F.size("i").cast("long").alias("n_ids"), F.size(F.array_except("i", "a")).cast("long").alias("n_unknown"))


@query("""
  WITH s AS (SELECT user_id, event_type, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events)
  SELECT event_id, (ARRAY['cache','segment','extract','ground','resolve','order','compile','done'])[CAST((no - 1) % 8 + 1 AS INTEGER)] AS stage, CAST((no - 1) // 8 AS BIGINT) AS request FROM s""")
def stage_stream(t):
    """Events as stages of requests, eight to a request."""
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    stages = F.array(*[F.lit(s) for s in ("cache", "segment", "extract", "ground", "resolve", "order", "compile", "done")])
    return t.events.withColumn("no", no).select("event_id", F.element_at(stages, ((F.col("no") - 1) % 8 + 1).cast("int")).alias("stage"), F.floor((F.col("no") - 1) / 8).cast("long").alias("request"))


@query(r"""
  WITH t AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations),
  a AS (SELECT conv_id, arg_min(w, (turn, role)) AS ids FROM t GROUP BY conv_id),
  x AS (SELECT conv_id, turn, role, unnest(w[1:5]) AS id, generate_subscripts(w[1:5], 1) - 1 AS i FROM t),
  v AS (
    SELECT conv_id, turn, role, '$.goals[0].ids[' || i || ']' AS path, 'not_allowed' AS kind, id AS found FROM x JOIN a USING (conv_id) WHERE NOT list_contains(ids, id)
    UNION ALL SELECT conv_id, turn, role, '$.goals[0].topic', 'not_allowed', role FROM t WHERE role NOT IN ('user', 'assistant')
    UNION ALL SELECT conv_id, turn, role, '$.goals[0].ids', 'missing', NULL FROM t WHERE len(w) < 3
    UNION ALL SELECT conv_id, turn, role, '$.goals[0].ids', 'too_many', '5' FROM t WHERE len(w) >= 5)
  SELECT * FROM v WHERE NOT (kind = 'not_allowed' AND path LIKE '%ids%' AND EXISTS (SELECT 1 FROM t WHERE t.conv_id = v.conv_id AND t.turn = v.turn AND t.role = v.role AND len(t.w) < 3))""")
def answer_violations(t):
    """Turns as answers that pick words of their conversation's first turn: words it doesn't have, unknown topics, missing or long lists."""
    w = T.words(F.col("text"), "[a-z]+")
    rows = t.conversations.select("conv_id", "turn", "role", w.alias("w"))
    own = rows.groupBy("conv_id").agg(F.min_by("w", F.struct("turn", "role")).alias("ids"))
    picked = F.when(F.size("w") >= 3, F.slice("w", 1, 5))
    answers = rows.select("conv_id", "turn", "role", F.to_json(F.struct(F.array(F.struct(F.col("role").alias("topic"), picked.alias("ids"))).alias("goals"))).alias("answer")).join(own, "conv_id")
    shape = schemas.Fields({"goals": schemas.Items(schemas.Fields({"topic": schemas.Text(F.array(F.lit("user"), F.lit("assistant"))), "ids": schemas.Items(schemas.Text(F.col("ids")), 4)}))})
    return schemas.violations(answers, ["conv_id", "turn", "role"], "answer", shape)


@query("""SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 100""")
def seeded_sample(t):
    """A sample of 100 documents that a seed fixes, whatever the partitions."""
    return t.documents.select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42")).cast("binary")).alias("o")).orderBy("o", "doc_id").limit(100).select("doc_id")
