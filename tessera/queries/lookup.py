"""Lookups over embeddings and conversations, clusters over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lookup as L
from tessera.operators import retrieval as R
from tessera.operators import segments
from tessera.operators.slots import latest
from tessera.queries.registry import query

_COS = "round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 6)"
_SIDE = """SELECT vec_id, label, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'c' || (vec_id % 2) END AS component, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE 's' || (vec_id % 2) END AS symptom,
  CASE WHEN vec_id % 5 = 0 THEN 'configure' ELSE 'fault' END AS intent, CASE WHEN vec_id % 7 = 0 THEN 'add' WHEN vec_id % 7 = 1 THEN 'remove' END AS direction, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE 'v' || (vec_id % 11 // 10) END AS version FROM embeddings"""
_GUARD = f"""
  s AS ({_SIDE}),
  p AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_id, {_COS} AS score FROM s q JOIN s c ON q.label = c.label AND q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        WHERE (q.component IS NULL OR c.component IS NULL OR q.component = c.component) AND (q.symptom IS NULL OR (c.symptom IS NOT NULL AND q.symptom = c.symptom))
          AND (q.intent IS NULL OR c.intent IS NULL OR q.intent = c.intent) AND (q.direction IS NULL OR c.direction IS NULL OR q.direction = c.direction)
          AND (q.version IS NULL OR c.version IS NULL OR q.version = c.version)),
  g AS (SELECT query_id, entry_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rn FROM p WHERE score >= 0.2)"""


def _sides(t):
    v = F.col("vec_id")
    s = t.embeddings.select(
        v, F.col("label").alias("siis_hash"), F.col("embedding").alias("vec"), F.when(v % 3 != 0, F.concat(F.lit("c"), v % 2)).alias("component"), F.when(v % 4 != 0, F.concat(F.lit("s"), v % 2)).alias("symptom"),
        F.when(v % 5 == 0, "configure").otherwise("fault").alias("intent"), F.when(v % 7 == 0, "add").when(v % 7 == 1, "remove").alias("direction"), F.when(v % 11 != 0, F.concat(F.lit("v"), F.floor(v % 11 / 10))).alias("version"),
    )
    names = ["component", "symptom", "intent", "direction", "vec", "version"]
    q = s.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "siis_hash", *[F.col(n).alias(f"q_{n}") for n in names])
    c = s.select(F.col("vec_id").alias("entry_id"), "siis_hash", *[F.col(n).alias(f"c_{n}") for n in names])
    return q, c


@query(f"WITH {_GUARD} SELECT query_id, entry_id, score FROM g WHERE rn = 1")
def guarded_lookup(t):
    """The most similar other vector of the same label whose slots agree, for every hundredth one."""
    return L.guarded(*_sides(t), least=0.2)


@query(f"""WITH {_GUARD}, e AS (SELECT q.vec_id AS query_id, min(c.vec_id) AS entry_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND q.vec_id // 10 % 13 = c.vec_id // 10 % 97 GROUP BY q.vec_id)
  SELECT q.vec_id AS query_id, coalesce(e.entry_id, g.entry_id) AS entry_id, CASE WHEN e.entry_id IS NOT NULL THEN 'exact' WHEN g.entry_id IS NOT NULL THEN 'semantic' ELSE 'miss' END AS tier
  FROM embeddings q LEFT JOIN e ON e.query_id = q.vec_id LEFT JOIN g ON g.query_id = q.vec_id AND g.rn = 1 WHERE q.vec_id % 100 = 0""")
def tiered_lookup(t):
    """Exact key first, then the guarded neighbour, then a miss."""
    q, c = _sides(t)
    key = lambda rows, n, m: rows.withColumn("key", F.concat_ws("|", "siis_hash", F.floor(F.col(n) / 10) % m))
    return L.tiered(key(q, "query_id", 13).select("query_id", "key"), key(c, "entry_id", 97).select("entry_id", "key"), L.guarded(q, c, least=0.2))


@query("""
  WITH s AS (SELECT q.vec_id AS query_id, c.label, max(round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6)) AS score
             FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id GROUP BY q.vec_id, c.label),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn, coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, label), 0) AS second FROM s)
  SELECT query_id, label, score, second FROM r WHERE rn = 1 AND score >= 0.3 AND round(score - second, 6) >= 0.01""")
def nearest_with_margin(t):
    """The label whose best vector is nearest to each vector, if it is clearly ahead of the next."""
    s = R.best_against_all(t.embeddings, t.embeddings, 1, F.col("label"), kinds=2).select("query_id", F.col("kind").cast("int").alias("label"), "score")
    return R.with_margin(s, ["query_id"], "score", "label", 0.3, 0.01)


@query("""
  WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'link:' || p_brand || p_size ELSE 'text:' || p_name END AS grp, p_name AS d FROM part),
  h AS (SELECT grp, arg_min(d, p_partkey) AS head FROM n GROUP BY grp), k AS (SELECT head, printf('SN-%04d', row_number() OVER (ORDER BY head)) AS node FROM (SELECT DISTINCT head FROM h))
  SELECT p_partkey, node FROM n JOIN h USING (grp) JOIN k USING (head)""")
def cluster_nodes(t):
    """Parts grouped by link or description, folded, and numbered."""
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", "p_size")).alias("link"), F.col("p_name").alias("description"))
    return L.clusters(rows, "p_partkey", "link", "description")


@query("""
  WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM f)
  SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island, event_type""")
def islands(t):
    """Runs of equal event types of each user."""
    return segments.islands(t.events, ["user_id"], "event_id", "event_type")


@query("""
  WITH s AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w >= 100 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s)
  SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first FROM r GROUP BY user_id, run""")
def id_runs(t):
    """Event numbers of each user split where they jump by 100 or more."""
    r = segments.runs(t.events, ["user_id"], "event_id", 100)
    return r.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""
  WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events)
  SELECT DISTINCT n.user_id, n.no FROM n JOIN n f ON f.user_id = n.user_id AND f.event_type = 'error' AND n.no BETWEEN f.no - 2 AND f.no + 8""")
def lookahead_expand(t):
    """Events up to two before or eight after an error of the same user."""
    n = t.events.withColumn("no", F.row_number().over(R.Window.partitionBy("user_id").orderBy("event_id"))).withColumn("flag", F.col("event_type") == "error")
    return segments.look_around(n, "user_id", "no", "flag", back=8, ahead=2)


@query("""
  WITH r AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  SELECT user_id, event_type, value, ts FROM r WHERE rn = 1""")
def upsert_latest(t):
    """The newest value of each key, as an upsert leaves it."""
    return latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value", "ts")


@query("""
  WITH q AS (SELECT conv_id, turn, sha256(lower(text)) AS k FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) AS rn FROM q)
  SELECT conv_id, turn, substr(k, 1, 24) AS key, rn > 1 AS reused FROM r""")
def memo_reuse(t):
    """Whether an equal prompt came before, as a memo would answer it."""
    q = t.conversations.select("conv_id", "turn", F.sha2(F.lower("text").cast("binary"), 256).alias("k"), F.struct("conv_id", "turn").alias("o"))
    f = q.groupBy("k").agg(F.min("o").alias("first"))
    return q.join(f, "k").select("conv_id", "turn", F.substring("k", 1, 24).alias("key"), (F.col("first") < F.col("o")).alias("reused"))


@query("""
  SELECT a.lang AS lang_a, b.lang AS lang_b, count(*) AS n_pairs FROM documents a JOIN documents b ON a.source = b.source AND a.lang <> b.lang GROUP BY a.lang, b.lang""")
def mismatch_pairs(t):
    """Pairs of documents of one source in different languages, counted without being built."""
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("a.lang") != F.col("b.lang"))).groupBy(F.col("a.lang").alias("lang_a"), F.col("b.lang").alias("lang_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).cast("long").alias("n_pairs"))


@query("""
  WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), e(before, after) AS (VALUES (['the', 'and'], 'backup'), (['der', 'und'], 'reset'), (['que', 'de'], 'safe'))
  SELECT doc_id, after FROM w JOIN e ON len(list_intersect(w.w, e.before)) = len(e.before)""")
def set_containment(t):
    """Edges whose words a document holds, by a broadcast table of edges and an equi-join on words."""
    edges = [(["the", "and"], "backup"), (["der", "und"], "reset"), (["que", "de"], "safe")]
    e = F.broadcast(t.documents.sparkSession.createDataFrame([(w, a, len(b)) for b, a in edges for w in b], "word string, after string, need int"))
    w = t.documents.select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return w.join(e, "word").groupBy("doc_id", "after", "need").count().where("count = need").select("doc_id", "after")
