"""Ranking queries over documents, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import sql_list
from tessera.operators import impacts as I
from tessera.operators import retrieval as R
from tessera.queries.registry import query
from tessera.sources import files

_STOP = sql_list(T.RANK_STOP)


def _terms(table: str, key: str, column: str, extra: str = "") -> str:
    return f"SELECT {key}, unnest(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}))) AS term{extra} FROM {table}"


_BM25 = f"""
  d AS ({_terms("documents", "doc_id", "text")}), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
  q AS (SELECT item_id, term, count(*) AS qn FROM ({_terms("benchmark", "item_id", "text")}) GROUP BY ALL),
  ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sc AS (SELECT item_id, tf.doc_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
         FROM tf JOIN q USING (term) JOIN df USING (term) JOIN ln ON ln.doc_id = tf.doc_id, st GROUP BY item_id, tf.doc_id),
  bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""
_JAC = f"""
  dw AS (SELECT DISTINCT doc_id, term FROM ({_terms("documents", "doc_id", "text")})), qw AS (SELECT DISTINCT item_id, term FROM ({_terms("benchmark", "item_id", "text")})),
  dn AS (SELECT doc_id, count(*) AS dn FROM dw GROUP BY doc_id), qc AS (SELECT item_id, count(*) AS qc FROM qw GROUP BY item_id),
  js AS (SELECT item_id, doc_id, round(count(*) * 1.0 / (any_value(dn) + any_value(qc) - count(*)), 6) AS score FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qc USING (item_id) GROUP BY item_id, doc_id),
  jr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM js)"""


def _index(t, asked):
    return I.impact_index(t.documents, "doc_id", {"text": 1}, asked)


def _bm25(t, k=20):
    asked = files.stored(R.query_terms(t.benchmark, "item_id", "text"), "asked")
    return I.bm25_pruned(_index(t, asked), asked, "item_id", k).best.withColumnRenamed("key", "doc_id")


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 20")
def bm25_topk(t):
    """The 20 best documents for each benchmark item by BM25."""
    return _bm25(t)


@query(f"""
  WITH p AS (SELECT p_partkey, term, sum(w) AS tf FROM (
      {_terms("part", "p_partkey", "p_name", ", 2 AS w")} UNION ALL {_terms("part", "p_partkey", "p_type", ", 2 AS w")} UNION ALL {_terms("part", "p_partkey", "p_brand", ", 1 AS w")}) GROUP BY p_partkey, term),
  q AS (SELECT n_nationkey, term, count(*) AS qn FROM (SELECT n_nationkey, unnest(qt) AS term FROM (SELECT n_nationkey, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP})) AS qt FROM nation JOIN part ON p_partkey = n_nationkey + 1)) GROUP BY ALL),
  ln AS (SELECT p_partkey, sum(tf) AS len FROM p GROUP BY p_partkey), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM ln), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  sc AS (SELECT n_nationkey, p.p_partkey, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
         FROM p JOIN q USING (term) JOIN df USING (term) JOIN ln ON ln.p_partkey = p.p_partkey, st GROUP BY n_nationkey, p.p_partkey),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM sc WHERE score > 0)
  SELECT n_nationkey, p_partkey, score, rank FROM r WHERE rank <= 3""")
def bm25_weighted(t):
    """Parts like one chosen for each nation, over weighted fields."""
    index = I.impact_index(t.part, "p_partkey", {"p_name": 2, "p_type": 2, "p_brand": 1})
    asked = t.nation.join(t.part, F.col("p_partkey") == F.col("n_nationkey") + 1).select("n_nationkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return I.bm25_pruned(index, R.query_terms(asked, "n_nationkey", "text"), "n_nationkey", 3).best.withColumnRenamed("key", "p_partkey")


@query(f"""
  WITH p AS (SELECT p_partkey, term, count(*) AS tf FROM ({_terms("part", "p_partkey", "p_name || ' ' || p_brand")}) GROUP BY ALL),
  a AS (SELECT o_orderpriority AS priority, min(p_partkey) AS chosen FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderpriority),
  q AS (SELECT priority, term, count(*) AS qn FROM (SELECT priority, unnest(list_filter(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+'), lambda x: x NOT IN ({_STOP}))) AS term FROM a JOIN part ON p_partkey = chosen) GROUP BY ALL),
  ln AS (SELECT p_partkey, sum(tf) AS len FROM p GROUP BY p_partkey), st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM ln), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  sc AS (SELECT priority, p.p_partkey, sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
         FROM p JOIN q USING (term) JOIN df USING (term) JOIN ln ON ln.p_partkey = p.p_partkey, st GROUP BY priority, p.p_partkey),
  b AS (SELECT sc.priority, sc.p_partkey, round(score + CASE WHEN part.p_type = w.p_type THEN 1.5 ELSE 0 END, 6) AS score FROM sc JOIN part ON part.p_partkey = sc.p_partkey JOIN a ON a.priority = sc.priority JOIN part w ON w.p_partkey = chosen WHERE score > 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY priority ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM b)
  SELECT priority, p_partkey, score, rank FROM r WHERE rank <= 8""")
def bm25_polarity(t):
    """Parts like the first one ordered under each priority; those of its type are wanted and gain a bonus. Ties by key."""
    index = I.impact_index(t.part, "p_partkey", {"p_name": 1, "p_brand": 1})
    sold = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    chosen = sold.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.min("p_partkey").alias("p_partkey")).join(t.part, "p_partkey")
    asked = R.query_terms(chosen.select("priority", F.concat_ws(" ", "p_name", "p_brand").alias("text")), "priority", "text")
    kinds = t.part.select(F.col("p_partkey").alias("key"), F.col("p_type").alias("kind"))
    found = I.bm25_pruned(index, asked, "priority", 8, kinds, chosen.select("priority", F.col("p_type").alias("kind")))
    return found.best.withColumnRenamed("key", "p_partkey")


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"


@query(f"""
  WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def cosine_topk(t):
    """The five nearest vectors of every hundredth one."""
    return R.dense_top(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 5)


_RRF = f"""{_BM25}, {_JAC},
  l AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM jr WHERE rank <= 20),
  f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY item_id, doc_id),
  rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f)"""


def _fused(t, k):
    asked = files.stored(R.query_terms(t.benchmark, "item_id", "text"), "asked")
    index = _index(t, asked)
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("qn"))
    lists = [I.bm25_pruned(index, asked, "item_id", 20).best, I.overlap_pruned(index, asked, "item_id", 20, sizes).best]
    return R.rrf([x.withColumnRenamed("key", "doc_id") for x in lists], "item_id", "doc_id", k)


@query(f"WITH {_RRF} SELECT item_id, doc_id, score, rank FROM rr WHERE rank <= 3")
def hybrid_rrf(t):
    """BM25 and word overlap fused by reciprocal ranks: the three best documents of each item."""
    return _fused(t, 3)


_RESCORE = f"""{_RRF},
  g AS (SELECT rr.*, score / max(score) OVER (PARTITION BY item_id) AS rel FROM rr WHERE rank <= 10),
  h AS (SELECT g.item_id, g.doc_id, g.rel, coalesce(js.score, 0) AS leaf, CASE WHEN d.lang = 'en' THEN 0.25 ELSE -0.35 END AS polarity, CASE WHEN d.text LIKE '%|%' THEN -0.3 ELSE 0 END AS surface
        FROM g JOIN documents d ON d.doc_id = g.doc_id LEFT JOIN js ON js.item_id = g.item_id AND js.doc_id = g.doc_id),
  z AS (SELECT item_id, doc_id, round(rel + 0.6 * leaf + polarity + surface, 6) AS score FROM h),
  y AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, lead(score) OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS next FROM z)"""


def _rescored(t):
    g = files.stored(_fused(t, 10).withColumn("rel", F.col("score") / F.max("score").over(R.Window.partitionBy("item_id"))).select("item_id", "doc_id", "rel"), "fused")
    near = R.overlap_of(g.select("item_id", "doc_id"), t.documents, "doc_id", t.benchmark, "item_id").withColumnRenamed("overlap", "leaf")
    d = t.documents.select("doc_id", "lang", F.col("text").contains("|").alias("table"))
    h = g.join(near, ["item_id", "doc_id"], "left").join(d, "doc_id")
    score = F.col("rel") + 0.6 * F.coalesce("leaf", F.lit(0.0)) + F.when(F.col("lang") == "en", 0.25).otherwise(-0.35) + F.when(F.col("table"), -0.3).otherwise(0.0)
    z = h.select("item_id", "doc_id", F.round(score, 6).alias("score"))
    w = R.Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return z.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))


@query(f"WITH {_RESCORE} SELECT item_id, doc_id, score, rank FROM y WHERE rank <= 3")
def rescore_leaf(t):
    """Fused candidates re-scored by word overlap, language and shape."""
    return _rescored(t).where("rank <= 3").drop("next")


@query(f"""WITH {_RESCORE}
  SELECT item_id, doc_id, score, CASE WHEN score >= 1.2 THEN 'catalog' WHEN doc_id % 2 = 0 THEN 'dummy' ELSE 'manual' END AS tier, round(least(score / 1.85, 1.0), 2) AS confidence,
         score < 1.2 OR score - coalesce(next, 0) < 0.1 AS uncertain
  FROM y WHERE rank = 1""")
def resolve_tiers(t):
    """The best candidate of each item, its tier, confidence and whether it is uncertain."""
    best = _rescored(t).where("rank = 1")
    path = F.when(F.col("doc_id") % 2 == 0, "settings > page").otherwise("page")
    s = F.col("score")
    return best.select("item_id", "doc_id", "score", R.tier(s, F.lit("open"), path, 1.2).alias("tier"), R.confidence(s).alias("confidence"), ((s < 1.2) | (s - F.coalesce("next", F.lit(0.0)) < 0.1)).alias("uncertain"))


@query("""
  WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents)
  SELECT count(*) AS n_docs, sum(n) AS n_tokens, round(avg(n), 6) AS mean_len, max(n) AS max_len, sum(len(w)) AS n_postings FROM d""")
def corpus_stats(t):
    """Sizes that ranking needs: documents, tokens, mean length and postings."""
    w = T.words(F.col("text"))
    d = t.documents.select(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k"))
    return d.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.round(F.avg("n"), 6).alias("mean_len"), F.max("n").cast("long").alias("max_len"), F.sum("k").alias("n_postings"))
