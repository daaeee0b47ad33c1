"""Evaluation: orders and line items stand for gold and predictions, labels for verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.queries.registry import query

_G = """SELECT l_orderkey, l_linenumber, l_returnflag AS owner, CASE l_partkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'dummy' ELSE 'catalog' END AS gold_tier,
  CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'dummy' ELSE 'catalog' END AS tier, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 7 END AS predicted, [l_partkey % 7, l_partkey % 5] AS accepted, [l_partkey % 4] AS parents FROM lineitem"""
_REL = """CASE gold_tier WHEN 'manual' THEN CASE WHEN tier = 'manual' THEN 2 ELSE 0 END
  WHEN 'dummy' THEN CASE WHEN tier = 'dummy' THEN 2 WHEN tier = 'manual' OR list_contains(parents, predicted) THEN 1 ELSE 0 END
  ELSE CASE WHEN predicted IS NULL THEN 0 WHEN list_contains(accepted, predicted) THEN 2 WHEN list_contains(parents, predicted) THEN 1 ELSE 0 END END"""


def _graded(t):
    tier = lambda c: F.when(F.col(c) % 3 == 0, "manual").when(F.col(c) % 3 == 1, "dummy").otherwise("catalog")
    g = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("owner"), tier("l_partkey").alias("gold_tier"), tier("l_suppkey").alias("tier"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 7).alias("predicted"),
        F.array(F.col("l_partkey") % 7, F.col("l_partkey") % 5).alias("accepted"), F.array(F.col("l_partkey") % 4).alias("parents"),
    )
    return g.withColumn("relevance", E.graded(F.col("gold_tier"), F.col("tier"), F.col("predicted"), F.col("accepted"), F.col("parents")))


@query(f"""WITH g AS ({_G}), r AS (SELECT *, {_REL} AS relevance FROM g)
  SELECT owner, count(*) AS n, round(avg(CASE WHEN gold_tier = 'catalog' THEN CASE WHEN relevance = 2 THEN 1.0 ELSE 0 END END), 6) AS p_at_1, round(avg(relevance), 6) AS mean_relevance,
    round(avg(CASE WHEN tier = gold_tier THEN 1.0 ELSE 0 END), 6) AS tier_accuracy, round(avg(CASE WHEN tier <> 'manual' AND relevance = 0 THEN 1.0 ELSE 0 END), 6) AS wrong_rate,
    count(*) FILTER (WHERE relevance = 0) AS rel_0, count(*) FILTER (WHERE relevance = 1) AS rel_1, count(*) FILTER (WHERE relevance = 2) AS rel_2
  FROM r GROUP BY GROUPING SETS ((owner), ())""")
def precision_at_1(t):
    """The mapper scorecard by owner and overall, in one pass."""
    return E.scorecard(_graded(t), "owner")


@query("""
  SELECT d.source, d.lang, count(*) AS n, round(avg(quality + toxic), 6) AS mean_score, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE quality = 0) AS poor
  FROM labels l JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((d.source), (d.lang), ())""")
def judge_summary(t):
    """Verdicts by source, by language and overall."""
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    return rows.groupingSets([[F.col("source")], [F.col("lang")], []], F.col("source"), F.col("lang")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality") + F.col("toxic")), 6).alias("mean_score"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 0).alias("poor"))


@query("""
  WITH r AS (SELECT event_id, user_id % 40 AS owner, CAST(floor(value) AS BIGINT) AS plan FROM events),
  s AS (SELECT a.event_id, a.owner, a.plan, bool_or(b.owner = a.owner) AS own, bool_or(b.owner <> a.owner) AS other FROM r a LEFT JOIN r b ON a.plan = b.plan AND b.event_id < a.event_id GROUP BY ALL)
  SELECT owner, CASE WHEN own THEN 'own' WHEN other THEN 'other' ELSE 'new' END AS source, count(*) AS n FROM s GROUP BY ALL""")
def hit_provenance(t):
    """Whether an equal plan was served before to the same owner, to another, or to nobody."""
    r = t.events.select("event_id", (F.col("user_id") % 40).alias("owner"), F.floor("value").cast("long").alias("plan"))
    return E.provenance(r, "plan", "owner", "event_id").groupBy("owner", "source").agg(F.count("*").alias("n"))


_RULES = """
  SELECT o_orderkey, 'price_negative' AS code, 'fail' AS severity FROM orders WHERE o_totalprice < 0 UNION ALL
  SELECT o_orderkey, 'price_high', 'warn' FROM orders WHERE o_totalprice > 300000 UNION ALL
  SELECT o_orderkey, 'status_open', 'info' FROM orders WHERE o_orderstatus = 'O' UNION ALL
  SELECT o_orderkey, 'priority_shape', 'fail' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') UNION ALL
  SELECT o_orderkey, 'date_early', 'warn' FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'"""


def _findings(t):
    c = F.col
    rules = {
        "price_negative": ("fail", c("o_totalprice") < 0), "price_high": ("warn", c("o_totalprice") > 300000), "status_open": ("info", c("o_orderstatus") == "O"),
        "priority_shape": ("fail", ~c("o_orderpriority").rlike("^[1-5]-[A-Z ]+$")), "date_early": ("warn", c("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz")),
    }
    return E.findings(t.orders, ["o_orderkey"], rules)


@query(_RULES)
def rule_findings(t):
    """One row for each rule that an order breaks."""
    return _findings(t)


@query(f"""WITH f AS ({_RULES}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY o_orderkey) AS rn FROM f)
  SELECT code, count(*) AS n, max(severity) AS worst, string_agg(CASE WHEN rn <= 3 THEN CAST(o_orderkey AS VARCHAR) END, ',' ORDER BY o_orderkey) AS examples FROM r GROUP BY code""")
def finding_summary(t):
    """Findings by code with the first three examples."""
    return E.summary(_findings(t), "o_orderkey")


@query("""
  SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN s_suppkey IS NULL THEN 'no_owner' WHEN round(l_extendedprice / l_quantity, 2) <> round(p_retailprice, 2) THEN 'altered' ELSE 'ok' END AS verdict
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def link_audit(t):
    """Line items checked against the catalogue: unknown, without owner, altered, or fine."""
    j = t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    altered = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2) != F.round("p_retailprice", 2)
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("p_partkey").isNull(), "unknown").when(F.col("s_suppkey").isNull(), "no_owner").when(altered, "altered").otherwise("ok").alias("verdict"))


@query("""
  SELECT 'labels' AS name, count(*) AS n, count(DISTINCT doc_id) AS n_distinct, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans FROM labels UNION ALL
  SELECT 'conversations', count(*), count(DISTINCT (conv_id, turn)), count(*) FILTER (WHERE text IS NULL OR text = '') FROM conversations UNION ALL
  SELECT 'benchmark', count(*), count(DISTINCT lower(text)), count(*) FILTER (WHERE text IS NULL) FROM benchmark""")
def set_validation(t):
    """Sizes, uniqueness and orphans of the evaluation tables."""
    orphans = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))
    a = t.labels.agg(F.lit("labels").alias("name"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct")).crossJoin(orphans)
    b = t.conversations.agg(F.lit("conversations").alias("name"), F.count("*").alias("n"), F.count_distinct("conv_id", "turn").alias("n_distinct"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("orphans"))
    c = t.benchmark.agg(F.lit("benchmark").alias("name"), F.count("*").alias("n"), F.count_distinct(F.lower("text")).alias("n_distinct"), F.count_if(F.col("text").isNull()).alias("orphans"))
    return a.unionByName(b).unionByName(c)


@query("""
  SELECT th AS threshold, count(*) AS n, round(avg(CASE WHEN value >= th THEN 1.0 ELSE 0 END), 6) AS hit_rate, count(*) FILTER (WHERE value >= th AND event_type = 'error') AS wrong
  FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (20.0), (50.0), (100.0)) v(th) GROUP BY th""")
def threshold_sweep(t):
    """Hit and wrong rates at six thresholds, scored in one pass with a column pair for each."""
    at = [1.0, 5.0, 10.0, 20.0, 50.0, 100.0]
    v, wrong = F.col("value"), F.col("event_type") == "error"
    one = t.events.agg(F.count("*").alias("n"), *[F.count_if(v >= x).alias(f"h{i}") for i, x in enumerate(at)], *[F.count_if((v >= x) & wrong).alias(f"w{i}") for i, x in enumerate(at)])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.round(F.col(f"h{i}") / F.col("n"), 6).alias("hit_rate"), F.col(f"w{i}").alias("wrong")) for i, x in enumerate(at)]))
    return one.select("n", rows.alias("r")).select("r.threshold", "n", "r.hit_rate", "r.wrong")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE k = 0) AS short, count(*) FILTER (WHERE k = 1) AS middle, count(*) FILTER (WHERE k = 2) AS long
  FROM (SELECT lang, CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 5000 THEN 1 ELSE 2 END AS k FROM documents) GROUP BY lang""")
def fire_rate_pivot(t):
    """Documents of each language by length, pivoted."""
    k = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    p = t.documents.select("lang", k.alias("k")).groupBy("lang").pivot("k", ["short", "middle", "long"]).count().na.fill(0)
    return p.withColumn("n", F.col("short") + F.col("middle") + F.col("long"))


@query("""
  WITH w AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS w FROM conversations WHERE role = 'user' GROUP BY conv_id),
  a AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS w FROM conversations WHERE role <> 'user' GROUP BY conv_id)
  SELECT conv_id, len(list_intersect(w.w, a.w)) AS shared, round(len(list_intersect(w.w, a.w)) * 1.0 / len(w.w), 6) AS coverage FROM w JOIN a USING (conv_id) WHERE len(w.w) > 0""")
def answer_coverage(t):
    """How much of a user's vocabulary the answers take up."""
    side = lambda cond: t.conversations.where(cond).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list(T.words(F.col("text"))))).alias("w"))
    u, a = side("role = 'user'").withColumnRenamed("w", "u"), side("role <> 'user'").withColumnRenamed("w", "a")
    n = F.size(F.array_intersect("u", "a"))
    return u.join(a, "conv_id").where(F.size("u") > 0).select("conv_id", n.cast("long").alias("shared"), F.round(n / F.size("u"), 6).alias("coverage"))


@query("""
  WITH r AS (SELECT source, avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN toxic IS NOT NULL THEN 1.0 - toxic END) AS b FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
  SELECT source, round(15 * (a + coalesce(b, a)) / 2, 4) AS points FROM r""")
def block_scores(t):
    """Points of a block from the rates that were measured."""
    r = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.avg((F.col("n_chars") > 200).cast("double")).alias("a"), F.avg(1.0 - F.col("toxic")).alias("b"))
    return r.select("source", E.block_score([F.col("a"), F.col("b")], 15.0).alias("points"))
