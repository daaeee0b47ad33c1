"""Judged plans: a conversation is a plan, the lines of its answers are the steps, judged by the words of what was asked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import judging as J
from tessera.queries.registry import query


def _plans(t):
    """Each conversation with its steps, links and a raw verdict, which names unknown verdicts, issues and actions too."""
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    c = t.conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.col("turn").alias("turn"), i.alias("pos"), x.alias("line")))
    plans = c.groupBy("conv_id").agg(
        F.count_if(user).alias("users"), F.count_if(F.col("role") == "system").alias("systems"), F.max_by("role", "turn").alias("last"),
        F.array_distinct(F.flatten(F.collect_list(F.when(user, T.words(F.col("text")))))).alias("asked"), F.array_sort(F.flatten(F.collect_list(F.when(answer, lines)))).alias("lines"),
    )
    step = lambda x: F.concat_ws(".", x["turn"].cast("string"), x["pos"].cast("string"))
    counted = F.transform("lines", lambda x: F.struct(step(x).alias("id"), x["line"].alias("line"), F.size(F.array_distinct(T.words(x["line"]))).alias("n"), F.size(F.array_intersect(T.words(x["line"]), F.col("asked"))).alias("k")))
    plans = plans.withColumn("counted", counted)
    said = F.transform(
        F.filter("counted", lambda s: s["n"] >= 3),
        lambda s: F.struct(
            F.concat(F.lit(" "), s["id"]).alias("id"),
            F.when(2 * s["k"] >= s["n"], "correct").when(5 * s["k"] >= s["n"], "partial").otherwise("off").alias("verdict"),
            F.when(s["n"] < 6, "fragment").when(~F.endswith(s["line"], F.lit(".")), "not_an_instruction").otherwise("unsure").alias("issue"),
        ),
    )
    turns = F.array_distinct(F.transform("lines", lambda x: x["turn"].cast("string")))
    links = F.transform(F.concat(turns, F.array(F.lit("none"))), lambda a: F.struct(a.alias("action"), (F.size(F.filter("lines", lambda y: y["turn"].cast("string") == a)) - 1).alias("relevance")))
    length = lambda i: F.length(F.get("lines", i)["line"])
    plans = plans.withColumn("said", said)
    correct = F.size(F.filter("said", lambda s: s["verdict"] == "correct"))
    verdict = F.struct(
        F.floor(F.try_divide(4 * correct, F.size("lines"))).alias("score"), F.col("said").alias("steps"), links.alias("links"),
        F.when(F.col("last") == "user", F.array(F.lit("an answer"))).alias("missing"), F.when(F.size("lines") > 1, length(F.lit(0)) <= length(F.size("lines") - 1)).alias("order_ok"),
    )
    return plans.select(
        "conv_id", F.when(F.col("systems") > 0, "system").otherwise("plain").alias("source"), F.when(F.col("users") > 3, "many").when(F.col("users") > 1, "few").alias("domain"), (F.col("last") == "assistant").alias("self_graded"),
        F.transform("counted", lambda s: s["id"]).alias("step_ids"), turns.alias("link_ids"), F.when(F.col("users") > 0, verdict).alias("verdict"),
    )


_JUDGED = """c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
  g AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'system') AS systems, arg_max(role, turn) AS last FROM c GROUP BY conv_id),
  u AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS asked FROM c WHERE role = 'user' GROUP BY conv_id),
  l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM c WHERE role = 'assistant'),
  k AS (SELECT l.*, asked IS NOT NULL AS judged, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w, len(w) AS n, len(list_intersect(w, asked)) AS k FROM l LEFT JOIN u USING (conv_id)),
  s AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN 2 * k >= n THEN 'correct' WHEN 5 * k >= n THEN 'partial' ELSE 'wrong' END AS verdict,
    CASE WHEN 2 * k >= n THEN 'none' WHEN n < 6 THEN 'fragment' WHEN NOT ends_with(line, '.') THEN 'not_an_instruction' ELSE 'none' END AS issue FROM k),
  a AS (SELECT conv_id, count(*) AS n_steps, count(*) FILTER (WHERE verdict = 'correct') AS n_correct, arg_min(length(line), (turn, pos)) AS first_line, arg_max(length(line), (turn, pos)) AS last_line FROM s GROUP BY conv_id),
  p AS (SELECT conv_id, coalesce(n_steps, 0) AS n_steps, n_steps IS NULL OR users > 0 AS judged, CASE WHEN n_steps IS NULL THEN 0 ELSE least(3, 4 * n_correct // n_steps) END AS score,
    coalesce(first_line <= last_line, true) AS order_ok, last, CASE WHEN systems > 0 THEN 'system' ELSE 'plain' END AS source, CASE WHEN users > 3 THEN 'many' WHEN users > 1 THEN 'few' ELSE 'unknown' END AS domain FROM g LEFT JOIN a USING (conv_id)),
  j AS (SELECT * FROM p WHERE judged), v AS (SELECT * FROM s WHERE judged AND verdict IS NOT NULL), o AS (SELECT least(2, count(*) - 1) AS relevance FROM s WHERE judged GROUP BY conv_id, turn)"""


@query(f"""WITH {_JUDGED}
  SELECT 'plans' AS section, 'n' AS key, count(*) AS n, NULL::DOUBLE AS mean FROM p UNION ALL SELECT 'plans', 'judged', count(*), NULL FROM j UNION ALL
  SELECT 'plans', 'failed', count(*), NULL FROM p WHERE NOT judged UNION ALL SELECT 'plans', 'empty', count(*), NULL FROM j WHERE n_steps = 0 UNION ALL
  SELECT 'plans', 'self_graded', count(*), NULL FROM j WHERE n_steps > 0 AND last = 'assistant' UNION ALL SELECT 'plans', 'order_problems', count(*), NULL FROM j WHERE n_steps > 0 AND NOT order_ok UNION ALL
  SELECT 'plans', 'missing_a_fix', count(*), NULL FROM j WHERE n_steps > 0 AND last = 'user' UNION ALL SELECT 'score', 'mean', count(*), round(avg(score), 3) FROM j UNION ALL
  SELECT 'score', CAST(b AS VARCHAR), count(conv_id), NULL FROM range(4) r(b) LEFT JOIN j ON score = b GROUP BY b UNION ALL
  SELECT 'source', source, count(*), round(avg(score), 3) FROM j GROUP BY source UNION ALL SELECT 'domain', domain, count(*), round(avg(score), 3) FROM j GROUP BY domain UNION ALL
  SELECT 'steps', 'credit', count(*), round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END), 3) FROM v UNION ALL
  SELECT 'steps', 'unjudged', count(*), NULL FROM s WHERE judged AND verdict IS NULL UNION ALL
  SELECT 'verdict', x, count(conv_id), NULL FROM (VALUES ('correct'), ('partial'), ('wrong')) t(x) LEFT JOIN v ON verdict = x GROUP BY x UNION ALL
  SELECT 'issue', issue, count(*), NULL FROM v WHERE issue <> 'none' GROUP BY issue UNION ALL SELECT 'links', 'relevance', count(*), round(avg(relevance), 3) FROM o""")
def judge_report(t):
    """The judge's whole summary: counts of plans, score histogram, means by source and domain, credit, verdicts, issues, links."""
    return J.summary(J.cleaned(_plans(t)))


@query(f"""WITH {_JUDGED}, x AS (SELECT conv_id, turn || '.' || (pos - 1) AS id, turn, pos, CASE WHEN judged THEN verdict END AS verdict, issue FROM s)
  SELECT conv_id, any_value(p.judged) AS judged, CAST(any_value(CASE WHEN p.judged THEN score ELSE 0 END) AS INTEGER) AS score, any_value(order_ok OR NOT p.judged) AS order_ok,
    CAST(any_value(CASE WHEN p.judged AND n_steps > 0 AND last = 'user' THEN 1 ELSE 0 END) AS INTEGER) AS n_missing,
    coalesce(string_agg(id || ':' || verdict || ':' || issue, ',' ORDER BY turn, pos), '') AS steps, coalesce(string_agg(CASE WHEN verdict IS NULL THEN id END, ',' ORDER BY turn, pos), '') AS unjudged
  FROM p LEFT JOIN x USING (conv_id) GROUP BY conv_id""")
def judged_plans(t):
    """Every plan with its cleaned verdict: score, steps in the plan's order, and what the judge left out."""
    rows = J.cleaned(_plans(t))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["id"], s["verdict"], s["issue"])), ",")
    return rows.select("conv_id", "judged", "score", "order_ok", F.col("n_missing").cast("int").alias("n_missing"), steps.alias("steps"), F.array_join("unjudged", ",").alias("unjudged"))


@query("""WITH k AS (SELECT lower(trim(text)) AS key, max(doc_id) AS kit_id, arg_max(quality, doc_id) AS quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1),
  r AS (SELECT source, kit_id, quality FROM documents LEFT JOIN k ON k.key = lower(trim(text)))
  SELECT source, count(*) AS n, count(kit_id) AS n_matched, count(*) - count(kit_id) AS n_unmatched, count(DISTINCT kit_id) AS n_kit, count(*) FILTER (WHERE quality = 1) AS n_good FROM r GROUP BY source""")
def results_in_kit(t):
    """All documents joined to the labelled document of the same text, unmatched ones counted too; digests are joined, not texts."""
    key = F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("key")
    kit = t.documents.join(t.labels, "doc_id").select(key, F.col("doc_id").alias("kit_id"), "quality")
    joined = J.joined_results(t.documents.select("source", key), kit, "key", "kit_id")
    return joined.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"), F.count_distinct("kit_id").alias("n_kit"), F.count_if(F.col("quality") == 1).alias("n_good")
    )
