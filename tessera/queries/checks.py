"""Checks and repair of plans: conversations stand for plans and their turns for actions, with texts that break known rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.queries.registry import query

_GOALS = ["Follow these steps to perform this Wi-Fi Troubleshooting.", "Follow these steps to perform this Wi-Fi Troubleshooting", "Fix the Wi-Fi", "Follow these steps to perform this Screen Configuration Troubleshooting."]
_TITLES = ["Screen issue", "screen issue", "Black Screen Problem", "Wi-Fi is very slow", None]
_SCORES = [0.5, 1.2, -0.1, None, 0.0, 1.0, 0.25]
_NAMES = ["Check Cable", "check the Cable", "Check Cable", " ", "Go to www.x.org"]
_DESCRIPTIONS = ["It will check the cable", "It will check", "Checks the cable for you now", None]
_STEPS = [["Tap Display."], ["1. Tap Display"], ["Tap Display.", " "], []]
_URIS = [None, "bixby://a/1", "bixby://dummy_positive", "bixby://none"]
_VALS = [None, "bixby://v/1", "bixby://v/2", "bixby://v/none"]
#: id, deeplink, description, message, originalType, deeplink and key of the validation.
_CATALOG = [("DL-1", "bixby://a/1", "Opens the A settings page", "View A", "onClickURL", "bixby://v/1", "k"), ("DL-2", "bixby://a/2", "Opens the B settings page", "View B", "onURL", "bixby://v/2", "k")]
#: What each variant breaks, written out: kind, variant, code, severity.
_BREAKS = """b(kind, v, code, severity) AS (VALUES
  ('goal',1,'GOAL_PERIOD','fail'),('goal',2,'GOAL_FORMAT','fail'),('goal',3,'GOAL_TOPIC_DUP','warn'), ('title',1,'TITLE_CASE','warn'),('title',2,'TITLE_CASE','warn'),('title',3,'TITLE_WORDS','fail'),('title',4,'TITLE_WORDS','fail'),
  ('score',1,'SCORE_RANGE','fail'),('score',2,'SCORE_RANGE','fail'),('score',3,'SCORE_RANGE','fail'), ('name',1,'ACTION_NAME_CASE','warn'),('name',3,'ACTION_NAME_EMPTY','fail'),('name',4,'URL_LEAK','fail'),('name',4,'ACTION_NAME_CASE','warn'),
  ('description',1,'DESC_WORDS','fail'),('description',2,'DESC_PREFIX','fail'),('description',3,'DESC_PREFIX','fail'),
  ('steps',1,'STEP_NUMBERED','warn'),('steps',1,'STEP_PERIOD','warn'),('steps',2,'STEPS_EMPTY','fail'),('steps',3,'STEPS_EMPTY','fail'))"""


def _pick(values: list, index, kind: str = "string"):
    """The value at ``index`` modulo their number."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (index % len(values)).cast("int"))


def _plans(t):
    """One goal for each conversation, an action with one group for each turn; every tenth conversation has no goal."""
    turn, conv = F.col("turn"), F.col("conv_id")
    i = conv + turn
    links = lambda uris, k: _pick(uris, k)
    act = F.struct(links(_URIS, i).alias("deeplink"), F.when(i % 8 < 4, "Opens the A settings page").otherwise("Changed").alias("description"), F.lit("View A").alias("message"), F.lit("onClickURL").alias("originalType"))
    val = F.struct(links(_VALS, conv).alias("deeplink"), F.when(turn % 2 == 0, "k").otherwise("other").alias("key"), *[F.lit(None).cast("string").alias(n) for n in ("resultType", "condition", "value")])
    group = F.struct(F.get(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in _STEPS]), (i % 4).cast("int")).alias("steps"), F.when(act["deeplink"].isNotNull(), act).alias("actionableDeeplink"), F.when(val["deeplink"].isNotNull(), val).alias("validationDeeplink"))
    category = _pick(["auto", "manual", "critical"], i)
    action = F.struct(_pick(_NAMES, turn).alias("actionName"), _pick(_DESCRIPTIONS, i).alias("description"), category.alias("category"), F.array(group).alias("stepGroups"))
    rows = t.conversations.select("conv_id", F.struct("turn", action.alias("action")).alias("a")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["action"]).alias("actions"))
    goal = F.struct(_pick(_GOALS, conv).alias("goal"), _pick(_TITLES, conv).alias("title"), _pick(_SCORES, conv, "double").alias("score"), "actions")
    plan = F.when(conv % 10 == 9, F.array().cast(C.PLAN)).otherwise(F.array(goal).cast(C.PLAN))
    meta = F.struct(F.when(conv % 20 == 9, "no_match").alias("fallback"))
    return rows.select("conv_id", plan.alias("contexts"), meta.alias("meta"))


def _catalog(t):
    rows = t.spark.createDataFrame(_CATALOG, "id string, deeplink string, description string, message string, originalType string, v string, k string")
    val = F.struct(F.col("v").alias("deeplink"), F.col("k").alias("key"), *[F.lit(None).cast("string").alias(n) for n in ("resultType", "condition", "value")])
    return rows.select("id", "deeplink", "description", "message", "originalType", val.alias("validation"))


_ACTIONS = "a AS (SELECT conv_id, turn, conv_id + turn AS i FROM conversations WHERE conv_id % 10 <> 9)"
_PLAN_CODES = f"""
  WITH {_BREAKS}, {_ACTIONS}, g AS (SELECT DISTINCT conv_id FROM a),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM a),
  n AS (SELECT *, CASE turn % 5 WHEN 0 THEN 'check cable' WHEN 1 THEN 'check the cable' WHEN 2 THEN 'check cable' WHEN 4 THEN 'go to www.x.org' END AS name FROM o),
  m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, name ORDER BY turn) AS nth, max(CASE WHEN i % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after,
        row_number() OVER (PARTITION BY conv_id, i % 4 ORDER BY turn) AS same FROM n),
  f AS (
    SELECT conv_id, code, severity FROM g JOIN b ON (kind = 'goal' AND v = conv_id % 4) OR (kind = 'title' AND v = conv_id % 5) OR (kind = 'score' AND v = conv_id % 7)
    UNION ALL SELECT conv_id, code, severity FROM a JOIN b ON (kind = 'name' AND v = turn % 5) OR (kind = 'description' AND v = i % 4) OR (kind = 'steps' AND v = i % 4)
    UNION ALL SELECT conv_id, 'ACTION_NAME_DUP', 'warn' FROM m WHERE name IS NOT NULL AND nth > 1
    UNION ALL SELECT conv_id, 'AUTO_NO_LINK', 'fail' FROM a WHERE i % 3 = 0 AND i % 4 = 0
    UNION ALL SELECT conv_id, 'MANUAL_HAS_LINK', 'warn' FROM a WHERE i % 3 = 1 AND i % 4 <> 0
    UNION ALL SELECT conv_id, 'CRITICAL_NOT_LAST', 'warn' FROM m WHERE after = 1 AND i % 3 <> 2
    UNION ALL SELECT conv_id, 'SAME_SCREEN_SPLIT', 'warn' FROM m WHERE i % 4 IN (1, 3) AND same > 1
    UNION ALL SELECT conv_id, 'FALLBACK_MISSING', 'warn' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 = 9) WHERE conv_id % 20 <> 9)"""


@query(f"{_PLAN_CODES} SELECT conv_id, code, severity, count(*) AS n FROM f GROUP BY ALL")
def plan_findings(t):
    """What is wrong with each plan, by code."""
    return C.findings(_plans(t), "conv_id").groupBy("conv_id", "code", "severity").agg(F.count("*").alias("n"))


@query(f"""{_PLAN_CODES}, c AS (SELECT DISTINCT conv_id, code FROM f WHERE severity = 'fail'), k AS (SELECT DISTINCT conv_id FROM conversations)
  SELECT k.conv_id, count(code) FILTER (WHERE code = 'SCHEMA') = 0 AS schema, count(code) FILTER (WHERE code IN ('GOAL_FORMAT', 'GOAL_PERIOD')) = 0 AS goal, count(code) FILTER (WHERE code = 'TITLE_WORDS') = 0 AS title,
         count(code) FILTER (WHERE code IN ('DESC_PREFIX', 'DESC_WORDS')) = 0 AS description, count(code) FILTER (WHERE code = 'URL_LEAK') = 0 AS url, count(code) FILTER (WHERE code = 'SCORE_RANGE') = 0 AS score
  FROM k LEFT JOIN c USING (conv_id) GROUP BY k.conv_id""")
def plan_rules(t):
    """Which rules of the format each plan keeps."""
    plans = _plans(t)
    return C.rule_pass(plans, C.findings(plans, "conv_id"), "conv_id")


_LINKS = f"""
  WITH {_ACTIONS}, l AS (SELECT conv_id, turn, i, i % 4 AS act, conv_id % 4 AS val, i % 8 < 4 AS copied, turn % 2 = 0 AS own_key FROM a)"""


@query(f"""{_LINKS}, f AS (
    SELECT conv_id, 'DL_UNKNOWN' AS code FROM l WHERE act = 3
    UNION ALL SELECT conv_id, 'DL_ALTERED' FROM l WHERE act = 1 AND NOT copied
    UNION ALL SELECT conv_id, 'DUMMY_TEXT' FROM l WHERE act = 2 AND NOT copied UNION ALL SELECT conv_id, 'DUMMY_TEXT' FROM l WHERE act = 2
    UNION ALL SELECT conv_id, 'DUMMY_WITH_VALIDATION' FROM l WHERE act = 2 AND val <> 0
    UNION ALL SELECT conv_id, 'VAL_UNKNOWN' FROM l WHERE val = 3
    UNION ALL SELECT conv_id, 'VAL_WITHOUT_CATALOG_ACT' FROM l WHERE val IN (1, 2) AND act IN (0, 3)
    UNION ALL SELECT conv_id, 'VAL_NOT_OWN' FROM l WHERE val = 2 AND act = 1
    UNION ALL SELECT conv_id, 'VAL_ALTERED' FROM l WHERE val = 1 AND act = 1 AND NOT own_key)
  SELECT conv_id, code, count(*) AS n FROM f GROUP BY ALL""")
def plan_links(t):
    """What is wrong with the links of each plan, against the catalogue."""
    return C.link_findings(_plans(t), _catalog(t), "conv_id").groupBy("conv_id", "code").agg(F.count("*").alias("n"))


@query(f"""{_LINKS}
  SELECT count(*) FILTER (WHERE act <> 0) AS act_total, count(*) FILTER (WHERE act IN (1, 2)) AS act_valid, count(*) FILTER (WHERE act = 1) AS act_catalog, count(*) FILTER (WHERE act = 2) AS act_dummy,
         count(*) FILTER (WHERE val <> 0) AS val_total, count(*) FILTER (WHERE (val = 1 AND (act <> 1 OR own_key)) OR (val = 2 AND act <> 1)) AS val_valid, count(*) FILTER (WHERE i % 3 = 0) AS auto_total, count(*) FILTER (WHERE i % 3 = 0 AND act <> 0) AS auto_linked,
         round((count(*) FILTER (WHERE act IN (1, 2)) + count(*) FILTER (WHERE (val = 1 AND (act <> 1 OR own_key)) OR (val = 2 AND act <> 1))) * 1.0 / (count(*) FILTER (WHERE act <> 0) + count(*) FILTER (WHERE val <> 0)), 6) AS validity,
         round(count(*) FILTER (WHERE i % 3 = 0 AND act <> 0) * 1.0 / count(*) FILTER (WHERE i % 3 = 0), 6) AS auto_link_rate, round(count(*) FILTER (WHERE act = 2) * 1.0 / count(*) FILTER (WHERE act <> 0), 6) AS dummy_rate FROM l""")
def link_counts(t):
    """Counts of links overall, and their rates."""
    return C.link_counts(_plans(t), _catalog(t), "conv_id")


@query("""
  WITH k AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 9), a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 10 <> 9 GROUP BY conv_id)
  SELECT count(*) AS plans, CAST(sum(n) AS BIGINT) AS actions, round(avg(n), 6) AS mean_actions FROM a""")
def actions_per_plan(t):
    """Plans that aren't empty, and their actions."""
    return C.actions_per_plan(_plans(t))


@query(f"""
  WITH {_ACTIONS}, s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, i FROM a)
  SELECT conv_id, 'contexts[0].actions[' || p || '].stepGroups[0].steps[' || k || ']' AS path, x AS text
  FROM (SELECT *, unnest([['Tap Display.'], ['1. Tap Display'], ['Tap Display.', ' '], []][CAST(i % 4 + 1 AS INTEGER)]) AS x, generate_subscripts([['Tap Display.'], ['1. Tap Display'], ['Tap Display.', ' '], []][CAST(i % 4 + 1 AS INTEGER)], 1) - 1 AS k FROM s)
  UNION ALL SELECT conv_id, 'contexts[0].actions[' || p || '].category', ['auto', 'manual', 'critical'][CAST(i % 3 + 1 AS INTEGER)] FROM s""")
def plan_strings(t):
    """Every step and category of every plan with its dotted path, out of the walk over all strings."""
    return C.strings_of(_plans(t), "conv_id").where(F.col("path").rlike(r"\.steps\[\d+\]$|\.category$"))


@query(f"""
  WITH {_ACTIONS},
  k AS (SELECT conv_id, turn, i, i % 4 IN (0, 1, 2) AS has_steps, i % 3 = 0 AND i % 4 IN (1, 2, 3) AS linked FROM a WHERE i % 4 <> 3),
  r AS (SELECT conv_id, count(*) AS n_actions, count(*) FILTER (WHERE linked) AS n_auto, count(*) FILTER (WHERE i % 3 = 2) AS n_critical FROM k GROUP BY conv_id)
  SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'Screen issue' WHEN 1 THEN 'Screen issue' WHEN 2 THEN 'Black screen problem' WHEN 3 THEN 'Wi-Fi is very' ELSE 'Troubleshooting issue' END AS title,
    CASE conv_id % 4 WHEN 2 THEN 'Follow these steps to perform this ' || CASE conv_id % 5 WHEN 0 THEN 'Screen Issue' WHEN 1 THEN 'Screen Issue' WHEN 2 THEN 'Black Screen Problem' WHEN 3 THEN 'Wi-Fi Is Very' ELSE 'Troubleshooting Issue' END || ' Troubleshooting.'
      WHEN 3 THEN 'Follow these steps to perform this Screen Configuration Troubleshooting.' ELSE 'Follow these steps to perform this Wi-Fi Troubleshooting.' END AS goal,
    CASE conv_id % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 5 THEN 1.0 WHEN 6 THEN 0.25 ELSE 0.0 END::DOUBLE AS score, n_actions, n_auto, n_critical FROM r""")
def plan_repair(t):
    """Plans with every rule enforced: titles, goals, scores, and what is left of their actions."""
    fixed = C.repaired(_plans(t), "conv_id").select("conv_id", F.explode("contexts").alias("g"))
    n = lambda k: F.size(F.filter("g.actions", lambda a: a["category"] == k)).cast("long")
    return fixed.select("conv_id", "g.title", "g.goal", "g.score", F.size("g.actions").cast("long").alias("n_actions"), n("auto").alias("n_auto"), n("critical").alias("n_critical"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 3 = 0 THEN 'status' END, CASE WHEN event_id % 5 = 0 THEN 'schema' END, CASE WHEN event_id % 4 = 3 THEN 'leaks' END,
    CASE WHEN (event_id % 3 = 1 AND event_id % 2 = 1) OR (event_id % 3 = 2 AND event_id % 2 = 0) THEN 'contexts' END, CASE WHEN event_id % 7 > 2 THEN 'fallback' END], lambda x: x IS NOT NULL), ',') AS problems FROM events""")
def adversarial_check(t):
    """What adversarial cases expected and didn't get."""
    e = F.col("event_id")
    rows = t.events.select(
        "event_id", F.lit(200).alias("expect_status"), F.when(e % 3 == 0, 500).otherwise(200).alias("status"), (e % 5 != 0).alias("schema_ok"), F.lit(0).alias("expect_leaks"), F.when(e % 4 == 3, 2).otherwise(0).alias("leaks"),
        F.when(e % 3 == 0, "any").when(e % 3 == 1, "empty").otherwise("non_empty").alias("expect_contexts"), (e % 2).alias("n_contexts"), F.when(e % 7 > 0, "no_match").alias("expect_fallback"), F.when(e % 7 <= 2, "no_match").alias("fallback"),
    )
    return rows.select("event_id", F.array_join(C.expectations(rows), ",").alias("problems"))


@query("""
  WITH n AS (SELECT conv_id, count(*) AS n, count(DISTINCT lower(trim(text))) AS u FROM conversations GROUP BY conv_id)
  SELECT conv_id, 'VAR_COUNT' AS code FROM n WHERE NOT n BETWEEN 8 AND 10""")
def result_lines(t):
    """Result lines whose variations (the turns of a conversation) are too few or too many."""
    lines = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.concat("text", F.lit(" "), F.col("turn").cast("string")))).alias("query_variations")).withColumn("query", F.lit("a query"))
    lines = lines.withColumn("contexts", F.array(F.lit(1))).withColumn("meta", F.struct(F.lit("x").alias("fallback")))
    return C.line_findings(lines, "conv_id").where("code IN ('VAR_COUNT', 'VAR_EMPTY', 'QUERY_MISSING', 'FALLBACK_MISSING')").select("conv_id", "code")
