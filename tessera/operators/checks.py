"""Checks of compiled plans: one finding for each broken rule, with its path.

A plan is a row ``key, contexts, meta``; :data:`PLAN` is the type of ``contexts``.
Plans are taken apart once into goals, actions, groups and steps, each with its
dotted path; every rule is a condition over one of these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import CHECKED_PROPER, EDGES, SMALL
from tessera.functions.steps import NUMBERING, clean_step, description, goal, split_words, title
from tessera.sources.files import bucketed

_ACT = "struct<deeplink string, description string, message string, originalType string>"
_VAL = "struct<deeplink string, key string, resultType string, condition string, value string>"
PLAN = f"array<struct<goal string, title string, score double, actions array<struct<actionName string, description string, category string, stepGroups array<struct<steps array<string>, actionableDeeplink {_ACT}, validationDeeplink {_VAL}>>>>>>"
# The form of a goal, the placeholder link, the reasons of an empty plan.
STRICT = r"^Follow these steps to perform this (.+?) (Troubleshooting|Configuration)\.$"
LENIENT = r"^Follow these steps to perform this (.+?) (Troubleshooting|Configuration)\.?$"
LOOSE = r"^Follow these steps to perform this (.+?) (Troubleshooting|Configuration)"
DUMMY = "bixby://dummy_positive"
FALLBACKS = ["no_match", "no_siis_context"]
#: Rules of the format block, and the codes that break them.
RULES = {"schema": ["SCHEMA"], "goal": ["GOAL_FORMAT", "GOAL_PERIOD"], "title": ["TITLE_WORDS"], "description": ["DESC_PREFIX", "DESC_WORDS"], "url": ["URL_LEAK"], "score": ["SCORE_RANGE"]}
FAIL, WARN = "fail", "warn"


def goals_of(plans: DataFrame, key: str) -> DataFrame:
    """``key, g, path, goal, title, score, actions``."""
    rows = plans.select(key, F.posexplode("contexts").alias("g", "x"))
    return rows.select(key, "g", F.format_string("contexts[%d]", "g").alias("path"), "x.goal", "x.title", "x.score", "x.actions")


def actions_of(goals: DataFrame, key: str) -> DataFrame:
    """``key, g, a, path, actionName, description, category, stepGroups``."""
    rows = goals.select(key, "g", "path", F.posexplode("actions").alias("a", "x"))
    return rows.select(key, "g", "a", F.format_string("%s.actions[%d]", "path", "a").alias("path"), "x.actionName", "x.description", "x.category", "x.stepGroups")


def groups_of(actions: DataFrame, key: str) -> DataFrame:
    """``key, g, a, s, path, steps, act, val``."""
    rows = actions.select(key, "g", "a", "path", F.posexplode("stepGroups").alias("s", "x"))
    return rows.select(key, "g", "a", "s", F.format_string("%s.stepGroups[%d]", "path", "s").alias("path"), "x.steps", F.col("x.actionableDeeplink").alias("act"), F.col("x.validationDeeplink").alias("val"))


def steps_of(groups: DataFrame, key: str) -> DataFrame:
    """``key, g, a, s, t, path, step``."""
    rows = groups.select(key, "g", "a", "s", "path", F.posexplode("steps").alias("t", "step"))
    return rows.withColumn("path", F.format_string("%s.steps[%d]", "path", "t"))


def strings_of(plans: DataFrame, key: str) -> DataFrame:
    """``key, path, text``: every string of every plan with its dotted path; nulls have no row."""
    goals = goals_of(plans, key)
    actions = actions_of(goals, key)
    groups = groups_of(actions, key)
    steps = steps_of(groups, key)

    def fields(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        listed = F.explode(F.array(*[F.struct(F.concat("path", F.lit(f".{shown}")).alias("path"), F.col(c).alias("text")) for c, shown in names.items()]))
        return rows.select(key, listed.alias("f")).select(key, "f.path", "f.text")

    link = {f"act.{n}": f"actionableDeeplink.{n}" for n in ("deeplink", "description", "message", "originalType")}
    link |= {f"val.{n}": f"validationDeeplink.{n}" for n in ("deeplink", "key", "resultType", "condition", "value")}
    out = fields(goals, {"goal": "goal", "title": "title"}).unionAll(fields(actions, {c: c for c in ("actionName", "description", "category")})).unionAll(fields(groups, link))
    return out.unionAll(steps.select(key, "path", F.col("step").alias("text"))).where("text IS NOT NULL")


def _found(rows: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """``key, code, severity, path`` of (code, severity, what follows the path, broken)."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.concat("path", F.lit(end)).alias("path"))) for code, sev, end, c in rules]))
    return rows.select(key, F.explode(broken).alias("f")).select(key, "f.code", "f.severity", "f.path")


def _word_set(text: Column) -> Column:
    return F.array_distinct(T.words(text))


def findings(plans: DataFrame, key: str, strict: bool = True, edges: list[tuple[str, str]] = EDGES) -> DataFrame:
    """``key, code, severity, path``: all that is wrong with each plan, but for its links' catalogue (see :func:`link_findings`).

    A null ``contexts`` is a finding of its own; ``strict``: whether a goal without
    its full stop fails or is only warned of.  Plans are written once in buckets of
    their key: however they were made, each rule reads them from there, and none of the
    windows and groups by key needs a shuffle.
    """
    plans = bucketed(plans.select(key, "contexts", "meta"), "plans", key, key)
    goals = goals_of(plans, key)
    actions = actions_of(goals, key)
    groups = groups_of(actions, key)
    steps = steps_of(groups, key)
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    c, n = F.col, lambda x: F.size(split_words(x))
    first_lower = lambda w: F.substring(w, 1, 1).rlike(r"\p{Ll}")
    whole = plans.withColumn("path", F.lit(""))
    body = _found(whole, key, [
        ("SCHEMA", FAIL, "contexts", c("contexts").isNull()),
        ("FALLBACK_MISSING", WARN, "meta.fallback", (F.size("contexts") == 0) & c("meta").isNotNull() & ~F.coalesce(c("meta.fallback").isin(FALLBACKS), F.lit(False))),
    ])
    words = split_words(F.col("title"))
    capital = F.exists(F.slice(words, 2, 100), lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}") & (w != F.upper(w)) & ~F.lower(F.regexp_replace(w, r"^[.,:;()]+|[.,:;()]+$", "")).isin(CHECKED_PROPER))
    about = F.regexp_extract("goal", LENIENT, 1)
    of_goals = _found(goals, key, [
        ("GOAL_FORMAT", FAIL, ".goal", c("goal").isNull() | ~c("goal").rlike(LENIENT)),
        ("GOAL_PERIOD", FAIL if strict else WARN, ".goal", c("goal").rlike(LENIENT) & ~c("goal").rlike(STRICT)),
        ("GOAL_TOPIC_DUP", WARN, ".goal", about.rlike(r"\b(Troubleshooting|Configuration)$")),
        ("TITLE_WORDS", FAIL, ".title", blank(c("title")) | ~n(c("title")).between(2, 3)),
        ("TITLE_CASE", WARN, ".title", ~blank(c("title")) & (first_lower(F.get(words, F.lit(0))) | capital)),
        ("SCORE_RANGE", FAIL, ".score", c("score").isNull() | F.isnan("score") | ~c("score").between(0.0, 1.0)),
        ("GOAL_NO_ACTIONS", WARN, ".actions", c("actions").isNull() | (F.size("actions") == 0)),
    ])
    name = F.lower(F.trim("actionName"))
    small = F.exists(split_words(c("actionName")), lambda w: first_lower(w) & ~F.lower(w).isin(SMALL)) | first_lower(F.get(split_words(c("actionName")), F.lit(0)))
    linked = F.size(F.filter("stepGroups", lambda x: x["actionableDeeplink"].isNotNull()))
    category = F.coalesce("category", F.lit("manual"))
    here = Window.partitionBy(key, "g").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    text = F.concat_ws(" ", "actionName", F.flatten(F.transform("stepGroups", lambda x: F.coalesce(x["steps"], F.array().cast("array<string>")))))
    own_words = actions.withColumn("category", category).withColumn("linked", linked).withColumn("n_groups", F.size("stepGroups")).withColumn("words", _word_set(text)).withColumn("name", F.when(blank(c("actionName")), None).otherwise(name))
    # words of the critical actions before, one set for each: a dependent may follow its provider
    own_words = own_words.withColumn("before", F.collect_list(F.when(c("category") == "critical", c("words"))).over(here))
    stop = ["in", "the", "a", "an", "of", "to"]
    arr = lambda ws: F.array(*[F.lit(w) for w in ws.split() if w not in stop])
    expected = F.lit(False)
    held = lambda words: lambda b: F.size(F.array_except(arr(words), b)) == 0
    for provider, dependent in edges:
        expected = expected | (held(dependent)(F.col("words")) & F.exists("before", held(provider)))
    seen = F.row_number().over(Window.partitionBy(key, "g", "name").orderBy("a"))
    first_goal = F.min("g").over(Window.partitionBy(key, "name"))
    marked = own_words.withColumn("nth", seen).withColumn("first_goal", first_goal)
    of_actions = _found(marked, key, [
        ("ACTION_NAME_EMPTY", FAIL, ".actionName", c("name").isNull()),
        ("ACTION_NAME_CASE", WARN, ".actionName", c("name").isNotNull() & small),
        ("ACTION_NAME_DUP", WARN, ".actionName", c("name").isNotNull() & (c("nth") > 1)),
        ("ACTION_REPEATED", WARN, ".actionName", c("name").isNotNull() & (c("nth") == 1) & (c("first_goal") < c("g"))),
        ("DESC_PREFIX", FAIL, ".description", c("description").isNull() | ~c("description").startswith("It will ")),
        ("DESC_WORDS", FAIL, ".description", c("description").isNotNull() & ~n(c("description")).between(5, 7)),
        ("STEPS_EMPTY", FAIL, ".stepGroups", c("stepGroups").isNull() | (F.size("stepGroups") == 0)),
        ("AUTO_NO_LINK", FAIL, "", (c("category") == "auto") & (c("linked") <= 0)),
        ("AUTO_PARTIAL_LINK", WARN, "", (c("category") == "auto") & (c("linked") > 0) & (c("linked") < c("n_groups"))),
        ("MANUAL_HAS_LINK", WARN, "", (c("category") == "manual") & (c("linked") > 0)),
        ("CRITICAL_NOT_LAST", WARN, "", (c("category") != "critical") & (F.size("before") > 0) & ~expected),
    ])
    screens = groups.where(c("act.deeplink").isNotNull() & (c("act.deeplink") != DUMMY)).groupBy(key, "g", "a", c("act.deeplink").alias("uri")).agg(F.min(F.regexp_replace("path", r"\.stepGroups\[\d+\]$", "")).alias("path"))
    screens = screens.withColumn("nth", F.row_number().over(Window.partitionBy(key, "g", "uri").orderBy("a")))
    of_groups = _found(groups, key, [("STEPS_EMPTY", FAIL, ".steps", c("steps").isNull() | (F.size("steps") == 0))])
    of_steps = _found(steps, key, [
        ("STEPS_EMPTY", FAIL, "", blank(c("step"))),
        ("STEP_NUMBERED", WARN, "", ~blank(c("step")) & c("step").rlike(NUMBERING)),
        ("STEP_PERIOD", WARN, "", ~blank(c("step")) & ~c("step").rlike(r"\.\s*$")),
    ])
    strings = strings_of(plans, key)
    leaks = _found(strings, key, [("URL_LEAK", FAIL, "", (F.size(T.leak_names(c("text"))) > 0) & ~(c("path").rlike(r"\.(?:actionableDeeplink|validationDeeplink)\.deeplink$") & c("text").rlike(T.CATALOG_URI)))])
    out = body.unionAll(of_goals).unionAll(of_actions).unionAll(_found(screens, key, [("SAME_SCREEN_SPLIT", WARN, "", c("nth") > 1)])).unionAll(of_groups).unionAll(of_steps)
    return out.unionAll(leaks)


def line_findings(lines: DataFrame, key: str) -> DataFrame:
    """``key, code, severity, path`` of result lines (key, query, query_variations, contexts, meta): what is around the plan."""
    c = F.col
    texts = F.filter(F.coalesce("query_variations", F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))
    rows = lines.withColumn("path", F.lit("")).withColumn("keys", F.transform(texts, T.normal))
    rows = rows.withColumn("n", F.size("query_variations")).withColumn("u", F.size(F.array_distinct("keys")))
    given = c("query_variations").isNotNull()
    out = _found(rows, key, [
        ("QUERY_MISSING", FAIL, "query", c("query").isNull() | (F.trim("query") == "")),
        ("SCHEMA", FAIL, "response", c("contexts").isNull()),
        ("FALLBACK_MISSING", WARN, "meta.fallback", (F.size("contexts") == 0) & c("meta").isNotNull() & ~F.coalesce(c("meta.fallback").isin(FALLBACKS), F.lit(False))),
        ("VAR_COUNT", FAIL, "query_variations", ~given | ~(c("n").between(8, 10) & c("u").between(8, 10))),
        ("VAR_EMPTY", FAIL, "query_variations", given & (F.size("keys") < c("n"))),
        ("VAR_UNIQUE", FAIL, "query_variations", given & (c("u") < F.size("keys"))),
        ("VAR_IS_QUERY", WARN, "query_variations", F.array_contains("keys", T.normal(c("query")))),
    ])
    leaks = lines.select(key, F.posexplode("query_variations").alias("i", "text")).withColumn("path", F.format_string("query_variations[%d]", "i"))
    return out.unionAll(_found(leaks, key, [("URL_LEAK", FAIL, "", F.size(T.leak_names(c("text"))) > 0)]))


def link_rows(plans: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Groups with what the catalogue has under their links: ``entry`` (of the action link) and ``known_val``.

    ``catalog``: id, deeplink, description, message, originalType, validation (struct of :data:`PLAN`'s fields).
    """
    groups = groups_of(actions_of(goals_of(plans, key), key), key)
    entries = catalog.select(F.col("deeplink").alias("uri"), F.struct("id", "description", "message", "originalType", "validation").alias("entry")).dropDuplicates(["uri"])
    known = catalog.where("validation.deeplink IS NOT NULL").select(F.col("validation.deeplink").alias("v_uri")).distinct().withColumn("known_val", F.lit(True))
    return groups.join(entries, F.col("act.deeplink") == F.col("uri"), "left").join(known, F.col("val.deeplink") == F.col("v_uri"), "left")


def link_findings(plans: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """``key, code, severity, path``: links that the catalogue doesn't have, has otherwise, or gives to another entry."""
    rows, c = link_rows(plans, catalog, key), F.col
    n = lambda x: F.size(split_words(x))
    act, val = c("act").isNotNull(), c("val").isNotNull()
    dummy, found = F.coalesce(c("act.deeplink") == DUMMY, F.lit(False)), c("entry").isNotNull() & ~F.coalesce(c("act.deeplink") == DUMMY, F.lit(False))
    known = F.coalesce("known_val", F.lit(False))
    own = c("entry.validation.deeplink").eqNullSafe(c("val.deeplink"))
    same = F.lit(True)
    for name in ("key", "resultType", "condition", "value"):
        same = same & c(f"val.{name}").eqNullSafe(c(f"entry.validation.{name}"))
    altered = lambda name: found & ~F.coalesce(c(f"act.{name}"), F.lit("" if name == "message" else None)).eqNullSafe(c(f"entry.{name}"))
    return _found(rows, key, [
        ("DL_UNKNOWN", FAIL, ".actionableDeeplink.deeplink", act & ~dummy & ~found),
        *[("DL_ALTERED", WARN, f".actionableDeeplink.{name}", altered(name)) for name in ("description", "message", "originalType")],
        *[("DUMMY_TEXT", WARN, f".actionableDeeplink.{name}", dummy & ~n(c(f"act.{name}")).between(5, 7)) for name in ("description", "message")],
        ("DUMMY_WITH_VALIDATION", WARN, ".validationDeeplink", dummy & val),
        ("VAL_UNKNOWN", FAIL, ".validationDeeplink.deeplink", val & ~known),
        ("VAL_WITHOUT_CATALOG_ACT", WARN, ".validationDeeplink", val & known & ~found & ~dummy),
        ("VAL_NOT_OWN", FAIL, ".validationDeeplink.deeplink", val & known & found & ~own),
        ("VAL_ALTERED", FAIL, ".validationDeeplink", val & known & found & own & ~same),
    ])


def link_counts(plans: DataFrame, catalog: DataFrame, key: str, *by: str) -> DataFrame:
    """Counts of links and what is right about them, by ``by`` (columns of the plans; none: overall), and their rates.

    Counts of parts of a table add up to those of the whole; rates are null where nothing was counted.
    """
    rows, c = link_rows(plans, catalog, key), F.col
    actions = actions_of(goals_of(plans, key), key).where("category = 'auto'")
    dummy = F.coalesce(c("act.deeplink") == DUMMY, F.lit(False))
    found = c("entry").isNotNull() & ~dummy
    own = c("entry.validation.deeplink").eqNullSafe(c("val.deeplink"))
    for name in ("key", "resultType", "condition", "value"):
        own = own & c(f"val.{name}").eqNullSafe(c(f"entry.validation.{name}"))
    valid = c("val").isNotNull() & F.coalesce("known_val", F.lit(False)) & (~found | own)
    owner = plans.select(key, *by)
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    links = rows.join(owner, key).groupBy(*by).agg(
        n(c("act").isNotNull()).alias("act_total"), n(c("act").isNotNull() & (found | dummy)).alias("act_valid"), n(c("act").isNotNull() & found).alias("act_catalog"), n(dummy).alias("act_dummy"),
        n(c("val").isNotNull()).alias("val_total"), n(valid).alias("val_valid"),
    )
    autos = actions.join(owner, key).groupBy(*by).agg(F.count("*").alias("auto_total"), n(F.exists("stepGroups", lambda g: g["actionableDeeplink"].isNotNull())).alias("auto_linked"))
    both = links.join(autos, list(by), "left") if by else links.crossJoin(autos)
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    both = both.na.fill(0, ["auto_total", "auto_linked"])
    return both.withColumns({"validity": rate(c("act_valid") + c("val_valid"), c("act_total") + c("val_total")), "auto_link_rate": rate(c("auto_linked"), c("auto_total")), "dummy_rate": rate(c("act_dummy"), c("act_total"))})


def rule_pass(plans: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key`` and a boolean for each rule of :data:`RULES`: whether no finding that fails breaks it."""
    failed = found.where(F.col("severity") == FAIL).groupBy(key).agg(F.collect_set("code").alias("codes"))
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    return plans.select(key).join(failed, key, "left").select(key, *[(~F.arrays_overlap(codes, F.array(*[F.lit(x) for x in broken]))).alias(rule) for rule, broken in RULES.items()])


def expectations(rows: DataFrame) -> Column:
    """Names of what an adversarial case expected and didn't get: ``rows`` has expect_status, status, schema_ok, expect_leaks,
    leaks, expect_contexts (any, empty, non_empty), n_contexts, expect_fallback (null: any), fallback."""
    c = F.col
    empty = (c("expect_contexts") == "empty") & (c("n_contexts") > 0)
    full = (c("expect_contexts") == "non_empty") & (c("n_contexts") == 0)
    return F.array_compact(F.array(
        F.when(~c("status").eqNullSafe(c("expect_status")), F.lit("status")), F.when(~F.coalesce("schema_ok", F.lit(False)), F.lit("schema")), F.when(c("leaks") > c("expect_leaks"), F.lit("leaks")),
        F.when(empty | full, F.lit("contexts")), F.when(c("expect_fallback").isNotNull() & ~c("fallback").eqNullSafe(c("expect_fallback")), F.lit("fallback")),
    ))


def repaired(plans: DataFrame, key: str) -> DataFrame:
    """The plans with every string scrubbed and every rule of the format enforced; goals and actions that nothing is left of are dropped.

    Links keep only catalogue addresses, and only automatic actions keep links.
    """
    scrubbed = lambda c: F.when(T.has_leak(c), T.scrub(c)).otherwise(c)
    uri = lambda c: F.when(c.rlike(T.CATALOG_URI), c)

    def link(x, names):
        made = F.struct(uri(x["deeplink"]).alias("deeplink"), *[scrubbed(x[n]).alias(n) for n in names])
        return F.when(x.isNotNull() & uri(x["deeplink"]).isNotNull(), made)

    def group(x):
        steps = F.filter(F.transform(F.coalesce(x["steps"], F.array().cast("array<string>")), lambda s: clean_step(s)), lambda s: s != "")
        return F.struct(steps.alias("steps"), link(x["actionableDeeplink"], ("description", "message", "originalType")).alias("actionableDeeplink"), link(x["validationDeeplink"], ("key", "resultType", "condition", "value")).alias("validationDeeplink"))

    none = lambda kind: F.lit(None).cast(kind)

    def action(x):
        groups = F.filter(F.transform(F.coalesce(x["stepGroups"], F.array()), group), lambda g: F.size(g["steps"]) > 0)
        given = F.coalesce(x["category"], F.lit("manual"))
        linked = F.exists(groups, lambda g: g["actionableDeeplink"].isNotNull())
        category = F.when((given == "auto") & ~linked, "manual").otherwise(given)
        bare = F.transform(groups, lambda g: F.struct(g["steps"].alias("steps"), none(_ACT).alias("actionableDeeplink"), none(_VAL).alias("validationDeeplink")))
        name = T.collapse(scrubbed(F.coalesce(x["actionName"], F.lit(""))))
        return F.struct(F.when(name == "", "Follow These Steps").otherwise(name).alias("actionName"), description(scrubbed(x["description"])).alias("description"), category.alias("category"), F.when(category == "auto", groups).otherwise(bare).alias("stepGroups"))

    def whole(x):
        actions = F.filter(F.transform(F.coalesce(x["actions"], F.array()), action), lambda a: F.size(a["stepGroups"]) > 0)
        shown = title(scrubbed(x["title"]))
        said = scrubbed(x["goal"])
        loose = F.regexp_extract(said, LOOSE, 1)
        text = F.when(said.rlike(STRICT), said).when(F.coalesce(loose, F.lit("")) != "", F.when(F.regexp_extract(said, LOOSE, 2) == "Configuration", goal(loose, "Configuration")).otherwise(goal(loose))).otherwise(goal(shown))
        score = F.when(x["score"].isNull() | F.isnan(x["score"]), 0.0).otherwise(F.round(F.least(F.greatest(x["score"], F.lit(0.0)), F.lit(1.0)), 2))
        return F.struct(text.alias("goal"), shown.alias("title"), score.alias("score"), actions.alias("actions"))

    goals = F.filter(F.transform(F.coalesce("contexts", F.array().cast(PLAN)), whole), lambda g: F.size(g["actions"]) > 0)
    return plans.withColumn("contexts", goals)


def actions_per_plan(plans: DataFrame) -> DataFrame:
    """``plans, actions, mean_actions`` over plans that aren't empty."""
    n = F.aggregate("contexts", F.lit(0), lambda s, g: s + F.coalesce(F.size(g["actions"]), F.lit(0)))
    return plans.where(F.size("contexts") > 0).select(n.alias("n")).agg(F.count("*").alias("plans"), F.sum("n").alias("actions"), F.round(F.avg("n"), 6).alias("mean_actions"))
