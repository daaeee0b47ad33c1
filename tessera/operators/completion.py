"""Paragraph completion: a plan's actions filled up from the paragraphs that a reader of the article would expect.

First, set by set over (plan, unit, sentence): a paragraph of which an action took
the beginning goes on in that action up to the first sentence that stops it.  Then the
chosen paragraphs that nothing cites are put together where they are neighbours and
dealt out in the article's order: into the action whose own sentences lie around
them, into the action they prepare, or as new actions of a goal that has room.  This
dealing depends on what was dealt before; it is one fold over a plan's groups inside its
row, so plans are spread over the cluster and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T
from tessera.functions.lexicon import VERBS
from tessera.operators.plans import critical_kind

MOST = 12  # actions of a goal
_LATE = 1_000_000  # a place behind all of a plan's own


def step_key(text: Column) -> Column:
    """What makes two steps the same: their words."""
    return F.array_join(T.unicode_words(text), " ")


def continued(sentences: DataFrame, units: DataFrame, chosen: DataFrame, actions: DataFrame, steps: DataFrame, key: str, verbs: list[str] = VERBS) -> DataFrame:
    """``key, pos, at, text, ids``: the steps, and those that go on where an action took a paragraph's beginning only.

    Looked at are chosen units with a name, in the order of ``rank``, if the cited ones of
    their instructions are the first ones and some are left.  The action is the first
    that cites the last of them; its kind (name and steps as they were) tells which other
    kinds stop the paragraph, as do escalations, ways out of safe mode, purposes and labels.
    """
    cited = steps.select(key, "pos", F.explode("ids").alias("no")).groupBy(key, "no").agg(F.min("pos").alias("pos"))
    named = chosen.where("name IS NOT NULL").groupBy(key, "unit").agg(F.min("rank").alias("rank"))
    lines = units.where("heading_step IS NULL").join(named, [key, "unit"]).select(key, "unit", "rank", F.posexplode("instructing").alias("n", "no")).join(cited, [key, "no"], "left")
    unit = Window.partitionBy(key, "unit")
    lines = lines.withColumn("taken", F.count("pos").over(unit)).withColumn("size", F.count("*").over(unit)).withColumn("last", F.max(F.when(F.col("pos").isNotNull(), F.col("n"))).over(unit))
    lines = lines.withColumn("holder", F.max(F.when(F.col("n") == F.col("taken") - 1, F.col("pos"))).over(unit))
    rest = lines.where((F.col("last") == F.col("taken") - 1) & (F.col("taken") < F.col("size")) & (F.col("n") >= F.col("taken"))).drop("pos", "last", "size", "taken")
    texts = steps.groupBy(key, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("said"))
    kinds = actions.join(texts, [key, "pos"], "left").select(key, F.col("pos").alias("holder"), critical_kind(F.concat_ws(" ", "name", "said")).alias("head"))
    rest = rest.join(sentences.select(key, "no", "text"), [key, "no"]).join(kinds, [key, "holder"])
    text, kind = F.col("text"), critical_kind(F.col("text"))
    other = kind.isNotNull() & ~kind.eqNullSafe(F.col("head"))
    stop = F.regexp_replace(text, S.LEAD_IN, "").rlike(S.FLAGS["escalation"]) | text.rlike(S.FLAGS["leaves_safe_mode"]) | other | text.rlike(S.FLAGS["purpose"]) | text.rlike(S.LABEL)
    open_ = rest.withColumn("stopped", F.max(stop.cast("int")).over(unit.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0")
    extra = open_.select(key, F.col("holder").alias("pos"), "rank", "n", "no", F.posexplode(S.steps(text, verbs)).alias("k", "step"))
    behind = _LATE + F.row_number().over(Window.partitionBy(key, "pos").orderBy("rank", "n", "k"))
    return steps.select(key, "pos", "at", "text", "ids").unionByName(extra.select(key, "pos", behind.alias("at"), F.col("step").alias("text"), F.array("no").alias("ids")))


def unit_steps(sentences: DataFrame, units: DataFrame, key: str, verbs: list[str] = VERBS) -> DataFrame:
    """``key, unit, said``: what each unit tells to do, as (n, k, text, no) in order; a heading that instructs is its unit's one step."""
    heads = units.where("heading_step IS NOT NULL").select(key, "unit", F.lit(0).alias("n"), F.lit(0).alias("k"), F.concat("heading_step", F.lit(".")).alias("text"), F.get("instructing", F.lit(0)).alias("no"))
    lines = units.where("heading_step IS NULL").select(key, "unit", F.posexplode("instructing").alias("n", "no")).join(sentences.select(key, "no", "text"), [key, "no"])
    told = heads.unionByName(lines.select(key, "unit", "n", "no", F.posexplode(S.steps(F.col("text"), verbs)).alias("k", "text")))
    return told.groupBy(key, "unit").agg(F.array_sort(F.collect_list(F.struct("n", "k", "text", "no"))).alias("said"))


def added_groups(sentences: DataFrame, units: DataFrame, chosen: DataFrame, steps: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``key, grp, heading, first, last, given, intro, said``: chosen units that nothing cites and that say something new.

    Neighbours of one heading are one group, in the article's order.  ``intro``: the line
    before the group, if it lies in the same section; ``given``: the first name of two to six words.
    """
    cited = steps.select(key, F.explode("ids").alias("no")).distinct()
    touched = units.select(key, "unit", F.explode("ids").alias("no")).join(cited, [key, "no"], "left_semi").select(key, "unit").distinct()
    known = steps.groupBy(key).agg(F.collect_set(step_key(F.col("text"))).alias("known"))
    short = F.when(F.size(S.split_words(F.col("name"))).between(2, 6), F.col("name"))
    wanted = chosen.groupBy(key, "unit").agg(F.min(short).alias("given"))
    free = units.join(wanted, [key, "unit"]).join(touched, [key, "unit"], "left_anti").join(told, [key, "unit"], "left").join(known, key, "left")
    new = F.coalesce(F.size(F.array_except(F.transform("said", lambda s: step_key(s["text"])), F.coalesce("known", F.array().cast("array<string>")))) > 0, F.lit(True))
    w = Window.partitionBy(key).orderBy("unit")
    before = F.lag(F.struct("unit", "heading")).over(w)
    free = free.where(new | F.col("said").isNull()).withColumn("fresh", F.when((before["unit"] == F.col("unit") - 1) & before["heading"].eqNullSafe(F.col("heading")), 0).otherwise(1)).withColumn("grp", F.sum("fresh").over(w))
    groups = free.groupBy(key, "grp").agg(
        F.min("heading").alias("heading"), F.min(F.array_min("ids")).alias("first"), F.max(F.array_max("ids")).alias("last"), F.min_by("given", F.when(F.col("given").isNotNull(), F.col("unit"))).alias("given"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "said"))), lambda u: F.coalesce(u["said"], F.array().cast("array<struct<n:int,k:int,text:string,no:int>>")))).alias("said"),
    )
    above = sentences.select(key, (F.col("no") + 1).cast("int").alias("first"), F.col("section").alias("heading"), F.col("text").alias("intro"))
    return groups.join(above, [key, "first", "heading"], "left")


def _place(actions: Column, fits) -> Column:
    """The number of the first action that fits, from 1; 0 for none."""
    return F.coalesce(F.array_position(F.transform(actions, lambda a: F.coalesce(fits(a), F.lit(False))), True), F.lit(0)).cast("int")


def _dealt(actions: Column, seen: Column, groups: Column, most: int) -> Column:
    """The fold: what becomes of each group, as (grp, target, name); the name is null where it joins an action."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    start = F.struct(
        seen.alias("seen"), F.transform(actions, lambda a: lower(a["name"])).alias("names"), F.transform(actions, lambda a: a["goal"]).alias("goals"),
        F.transform(actions, lambda a: F.struct(a["said"].alias("said"), a["kind"].alias("kind"), a["cites"].alias("cites"))).alias("acts"),
        F.array().cast("array<struct<grp:long,target:int,name:string>>").alias("out"),
    )

    def deal(state, g):
        inside = lambda a: F.filter(a["cites"], lambda c: c["section"].eqNullSafe(g["heading"]))
        around = _place(state["acts"], lambda a: F.exists(inside(a), lambda c: c["no"] < g["first"]) & F.exists(inside(a), lambda c: c["no"] > g["last"]))
        prepares = g["wanted"].isNotNull() & ~g["kind"].eqNullSafe(g["wanted"])
        prepared = F.when(prepares, _place(state["acts"], lambda a: (F.size(inside(a)) > 0) & a["kind"].eqNullSafe(g["wanted"]))).otherwise(0)

        def settle(holder):
            fresh = F.size(F.array_except(g["keys"], state["seen"])) > 0
            room = F.size(F.filter(state["goals"], lambda x: x == g["goal"])) < most
            joins, makes = fresh & (holder > 0), fresh & (holder == 0) & room

            def after(name):
                said = lambda old: F.concat_ws(" ", old, g["told"])
                cites = F.transform(g["said"], lambda s: F.struct(g["heading"].alias("section"), s["no"].alias("no")))
                grown = lambda a: F.struct(said(a["said"]).alias("said"), critical_kind(said(a["said"])).alias("kind"), F.concat(a["cites"], cites).alias("cites"))
                made = F.struct(said(name).alias("said"), critical_kind(said(name)).alias("kind"), cites.alias("cites"))
                acts = F.when(joins, F.transform(state["acts"], lambda a, i: F.when(i + 1 == holder, grown(a)).otherwise(a))).when(makes, F.concat(state["acts"], F.array(made))).otherwise(state["acts"])
                row = F.struct(g["grp"].alias("grp"), F.when(joins, holder).otherwise(F.size(state["acts"]) + 1).alias("target"), F.when(makes, name).alias("name"))
                return F.struct(
                    F.when(joins | makes, F.array_union(state["seen"], g["keys"])).otherwise(state["seen"]).alias("seen"), F.when(makes, F.concat(state["names"], F.array(lower(name)))).otherwise(state["names"]).alias("names"),
                    F.when(makes, F.concat(state["goals"], F.array(g["goal"]))).otherwise(state["goals"]).alias("goals"), acts.alias("acts"), F.when(joins | makes, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"),
                )

            return S.let(S.group_name(g["given"], F.coalesce(g["intro"], F.lit("")), g["heading"], g["said"][0]["text"], g["told"], state["names"], critical_kind), after)

        return S.let(F.when(around > 0, around).otherwise(prepared), settle)

    return F.aggregate(groups, start, deal, lambda s: s["out"])


def completed_plans(sentences: DataFrame, units: DataFrame, chosen: DataFrame, actions: DataFrame, steps: DataFrame, key: str, most: int = MOST, verbs: list[str] = VERBS) -> DataFrame:
    """``key, place, at, name, goal, text, ids, added``: the steps of every plan with what completes it, actions and steps numbered from 1.

    ``sentences``: key, no (int, 1, 2, ... in each article), section, text; ``units``: key,
    unit (1, 2, ...), heading, ids, instructing (arrays of no), heading_step; ``chosen``: key,
    unit, rank, name (null: chosen without one, such a unit isn't continued); ``actions``: key,
    pos, name, goal; ``steps``: key, pos, at, text, ids.  A group goes to the goal
    that already cites its section, else to the one with most actions, if that has
    under ``most``.  Steps that join an action come in the article's order among its own.
    Plans without actions get new ones under goal 0; articles without a plan stay so.
    """
    full = continued(sentences, units, chosen, actions, steps, key, verbs)
    told = unit_steps(sentences, units, key, verbs)
    groups = added_groups(sentences, units, chosen, full, told, key)
    section = sentences.select(key, "no", "section")
    cites = full.select(key, "pos", F.explode("ids").alias("no")).join(section, [key, "no"]).groupBy(key, "pos").agg(F.collect_set(F.struct("section", "no")).alias("cites"))
    said = full.groupBy(key, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ").alias("said"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    placed = actions.select(key, "pos", "name", "goal", number.alias("place"))
    text = F.concat_ws(" ", "name", "said")
    none = F.array().cast("array<struct<section:string,no:int>>")
    listed = placed.join(said, [key, "pos"], "left").join(cites, [key, "pos"], "left").select(key, "place", "name", F.col("goal").cast("int").alias("goal"), text.alias("said"), critical_kind(text).alias("kind"), F.coalesce("cites", none).alias("cites"))
    plan = listed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "name", "goal", "said", "kind", "cites"))).alias("actions"))
    seen = full.groupBy(key).agg(F.collect_set(step_key(F.col("text"))).alias("seen"))
    # goals: by section as first cited (before any continuation: that stays in its sections), else the largest
    first_cited = steps.join(placed.select(key, "pos", "place", "goal"), [key, "pos"]).select(key, "place", "at", "goal", F.posexplode("ids").alias("i", "no")).join(section, [key, "no"])
    by_section = first_cited.groupBy(key, F.col("section").alias("heading")).agg(F.min_by("goal", F.struct("place", "at", "i")).cast("int").alias("own_goal"))
    largest = actions.groupBy(key, "goal").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("goal", F.struct("n", (-F.col("goal")).alias("g"))).cast("int").alias("main"))
    ready = groups.join(by_section, [key, "heading"], "left").join(largest, key, "left")
    steps_text = F.array_join(F.transform("said", lambda s: s["text"]), " ")
    struct = F.struct(
        F.col("grp").cast("long").alias("grp"), "heading", "first", "last", "given", "intro", "said", F.transform("said", lambda s: step_key(s["text"])).alias("keys"), steps_text.alias("told"), critical_kind(steps_text).alias("kind"),
        critical_kind(S.heading_name(F.col("heading"))).alias("wanted"), F.coalesce("own_goal", "main", F.lit(0)).alias("goal"),
    )
    in_order = ready.where(F.size("said") > 0).groupBy(key).agg(F.array_sort(F.collect_list(struct), lambda a, b: F.when(a["grp"] < b["grp"], -1).otherwise(1)).alias("groups"))
    rows = plan.join(in_order, key, "full").join(seen, key, "left")
    no_actions = F.array().cast("array<struct<place:int,name:string,goal:int,said:string,kind:string,cites:array<struct<section:string,no:int>>>>")
    dealt = rows.where("groups IS NOT NULL").select(key, "groups", _dealt(F.coalesce("actions", no_actions), F.coalesce("seen", F.array().cast("array<string>")), F.col("groups"), most).alias("out"))
    put = dealt.select(key, "groups", F.explode("out").alias("o")).select(key, F.col("o.target").alias("place"), F.col("o.name").alias("new"), F.element_at(F.filter("groups", lambda g: g["grp"] == F.col("o.grp")), 1).alias("g"))
    more = put.select(key, "place", "new", F.col("g.grp").alias("grp"), F.col("g.goal").alias("to"), F.posexplode("g.said").alias("i", "s"))
    more = more.select(key, "place", "new", "to", (2 * _LATE + F.col("grp") * 1000 + F.col("i")).alias("at"), F.col("s.text").alias("text"), F.array("s.no").alias("ids"), F.lit(True).alias("added"))
    own = full.join(placed.select(key, "pos", "place"), [key, "pos"]).select(key, "place", F.lit(None).cast("string").alias("new"), F.lit(None).cast("int").alias("to"), F.col("at").cast("long").alias("at"), "text", "ids", (F.col("at") > _LATE).alias("added"))
    all_ = own.unionByName(more)
    # an action that others joined is sorted by the article; the others keep their order
    sizes = sentences.groupBy(key).agg(F.max("no").alias("size"))
    action = Window.partitionBy(key, "place")
    joined = (F.max((F.col("added") & (F.col("at") >= 2 * _LATE) & F.col("new").isNull()).cast("int")).over(action) == 1)
    where = F.coalesce(F.array_min(F.filter("ids", lambda i: i <= F.col("size"))), F.lit(_LATE))
    numbered = all_.join(sizes, key, "left").withColumn("where", F.when(joined, where).otherwise(0))
    names = placed.select(key, "place", "name", "goal")
    out = numbered.join(names, [key, "place"], "left").withColumn("no", F.row_number().over(action.orderBy("where", "at")))
    name = F.coalesce("name", F.max("new").over(action))
    goal = F.coalesce(F.col("goal").cast("int"), F.max("to").over(action))
    return out.select(key, "place", F.col("no").alias("at"), name.alias("name"), goal.alias("goal"), "text", "ids", "added")
