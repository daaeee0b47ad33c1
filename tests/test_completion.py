"""Paragraph completion against a plain version: golden cases, generated plans, and all conversations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.operators import completion as C
from tessera.operators.plans import CRITICAL
from tessera.queries import QUERIES

SENTENCES = "a long, no int, section string, text string"
UNITS = "a long, unit int, heading string, ids array<int>, instructing array<int>, heading_step string"
CHOSEN = "a long, unit int, rank int, name string"
ACTIONS = "a long, pos int, name string, goal int"
STEPS = "a long, pos int, at int, text string, ids array<int>"


def completed(spark, sentences, units, chosen, actions, steps, most=12):
    tables = [spark.createDataFrame(rows, kind) for rows, kind in ((sentences, SENTENCES), (units, UNITS), (chosen, CHOSEN), (actions, ACTIONS), (steps, STEPS))]
    plan = {}
    for r in sorted(C.completed_plans(*tables, "a", most).collect(), key=lambda r: (r.a, r.place, r.at)):
        plan.setdefault((r.a, r.place), (r.name, r.goal, []))[2].append((r.text, r.ids[0] if r.ids else None))
    return plan


def article(section, *texts):
    return [(1, n, section, t) for n, t in enumerate(texts, 1)]


def test_continued_up_to_a_purpose_and_repeats_left_out(spark):
    section = "Some things to check first"
    sentences = article(section, "Connect a USB mouse to your phone.", "You can also back up your data by connecting it to a monitor.", "To clean your device, gently wipe the screen.", "Visit a Samsung service center.", "Charge the phone for an hour.")
    units = [(1, 1, section, [1, 2, 3], [1, 2, 3], None), (1, 2, section, [4], [4], None), (1, 3, section, [5], [5], None)]
    chosen = [(1, 1, 0, "Use A USB Mouse"), (1, 2, 1, "Visit Service Center"), (1, 3, 2, "Charge The Phone")]
    plan = completed(spark, sentences, units, chosen, [(1, 1, "Use A USB Mouse", 0), (1, 2, "Visit Service", 0)], [(1, 1, 1, "Connect a USB mouse to your phone.", [1]), (1, 2, 1, "Visit a Samsung service center.", [9])])
    assert plan[1, 1][2] == [("Connect a USB mouse to your phone.", 1), ("Back up your data by connecting it to a monitor.", 2)]
    assert plan[1, 3] == ("Charge The Phone", 0, [("Charge the phone for an hour.", 5)]) and len(plan) == 3


def test_a_preparation_opens_what_it_prepares(spark):
    heading = "6. Perform a Factory Data Reset"
    sentences = article(heading, "It is important to back up your data before proceeding with this step.", "Navigate to Settings, search for and select Factory data reset.")
    plan = completed(spark, sentences, [(1, 1, heading, [1], [1], None), (1, 2, heading, [2], [2], None)], [(1, 1, 0, None)], [(1, 1, "Perform Factory Data Reset", 0)], [(1, 1, 1, "Navigate to Settings.", [2])])
    assert [i for _, i in plan[1, 1][2]] == [1, 2] and len(plan) == 1


def test_steps_between_join_the_action_around_them(spark):
    heading = "8. Factory Data Reset"
    sentences = article(heading, "Navigate to and open Settings.", "Tap General management.", "Tap Reset.", "Tap Delete all.")
    units = [(1, n, heading, [n], [n], None) for n in range(1, 5)]
    plan = completed(spark, sentences, units, [(1, n, n, None) for n in (1, 2, 3, 4)], [(1, 5, "Reset Phone", 0)], [(1, 5, 1, "Navigate to and open Settings.", [1]), (1, 5, 2, "Tap Delete all.", [4])])
    assert [i for _, i in plan[1, 1][2]] == [1, 2, 3, 4] and len(plan) == 1


def test_goals_names_and_the_limit(spark):
    sentences = article("3. Charge", "Charge the phone for an hour.") + [(1, 2, "4. Cool", "Here's how to cool the phone:"), (1, 3, "4. Cool", "Remove the case."), (1, 4, "5. Clean The Port", "Wipe the port."), (1, 5, "6. Update Software", "It matters.")]
    units = [(1, 1, "3. Charge", [1], [1], None), (1, 2, "4. Cool", [3], [3], None), (1, 3, "5. Clean The Port", [4], [4], None), (1, 4, "6. Update Software", [5], [5], "Update software")]
    chosen = [(1, u, u, None) for u in (1, 2, 3, 4)]
    actions, steps = [(1, 1, "Turn It Off", 2), (1, 2, "Turn It On", 1), (1, 3, "Sleep", 1)], [(1, 1, 1, "Turn it off.", [2])]
    plan = completed(spark, sentences, units, chosen, actions, steps)
    assert {k[1]: (v[0], v[1]) for k, v in plan.items()} == {1: ("Turn It Off", 2), 4: ("Charge The Phone", 1), 5: ("Cool The Phone", 2), 6: ("Clean The Port", 1), 7: ("Update Software", 1)}
    assert plan[1, 7][2] == [("Update software.", 5)]
    tight = completed(spark, sentences, units, chosen, actions, steps, most=3)
    assert sorted(v[0] for v in tight.values()) == ["Charge The Phone", "Cool The Phone", "Turn It Off"]


# ---- a plain version: lists and loops over one plan --------------------------------------------------
def kind(text):
    found = [k for k, p in CRITICAL if re.search(p, text)]
    return found[-1] if found else None


def norm(text):
    return " ".join(re.findall(r"\w+", text.lower()))


class Plain:
    """One plan; ``told`` gives the steps of each sentence, ``name`` a group's name from what is known then."""

    def __init__(self, sentences, units, chosen, actions, steps, told, most):
        self.text, self.section = {s[1]: s[3] for s in sentences}, {s[1]: s[2] for s in sentences}
        self.units, self.told, self.most = {u[1]: u for u in units}, told, most
        self.chosen = sorted({c[1] for c in chosen})
        self.acts = [{"name": a[2], "goal": a[3], "steps": [(s[3], list(s[4])) for s in sorted(steps, key=lambda s: s[2]) if s[1] == a[1]]} for a in sorted(actions, key=lambda a: a[1])]
        self.first_goal = {}
        for a in self.acts:
            for _, ids in a["steps"]:
                for i in ids:
                    self.first_goal.setdefault(self.section.get(i), a["goal"])
        goals = [a["goal"] for a in self.acts]
        self.main = min(goals, key=lambda g: (-goals.count(g), g), default=0)
        self.extend([c[1] for c in sorted(chosen, key=lambda c: c[2]) if c[3]])
        self.deal()

    def said(self, a):
        return " ".join([a["name"] or "", *(t for t, _ in a["steps"])])

    def cited(self):
        return {i for a in self.acts for _, ids in a["steps"] for i in ids}

    def extend(self, named):
        cited, kinds = self.cited(), [kind(self.said(a)) for a in self.acts]
        for u in named:
            ids = self.units[u][4]
            have = [i in cited for i in ids]
            n = sum(have)
            if self.units[u][5] or not n or n == len(ids) or not all(have[:n]):
                continue
            at = next(k for k, a in enumerate(self.acts) if any(ids[n - 1] in x for _, x in a["steps"]))
            for i in ids[n:]:
                t = self.text[i]
                stops = [re.search(S.FLAGS["escalation"], re.sub(S.LEAD_IN, "", t)), re.search(S.FLAGS["leaves_safe_mode"], t), kind(t) not in (None, kinds[at]), re.search(S.FLAGS["purpose"], t), re.search(S.LABEL, t)]
                if any(stops):
                    break
                self.acts[at]["steps"] += [(x, [i]) for x in self.told[t]]

    def unit_steps(self, u):
        unit = self.units[u]
        return [(f"{unit[5]}.", unit[4][0])] if unit[5] else [(x, i) for i in unit[4] for x in self.told[self.text[i]]]

    def deal(self):
        seen, cited = {norm(t) for a in self.acts for t, _ in a["steps"]}, self.cited()
        left = [u for u in self.chosen if u in self.units and not cited & set(self.units[u][3])]
        left = [u for u in left if not self.unit_steps(u) or any(norm(t) not in seen for t, _ in self.unit_steps(u))]
        groups = []
        for u in left:
            if groups and groups[-1][-1] == u - 1 and self.units[u][2] == self.units[u - 1][2]:
                groups[-1].append(u)
            else:
                groups.append([u])
        for g in groups:
            steps = [s for u in g for s in self.unit_steps(u)]
            if not any(norm(t) not in seen for t, _ in steps):
                continue
            heading, ids = self.units[g[0]][2], [i for u in g for i in self.units[u][3]]
            own = [[i for _, x in a["steps"] for i in x if self.section.get(i) == heading] for a in self.acts]
            to = next((k for k, x in enumerate(own) if x and min(x) < min(ids) and max(x) > max(ids)), None)
            wants, does = kind(re.sub(S.HEADING_NUMBER, "", heading)), kind(" ".join(t for t, _ in steps))
            if to is None and wants and wants != does:
                to = next((k for k, x in enumerate(own) if x and kind(self.said(self.acts[k])) == wants), None)
            if to is not None:
                grown = self.acts[to]["steps"] + [(t, [i]) for t, i in steps]
                self.acts[to]["steps"] = sorted(grown, key=lambda s: min([i for i in s[1] if i in self.text], default=10**6))
            else:
                goal = self.first_goal.get(heading, self.main)
                if sum(a["goal"] == goal for a in self.acts) >= self.most:
                    continue
                self.acts.append({"name": None, "goal": goal, "steps": [(t, [i]) for t, i in steps], "new": True})
            seen |= {norm(t) for t, _ in steps}


POOL = [
    "Tap Reset.", "Restart the phone.", "Open the case.", "To clean it, wipe the screen.", "Check the cable and then charge the phone.", "The phone is warm.", "If the problem persists, perform a factory data reset.", "Press the key.",
    "Note: hold the key.", "Restart the tablet in safe mode.", "Exit safe mode.", "Update the software.", "Wait for an hour.", "Hold the key, then tap Reset.",
]
HEADS = ["1. Restart the device", "2. Factory Data Reset", "Notes", "3. Enter Safe Mode", "4. Clean the port"]


def generated(rng, a):
    sentences, units, no = [], [], 0
    for heading in rng.sample(HEADS, rng.randint(1, 4)):
        for _ in range(rng.randint(1, 3)):
            texts = [rng.choice(POOL) for _ in range(rng.randint(1, 4))]
            ids = list(range(no + 1, no + 1 + len(texts)))
            no += len(texts)
            sentences += [(a, i, heading, t) for i, t in zip(ids, texts)]
            does = [i for i, t in zip(ids, texts) if t != "The phone is warm."]
            if does:
                units.append((a, len(units) + 1, heading, ids, does, "Clean the port" if heading == "4. Clean the port" and rng.random() < 0.5 else None))
    actions = [(a, p, rng.choice(["Do It Now", "Restart Phone", "Perform Factory Data Reset", None]), rng.randint(0, 2)) for p in range(rng.randint(0, 3))]
    steps = [(a, p, n, rng.choice(POOL), rng.sample(range(1, no + 2), rng.randint(1, 2))) for _, p, _, _ in actions for n in range(rng.randint(0, 3))]
    chosen = [(a, u[1], k, rng.choice([None, "Some Name"])) for k, u in enumerate(rng.sample(units, rng.randint(0, len(units))))]
    return sentences, units, chosen, actions, steps


def shape(plan):
    return [(goal, [(t, i) for t, i in steps]) for _, goal, steps in plan]


@pytest.mark.parametrize("most", [12, 2])
def test_generated_plans_are_the_plain_ones(spark, most):
    rng = random.Random(most)
    made = {a: generated(rng, a) for a in range(150)}
    told = {r.t: r.s for r in spark.createDataFrame([(t,) for t in POOL], "t string").select("t", S.steps(F.col("t")).alias("s")).collect()}
    got = completed(spark, *[[row for m in made.values() for row in m[k]] for k in range(5)], most)
    some = 0
    for a, parts in made.items():
        plan = Plain(*parts, told, most)
        want = [(x["goal"], [(t, i[0] if i else None) for t, i in x["steps"]]) for x in plan.acts if x["steps"]]
        mine = [(v[1], v[2]) for k, v in sorted(got.items()) if k[0] == a]
        assert mine == want, (a, parts)
        some += any(x.get("new") for x in plan.acts)
    assert some > 30


def test_conversations_are_completed_like_the_plain_version(spark):
    from tessera.queries import extraction

    t = extraction.Tables(spark, "/root/testdata/sf0.001")
    sentences, units, chosen, actions, steps = [x.collect() for x in extraction.conversation_plans(t)]
    told = {r.text: r.s for r in spark.createDataFrame([(r.text,) for r in sentences], "text string").distinct().select("text", S.steps(F.col("text"), extraction._VERBS).alias("s")).collect()}
    got = {}
    for r in sorted(QUERIES["completed_paragraphs"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: (r.conv_id, r.place, r.at)):
        got.setdefault(r.conv_id, {}).setdefault(r.place, []).append((r.goal, r.text))
    for a in {r.conv_id for r in sentences}:
        mine = [[r for r in rows if r.conv_id == a] for rows in (sentences, units, chosen, actions, steps)]
        plan = Plain(*mine, told, 12)
        assert list(got.get(a, {}).values()) == [[(x["goal"], s) for s, _ in x["steps"]] for x in plan.acts if x["steps"]], a
    assert sum(r.added for r in QUERIES["completed_paragraphs"](spark, "/root/testdata/sf0.001").collect()) > 0
