"""Procedure starts, tails and cuts: golden cases, and a plain version over generated articles."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import steps as S
from tessera.functions import text as T
from tessera.operators import expansion as E

SENTENCES = "k int, no int, section string, text string"


def finished(spark, sentences, actions):
    rows = spark.createDataFrame(sentences, SENTENCES).withColumn("instructs", S.is_instruction(F.col("text")))
    found = E.finished(spark.createDataFrame(actions, "k int, pos int, ids array<int>, name string, path string"), rows, "k")
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.k, r.pos, r.part)):
        out.setdefault((r.k, r.pos), []).append(r.ids)
    return out


def test_golden(spark):
    reset = ["Some facts.", "To perform a factory data reset:", "Go to Settings and tap Reset.", "Tap Delete all.", "Enter your account's password."]
    cache = ["Navigate to Settings and then tap Apps.", "Tap Storage.", "Tap Clear cache.", "Restart the phone."]
    peel = ["If your screen protector is peeling, remove it.", "If you wish to keep your screen protector on, you can try enabling Touch sensitivity.", "To do this, go to Settings, tap Display, and then tap the switch next to Touch sensitivity."]
    sentences = [(k, n, "s", t) for k, texts in ((1, reset), (2, cache), (3, peel)) for n, t in enumerate(texts, 1)]
    got = finished(spark, sentences, [
        (1, 1, [5], "Factory Data Reset", None), (1, 2, [5], "Battery", None), (2, 1, [1, 2], "Clear Gmail Cache", "Settings > Apps > Clear cache"), (2, 2, [1, 2], "Clear Gmail Cache", "Settings > Apps > Brightness"),
        (3, 1, [1, 2, 3], "Remove Damaged Screen Protector", "Settings > Display > Touch sensitivity"), (3, 2, [3], "Enable Touch sensitivity", "Settings > Display > Touch sensitivity"), (3, 3, [], "x", "y"), (3, 4, [1, 77], None, None),
    ])
    assert got == {(1, 1): [[3, 4, 5]], (1, 2): [[5]], (2, 1): [[1, 2, 3]], (2, 2): [[1, 2]], (3, 1): [[1], [2, 3]], (3, 2): [[3]], (3, 3): [[]], (3, 4): [[1]]}


POOL = ["To clear the cache:", "Tap Storage.", "Tap Clear cache.", "If it is hot, remove the case.", "Restart the phone.", "The phone is warm.", "Go to Settings and tap Storage.", "To do this, tap Clear cache.", "Then tap the storage.", "Hold the key again to confirm.", "When done, tap Storage."]
PATHS = [None, "Settings > Apps > Clear cache", "Settings > Storage", "Settings > the"]


def plain(texts, sections, ids, name, path, instructs, terms):
    """One action over lists."""
    n = len(texts)
    starts = lambda i: bool(re.search(S.FLAGS["starts_procedure"], re.sub(S.LEAD_IN, "", texts[i].strip())))
    leaf = terms(path.rsplit(">", 1)[-1].strip()) if path else set()
    if ids and not starts(min(ids)):
        first, run = min(ids), []
        stretch = [i for i in range(first - 1, max(-1, first - 9), -1)]
        while stretch and sections[stretch[0]] == sections[first] and stretch[0] not in ids and instructs[texts[stretch[0]]]:
            run.insert(0, stretch.pop(0))
        head = stretch[0] if stretch else None
        if run and head is not None and sections[head] == sections[first] and head not in ids and texts[head].rstrip().endswith(":") and terms(texts[head]) & terms(" ".join(x for x in (name, path) if x)):
            ids = run + ids
    if ids and leaf and not any(leaf <= terms(texts[i]) for i in ids):
        for k in (1, 2):
            ahead = list(range(ids[-1] + 1, min(n, ids[-1] + 1 + k)))
            if len(ahead) == k and all(sections[i] == sections[ids[-1]] and i not in ids and instructs[texts[i]] for i in ahead) and leaf <= terms(texts[ahead[-1]]):
                ids = ids + ahead
                break
    if leaf and len(ids) > 1:
        hits = [p for p, i in enumerate(ids) if leaf <= terms(texts[i])]
        cuts = [p for p in range(1, hits[0] + 1) if starts(ids[p]) or re.match(S.FLAGS["continuation"], texts[ids[p]])] if hits else []
        if cuts:
            cut = cuts[-1]
            while cut > 1 and starts(ids[cut - 1]):
                cut -= 1
            head = [texts[i] for i in ids[:cut]]
            if not re.search(S.ENTRY, " ".join(head)) and any(instructs[t] for t in head):
                return [ids[:cut], ids[cut:]]
    return [ids]


def test_generated_articles(spark):
    rng = random.Random(12)
    looked = spark.createDataFrame([(t,) for t in POOL], "t string").select("t", S.is_instruction(F.col("t")).alias("i")).collect()
    instructs = {r.t: r.i for r in looked}
    spoken = set(POOL) | {p.rsplit(">", 1)[-1].strip() for p in PATHS if p} | {" ".join(x for x in (m, p) if x) for m in (None, "Clear It", "Storage") for p in PATHS}
    bag = {r.t: set(r.x) for r in spark.createDataFrame([(t,) for t in spoken], "t string").select("t", T.content_terms(F.col("t")).alias("x")).collect()}
    sentences, actions, want = [], [], {}
    for k in range(120):
        texts = [rng.choice(POOL) for _ in range(rng.randint(2, 14))]
        sections = sorted(rng.choice(["a", "a", "b"]) for _ in texts)
        sentences += [(k, n + 1, s, t) for n, (s, t) in enumerate(zip(sections, texts))]
        for pos in range(3):
            ids = sorted(rng.sample(range(len(texts)), rng.randint(1, min(4, len(texts)))))
            name, path = rng.choice([None, "Clear It", "Storage"]), rng.choice(PATHS)
            actions.append((k, pos, [i + 1 for i in ids], name, path))
            want[k, pos] = [[i + 1 for i in part] for part in plain(texts, sections, ids, name, path, instructs, bag.__getitem__)]
    got = finished(spark, sentences, actions)
    assert got == want
    given = {(a[0], a[1]): [a[2]] for a in actions}
    assert sum(len(v) == 2 for v in want.values()) > 5 and sum(len(sum(v, [])) > len(given[k][0]) for k, v in want.items()) > 20
