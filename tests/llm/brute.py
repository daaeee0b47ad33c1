"""Plain versions of operators, for comparison on small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def shingle_list(text, k=5):
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)


def jaccard_components(rows):
    """{doc_id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {d: set(shingle_list(t)) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def leaks(docs, items):
    """{(doc_id, item_id)} where some item-sized window has bag similarity of 0.75 or more."""
    out = set()
    for i, t in items:
        bag, n = Counter(shingle_list(t)), len(words(t))
        if not bag:
            continue
        for d, text in docs:
            w = words(text)
            if n < 5:
                if any(tuple(w[k : k + n]) in bag for k in range(len(w) - n + 1)):
                    out.add((d, i))
                continue
            s = shingle_list(text) if len(w) >= 5 else []
            if not set(s) & set(bag):
                continue
            for k in range(len(s) - (n - 4) + 1):
                window = Counter(s[k : k + n - 4])
                common = sum((window & bag).values())
                if 100 * common >= 75 * (2 * (n - 4) - common):
                    out.add((d, i))
                    break
    return out


def leaks_of_short_texts(docs, items):
    """{(doc_id, item_id)} of texts shorter than the item, compared as a whole."""
    out = set()
    for i, t in items:
        for d, text in docs:
            if 5 <= len(words(text)) < len(words(t)):
                a, b = Counter(shingle_list(text)), Counter(shingle_list(t))
                if 100 * sum((a & b).values()) >= 75 * sum((a | b).values()):
                    out.add((d, i))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_entities(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


class PlainTree:
    """Context-tree weighting over the bytes of words with dictionaries: ``counts`` of words (bytes)."""

    def __init__(self, counts, depth=6):
        self.depth, self.nodes = depth, defaultdict(lambda: [0, 0])
        for word, n in counts.items():
            for ctx, byte in self.places(word):
                for k in range(8):
                    for d in range(depth + 1):
                        self.nodes[ctx[:d], (1 << k) | (byte >> (8 - k))][(byte >> (7 - k)) & 1] += n
        children = defaultdict(list)
        for ctx, node in self.nodes:
            if ctx:
                children[ctx[:-1], node].append((ctx, node))
        self.mixed, self.stay = {}, {}
        for key in sorted(self.nodes, key=lambda x: -len(x[0])):
            a, b = self.nodes[key]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) if a + b else 0.0
            if len(key[0]) == depth:
                self.mixed[key], self.stay[key] = own, 1.0
            else:
                below = sum(self.mixed[c] for c in children[key])
                top = max(own, below)
                self.mixed[key] = top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))
                self.stay[key] = math.exp(math.log(0.5) + own - self.mixed[key])

    def places(self, word):
        """Each byte and the closing blank, with the bytes before it, the last one first."""
        whole = b" " * self.depth + word + b" "
        return [(whole[i - self.depth : i][::-1], whole[i]) for i in range(self.depth, len(whole))]

    def log_byte(self, ctx, byte):
        total = 0.0
        for k in range(8):
            node, p, rest, last = (1 << k) | (byte >> (8 - k)), 0.0, 1.0, 0.5
            for d in range(self.depth + 1):
                a, b = self.nodes.get((ctx[:d], node), (0, 0))
                if not a + b:
                    break
                last = (b + 0.5) / (a + b + 1)
                p += rest * self.stay[ctx[:d], node] * last
                rest *= 1 - self.stay[ctx[:d], node]
            p += rest * last
            total += math.log10(p if (byte >> (7 - k)) & 1 else 1 - p)
        return total

    def log_word(self, word):
        return sum(self.log_byte(*x) for x in self.places(word))


def learned_patterns(sightings, seeds=5, least=0.6, letters=3):
    """{pattern: (kind, share)} from (item, base kind or "", patterns), by plain rounds until nothing changes."""
    graph, base = defaultdict(set), {}
    for item, kind, patterns in sightings:
        for p in patterns:
            if p.startswith("= ") or len(re.sub(r"[^a-zA-Z0-9]", "", p)) >= letters:
                graph[p].add(item)
                if kind:
                    base.setdefault((p, item), set()).add(kind)
    known = {}
    for (_, item), kinds in base.items():
        known[item] = min(max(kinds), known.get(item, max(kinds)))
    while True:
        confident = {}
        for p, items in graph.items():
            for kind, n in Counter(known[i] for i in items if i in known).items():
                if n >= seeds and n / len(items) >= least:
                    confident[p] = (kind, n / len(items), n)
        scores = defaultdict(Counter)
        for p, (kind, share, n) in confident.items():
            for i in graph[p] - known.keys():
                scores[i][kind] += share * math.log2(n)
        if not scores:
            return {p: (kind, share) for p, (kind, share, _) in confident.items()}
        for i, of in scores.items():
            known[i] = max((score, kind) for kind, score in of.items())[1]
