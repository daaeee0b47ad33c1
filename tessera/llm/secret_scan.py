"""Secrets by grammar inference on labelled credentials (operator 11).

Base patterns find credentials whose place or prefix gives them away; these are
the labelled examples of their kind.  From a bounded sample of each kind a prefix
tree is made, and states whose continuations do not differ statistically (Hoeffding's
bound on every frequency, down the whole subtree) are merged, which turns the tree
into a probabilistic automaton of the kind's format.  One more automaton is inferred
from strings that nothing labels.  Every other candidate string of every text is then
scored by all automata: it is a secret if one kind explains it about as well as the
kind's own examples, and far better than the automaton of ordinary strings does.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import slices
from tessera.llm.storage import Stored, materialise

KINDS = ["assign", "access", "hex"]
ORDINARY = ""  # the kind of strings that nothing labels
SAMPLE = 2_000  # distinct examples of a kind that its automaton is fitted to
LONGEST = 256  # characters of such an example; all lengths are scored
LEAST_EXAMPLES = 20  # a kind with fewer distinct examples has no automaton
ALPHA = 0.05  # of the test for different states
LEAST_CANDIDATE = 12  # characters: no base pattern takes a shorter credential
LEAST_ODDS = 16.0  # bits by which a kind must explain a candidate better than ordinary strings do
SYMBOLS = 67  # characters of candidates, and the end
CACHED = 1 << 16  # scores of short strings that a task remembers

# The base patterns.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Base secrets as (kind, start, end, credential) in code points, by start and then kind."""
    out = [("assign", m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_CANDIDATE]
    out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)] + [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, spans: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """Runs of credential characters outside the base spans (by start), cut at these."""
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][2] <= at:
            k += 1
        j = k
        while j < len(spans) and spans[j][1] < end:
            if spans[j][1] - at >= LEAST_CANDIDATE:
                out.append((at, spans[j][1]))
            at = max(at, spans[j][2])
            j += 1
        if end - at >= LEAST_CANDIDATE:
            out.append((at, end))
    return out


class State:
    """A state of a prefix tree or automaton: how many strings reach it and end in it, and where each symbol leads."""

    __slots__ = ("count", "ends", "next", "seen")

    def __init__(self):
        self.count, self.ends, self.next, self.seen = 0, 0, {}, {}


def prefix_tree(strings: list[str]) -> State:
    root = State()
    for s in strings:
        at = root
        at.count += 1
        for c in s:
            at.seen[c] = at.seen.get(c, 0) + 1
            at = at.next.setdefault(c, State())
            at.count += 1
        at.ends += 1
    return root


def _differ(f: int, n: int, g: int, m: int, alpha: float) -> bool:
    """Whether two frequencies are further apart than chance allows (Hoeffding)."""
    return abs(f / n - g / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def compatible(a: State, b: State, alpha: float) -> bool:
    """Whether ends and symbols of two states, and of all that follows in both, agree."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if _differ(x.ends, x.count, y.ends, y.count, alpha):
            return False
        for c in x.seen.keys() | y.seen.keys():
            if _differ(x.seen.get(c, 0), x.count, y.seen.get(c, 0), y.count, alpha):
                return False
        todo += [(x.next[c], y.next[c]) for c in x.next.keys() & y.next.keys() if x.next[c] is not y.next[c]]
    return True


def _fold(into: State, tree: State) -> None:
    """Add a tree's counts to an automaton, so that it stays deterministic."""
    todo = [(into, tree)]
    while todo:
        x, y = todo.pop()
        x.count += y.count
        x.ends += y.ends
        for c, n in y.seen.items():
            x.seen[c] = x.seen.get(c, 0) + n
            if c in x.next:
                todo.append((x.next[c], y.next[c]))
            else:
                x.next[c] = y.next[c]


def infer(strings: list[str], alpha: float = ALPHA) -> list[State]:
    """A probabilistic automaton of the strings' format, its states by discovery.

    States are settled one by one; the most frequent unsettled successor is either
    merged into the first settled state that it is compatible with, or settled itself.
    """
    root = prefix_tree(strings)
    settled = [root]
    ids = {id(root)}
    while True:
        open_ = [(-child.count, k, c) for k, state in enumerate(settled) for c, child in state.next.items() if id(child) not in ids]
        if not open_:
            return settled
        _, k, c = min(open_)
        child = settled[k].next[c]
        for state in settled:
            if compatible(state, child, alpha):
                settled[k].next[c] = state
                _fold(state, child)
                break
        else:
            settled.append(child)
            ids.add(id(child))


class Automaton(NamedTuple):
    """Transitions ``(state, symbol) -> (state, bits)``, bits of an end by state, and of a symbol that no example has there."""

    steps: dict[tuple[int, str], tuple[int, float]]
    ends: list[float]
    unseen: list[float]
    limit: float


def bits(automaton: Automaton, value: str) -> float:
    """Code length of a value: minus the binary logarithm of its likelihood.

    A symbol that no example has in a state leaves the format: all that follows
    is as likely as any other symbol.
    """
    total, state, steps = 0.0, 0, automaton.steps
    for k, c in enumerate(value):
        step = steps.get((state, c))
        if step is None:
            return total + automaton.unseen[state] + (len(value) - k) * math.log2(SYMBOLS)
        state = step[0]
        total += step[1]
    return total + automaton.ends[state]


def _table(states: list[State]) -> tuple[list[tuple[int, str, int, float]], list[float], list[float]]:
    """Steps, ends and unseen bits of an automaton, half a count added to every outcome."""
    number = {id(s): k for k, s in enumerate(states)}
    cost = lambda n, s: -math.log2((n + 0.5) / (s.count + 0.5 * SYMBOLS))
    steps = [(k, c, number[id(s.next[c])], cost(n, s)) for k, s in enumerate(states) for c, n in s.seen.items()]
    return steps, [cost(s.ends, s) for s in states], [cost(0, s) for s in states]


def fit_kind(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of a kind, from four of five examples; the least likely of the others sets its limit of bits a letter."""
    kept = [v for k, v in enumerate(values) if k % 5]
    steps, ends, unseen = _table(infer(kept, alpha))
    automaton = Automaton({(k, c): (to, b) for k, c, to, b in steps}, ends, unseen, math.inf)
    return automaton._replace(limit=max(bits(automaton, v) / (len(v) + 1) for v in values[::5]))


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """``doc_id, base, seen``: base secrets and other candidates of every text, without the texts."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            base, seen = [], []
            for text in part.column("text").to_pylist():
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end", "value"), s)) for s in spans])
                seen.append([{"start": s, "end": e, "value": text[s:e]} for s, e in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base, _BASE), pa.array(seen, _SEEN)], ["doc_id", "base", "seen"])

    kind = "doc_id long, base array<struct<kind:string,start:long,end:long,value:string>>, seen array<struct<start:long,end:long,value:string>>"
    return materialise(only.mapInArrow(run, kind), "secret-scan")


def learn(scanned: DataFrame, sample: int = SAMPLE, alpha: float = ALPHA) -> dict[str, Automaton]:
    """Automata by kind, each fitted in a task to at most ``sample`` distinct examples with the least hashes."""
    labelled = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    others = scanned.select(F.explode("seen").alias("s")).select(F.lit(ORDINARY).alias("kind"), "s.value")
    values = materialise(labelled.unionAll(others).where(F.length("value") <= LONGEST).distinct(), "secret-values")
    by_kind = [values.df.where(F.col("kind") == k).withColumn("at", F.xxhash64("value")).orderBy("at", "value").limit(sample) for k in (*KINDS, ORDINARY)]
    examples = by_kind[0]
    for more in by_kind[1:]:
        examples = examples.unionAll(more)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        found = rows.sort_values(["at", "value"])
        kind, given = found["kind"].iloc[0], found["value"].tolist()
        if len(given) < LEAST_EXAMPLES:
            return pd.DataFrame([], columns=["kind", "steps", "ends", "unseen", "limit"])
        a = fit_kind(given, alpha)
        steps = [{"at": k, "symbol": c, "to": to, "bits": b} for (k, c), (to, b) in a.steps.items()]
        return pd.DataFrame([{"kind": kind, "steps": steps, "ends": a.ends, "unseen": a.unseen, "limit": a.limit}])

    shape = "kind string, steps array<struct<at:int,symbol:string,to:int,bits:double>>, ends array<double>, unseen array<double>, limit double"
    rows = examples.groupBy("kind").applyInPandas(fit, shape).collect()  # four automata of bounded samples
    values.drop()
    return {r["kind"]: Automaton({(s["at"], s["symbol"]): (s["to"], s["bits"]) for s in r["steps"]}, r["ends"], r["unseen"], r["limit"]) for r in rows}


def judged(automata: dict[str, Automaton], value: str) -> str:
    """The kind whose format a candidate has; empty if none."""
    costs = {k: bits(a, value) for k, a in automata.items()}
    # without an automaton of ordinary strings every symbol is as likely as any other
    plain = costs.pop(ORDINARY, (len(value) + 1) * math.log2(SYMBOLS))
    fits = [(cost, k) for k, cost in costs.items() if cost / (len(value) + 1) <= automata[k].limit and plain - cost >= LEAST_ODDS]
    return min(fits)[1] if fits else ""


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, spans``: secrets of every text as (start, rank, end, kind, source), by start and then kind.

    Base secrets come from their patterns (``source`` base); other candidates from the
    inferred formats (``source`` learned), outside of all base spans.  Null and
    empty texts have none.  Ids are passed on as they are; a repeated row is a row of
    its own; other columns are left out; an empty table gives an empty result; without
    labelled examples nothing is learned.  Offsets count code points.  Texts and
    candidates of any length are taken whole; the sample of ``sample`` examples of up
    to ``LONGEST`` characters is for fitting alone.
    """
    scanned = scan(docs, id_col, text_col)
    automata = docs.sparkSession.sparkContext.broadcast(learn(scanned.df, sample, alpha))
    out = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("source", pa.string())]))

    def run(batches):
        known, memory = automata.value, {}

        def kind_of(value):
            if len(value) > LONGEST:
                return judged(known, value)
            if value not in memory:
                if len(memory) >= CACHED:
                    memory.clear()
                memory[value] = judged(known, value)
            return memory[value]

        span = lambda s, kind, source: {"start": s["start"], "rank": KINDS.index(kind), "end": s["end"], "kind": kind, "source": source}
        for batch in batches:
            spans = []
            for base, seen in zip(batch.column("base").to_pylist(), batch.column("seen").to_pylist()):
                found = [span(s, s["kind"], "base") for s in base]
                found += [span(s, kind, "learned") for s in seen if (kind := kind_of(s["value"]))]
                spans.append(sorted(found, key=lambda s: (s["start"], s["rank"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, out)], ["doc_id", "spans"])

    return scanned.df.mapInArrow(run, "doc_id long, spans array<struct<start:long,rank:int,end:long,kind:string,source:string>>")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned`` from :func:`find`."""
    base = F.filter("spans", lambda s: s["source"] == "base")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_learned"))
